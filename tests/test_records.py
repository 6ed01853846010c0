from __future__ import annotations

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.operators.records import parse_records, parse_texts, read_line, read_text

CASES = [
    ("0,a,ACGT,4", None),
    ('"0","a,b","ACGT","4"', None),
    ('0,"a""b",ACGT,4', None),
    ("007,a,acgtuRYSWKMBDHVN,0016", None),
    (f"{2**70},a,A,1", None),
    (None, "columns"),
    ("", "columns"),
    ("0,a,ACGT", "columns"),
    ("0,a,ACGT,4,", "columns"),
    ('0,"a,ACGT,4', "quoting"),
    ('0,"a"b,ACGT,4', "quoting"),
    ('0,a"b,ACGT,4', "quoting"),
    ('0, "a",ACGT,4', "quoting"),
    ('0,a,ACGT,"4', "quoting"),
    ("x,a,ACGT,4", "number"),
    ("-1,a,ACGT,4", "number"),
    ("0,a,ACGT,4\r", "number"),
    ("0,a,ACGT,", "number"),
    ("٣,a,ACGT,4", "number"),
    (" 0,a,ACGT,4", "number"),
    ("0,,ACGT,4", "id"),
    ("0,a b,ACGT,4", "id"),
    ("0,a​b,ACGT,4", "id"),
    ("0,a ,ACGT,4", "id"),
    ("0,aㅤ,ACGT,4", "id"),
    ("0,a\x07,ACGT,4", "id"),
    ('0,"a\nb",ACGT,4', "id"),
    ("0,é,ACGT,4", None),
    ("0,a,,0", "seq"),
    ("0,a,ACGX,4", "seq"),
    ("0,a,ACG T,5", "seq"),
    ("0,a,ACGT,5", "length"),
    (f"0,a,ACGT,{10**30}", "length"),
    (",,,", "number"),
]


@pytest.mark.parametrize(("raw", "reason"), CASES)
def test_reasons(raw, reason):
    row = read_line(raw)
    assert row[3] == reason and (row[2] is None) == (reason is not None)


def test_values():
    assert read_line('12,"a""b,c",acg,3')[:3] == (12, 'a"b,c', "acg")
    assert read_line(f"{2**63 - 1},a,A,1")[0] == 2**63 - 1 and read_line(f"{2**63},a,A,1")[:3] == (None, "a", "A")
    assert read_line('0,a,ACGT,"4')[3:5] == ("quoting", 9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n é', max_size=6), min_size=4, max_size=4))
def test_quoted_round_trip(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    from helixmill.operators.records import Reader

    assert Reader(out.getvalue()).record()[0] == fields


def test_text_goes_on_after_faults():
    text = '0,a,AC,2\n1,"b,AC,2\n2,c,AC,2\r\n\n3,d,AC,9\n4,"e\nf",AC,2\n5,"g,AC,2\nrest'
    rows = list(read_text(text))
    assert [(r[0], r[1], r[4]) for r in rows] == [(0, 0, None), (9, None, "quoting"), (19, 2, None), (30, None, "length"), (39, None, "id"), (52, None, "quoting"), (62, None, "columns")]
    assert [text[r[0]] for r in rows] == list("01234") + ["5", "r"]


def test_lines_between_a_broken_quote_and_the_next_valid_record():
    text = '1,"a,AC,2\n2,b,AC\n3,c,AC,9\nx,d,AC,2\n4,"e\nf",AC,2\n5,"g\n6,h,AC,2\n7,"i'
    rows = [(text[r[0]], r[1], r[4]) for r in read_text(text)]
    assert rows == [("1", None, "quoting"), ("2", None, "columns"), ("3", None, "length"), ("x", None, "number"), ("4", None, "id"), ("5", None, "quoting"), ("6", 6, None), ("7", None, "quoting")]
    assert [r[5] for r in read_text(text)] == [38, 10, 24, 26, 37, 50, None, 64]


def test_quote_that_takes_other_lines():
    """No valid record is lost to a quote that closes by chance in a later line."""
    text = '1,"a,AC,2\n2,b,AC,2\n3,c",AC,2\n4,d,AC,2'
    rows = [(text[r[0]], r[1], r[4]) for r in read_text(text)]
    assert rows == [("1", None, "quoting"), ("2", 2, None), ("3", None, "quoting"), ("4", 4, None)]
    text = '1,"a,AC\n2,b,AC,2\n3,c",x,AC,2\n4,d,AC,2'
    rows = [(text[r[0]], r[1], r[4]) for r in read_text(text)]
    assert rows == [("1", None, "quoting"), ("2", 2, None), ("3", None, "quoting"), ("4", 4, None)]


def test_frames(spark):
    rows = [(i, raw, "x") for i, (raw, _) in enumerate(CASES)] + [(0, "0,a,ACGT,4", "x")]
    df = spark.createDataFrame(rows, "line_no long, raw string, reason string")
    got = parse_records(df).collect()
    assert len(got) == len(rows) and {r["line_no"]: r["reason"] for r in got} == {i: reason for i, (_, reason) in enumerate(CASES)}
    assert parse_records(df.limit(0)).count() == 0
    texts = spark.createDataFrame([(1, "0,a,AC,2\n1,b,AC,3"), (2, None), (3, "")], "k long, t string")
    assert [(r["k"], r["record_at"], r["reason"]) for r in parse_texts(texts, "k", "t").collect()] == [(1, 0, None), (1, 9, "length")]
    long = "A" * 1_000_000
    wide = spark.createDataFrame([(1, f"1,a,{long},1000000")], "line_no long, raw string")
    assert parse_records(wide).first()["reason"] is None
