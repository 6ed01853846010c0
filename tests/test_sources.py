from __future__ import annotations

import gzip
import io

import pytest
from pyspark.sql import functions as F

from helixmill import cli
from helixmill.operators import minimisers
from helixmill.operators.counter import merge_counts
from helixmill.sources import fastx, tables
from helixmill.streaming.counts import running_counts, sequence_stream, windowed_stats

from .test_sequences import READS

FASTA = f">Record_1 first\n{READS[0]}\n>Record_2\n{READS[1][:40]}\n{READS[1][40:]}\n"
FASTQ = "".join(f"@Read_{i} x\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(READS, 1))


@pytest.fixture
def files(tmp_path):
    (tmp_path / "reads.fa").write_text(FASTA)
    (tmp_path / "reads.fq").write_text(FASTQ)
    with open(tmp_path / "reads.fq.gz", "wb") as out:  # two members
        half = FASTQ.index("@Read_2")
        out.write(gzip.compress(FASTQ[:half].encode()) + gzip.compress(FASTQ[half:].encode()))
    (tmp_path / "none.fa").write_text("")
    return tmp_path


def test_formats():
    names = {"a.fa": "fasta", "a.fna.gz": "fasta", "a.fasta.gz.gz": "fasta", "a.fq": "fastq", "a.fastq.gz": "fastq", "a.FA": None, "a.txt": None}
    assert {n: fastx.format_of(n) for n in names} == names
    assert (fastx.sniff(">x"), fastx.sniff("@x"), fastx.sniff("")) == ("fasta", "fastq", None)


def test_files(spark, files):
    for name, ids in (("reads.fa", ["Record_1", "Record_2"]), ("reads.fq", ["Read_1", "Read_2"]), ("reads.fq.gz", ["Read_1", "Read_2"])):
        rows = fastx.read_fastx(spark, str(files / name)).orderBy("n").collect()
        assert [(r["n"], r["id"], r["seq"]) for r in rows] == list(zip(range(2), ids, READS, strict=True))
    assert fastx.read_fastx(spark, str(files / "none.fa")).count() == 0
    assert fastx.read_fastx(spark, str(files)).count() == 6
    assert fastx.read_fastx(spark, str(files / "reads.*"), form="sniff").count() == 6
    assert fastx.read_fastx(spark, "file://" + str(files / "reads.fa")).count() == 2
    assert fastx.read_fastx(spark, "file:" + str(files)).count() == 6
    with pytest.raises(Exception, match="nowhere"):
        fastx.read_fastx(spark, str(files / "nowhere.fa")).count()
    every = fastx.read_fastx(spark, str(files)).collect()
    assert len({r["n"] for r in every}) == 6  # ordinals are unique over all files
    dense = fastx.dense_numbers(fastx.read_fastx(spark, str(files))).orderBy("n").collect()
    assert [r["n"] for r in dense] == list(range(6)) and [r["id"] for r in dense] == [r["id"] for r in sorted(every, key=lambda r: r["n"])]


@pytest.mark.parametrize("size", [1, 7, 50, 97, 1000])
def test_parts_of_a_file(tmp_path, size):
    """Every record comes out of exactly one part, wherever the parts are cut."""
    records = [(f"r{i}", "ACGT" * (i % 5)) for i in range(20)]
    fasta = "".join(f">{n} >x\n{s[:5]}\n{s[5:]}\n" for n, s in records)
    fastq = "".join(f"@{n} +\n{s}\n+@\n{'@' * len(s)}\n" for n, s in records)
    for form, text in (("fasta", fasta), ("fastq", fastq), ("fastq", fastq.rstrip("\n") if records[-1][1] else fastq)):
        path = tmp_path / f"x.{form}"
        path.write_text(text)
        reader = fastx.FastxReader({"path": str(path), "splitbytes": str(size)})
        got = [(r["n"], r["id"], r["seq"]) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert [x[1:] for x in got] == records
        assert [x[0] for x in got] == sorted({x[0] for x in got})


def test_wrapped_fastq_of_several_parts(tmp_path):
    path = tmp_path / "x.fq"
    path.write_text("@a\nACGT\nACGT\n+\nIIII\nIIII\n" * 9)
    whole = fastx.FastxReader({"path": str(path)})
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == 9
    parts = fastx.FastxReader({"path": str(path), "splitbytes": "40"})
    with pytest.raises(fastx.MalformedRecord):
        [b for p in parts.partitions() for b in parts.read(p)]


def test_sequences_of_two_files_stay_apart(spark, tmp_path):
    from helixmill.operators.coverage import coverage_histograms

    for name, seq in (("a.fa", READS[0]), ("b.fa", READS[1])):
        (tmp_path / name).write_text(f">x\n{seq}\n")
    rows = fastx.read_fastx(spark, str(tmp_path))
    assert coverage_histograms(rows, 7).count() == 2


def test_spilled_counts(spark, tmp_path):
    for part, chunk, text in ((0, 0, "1\t1\n2\t2\n"), (0, 1, "1\t3\n2\t4\n"), (1, 0, "11\t10\n22\t20\n"), (1, 1, "11\t12\n23\t24\n")):
        (tmp_path / f"temp_kmers.part_{part}_chunk_{chunk}").write_text(text)
    rows = tables.read_spilled(spark, str(tmp_path / "temp_kmers.part_*_chunk_*"))
    assert rows.where("part_no = 1 and chunk_no = 1").count() == 2
    want = {1: 4, 2: 6, 11: 22, 22: 20, 23: 24}
    assert {r["kmer"]: r["count"] for r in merge_counts(rows, 15, once=False).collect()} == want
    tables.merge_spilled(spark, str(tmp_path / "temp_kmers.part_*_chunk_*"), str(tmp_path / "kept"), 15)
    assert len(list(tmp_path.glob("temp_kmers.*"))) == 4
    tables.write_spilled(rows, str(tmp_path / "again"))
    assert {r["kmer"]: r["count"] for r in merge_counts(tables.read_spilled(spark, str(tmp_path / "again")), 15, once=False).collect()} == want
    tables.merge_spilled(spark, str(tmp_path / "temp_kmers.part_*_chunk_*"), str(tmp_path / "merged"), 15, acgt=True, delete=True)
    texts = {r["kmer"]: r["count"] for r in tables.read_counts(spark, str(tmp_path / "merged"), acgt=True).collect()}
    assert texts == {"A" * 14 + "C": 4, "A" * 14 + "G": 6, "A" * 13 + "GT": 22, "A" * 12 + "CCG": 20, "A" * 12 + "CCT": 24}
    assert not list(tmp_path.glob("temp_kmers.*")) and (tmp_path / "kept").exists()


def test_malformed(spark, tmp_path):
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nIIII\n@b\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        fastx.read_fastx(spark, str(tmp_path / "bad.fq")).collect()
    rows = fastx.read_fastx(spark, str(tmp_path / "bad.fq"), mode="PERMISSIVE").orderBy("n").collect()
    assert [(r["id"], r["error"] is None) for r in rows] == [("a", True), (None, False)]
    assert fastx.read_fastx(spark, str(tmp_path / "bad.fq"), mode="DROPMALFORMED").count() == 1


def test_streams_and_lists(spark):
    assert [r["id"] for r in fastx.read_stream(spark, io.StringIO(FASTQ)).orderBy("n").collect()] == ["Read_1", "Read_2"]
    assert fastx.read_stream(spark, io.StringIO("")).count() == 0
    assert fastx.from_list(spark, READS).count() == 2
    assert next(fastx.read_fasta([">x\n", "AÀC\n"]))[1] == "ANC"


def test_numbers():
    assert [tables.plain(x) for x in (1.0, 0.5, 1e-7, 0.0)] == ["1", "0.5", "0.0000001", "0"]
    assert (tables.six(0.0078125), tables.six(1 / 3)) == ("0.007812", "0.333333")


def test_counts_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([(1, 4), (2, 6)], "kmer long, count long")
    tables.write_counts(counts, str(tmp_path / "c"))
    assert {tuple(r) for r in tables.read_counts(spark, str(tmp_path / "c")).collect()} == {(1, 4), (2, 6)}
    tables.write_partial_counts(counts, str(tmp_path / "p"), 2)
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "p")).where("part_no = 1").count() == 1
    tables.delete_if_exists(str(tmp_path / "none"))


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a"b', READS[0]), (1, "b", "ACG")], "n long, id string, seq string")
    lists = minimisers.sequences_to_minimisers(df, 31, 7).join(df.select("n", "id"), "n")
    lines = [r["line"] for r in tables.span_lines(lists).orderBy("_order").collect()]
    assert lines[0].startswith('a"b\t') and lines[0].endswith("\t") and lines[1] == "b\t"
    whole = minimisers.minimisers_to_sequences(df, 0, 10, key="id")
    assert tables.member_lines(whole).first()["line"] == 'AAAACCCTTA\t[("a\\"b", 0, 72)]'
    rows = spark.createDataFrame([(1, [0.5, 1.0]), (0, [0.25, 0.0])], "n long, v array<double>")
    tables.write_lines(tables.vector_lines(rows, "v", False, "csv"), str(tmp_path / "v"), ["x", "y"], "csv")
    parts = sorted((tmp_path / "v").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "x,y\n0.25,0\n0.5,1\n"
    assert tables.sorted_lines(str(tmp_path / "v")) == ["0.25,0", "0.5,1", "x,y"]


def test_command_line(spark, files, capsys):
    run = lambda *a: cli.main([*map(str, a)])
    out = files / "out"
    assert run("comp", "oligo", "-i", files / "reads.fa", "-o", out, "-k", 4, "-H") == 0
    lines = out.read_text().splitlines()
    assert len(lines) == 3 and lines[0].startswith("AAAA AAAC") and len(lines[1].split()) == 136
    assert run("comp", "oligo", "-i", files / "reads.fq", "-o", out, "-c", "-r", "-p", "tsv") == 0
    assert sum(map(int, out.read_text().splitlines()[0].split("\t"))) == 70
    assert run("comp", "cgr", "-i", files / "reads.fa", "-o", out) == 0
    assert out.read_text().startswith("(0.75,0.75) ")
    assert run("comp", "cgr", "-i", files / "reads.fa", "-o", out, "-k", 4, "-c") == 0
    assert out.read_text().startswith("(0.5,0.5,")
    assert run("comp", "cgr", "-i", files / "reads.fa", "-o", out, "-c") == 2
    assert run("cov", "-i", files / "reads.fa", "-o", files / "cov", "-k", 7, "-s", 5, "-c", 5, "--counts") == 0
    assert (files / "cov/kmers.vectors").read_text() == "66 0 0 0 0\n66 0 0 0 0\n"
    assert run("min", "-i", files / "reads.fa", "-o", out) == 0
    assert out.read_text() == "Record_1\tAAAACCCTTA:0-72\t\nRecord_2\tAAAACGACGC:0-72\t\n"
    assert run("min", "-i", files / "reads.fa", "-o", out, "-p", "m2s") == 0
    assert sorted(out.read_text().splitlines())[0] == 'AAAACCCTTA\t[("Record_1", 0, 72)]'
    assert run("min", "-i", files / "reads.fa", "-o", out, "-w", 5, "-m", 7) == 2
    assert run("ctr", "-i", files / "reads.fa", "-o", files / "ctr", "-k", 15, "-a") == 0
    assert len((files / "ctr/kmers.counts").read_text().splitlines()) == 116
    for bad in (["ctr", "-i", "x", "-o", "y"], ["ctr", "-i", "x", "-o", "y", "-k", "32"], ["comp", "oligo", "-i", "x", "-o", "y", "-k", "8"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(i, "r", READS[i % 2]) for i in range(4)], "n long, id string, seq string").withColumn("read_at", F.lit("2023-01-01 00:00:00").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sequence_stream(spark, str(tmp_path / "in"), files=1)
    for name, df, mode in (("counts_now", running_counts(stream, 15), "complete"), ("stats_now", windowed_stats(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("counts_now").count() == 116 and spark.table("counts_now").agg(F.sum("count")).first()[0] == 232
    assert spark.table("stats_now").first()[1:] == (4, 288)
