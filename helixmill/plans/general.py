"""Queries of the general record operators, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import parse_records, parse_texts
from ..operators.skew import Measures, heavy_keys, per_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return parse_records(table(spark, folder, "raw_records")).where("reason is not null").select("line_no", "reason")


def p5_valid(spark: SparkSession, folder: str) -> DataFrame:
    return parse_records(table(spark, folder, "raw_records")).where("reason is null").select("line_no", "n", "id", "seq")


#: Lines that ``p5_texts`` joins to one text.
TEXT_LINES = 100


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons of failing lines, read from texts of many lines: after broken quotes the reader has to find its way back.

    Null and empty lines are no part of a text, nor are lines that hold a break of their own.
    """
    lines = table(spark, folder, "raw_records").where(r"raw <> '' and not raw rlike '[\\r\\n]'")
    texts = lines.groupBy(F.floor(F.col("line_no") / TEXT_LINES).alias("text_no")).agg(F.sort_array(F.collect_list(F.struct("line_no", "raw"))).alias("lines"))
    whole = texts.select("text_no", F.array_join("lines.raw", "\n").alias("text"))
    places = texts.select("text_no", F.posexplode("lines").alias("i", "line"), "lines")
    before = F.aggregate(F.slice("lines", 1, F.col("i")), F.lit(0), lambda total, x: total + F.length(x["raw"]) + 1)
    places = places.select("text_no", before.alias("record_at"), "line.line_no")
    found = parse_texts(whole, "text_no", "text").where("reason is not null")
    return found.join(places, ["text_no", "record_at"], "left").select("line_no", "reason")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [heavy_keys(table(spark, folder, t), k).select(F.lit(k).alias("field_name"), "key_value") for t, k in (("minimisers", "m_active"), ("sequences", "id"))]
    return parts[0].union(parts[1])


def p6_m_active(spark: SparkSession, folder: str) -> DataFrame:
    span = F.col("span_end") - F.col("span_start")
    what = Measures(sums={"span_total": span}, least={"first_start": F.col("span_start")}, most={"longest_span": span})
    return per_key(table(spark, folder, "minimisers"), "m_active", what).drop("n_chunks")


def p6_id(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("seq")
    what = Measures(sums={"letters": size}, least={"first_n": F.col("n")}, most={"longest": size})
    return per_key(table(spark, folder, "sequences"), "id", what).drop("n_chunks")


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_valid, p5_texts, p6_found, p6_m_active, p6_id)}


_RECORDS = r"""
with q as (
  select line_no, raw,
    coalesce(regexp_full_match(raw, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*'), false) as fits,
    list_transform(regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",]*)', 1),
      lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f
  from raw_records),
r as (
  select line_no, f, case
    when raw is null then 'columns'
    when not fits then 'quoting'
    when len(f) <> 4 then 'columns'
    when not regexp_full_match(f[1], '[0-9]+') or not regexp_full_match(f[4], '[0-9]+') then 'number'
    when f[2] = '' or regexp_matches(f[2], '[\s\p{Z}\p{Cc}\p{Cf}\x{85}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2065}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{FFF0}-\x{FFF8}\x{E0000}-\x{E0FFF}]') then 'id'
    when not regexp_full_match(f[3], '[ACGTURYSWKMBDHVNacgturyswkmbdhvn]+') then 'seq'
    when (case when ltrim(f[4], '0') = '' then '0' else ltrim(f[4], '0') end) <> cast(length(f[3]) as varchar) then 'length'
    end as reason
  from q)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _RECORDS + "select line_no, reason from r where reason is not null",
        "p5_valid": _RECORDS + "select line_no, try_cast(f[1] as bigint) as n, f[2] as id, f[3] as seq from r where reason is null",
        "p5_texts": _RECORDS.replace("  from q)", "  from q where raw <> '' and not regexp_matches(raw, '[\\r\\n]'))") + "select line_no, reason from r where reason is not null",
        "p6_found": """
            select 'm_active' as field_name, cast(m_active as varchar) as key_value from minimisers where m_active is not null
            group by m_active having count(*) > 0.02 * (select count(*) from minimisers)
            union all
            select 'id', id from sequences where id is not null group by id having count(*) > 0.02 * (select count(*) from sequences)""",
        "p6_m_active": """
            select m_active as key_value, count(*) as n_rows, cast(sum(span_end - span_start) as bigint) as span_total,
              min(span_start) as first_start, max(span_end - span_start) as longest_span
            from minimisers where m_active is not null group by m_active""",
        "p6_id": """
            select id as key_value, count(*) as n_rows, cast(sum(length(seq)) as bigint) as letters, min(n) as first_n,
              cast(max(length(seq)) as integer) as longest
            from sequences where id is not null group by id""",
    }
