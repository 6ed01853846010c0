"""Queries of the operators for training data, and their equivalents in SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clusters import Clusters
from .langid import document_languages, fit, language_segments, unnamed_languages
from .mixing import mix_sources
from .neardup import NearDuplicates
from .neighbours import nearest_neighbours, similar_pairs
from .splitting import split_oversized
from .tokens import encode_corpus


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "sequences"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(nearest_neighbours(table(spark, folder, "oligo_vectors"), floor=0.97))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates(table(spark, folder, "sequences")).pairs().select("n_a", "n_b")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates(table(spark, folder, "sequences")).groups()


def _clusters(spark: SparkSession, folder: str) -> Clusters:
    return Clusters(table(spark, folder, "oligo_vectors"), table(spark, folder, "coverage_vectors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).tight()


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).clusters()


def p4_components(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).groups()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Of each target: its documents, and whether the mix keeps within its repeats, and its share to a document.

    The tokens of a source are kept to its last document, so a share is off by at most the largest document.
    """
    mix, report = mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    used = mix.groupBy("source").agg(F.max("copies").alias("most"), F.max("n_tokens").alias("largest"))
    whole = report.agg(F.sum("tokens_used").alias("whole"), F.sum(F.when(F.col("tokens_available") > 0, F.col("target_share"))).alias("live"))
    both = report.join(used, "source", "left").crossJoin(F.broadcast(whole))
    off = F.abs(F.col("tokens_used") - F.col("whole") * F.col("target_share") / F.col("live"))
    largest = F.max("largest").over(Window.partitionBy())  # a row for each target
    return both.withColumn("any", largest).select("source", F.col("n_docs"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.col("n_docs").eqNullSafe(0) | (off <= F.col("any") * (1 + F.count("*").over(Window.partitionBy())))).alias("within_share"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return unnamed_languages(documents, fit(documents))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return document_languages(documents, fit(documents))


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return language_segments(documents, fit(documents))


def queries() -> dict:
    every = (p1_found, p2_found, p3_found, p3_groups, p4_found, p4_clusters, p4_components, p7_ids, p8_mix, p8_shares, p8_bounds, p9_found, p9_documents, p9_segments)
    return {f.__name__: f for f in every}


_SETS = """
with s as (select n, upper(replace(replace(seq, 'u', 't'), 'U', 'T')) as seq from sequences where seq is not null),
w as (select n, unnest(list_transform(range(1, length(seq) - 9), lambda i: substr(seq, i, 11))) as f from s),
k as (select distinct n, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) as f from w where regexp_full_match(f, '[ACGT]{11}')),
z as (select n, count(*) as c from k group by n),
p as (select a.n as n_a, b.n as n_b, count(*) as c from k a join k b on a.f = b.f and a.n < b.n group by 1, 2),
j as (select n_a, n_b from p join z x on x.n = n_a join z y on y.n = n_b where p.c >= 0.5 * (x.c + y.c - p.c))
"""

_UNITS = """
with u as (select n, list_transform(kvec, lambda x: x / sqrt(list_sum(list_transform(kvec, lambda y: y * y)))) as k
  from oligo_vectors where kvec is not null and list_sum(kvec) > 0)
"""


_ALIKE = _UNITS + """,
    c as (select n, bin_count as b from (select *, row_number() over (partition by n order by computed_at desc) as r from coverage_vectors
      where bin_count is not null and list_sum(bin_count) > 0) where r = 1),
    v as (select n, k, list_transform(b, lambda x: x / sqrt(list_sum(list_transform(b, lambda y: y * y)))) as b from u join c using (n)),
    e as (select x.n as a, y.n as m from v x join v y on round(list_dot_product(x.b, y.b), 9) >= 0.95 and round(list_dot_product(x.k, y.k), 9) >= 0.97)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            with recursive c as (select n, length(seq) as l, unnest(range(1, length(seq) + 1)) as i, unnest(string_split(seq, '')) as x
              from sequences where length(seq) > 1000),
            g as (select n, max(i) as e from (select n, i, i - row_number() over (partition by n order by i) as r from c where x not in ('A','C','G','T','U','a','c','g','t','u'))
              group by n, r having count(*) >= 10),
            t as (select n, cast(length(seq) as integer) as l, coalesce((select list(e) from g where g.n = s.n), []) as ends from sequences s where length(seq) > 1000),
            p as (
              select n, l, ends, 1 as piece_no, 0 as piece_start, cast(coalesce(list_max(list_filter(ends, lambda x: x > 50 and x <= 1000)), 1000) as integer) as piece_end from t
              union all
              select n, l, ends, piece_no + 1, piece_end - 50, case when l - (piece_end - 50) <= 1000 then l
                else cast(coalesce(list_max(list_filter(ends, lambda x: x > piece_end and x <= piece_end + 950)), piece_end + 950) as integer) end
              from p where piece_end < l)
            select n, piece_no, piece_start, piece_end from p""",
        "p2_found": _UNITS + """,
            s as (select a.n as a, b.n as b, round(list_dot_product(a.k, b.k), 9) as c from u a join u b on a.n <> b.n),
            r as (select a, b, c, row_number() over (partition by a order by c desc, b) as r from s)
            select distinct least(a, b) as n_a, greatest(a, b) as n_b from r where r <= 10 and c >= 0.97""",
        "p3_found": _SETS + "select n_a, n_b from j",
        "p3_groups": _SETS.replace("with s as", "with recursive s as", 1).rstrip() + """,
            e as (select n_a as a, n_b as b from j union all select n_b, n_a from j),
            reach as (select n as a, n as b from z union select reach.a, e.b from reach join e on e.a = reach.b),
            g as (select a as n, min(b) as group_n from reach group by a),
            c as (select n, min(n) over (partition by fs) as class_n from (select n, list(f order by f) as fs from k group by n)),
            l as (select a as n, count(*) as n_links from e group by a)
            select n, group_n, class_n, coalesce(n_links, 0) as n_links from g join c using (n) left join l using (n)""",
        "p4_components": _ALIKE.replace("with u as", "with recursive u as", 1).rstrip() + """,
            reach as (select n as a, n as b from v union select reach.a, e.m from reach join e on e.a = reach.b),
            g as (select a as n, min(b) as component_n, count(*) as component_size from reach group by a),
            d as (select a as n, count(*) as degree from e group by a),
            w as (select component_n, bool_and(degree = component_size) as is_whole from g join d using (n) group by component_n)
            select n, component_n, component_size, is_whole from g join w using (component_n)""",
        "p8_bounds": r"""
            with d as (select regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s-]+', '_', 'g') as source, doc_id from documents),
            t as (select distinct regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s-]+', '_', 'g') as source from mix_targets where source is not null)
            select t.source, count(doc_id) as n_docs, true as within_repeats, true as within_share from t left join d on d.source = t.source group by t.source""",
        "p4_found": _ALIKE.rstrip() + """,
            h as (select a, list(m order by m) as hood from e group by a),
            t as (select hood from h group by hood having count(*) >= 5 and count(*) = len(hood))
            select hood[1] as cluster_n, unnest(hood) as n from t""",
    }
