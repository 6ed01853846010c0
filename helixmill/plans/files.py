"""Queries of sources and sinks: tables written as the text forms and read back, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import cgr, counter, kmers, minimisers, oligo
from ..session import scratch
from ..sources import fastx, tables
from .general import table
from .sequences import _code, _dim, _oligo_sql, _reverse, _seqs, _spans_sql, _windows

#: Bytes of a task when files are read back: small, so that records are cut at task borders in the test tables too.
SPLIT = 1 << 16


def _read_back(spark: SparkSession, records: DataFrame, form: str, compression: str = "none") -> DataFrame:
    """Writes the column ``value`` as text files and reads them as sequences."""
    path = scratch(spark, form)
    records.select("value").write.option("compression", compression).text(path)
    found = fastx.read_fastx(spark, path, form, split=SPLIT)
    return found.select(F.col("id").cast("bigint").alias("n"), "seq")


def _bases() -> Column:
    return F.coalesce(codec.normalise(F.col("seq")), F.lit(""))


def scan_fasta(spark: SparkSession, folder: str) -> DataFrame:
    body = F.regexp_replace(_bases(), "(.{60})", "$1\n")
    return _read_back(spark, _seqs(spark, folder).select(F.concat(F.lit(">"), "n", F.lit(" of the table\n"), body).alias("value")), "fasta")


def scan_fastq(spark: SparkSession, folder: str) -> DataFrame:
    quality = F.repeat(F.lit("@"), F.length(_bases()))
    return _read_back(spark, _seqs(spark, folder).select(F.concat(F.lit("@"), "n", F.lit("\n"), _bases(), F.lit("\n+\n"), quality).alias("value")), "fastq")


def scan_gzip(spark: SparkSession, folder: str) -> DataFrame:
    return _read_back(spark, _seqs(spark, folder).select(F.concat(F.lit(">"), "n", F.lit("\n"), _bases()).alias("value")), "fasta", "gzip")


def scan_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Ordinals over many tasks are unique, and dense ones run from 0 in the same order."""
    path = scratch(spark, "fasta")
    _seqs(spark, folder).select(F.concat(F.lit(">"), "n", F.lit("\n"), _bases()).alias("value")).write.text(path)
    dense = fastx.dense_numbers(fastx.read_fastx(spark, path, "fasta", split=SPLIT))
    return dense.agg(F.count("*").alias("records"), F.countDistinct("n").alias("numbers"), F.min("n").alias("first"), F.max("n").alias("last"))


def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "seq_files").select("file_name", fastx.format_column(F.col("file_name")).alias("format"), F.col("file_name").endswith(".gz").alias("gzip"))
    return found


def first_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sequences").select("n", codec.first_token(F.concat(F.col("id"), F.lit(" described"))).alias("name"))


def lines_oligo_k3(spark: SparkSession, folder: str) -> DataFrame:
    return tables.vector_lines(oligo.oligo_vectors(_seqs(spark, folder), 3), "kvec").select(F.col("_order").alias("n"), "line")


def lines_oligo_k3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.vector_lines(oligo.oligo_vectors(_seqs(spark, folder), 3, norm=False), "kvec", False, "csv").select(F.col("_order").alias("n"), "line")


def lines_kmer_cgr_k3(spark: SparkSession, folder: str) -> DataFrame:
    """The square has its default size."""
    return tables.path_lines(cgr.kmer_cgr(_seqs(spark, folder), 3, norm=False), "points").select(F.col("_order").alias("n"), "line")


def lines_counts_k15(spark: SparkSession, folder: str) -> DataFrame:
    return tables.count_lines(counter.kmer_counts(_seqs(spark, folder), 15)).select("line")


def lines_s2m(spark: SparkSession, folder: str) -> DataFrame:
    lists = minimisers.sequences_to_minimisers(_seqs(spark, folder), 31, 7)
    return tables.span_lines(lists, name="n").select(F.col("_order").alias("n"), "line")


def lines_m2s(spark: SparkSession, folder: str) -> DataFrame:
    return tables.member_lines(minimisers.minimisers_to_sequences(_seqs(spark, folder), 31, 7), "n").select("line")


def sink_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written in order under a header, and read as one text: numbers of the lines, and the lines."""
    path = scratch(spark, "vectors")
    lines = tables.vector_lines(oligo.oligo_vectors(_seqs(spark, folder), 3, norm=False), "kvec", False, "tsv")
    tables.write_lines(lines, path, kmers.header(3), "tsv")
    parts = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    from pyspark.sql.window import Window

    sizes = parts.groupBy("file", "block").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    starts = sizes.select("file", "block", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return parts.join(starts, ["file", "block"]).select((F.col("at") - F.col("first") + F.col("start")).alias("line_no"), "line")


def sink_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "counts")
    tables.write_counts(counter.kmer_counts(_seqs(spark, folder), 15), path)
    return tables.read_counts(spark, path)


def sink_spilled(spark: SparkSession, folder: str) -> DataFrame:
    """Partial counts written, read and merged, every row counted as it stands."""
    path = scratch(spark, "spilled")
    tables.write_spilled(table(spark, folder, "kmer_counts").where("kmer is not null"), path)
    return counter.merge_counts(tables.read_spilled(spark, path), 11, once=False)


def count_merge_every_row(spark: SparkSession, folder: str) -> DataFrame:
    return counter.merge_counts(table(spark, folder, "kmer_counts"), 11, once=False)


def kmer_codes_reversed(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "kmer_counts").select("kmer").where("kmer is not null").distinct()
    return codes.select("kmer", codec.reverse_complement_code(F.col("kmer"), 11).alias("rev"), codec.canonical_code(F.col("kmer"), 11).alias("canonical"))


def corners(spark: SparkSession, folder: str) -> DataFrame:
    letters = table(spark, folder, "sequences").select(F.explode(F.split("seq", "")).alias("letter")).where("letter <> ''").distinct()
    return letters.select("letter", codec.corner(F.col("letter"), "x", 3.0).alias("x"), codec.corner(F.col("letter"), "y", 3.0).alias("y"))


def queries() -> dict:
    every = (
        scan_fasta, scan_fastq, scan_gzip, scan_numbers, file_formats, first_tokens, lines_oligo_k3, lines_oligo_k3_counts, lines_kmer_cgr_k3, lines_counts_k15,
        lines_s2m, lines_m2s, sink_ordered, sink_counts, sink_spilled, count_merge_every_row, kmer_codes_reversed, corners,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    scanned = "select n, coalesce(regexp_replace(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g'), '') as seq from sequences"
    counted = f"with {_windows(15)}, a as (select c, count(*) as count from k group by c)"
    joined = lambda value, sep, k: f"select n, string_agg({value}, {sep} order by pos) as line from ({_oligo_sql(k, 'coalesce(a.c, 0)')}) group by n"
    corner = {"x": "('G', 'T')", "y": "('C', 'G')"}
    fold = lambda axis: " + ".join([f"(case when substr(kmer, {i}, 1) in {corner[axis]} then 9.0::double else 0.0 end) / {2 ** (4 - i)}" for i in range(1, 4)] + ["9.0::double / 16"])
    short = lambda x: f"regexp_replace(cast({x} as varchar), '[.]0$', '')"
    text_of = "array_to_string(list_transform(range(1, 12), lambda i: substr('ACGT', cast((kmer // cast(pow(4, 11 - i) as bigint)) % 4 as integer) + 1, 1)), '')"
    every = "select kmer, coalesce(cast(sum(cnt) as bigint), 0) as count from kmer_counts where kmer is not null group by kmer"
    return {
        "scan_fasta": scanned,
        "scan_fastq": scanned,
        "scan_gzip": scanned,
        "scan_numbers": "select count(*) as records, count(*) as numbers, 0::bigint as first, count(*) - 1 as last from sequences",
        "file_formats": r"""select file_name, case when regexp_matches(file_name, '[.](fq|fastq)([.]gz)*$') then 'fastq'
            when regexp_matches(file_name, '[.](fasta|fa|fna)([.]gz)*$') then 'fasta' end as format, ends_with(file_name, '.gz') as gzip from seq_files""",
        "first_tokens": r"select n, regexp_extract(id || ' described', '^\S*') as name from sequences",
        "lines_oligo_k3": f"select n, string_agg(printf('%.6f', value), ' ' order by pos) as line from ({_oligo_sql(3, 'coalesce(a.c, 0) / greatest(1, coalesce(t.t, 0))')}) group by n",
        "lines_oligo_k3_counts": joined("cast(cast(value as bigint) as varchar)", "','", 3),
        "lines_kmer_cgr_k3": f"""select n, string_agg('(' || {short('x')} || ',' || {short('y')} || ',' || cast(f as varchar) || ')', ' ' order by pos) as line
            from (select n, pos, cast({fold('x')} as double) as x, cast({fold('y')} as double) as y, cast(value as bigint) as f from ({_oligo_sql(3, 'coalesce(a.c, 0)')})) group by n""",
        "lines_counts_k15": f"{counted} select {_code('c')} || chr(9) || count as line from a",
        "lines_s2m": _spans_sql(31, 7, """, t as (select n, string_agg(minimiser || ':' || span_start || '-' || span_end, chr(9) order by span_start) as spans from spans group by n)
            select s.n, cast(s.n as varchar) || coalesce(chr(9) || t.spans, '') || chr(9) as line from sequences s left join t using (n)"""),
        "lines_m2s": _spans_sql(31, 7, """select minimiser || chr(9) || '[' || string_agg('("' || n || '", ' || span_start || ', ' || span_end || ')', ', ' order by n, span_start) || ']' as line from spans group by minimiser"""),
        "sink_ordered": f"""with {_dim(3)}, v as ({joined("cast(cast(value as bigint) as varchar)", "chr(9)", 3)})
            select 0::bigint as line_no, string_agg(kmer, chr(9) order by pos) as line from d
            union all select row_number() over (order by n), line from v""",
        "sink_counts": f"{counted} select {_code('c')} as kmer, count from a",
        "sink_spilled": every,
        "count_merge_every_row": every,
        "kmer_codes_reversed": f"""with t as (select distinct kmer, {text_of} as acgt from kmer_counts where kmer is not null)
            select kmer, {_code(_reverse('acgt'))} as rev, least(kmer, {_code(_reverse('acgt'))}) as canonical from t""",
        "corners": """with l as (select distinct unnest(string_split(seq, '')) as letter from sequences where seq <> '')
            select letter, case when upper(letter) in ('G', 'T', 'U') then 3.0::double when upper(letter) in ('A', 'C') then 0.0::double end as x,
              case when upper(letter) in ('C', 'G') then 3.0::double when upper(letter) in ('A', 'T', 'U') then 0.0::double end as y from l where letter <> ''""",
    }
