"""Queries of the sequence operators over whole tables, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import cgr, counter, coverage, kmers, minimisers, oligo
from ..sources.tables import span_lines
from .general import table


def _seqs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sequences").select("n", "id", "seq")


def seq_stats(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.sequence_stats(_seqs(spark, folder))


def kmer_pairs_k3(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.kmer_pairs(_seqs(spark, folder), 3)


def kmer_windows_k4(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.kmer_windows(_seqs(spark, folder), 4)


def kmer_table_k6(spark: SparkSession, folder: str) -> DataFrame:
    codec.register(spark)
    _seqs(spark, folder).createOrReplaceTempView("helixmill_sequences")
    return spark.sql("select n, pos, kmer from helixmill_sequences, lateral kmer_table(seq, 6)")


def kmer_codec(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "kmer_counts").select("kmer").where("kmer is not null").distinct()
    text = codes.select("kmer", codec.decode(F.col("kmer"), 11).alias("acgt"))
    pair = codec.encode_pair(F.col("acgt"))
    return text.select("kmer", "acgt", pair["fwd"].alias("fwd"), pair["rev"].alias("rev"), codec.canonical(F.col("acgt")).alias("canonical"), codec.partition_of(F.col("kmer"), 4).alias("part_no"))


def kmer_codec_sql(spark: SparkSession, folder: str) -> DataFrame:
    codec.register(spark)
    table(spark, folder, "kmer_counts").createOrReplaceTempView("helixmill_kmer_counts")
    return spark.sql("select distinct kmer, kmer_decode(kmer, 11) as acgt, kmer_encode(kmer_revcomp(kmer_decode(kmer, 11))) as rev from helixmill_kmer_counts where kmer is not null")


def kmer_count_k5(spark: SparkSession, folder: str) -> DataFrame:
    return counter.kmer_counts(_seqs(spark, folder), 5)


def kmer_count_k15(spark: SparkSession, folder: str) -> DataFrame:
    return counter.kmer_counts(_seqs(spark, folder), 15)


def kmer_count_k31_acgt(spark: SparkSession, folder: str) -> DataFrame:
    return counter.kmer_counts(_seqs(spark, folder), 31, acgt=True)


def count_merge(spark: SparkSession, folder: str) -> DataFrame:
    return counter.merge_counts(table(spark, folder, "kmer_counts"), 11)


def count_merge_acgt(spark: SparkSession, folder: str) -> DataFrame:
    return counter.merge_counts(table(spark, folder, "kmer_counts"), 11, acgt=True)


def dim_k4(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.vector_positions(spark, 4)


def dim_k3_forward(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.vector_positions(spark, 3, False)


def _oligo(k: int, **how):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return oligo.long_form(oligo.oligo_vectors(_seqs(spark, folder), k, **how), k, how.get("canonical_only", True))

    return run


def coverage_hist_k15(spark: SparkSession, folder: str) -> DataFrame:
    return _bins(coverage.coverage_histograms(_seqs(spark, folder), 15, 16, 16, norm=False))


def coverage_hist_k7_norm(spark: SparkSession, folder: str) -> DataFrame:
    return _bins(coverage.coverage_histograms(_seqs(spark, folder), 7, 16, 16))


def coverage_hist_k15_alt(spark: SparkSession, folder: str) -> DataFrame:
    rows = _seqs(spark, folder)
    return _bins(coverage.coverage_histograms(rows, 15, 5, 8, norm=False, alt=rows.where("length(seq) > 1000")))


def coverage_hist_k11_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = counter.merge_counts(table(spark, folder, "kmer_counts"), 11)
    return _bins(coverage.coverage_histograms(_seqs(spark, folder), 11, 16, 16, norm=False, counts=counts))


def _bins(histograms: DataFrame) -> DataFrame:
    return histograms.select("n", F.posexplode("bin_count").alias("bin", "value"))


def minimisers_w31_m7(spark: SparkSession, folder: str) -> DataFrame:
    return minimisers.minimiser_spans(_seqs(spark, folder), 31, 7)


def minimisers_w31_m7_compat(spark: SparkSession, folder: str) -> DataFrame:
    return minimisers.minimiser_spans(_seqs(spark, folder), 31, 7, compat=True)


def minimisers_w20_m10_builtin(spark: SparkSession, folder: str) -> DataFrame:
    return minimisers.minimiser_spans_sql(_seqs(spark, folder), 20, 10)


def minimiser_per_read(spark: SparkSession, folder: str) -> DataFrame:
    return minimisers.minimiser_spans(_seqs(spark, folder), 0, 10)


def min_s2m(spark: SparkSession, folder: str) -> DataFrame:
    lists = minimisers.sequences_to_minimisers(_seqs(spark, folder), 31, 7)
    return span_lines(lists, name="n", trailing_tab=False).select(F.col("_order").alias("n"), "line")


def min_m2s(spark: SparkSession, folder: str) -> DataFrame:
    bins = minimisers.minimisers_to_sequences(_seqs(spark, folder), 31, 7)
    members = F.array_join(F.transform("members", lambda m: F.concat(m["n"], F.lit(":"), m["span_start"], F.lit("-"), m["span_end"])), " ")
    return bins.select("minimiser", F.size("members").alias("n_members"), members.alias("members"))


def kmer_minimiser_w15_m7(spark: SparkSession, folder: str) -> DataFrame:
    return minimisers.kmer_minimisers(_seqs(spark, folder), 15, 7)


def cgr_path(spark: SparkSession, folder: str) -> DataFrame:
    paths = cgr.cgr_paths(_seqs(spark, folder), mode="PERMISSIVE")
    points = paths.select("n", F.posexplode("path").alias("pos", "p"))
    return points.select("n", "pos", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


def kmer_cgr_k4(spark: SparkSession, folder: str) -> DataFrame:
    points = cgr.kmer_cgr(_seqs(spark, folder), 4, 16).select("n", F.posexplode("points").alias("pos", "p"))
    return points.select("n", "pos", "p.x", "p.y", "p.freq")


def queries() -> dict:
    plain = (
        seq_stats, kmer_pairs_k3, kmer_windows_k4, kmer_table_k6, kmer_codec, kmer_codec_sql, kmer_count_k5, kmer_count_k15, kmer_count_k31_acgt, count_merge,
        count_merge_acgt, dim_k4, dim_k3_forward, coverage_hist_k15, coverage_hist_k7_norm, coverage_hist_k15_alt, coverage_hist_k11_counts,
        minimisers_w31_m7, minimisers_w31_m7_compat, minimisers_w20_m10_builtin, minimiser_per_read, min_s2m, min_m2s, kmer_minimiser_w15_m7,
        cgr_path, kmer_cgr_k4,
    )
    return {f.__name__: f for f in plain} | {
        "oligo_k3_counts": _oligo(3, norm=False),
        "oligo_k4_norm": _oligo(4),
        "oligo_k3_forward": _oligo(3, canonical_only=False),
        "oligo_k3_forward_half": _oligo(3, canonical_only=False, denominator=2),
    }


_READS = "reads as (select n, regexp_replace(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g') as seq from sequences where seq is not null)"


def _code(text: str) -> str:
    """SQL of the code of a k-mer in text."""
    return f"cast(list_sum(list_transform(range(1, length({text}) + 1), lambda i: (instr('ACGT', substr({text}, i, 1)) - 1) * cast(pow(4, length({text}) - i) as bigint))) as bigint)"


def _reverse(text: str) -> str:
    return f"reverse(translate({text}, 'ACGT', 'TGCA'))"


def _windows(k: int) -> str:
    return f"""{_READS},
        w as (select n, i - 1 as pos, substr(seq, i, {k}) as f from (select n, seq, unnest(range(1, length(seq) - {k - 2})) as i from reads)),
        k as (select n, cast(pos as integer) as pos, f, least(f, {_reverse('f')}) as c from w where regexp_full_match(f, '[ACGT]+'))"""


def _dim(k: int, canonical: bool = True) -> str:
    code = f"substr('ACGT', cast((c // cast(pow(4, {k} - i) as bigint)) % 4 as integer) + 1, 1)"
    text = f"array_to_string(list_transform(range(1, {k + 1}), lambda i: {code}), '')"
    keep = f"where t <= {_reverse('t')}" if canonical else ""
    return f"d as (select cast(row_number() over (order by c) - 1 as integer) as pos, c as code, t as kmer from (select c, {text} as t from range({4**k}) r(c)) {keep})"


def _oligo_sql(k: int, value: str, canonical: bool = True) -> str:
    kind = "c" if canonical else "f"
    return f"""with {_windows(k)}, {_dim(k, canonical)},
        a as (select n, {kind} as kmer, count(*) as c from k group by 1, 2), t as (select n, sum(c) as t from a group by n)
        select s.n, d.pos, d.kmer, cast({value} as double) as value
        from sequences s cross join d left join a on a.n = s.n and a.kmer = d.kmer left join t on t.n = s.n"""


def _coverage_sql(k: int, size: int, bins: int, counts: str | None = None, norm: bool = False, key: str = "c") -> str:
    counts = counts or "select c as kmer, count(*) as c from k group by 1"
    value = "coalesce(b.v, 0) / greatest(1, coalesce(t.t, 0))" if norm else "coalesce(b.v, 0)"
    return f"""with {_windows(k)}, counts as ({counts}),
        b as (select n, least(coalesce(counts.c, 0) // {size}, {bins - 1}) as bin, count(*) as v from k left join counts on counts.kmer = k.{key} group by 1, 2),
        t as (select n, sum(v) as t from b group by n)
        select s.n, cast(r.bin as integer) as bin, cast({value} as double) as value
        from sequences s cross join range({bins}) r(bin) left join b on b.n = s.n and b.bin = r.bin left join t on t.n = s.n"""


def _spans_sql(w: int, m: int, tail: str) -> str:
    return f"""with {_READS},
        p as (select n, length(seq) as l, i - 1 as pos, substr(seq, i, {m}) as f from (select n, seq, unnest(range(1, length(seq) - {m - 2})) as i from reads)),
        q as (select n, l, pos, case when regexp_full_match(f, '[ACGT]+') then least(f, {_reverse('f')}) end as c from p),
        x as (select *, min(c) over o as v, count(c) over o as nv from q window o as (partition by n order by pos rows between current row and {w - m} following)),
        y as (select * from x where nv = {w - m + 1}),
        z as (select *, lag(pos) over o as pp, lag(v) over o as pv from y window o as (partition by n order by pos)),
        g as (select *, sum(case when pp is null or pp <> pos - 1 or pv <> v then 1 else 0 end) over (partition by n order by pos) as grp from z),
        spans as (select n, min(v) as minimiser, cast(min(pos) as integer) as span_start, cast(max(pos) + {w} as integer) as span_end,
          max(pos) + {w} = max(l) and count(*) = 1 and coalesce(min(pp) = min(pos) - 1, false) as last_alone from g group by n, grp)
        {tail}"""


_SPANS = "select n, minimiser, span_start, span_end from spans"


def oracle_sql() -> dict[str, str]:
    merged = "select kmer, coalesce(cast(sum(cnt) as bigint), 0) as c from (select distinct part_no, chunk_no, kmer, cnt from kmer_counts where kmer is not null) group by kmer"
    text_of = "array_to_string(list_transform(range(1, 12), lambda i: substr('ACGT', cast((kmer // cast(pow(4, 11 - i) as bigint)) % 4 as integer) + 1, 1)), '')"
    corner = {"x": "('G', 'T')", "y": "('C', 'G')"}
    fold = lambda axis: " + ".join([f"(case when substr(kmer, {i}, 1) in {corner[axis]} then 16.0 else 0.0 end) / {2 ** (5 - i)}" for i in range(1, 5)] + ["0.5"])
    half = lambda axis: f"(prev.{axis} + case when substr(seq, prev.pos + 2, 1) in {corner[axis]} then 1.0 else 0.0 end) / 2"
    return {
        "seq_stats": "select count(*) as seq_count, cast(sum(length(seq)) as bigint) as total_length from sequences",
        "kmer_pairs_k3": f"with {_windows(3)} select n, pos, {_code('f')} as fwd, {_code(_reverse('f'))} as rev from k",
        "kmer_windows_k4": f"with {_windows(4)} select n, pos, c as kmer from k",
        "kmer_table_k6": f"with {_windows(6)} select n, pos, c as kmer from k",
        "kmer_codec": f"""with t as (select distinct kmer, {text_of} as acgt from kmer_counts where kmer is not null)
            select kmer, acgt, {_code('acgt')} as fwd, {_code(_reverse('acgt'))} as rev, least(acgt, {_reverse('acgt')}) as canonical, kmer % 4 as part_no from t""",
        "kmer_codec_sql": f"""with t as (select distinct kmer, {text_of} as acgt from kmer_counts where kmer is not null)
            select kmer, acgt, {_code(_reverse('acgt'))} as rev from t""",
        "kmer_count_k5": f"with {_windows(5)}, a as (select c, count(*) as count from k group by c) select {_code('c')} as kmer, count from a",
        "kmer_count_k15": f"with {_windows(15)}, a as (select c, count(*) as count from k group by c) select {_code('c')} as kmer, count from a",
        "kmer_count_k31_acgt": f"with {_windows(31)} select c as kmer, count(*) as count from k group by c",
        "count_merge": f"select kmer, c as count from ({merged})",
        "count_merge_acgt": f"select {text_of} as kmer, c as count from ({merged})",
        "dim_k4": f"with {_dim(4)} select pos, code, kmer from d",
        "dim_k3_forward": f"with {_dim(3, False)} select pos, code, kmer from d",
        "oligo_k3_counts": _oligo_sql(3, "coalesce(a.c, 0)"),
        "oligo_k4_norm": _oligo_sql(4, "coalesce(a.c, 0) / greatest(1, coalesce(t.t, 0))"),
        "oligo_k3_forward": _oligo_sql(3, "coalesce(a.c, 0) / greatest(1, coalesce(t.t, 0))", False),
        "oligo_k3_forward_half": _oligo_sql(3, "coalesce(a.c, 0) / greatest(1, 2 * coalesce(t.t, 0))", False),
        "coverage_hist_k15": _coverage_sql(15, 16, 16),
        "coverage_hist_k7_norm": _coverage_sql(7, 16, 16, norm=True),
        "coverage_hist_k15_alt": _coverage_sql(15, 5, 8, "select c as kmer, count(*) as c from k where n in (select n from sequences where length(seq) > 1000) group by 1"),
        "coverage_hist_k11_counts": _coverage_sql(11, 16, 16, f"select {text_of} as kmer, c from ({merged})"),
        "minimisers_w31_m7": _spans_sql(31, 7, _SPANS),
        "minimisers_w31_m7_compat": _spans_sql(31, 7, f"""{_SPANS} where not last_alone
            union all
            select n, repeat('T', 7), cast(l - t as integer), cast(l as integer) from (select n, length(seq) as l, length(regexp_extract(seq, '[ACGT]*$')) as t from reads) where t >= 7 and t < 31"""),
        "minimisers_w20_m10_builtin": _spans_sql(20, 10, _SPANS),
        "minimiser_per_read": f"""with {_windows(10)} select n, min(c) as minimiser, 0 as span_start, cast(max(length(seq)) as integer) as span_end
            from k join reads using (n) where regexp_full_match(seq, '[ACGT]+') group by n""",
        "min_s2m": _spans_sql(31, 7, """, t as (select n, string_agg(minimiser || ':' || span_start || '-' || span_end, chr(9) order by span_start) as spans from spans group by n)
            select s.n, cast(s.n as varchar) || coalesce(chr(9) || t.spans, '') as line from sequences s left join t using (n)"""),
        "min_m2s": _spans_sql(31, 7, """select minimiser, cast(count(*) as integer) as n_members,
            string_agg(n || ':' || span_start || '-' || span_end, ' ' order by n, span_start) as members from spans group by minimiser"""),
        "kmer_minimiser_w15_m7": _spans_sql(15, 7, f"""select z.n, cast(pos as integer) as pos, least(substr(seq, pos + 1, 15), {_reverse('substr(seq, pos + 1, 15)')}) as kmer,
            case when pp = pos - 1 then pv else v end as minimiser from z join reads using (n)"""),
        "cgr_path": f"""with recursive {_READS}, prev as (
              select n, seq, -1 as pos, 0.5::double as x, 0.5::double as y from reads where regexp_full_match(seq, '[ACGT]+')
              union all
              select n, seq, pos + 1, {half('x')}, {half('y')} from prev where pos + 1 < length(seq))
            select n, pos, round(x, 9) as x, round(y, 9) as y from prev where pos >= 0""",
        "kmer_cgr_k4": f"select o.n, o.pos, cast({fold('x')} as double) as x, cast({fold('y')} as double) as y, o.value as freq from ({_oligo_sql(4, 'coalesce(a.c, 0) / greatest(1, coalesce(t.t, 0))')}) o",
    }
