"""Column functions on k-mers, written as built-in expressions only, and the same as SQL functions.

k-mers are text over ACGT or BIGINT codes of two bits a letter (A 0, C 1, G 2, T 3), k from 1 to 31.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LONGEST_K = 31


def normalise(seq: Column) -> Column:
    """Upper-case bases with U as T; every other character as N."""
    return F.regexp_replace(F.translate(seq, "acgtuU", "ACGTTT"), "[^ACGT]", "N")


def is_clean(kmer: Column) -> Column:
    """Whether there is no ambiguous letter (in normalised text)."""
    return kmer.rlike("^[ACGT]+$")


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def encode(kmer: Column) -> Column:
    """Code of a k-mer in text; null for text that is no k-mer of 1 to 31 bases."""
    plain = F.translate(kmer, "acgtuU", "ACGTTT")
    code = F.conv(F.translate(plain, "ACGT", "0123"), 4, 10).cast("bigint")
    return F.when(plain.rlike(f"^[ACGT]{{1,{LONGEST_K}}}$"), code)


def encode_pair(kmer: Column) -> Column:
    """Struct (fwd, rev): codes of a k-mer and of its reverse complement."""
    plain = F.translate(kmer, "acgtuU", "ACGTTT")
    return F.when(encode(kmer).isNotNull(), F.struct(encode(kmer).alias("fwd"), encode(reverse_complement(plain)).alias("rev")))


def decode(code: Column, k: int) -> Column:
    """Text of a code; null for codes that no k-mer of this length has."""
    text = F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return F.when((code >= 0) & (code < F.lit(4**k)), text)


def reverse_complement_code(code: Column, k: int) -> Column:
    """Code of the reverse complement, letter by letter."""
    letter = lambda a, i: F.shiftleft(a, 2).bitwiseOR(F.shiftright(code, 2 * i).bitwiseAND(F.lit(3)).bitwiseXOR(F.lit(3)))
    out = F.lit(0).cast("bigint")
    for i in range(k):
        out = letter(out, i)
    return out


def canonical_code(code: Column, k: int) -> Column:
    return F.least(code, reverse_complement_code(code, k))


def partition_of(code: Column, parts: int) -> Column:
    """Number of the partition that a k-mer's counts go to."""
    return F.pmod(code, F.lit(parts))


def bucket(count: Column, bin_size: int, bin_count: int) -> Column:
    """Histogram bin of a count: equal widths, the last one open-ended; a missing count is 0."""
    return F.least(F.floor(F.coalesce(count, F.lit(0)) / bin_size), F.lit(bin_count - 1)).cast("int")


def share(value: Column, total: Column) -> Column:
    """value over total, where a total of 0 counts as 1."""
    return value / F.greatest(F.lit(1.0), total)


def first_token(header: Column) -> Column:
    """Record name: what is before the first white space of a header line."""
    return F.regexp_extract(header, r"^\S*", 0)


def corner(base: Column, axis: str, size: float) -> Column:
    """Coordinate of a base's corner in the chaos-game square; null for other letters."""
    high = {"x": ("G", "T", "U"), "y": ("C", "G")}[axis]
    up = F.upper(base)
    return F.when(up.isin("A", "C", "G", "T", "U"), F.when(up.isin(*high), F.lit(float(size))).otherwise(F.lit(0.0)))


#: Windows of a piece when ``kmer_table`` cuts a sequence: a place in a text is found by counting from its start.
PIECE = 32
#: SQL of the pieces of s (b: where it begins, p: its letters, r: their reverse complement, e: its last window), and of the
#: windows of a piece x.
_PIECES = f"""transform(
            transform(if(k > 0 AND length(s) >= k, sequence(0, length(s) - k, {PIECE}), array()),
                b -> struct(b AS b, regexp_replace(translate(substring(s, b + 1, {PIECE} - 1 + k), 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N') AS p)),
            x -> struct(x.b AS b, x.p AS p, reverse(translate(x.p, 'ACGT', 'TGCA')) AS r, length(x.p) - k AS e))"""
_EVERY = "transform(sequence(0, x.e), i -> struct(x.b + i AS pos, least(substring(x.p, i + 1, k), substring(x.r, x.e - i + 1, k)) AS kmer))"
_WINDOWS = f"x -> if(contains(x.p, 'N'), filter({_EVERY}, y -> NOT contains(y.kmer, 'N')), {_EVERY})"

#: SQL text of the functions that ``register`` makes; they are inlined into the plan. The body of ``kmer_table`` is one
#: generator over the sequence itself: with a filter or a subquery around it, Spark joins the windows of all distinct sequences
#: back to the table by the sequence, which travels with each of its windows.
SQL_FUNCTIONS = {
    "kmer_normalise(s STRING) RETURNS STRING": "regexp_replace(translate(s, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N')",
    "kmer_revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGT', 'TGCA'))",
    "kmer_canonical(s STRING) RETURNS STRING": "least(s, reverse(translate(s, 'ACGT', 'TGCA')))",
    "kmer_encode(s STRING) RETURNS BIGINT": "if(s rlike '^[ACGT]{1,31}$', cast(conv(translate(s, 'ACGT', '0123'), 4, 10) as bigint), null)",
    "kmer_decode(c BIGINT, k INT) RETURNS STRING": "translate(lpad(conv(cast(c as string), 10, 4), k, '0'), '0123', 'ACGT')",
    "kmer_table(s STRING, k INT) RETURNS TABLE (pos INT, kmer STRING)": f"SELECT inline(flatten(transform({_PIECES}, {_WINDOWS}))) AS (pos, kmer)",
    "kmer_windows(s STRING, k INT) RETURNS ARRAY<STRING>": "if(length(s) >= k, transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)), array())",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to Spark SQL for this session.

    ``kmer_table`` is a table function for LATERAL joins: ``SELECT n, pos, kmer FROM sequences, LATERAL kmer_table(seq, 15)``.
    """
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
