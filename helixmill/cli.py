"""Command line: ``python -m helixmill.cli comp oligo|comp cgr|cov|min|ctr``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cgr, counter, coverage, minimisers, oligo
from .operators.kmers import header
from .session import materialise, ship
from .sources import fastx, tables


def _range(low: int, high: int | None = None):
    def check(text: str) -> int:
        value = int(text)
        if value < low or high is not None and value > high:
            raise argparse.ArgumentTypeError(f"must be from {low}" + (f" to {high}" if high is not None else ""))
        return value

    return check


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixmill", description="k-mer analytics of sequences on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def common(p: argparse.ArgumentParser, output: str) -> None:
        p.add_argument("-i", "--input", required=True, help="FASTA or FASTQ file, plain or .gz; - reads standard input")
        p.add_argument("-o", "--output", required=True, help=output)
        p.add_argument("-t", "--threads", type=_range(0), default=0, help="cores of a local session, 0 for all")

    kinds = commands.add_parser("comp", help="composition").add_subparsers(dest="kind", required=True)
    p = kinds.add_parser("oligo", help="composition vectors")
    common(p, "output file")
    p.add_argument("-c", "--counts", action="store_true", help="counts instead of shares")
    p.add_argument("-k", "--k-size", type=_range(3, 7), default=3)
    p.add_argument("-r", "--raw-count", action="store_true", help="forward k-mers instead of canonical ones")
    p.add_argument("-p", "--preset", choices=list(tables.DELIMITERS), default="spc")
    p.add_argument("-H", "--header", action="store_true")
    p = kinds.add_parser("cgr", help="chaos-game representation")
    common(p, "output file")
    p.add_argument("-c", "--counts", action="store_true", help="counts instead of shares, with -k")
    p.add_argument("-k", "--k-size", type=_range(3, 7))
    p.add_argument("-v", "--vec-size", type=_range(1))
    p = commands.add_parser("cov", help="coverage histograms")
    common(p, "output folder")
    p.add_argument("-a", "--alt-input", help="file whose k-mers are counted instead")
    p.add_argument("-k", "--k-size", type=_range(7, 31), default=15)
    p.add_argument("-p", "--preset", choices=list(tables.DELIMITERS), default="spc")
    p.add_argument("-s", "--bin-size", type=_range(5), default=16)
    p.add_argument("-c", "--bin-count", type=_range(5), default=16)
    p.add_argument("-m", "--memory", type=_range(6, 128), default=6, help="GB of a local session")
    p.add_argument("--counts", action="store_true", help="counts instead of shares")
    p = commands.add_parser("min", help="minimisers")
    common(p, "output file")
    p.add_argument("-m", "--m-size", type=_range(7, 28), default=10)
    p.add_argument("-w", "--w-size", type=_range(0), default=0, help="0: the whole sequence")
    p.add_argument("-p", "--preset", choices=["s2m", "m2s"], default="s2m")
    p = commands.add_parser("ctr", help="k-mer counts")
    common(p, "output folder")
    p.add_argument("-k", "--k-size", type=_range(10, 31), required=True)
    p.add_argument("-m", "--memory", type=_range(6, 128), default=6, help="GB of a local session")
    p.add_argument("-a", "--acgt", action="store_true", help="k-mers as text")
    return top


def _session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("helixmill")
    if "SPARK_REMOTE" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{args.threads or '*'}]").config("spark.driver.memory", f"{getattr(args, 'memory', 6)}g")
    return builder.getOrCreate()


def _input(spark: SparkSession, path: str) -> DataFrame:
    return fastx.read_stream(spark) if path == "-" else fastx.read_fastx(spark, path)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    ship(spark)
    rows = _input(spark, args.input)
    if args.command == "comp" and args.kind == "oligo":
        forward, norm = args.raw_count, not args.counts
        vectors = oligo.oligo_vectors(rows, args.k_size, norm, not forward)
        names = header(args.k_size, not forward) if args.header else None
        tables.write_file(tables.vector_lines(vectors, "kvec", norm, args.preset), args.output, names, args.preset)
    elif args.command == "comp":
        if args.k_size is None:
            tables.write_file(tables.path_lines(cgr.cgr_paths(rows, args.vec_size or 1)), args.output)
        else:
            tables.write_file(tables.path_lines(cgr.kmer_cgr(rows, args.k_size, args.vec_size, not args.counts), "points"), args.output)
    elif args.command == "cov":
        tables.make_folder(args.output)
        counts = counter.kmer_counts(_input(spark, args.alt_input) if args.alt_input else rows, args.k_size)
        counts = materialise(counts, "counts")
        tables.write_file(tables.count_lines(counts), f"{args.output}/kmers.counts")
        bins = coverage.coverage_histograms(rows, args.k_size, args.bin_size, args.bin_count, not args.counts, counts)
        tables.write_file(tables.vector_lines(bins, "bin_count", not args.counts, args.preset), f"{args.output}/kmers.vectors")
    elif args.command == "min":
        if args.preset == "s2m":
            lists = minimisers.sequences_to_minimisers(rows, args.w_size, args.m_size, compat=True)
            names = rows.select("n", "id")
            tables.write_file(tables.span_lines(lists.join(names, "n")), args.output)
        else:
            bins = minimisers.minimisers_to_sequences(rows, args.w_size, args.m_size, compat=True, key="id")
            tables.write_file(tables.member_lines(bins), args.output)
    else:
        tables.make_folder(args.output)
        tables.write_file(tables.count_lines(counter.kmer_counts(rows, args.k_size, acgt=args.acgt)), f"{args.output}/kmers.counts")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "comp" and args.kind == "cgr" and args.counts and args.k_size is None:
        print("counts need a k-mer size (-k)", file=sys.stderr)
        return 2
    if args.command == "min" and 0 < args.w_size <= args.m_size:
        print("the window must be wider than the minimiser", file=sys.stderr)
        return 2
    run(args, _session(args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
