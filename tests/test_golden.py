"""Published golden outputs for two reads of 72 bases, and minimisers of a sequence of 100."""

from __future__ import annotations

import hashlib

import pytest

from helixmill import api, cli
from helixmill.operators.coverage import coverage_histograms
from helixmill.sources import tables

from .test_sequences import READS

#: Fixed values.
SPANS = [
    "Read_1\tACGCCAT:0-32\tAAATCCC:2-57\tAACAACT:27-62\tAAACCCT:32-63\tAAAACCC:33-72",
    "Read_2\tAAAATAC:0-50\tAAGAATC:20-57\tAAGCAGA:27-64\tAACGACG:34-65\tAAACGAC:35-66\tAAAACGA:36-72",
]
BINS = ['AAAACCCTTA\t[("Read_1", 0, 72)]', 'AAAACGACGC\t[("Read_2", 0, 72)]']
#: Fixed values.
HUNDRED = "ATGCGATATCGTAGGCGTCGATGGAGAGCTAGATCGATCGATCTAAATCCCGATCGATTCCGAGCGCGATCAAAGCGCGATAGGCTAGCTAAAGCTAGCA"
HUNDRED_MINIMISERS = ["ACGATAT", "ACGCCTA", "AGAGCTA", "AAATCCC", "AATCCCG", "AATCGAT", "AAAGCGC"]
#: Starts of two outputs, and SHA-256 (first 32 digits) of the sorted, trimmed lines of whole outputs.
SHARES_START = "0.014493 0.014493 0.000000 0.028986 0.014493 0.014493 0.000000 0.028986 0.000000 0.000000 0.028986 0.028986"
POINTS_START = "(0.5,0.5,1) (0.5,8.5,1) (8.5,8.5,0) (8.5,0.5,2) (0.5,4.5,1) (0.5,12.5,1) (8.5,12.5,0) (8.5,4.5,2) (4.5,4.5,0)"

DIGESTS = {
    "comp oligo -k 4": "100f3b241eabc47443a0b7bc448c8b3a",
    "comp oligo -k 4 -H": "b00bd3a94637f20797898d5ec9d70d51",
    "comp oligo -k 4 -c": "ea8327b0abd2463b00e0a520de0aaa5d",
    "comp cgr": "0c99c3269950619c40d22bf4f0d8c114",
    "comp cgr -k 4 -v 16 -c": "400338b34b9ea4587a361860d0a05090",
    "ctr -k 15": "a6f00d15c869a177f7787f178c5f3546",
    "coverage": "085f2fd409c6ce56071b8ab9f57730eb",
    "coverage counts": "4d03b2ee726dc6c4fb9fabb8244035ef",
}


def digest(lines) -> str:
    return hashlib.sha256("\n".join(sorted(x.strip() for x in lines)).encode()).hexdigest()[:32]


@pytest.mark.parametrize("command", [c for c in DIGESTS if c[:3] != "cov"])
def test_whole_outputs(spark, tmp_path, command):
    (tmp_path / "reads.fa").write_text("".join(f">Record_{i}\n{s[:50]}\n{s[50:]}\n" for i, s in enumerate(READS, 1)))
    out = tmp_path / "out"
    assert cli.main([*command.split(), "-i", str(tmp_path / "reads.fa"), "-o", str(out)]) == 0
    assert digest((out / "kmers.counts" if out.is_dir() else out).read_text().splitlines()) == DIGESTS[command]


def test_whole_coverage(spark):
    rows = spark.createDataFrame(list(enumerate(READS)), "n long, seq string")
    for name, norm in (("coverage", True), ("coverage counts", False)):
        lines = tables.vector_lines(coverage_histograms(rows, 4, 2, 3, norm), "bin_count", norm)
        assert digest(r["line"] for r in lines.collect()) == DIGESTS[name]


def test_command_line_outputs(spark, tmp_path):
    (tmp_path / "reads.fq").write_text("".join(f"@Read_{i}\n{s}\n+\n{'I' * 72}\n" for i, s in enumerate(READS, 1)))
    out = tmp_path / "out"

    def run(*args):
        assert cli.main([*args[:1], *args[1:], "-i", str(tmp_path / "reads.fq"), "-o", str(out)]) == 0
        return [line.strip() for line in out.read_text().splitlines()]

    assert run("min", "-w", "31", "-m", "7") == SPANS
    assert sorted(run("min", "-p", "m2s")) == BINS
    assert run("comp", "oligo", "-k", "4")[0].startswith(SHARES_START)
    assert run("comp", "cgr", "-k", "4", "-v", "16", "-c")[0].startswith(POINTS_START)


def test_hundred():
    spans = api.MinimiserGenerator(HUNDRED, 31, 7)
    assert [spans.to_acgt(v) for v, _, _ in spans][: len(HUNDRED_MINIMISERS)] == HUNDRED_MINIMISERS
    assert api.utils.to_acgt(*[api.utils.to_numeric("ACGTT")[0], 5]) == "ACGTT"
