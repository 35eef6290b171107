"""Command line: correct FASTA/FASTQ files."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from mendseq.operators.report import annotate, observed, summary_text
from mendseq.plans.pipeline import MODELLED, Settings, build_trusted, correct_reads, loaded_trust
from mendseq.session import materialize
from mendseq.sources.fastx import read_fastx, write_fastx
from mendseq.sources.trusted_store import load_trusted, save_trusted

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(
        prog="mendseq", add_help=False, allow_abbrev=False,
        description="Correct substitution errors in sequencing reads.")
    p.add_argument("-r", action="append", metavar="file", help="read file, may be repeated")
    p.add_argument("-k", nargs=3, metavar=("length", "genome_size", "alpha"),
                   help="k-mer length, genome size and sampling rate")
    p.add_argument("-K", nargs=2, metavar=("length", "genome_size"),
                   help="k-mer length and genome size; the sampling rate is inferred")
    p.add_argument("-od", default=".", metavar="folder", help="output folder (default: .)")
    p.add_argument("-t", type=int, default=1, help="accepted; Spark decides how much runs at once")
    p.add_argument("-maxcor", type=int, help="most corrections within 20 bases (default: 4)")
    p.add_argument("-trim", action="store_true", help="cut off uncorrectable suffixes")
    p.add_argument("-discard", action="store_true", help="drop unfixable reads; pairs lose their match")
    p.add_argument("-noQual", action="store_true", help="ignore quality scores")
    p.add_argument("-newQual", metavar="char", help="quality given to corrected bases")
    p.add_argument("-stable", action="store_true", help="accepted; results never depend on timing")
    p.add_argument("-saveTrustedKmers", metavar="path", help="save the trusted k-mers and stop")
    p.add_argument("-loadTrustedKmers", metavar="path", help="use saved trusted k-mers")
    p.add_argument("-zlib", type=int, default=1, metavar="level", help="gzip level 0-9 (default: 1)")
    p.add_argument("-exactFP", action="store_true",
                   help="take set A as exact instead of as crowded as a Bloom filter")
    p.add_argument("-h", action="help", help="print this help and quit")
    p.add_argument("-v", action="version", version=VERSION, help="print the version and quit")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    p = parser()
    if not argv:
        p.print_help()
        p.exit(1)
    args = p.parse_args(argv)
    if args.k and args.K:
        p.error("-k and -K exclude each other")
    if not (args.k or args.K):
        p.error("a k-mer length is needed: -k or -K")
    if not args.r:
        p.error("no read file given: -r")
    if args.saveTrustedKmers and args.loadTrustedKmers:
        p.error("-saveTrustedKmers and -loadTrustedKmers exclude each other")
    if not 0 <= args.zlib <= 9:
        p.error("-zlib must be 0 to 9")
    try:
        settings_of(args)
    except ValueError as wrong:
        p.error(str(wrong))
    return args


def settings_of(args: argparse.Namespace) -> Settings:
    length, genome_size, alpha = (*args.k,) if args.k else (*args.K, None)
    return Settings(
        k=int(length), genome_size=int(genome_size), alpha=None if alpha is None else float(alpha),
        max_corrections=args.maxcor, trim=args.trim, use_quality=not args.noQual,
        new_quality=args.newQual[:1] if args.newQual else None,
        **({} if args.exactFP else {"false_positives": MODELLED}))


def run(spark: SparkSession, args: argparse.Namespace) -> str | None:
    """Returns the summary text, or None after saving the trusted k-mers."""
    settings = settings_of(args)
    reads = read_fastx(spark, args.r)
    if args.loadTrustedKmers:
        kmers = load_trusted(spark, args.loadTrustedKmers, settings.k, settings.genome_size)
        trust = loaded_trust(reads, kmers, settings)
    else:
        trust = build_trusted(reads, settings)
    if args.saveTrustedKmers:
        save_trusted(trust.kmers.df, args.saveTrustedKmers, settings.k, trust.alpha, settings.genome_size)
        return None
    counted, summary_row = observed(correct_reads(reads, trust, settings), settings.trim, args.discard)
    corrected = materialize(counted, "corrected")
    write_fastx(annotate(corrected, settings.trim, args.discard), args.r, args.od, args.zlib, reads.count())
    return summary_text(summary_row())


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(message)s")
    spark = SparkSession.builder.appName("mendseq").getOrCreate()
    text = run(spark, args)
    if text:
        print(text, file=sys.stderr, end="")
    return 0
