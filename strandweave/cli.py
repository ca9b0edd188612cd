"""Command line: ``python -m strandweave.cli align|list|check|plot-data|config ...``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import catalog, profiles
from .plans import config as settings
from .plans.pipeline import align_pairs
from .sinks import files
from .sources import fasta


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandweave")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("align", help="align two FASTA files, or two sets of names of one or two files")
    a.add_argument("fasta1")
    a.add_argument("fasta2", nargs="?")
    a.add_argument("--names1", help="names joined by + from the first file")
    a.add_argument("--names2", help="names joined by + from the second file (or the first)")
    a.add_argument("--config")
    a.add_argument("--preset", default="default", choices=sorted(settings.PRESETS))
    a.add_argument("--gap-open", type=float)
    a.add_argument("--gap-extend", type=float)
    a.add_argument("--diagonal", action="store_true", help="chunks along the diagonal instead of anchor chains")
    a.add_argument("--out", required=True)
    n = sub.add_parser("list", help="names in a FASTA file")
    n.add_argument("fasta")
    n.add_argument("--range")
    n.add_argument("--limit", type=int, default=0)
    c = sub.add_parser("check", help="validate FASTA files, and whether a pair can be aligned")
    c.add_argument("fasta", nargs="+")
    v = sub.add_parser("plot-data", help="write what plots need, from results that align wrote as JSON")
    v.add_argument("results")
    v.add_argument("--out", required=True)
    g = sub.add_parser("config", help="write settings")
    g.add_argument("out")
    g.add_argument("--preset", default="default", choices=sorted(settings.PRESETS))
    return p


def _named(spark: SparkSession, path: str, names: str | None, side: int):
    records = catalog.last_wins(fasta.read_fasta(spark, path)) if names else None
    if names is None:
        return fasta.nth_record(fasta.read_fasta(spark, path)).select(F.lit(0).cast("long").alias("pair_id"), F.col("seq_id").alias(f"name{side}"), F.col("seq").alias(f"s{side}"))
    return catalog.combined(spark.createDataFrame([(names,)], "spec string"), records).select(F.lit(0).cast("long").alias("pair_id"), F.col("spec").alias(f"name{side}"), F.col("seq").alias(f"s{side}"))


def run(spark: SparkSession, argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    if args.command == "config":
        settings.save(settings.load(preset=args.preset), args.out)
        return 0
    if args.command == "plot-data":
        rows = fasta.read_results(spark, args.results).select("metadata.pair_id", F.col("alignment.sequence1").alias("a1"), F.col("alignment.sequence2").alias("a2"))
        for kind, path in files.write_plot_data(rows, args.out).items():
            print(f"{kind}\t{path}")
        return 0
    if args.command == "list":
        names = fasta.read_ids(spark, args.fasta).select("seq_id").distinct()
        if args.range:
            names = catalog.name_range(names, args.range)
        for (name,) in catalog.listed(names, limit=args.limit).toLocalIterator():
            print(name)
        return 0
    if args.command == "check":
        bad = 0
        for path in args.fasta:
            found = fasta.problems(spark, path)
            bad += bool(found)
            print(f"{path}: {', '.join(found) or 'valid'}")
        if len(args.fasta) == 2 and not bad:
            row = profiles.compatibility(fasta.read_pair(spark, *args.fasta)).first()
            print("compatible" if row.compatible else f"not compatible: {row.reason}")
            bad += not row.compatible
        return int(bad > 0)
    changes = {k: v for k, v in (("gap_open", args.gap_open), ("gap_extend", args.gap_extend)) if v is not None}
    config = settings.load(args.config, args.preset, **changes)
    if found := settings.problems(config):
        print("\n".join(found), file=sys.stderr)
        return 2
    pairs = _named(spark, args.fasta1, args.names1, 1).join(_named(spark, args.fasta2 or args.fasta1, args.names2, 2), "pair_id")
    done = align_pairs(pairs, config, not args.diagonal).join(pairs.select("pair_id", "name1", "name2"), "pair_id")
    for kind, path in files.write_all(done, args.out, configuration=asdict(config)).items():
        print(f"{kind}\t{path}")
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    try:
        sys.exit(run(spark, sys.argv[1:]))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
