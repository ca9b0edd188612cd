"""Alignments and sequences as text formats and files.

Lines are Column expressions, so they can be queried as well as written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import ungapped
from ..operators.columns import cigar_of, classes, statistics


def fasta_text(name: Column, seq: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n"))


def paf_line(name1: Column, name2: Column, a1: Column, a2: Column, ops: Column, cigar: Column | None = None) -> Column:
    """Twelve columns and the CIGAR (that of ``ops``, unless given); the whole of both sequences, forward."""
    cigar = cigar_of(ops) if cigar is None else cigar
    s, n1, n2 = statistics(ops), F.length(ungapped(a1)), F.length(ungapped(a2))
    return F.concat_ws("\t", name1, n1, F.lit(0), n1, F.lit("+"), name2, n2, F.lit(0), n2, s["matches"], s["total_aligned"], F.lit(255), F.concat(F.lit("cg:Z:"), cigar))


def paf_lines(alignments: DataFrame) -> DataFrame:
    """(pair_id, name1, name2, a1, a2) -> pair_id, line."""
    rows = alignments.withColumn("ops", classes(F.col("a1"), F.col("a2")))
    return rows.select("pair_id", paf_line(F.col("name1"), F.col("name2"), F.col("a1"), F.col("a2"), F.col("ops")).alias("line"))


def maf_lines(alignments: DataFrame) -> DataFrame:
    """An ``a`` line and two ``s`` lines a pair: pair_id, nth, line."""
    def one(i: int) -> Column:
        n = F.length(ungapped(F.col(f"a{i}"))).cast("string")
        return F.concat_ws(" ", F.lit("s"), F.col(f"name{i}"), F.lit("0"), n, F.lit("+"), n, F.col(f"a{i}"))

    return alignments.select("pair_id", F.posexplode(F.array(F.lit("a"), one(1), one(2))).alias("nth", "line"))


def snippet_blocks(alignments: DataFrame, length: int = 100, width: int = 50) -> DataFrame:
    """The first ``length`` columns in blocks: pair_id, start (from 1), seq1, comp, seq2."""
    n = F.least(F.length("a1"), F.lit(length))
    rows = alignments.where(F.length("a1") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1, F.lit(width))))
    size = F.least(F.lit(width), F.lit(length) - F.col("i"))
    comp = F.translate(classes(F.col("a1"), F.col("a2")), "=XIDM", "|    ")
    part = lambda c: F.substring(c, F.col("i") + 1, size)
    return rows.select("pair_id", (F.col("i") + 1).alias("start"), part(F.col("a1")).alias("seq1"), part(comp).alias("comp"), part(F.col("a2")).alias("seq2"))


def column_places(alignments: DataFrame) -> DataFrame:
    """Places of matches, mismatches and gaps as arrays: the data behind an alignment plot."""

    def place(signs: bytes) -> Column:
        @F.arrow_udf("array<int>")
        def places(ops: pa.Array) -> pa.Array:
            arrays = (None if o.as_py() is None else np.flatnonzero(np.isin(np.frombuffer(o.as_py().encode(), np.uint8), list(signs))).astype(np.int32) for o in ops)
            return pa.array(arrays, pa.list_(pa.int32()))

        return places("ops")

    rows = alignments.withColumn("ops", classes(F.col("a1"), F.col("a2")))
    return rows.select("pair_id", place(b"=").alias("matches"), place(b"X").alias("mismatches"), place(b"IDM").alias("gaps"))


def stats_long(alignments: DataFrame) -> DataFrame:
    """Statistics as (pair_id, metric, value)."""
    return _long(alignments.withColumn("ops", classes(F.col("a1"), F.col("a2"))))


def _long(rows: DataFrame) -> DataFrame:
    s = statistics(F.col("ops"))
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in s.items()])
    return rows.select("pair_id", F.explode(pairs).alias("p")).select("pair_id", "p.*")


def summary_text(ops: Column, score: Column, cigar: Column | None = None) -> Column:
    """A readable summary: score, statistics in percent where they are ratios, CIGAR and its operations."""
    s, cigar = statistics(ops), cigar_of(ops) if cigar is None else cigar
    lines = [F.lit("ALIGNMENT SUMMARY"), F.format_string("Total score: %.2f", score)]
    for k, v in s.items():
        label = k.replace("_", " ").capitalize()
        if k in ("identity", "divergence"):
            lines.append(F.format_string(f"{label}: %.2f%%", v * 100))
        elif k == "gap_percentage":
            lines.append(F.format_string(f"{label}: %.2f%%", v))
        else:
            lines.append(F.format_string(f"{label}: %d", v))
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDX=])"), F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in (("M", "Double gap"), ("I", "Insertion"), ("D", "Deletion"), ("X", "Mismatch"), ("=", "Match")) for x in kv])
    parts = F.transform(runs, lambda r: F.concat(F.lit("  "), F.regexp_extract(r, r"\d+", 0), F.lit(" "), F.element_at(names, F.right(r, F.lit(1)))))
    return F.concat_ws("\n", *lines, F.concat(F.lit("CIGAR: "), cigar), F.array_join(parts, "\n"))


def write_chunks(aligned: DataFrame, path: str, groups: int = 16) -> None:
    """Chunks in ``groups`` folders by a hash of their pair, so that a pair's are found without reading the others'; folders
    by pair would be as many as there are pairs."""
    rows = aligned.withColumn("pair_group", F.pmod(F.xxhash64("pair_id"), F.lit(groups)).cast("int"))
    rows.repartition("pair_group", F.pmod(F.xxhash64("pair_id", F.lit(1)), F.lit(8))).write.mode("overwrite").partitionBy("pair_group").parquet(path)


def write_plot_data(alignments: DataFrame, folder: str, mode: str = "overwrite") -> dict[str, str]:
    """What plots of alignments (pair_id, a1, a2) need: windows of all levels (partitioned by level), heat map and identity
    curve, places of matches, mismatches and gaps, and each pair's statistics with its quality class."""
    from ..operators import columns

    stats = columns.alignment_stats(alignments).join(columns.quality_class(alignments), "pair_id")
    tables = {
        "windows": (columns.window_pyramid(alignments), ["level"]), "heatmap": (columns.heatmap_windows(alignments), []), "curve": (columns.identity_curve(alignments), []),
        "places": (column_places(alignments), []), "raw": (stats, ["quality_class"]),
    }
    paths = {}
    for name, (rows, by) in tables.items():
        paths[name] = f"{folder}/{name}"
        rows.write.mode(mode).partitionBy(*by).json(paths[name])
    return paths


#: What each statistic of the CSV means.
DESCRIPTIONS = {
    "matches": "columns of equal bases",
    "mismatches": "columns of differing bases",
    "insertions": "gaps in the first sequence",
    "deletions": "gaps in the second sequence",
    "total_aligned": "columns that are not gaps on both sides",
    "total_gaps": "gaps of one side",
    "identity": "matches as a share of the aligned columns",
    "divergence": "mismatches and gaps as a share of the aligned columns",
    "gap_openings": "runs of gaps",
    "gap_percentage": "gaps in percent of the aligned columns",
}


def write_all(alignments: DataFrame, folder: str, mode: str = "overwrite", configuration: dict | None = None) -> dict[str, str]:
    """Write alignments (pair_id, name1, name2, total_score, a1, a2) in every format; returns the folders.

    CIGAR gzip, PAF, MAF, summary, JSON, statistics CSV, ungapped and gapped FASTA, and a manifest.  The JSON repeats ``configuration`` (settings by name), where given.
    """
    # Classes and CIGAR are worked out once; four formats hold the CIGAR.
    rows = alignments.withColumn("ops", classes(F.col("a1"), F.col("a2"))).withColumn("cigar", cigar_of(F.col("ops"))).persist()
    try:
        s = statistics(F.col("ops"))
        text = {
            "cigar": (rows.select("cigar"), {"compression": "gzip"}),
            "paf": (rows.select(paf_line(*[F.col(c) for c in ("name1", "name2", "a1", "a2", "ops", "cigar")])), {}),
            "maf": (maf_lines(rows).orderBy("pair_id", "nth").select("line"), {}),
            "summary": (rows.select(summary_text(F.col("ops"), F.col("total_score"), F.col("cigar"))), {}),
            "ungapped1": (rows.select(fasta_text(F.col("name1"), ungapped(F.col("a1")))), {}),
            "ungapped2": (rows.select(fasta_text(F.col("name2"), ungapped(F.col("a2")))), {}),
            "gapped1": (rows.select(fasta_text(F.col("name1"), F.col("a1"))), {}),
            "gapped2": (rows.select(fasta_text(F.col("name2"), F.col("a2"))), {}),
        }
        paths = {}
        for name, (df, options) in text.items():
            paths[name] = f"{folder}/{name}"
            df.write.mode(mode).options(**options).text(paths[name])
        paths["json"] = f"{folder}/json"
        settings = [F.struct(*[F.lit(v).alias(k) for k, v in configuration.items()]).alias("configuration")] if configuration else []
        rows.select(
            *settings,
            F.struct("pair_id", "name1", "name2", "total_score", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")).alias("metadata"),
            F.struct(*[c.alias(k) for k, c in s.items()]).alias("statistics"),
            F.struct(F.col("a1").alias("sequence1"), F.col("a2").alias("sequence2"), "cigar", F.length("a1").alias("length")).alias("alignment"),
        ).write.mode(mode).json(paths["json"])
        paths["csv"] = f"{folder}/csv"
        described = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
        _long(rows).withColumn("description", F.element_at(described, F.col("metric"))).write.mode(mode).option("header", True).csv(paths["csv"])
        spark = rows.sparkSession
        spark.createDataFrame(list(paths.items()), "kind string, path string").coalesce(1).write.mode(mode).json(f"{folder}/manifest")
        return paths
    finally:
        rows.unpersist()

