"""Aligned pairs (pair_id, a1, a2): column classes, statistics, runs and windows.

A pair's columns become one string of classes, ``=`` match, ``X`` mismatch, ``I`` gap in the first, ``D``
gap in the second, ``M`` gap in both; everything else is counting in that string.  All operators but the
two histograms are narrow: no shuffle, whatever the number of pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import VALID
from ..functions.features import let, times, ungapped
from .kernels import column_classes, partial_columns


def symbols(s: Column) -> Column:
    """Array of a string's symbols; empty for an empty string."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def _classes(strict: bool):
    @F.arrow_udf("string")
    def classes(a1: pa.Array, a2: pa.Array) -> pa.Array:
        both = ((x.as_py(), y.as_py()) for x, y in zip(a1, a2))  # one pair at a time: the batch isn't held again as objects
        return pa.array((None if x is None or y is None else column_classes(x, y, strict) for x, y in both), pa.string())

    return classes


def classes(a1: Column, a2: Column, strict: bool = False) -> Column:
    """Class string of two gapped strings, cut to the shorter one: one Arrow pass that compares bytes.  ``strict``: only
    plain bases match."""
    return _classes(strict)(a1, a2)


def with_classes(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ops", classes(F.col("a1"), F.col("a2")))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _counts(ops: Column) -> dict[str, Column]:
    n = {name: times(ops, c).cast("long") for name, c in (("matches", "="), ("mismatches", "X"), ("insertions", "I"), ("deletions", "D"))}
    n["total_aligned"] = n["matches"] + n["mismatches"] + n["insertions"] + n["deletions"]
    n["total_gaps"] = n["insertions"] + n["deletions"]
    return n


def statistics(ops: Column) -> dict[str, Column]:
    n = _counts(ops)
    return {
        **n,
        "identity": _ratio(n["matches"], n["total_aligned"]),
        "divergence": _ratio(n["mismatches"] + n["total_gaps"], n["total_aligned"]),
        # A gap opens at a gap of one side that no gap of any kind comes before.
        "gap_openings": F.regexp_count(ops, F.lit("(?<![IDM])[ID]")).cast("long"),
        "gap_percentage": _ratio(n["total_gaps"], n["total_aligned"]) * 100,
    }


def alignment_stats(pairs: DataFrame) -> DataFrame:
    return with_classes(pairs).select("pair_id", *[c.alias(k) for k, c in statistics(F.col("ops")).items()])


def strict_stats(pairs: DataFrame) -> DataFrame:
    """Statistics that count plain bases as matches only; identity over columns without gaps."""
    ops = pairs.select("pair_id", classes(F.col("a1"), F.col("a2"), True).alias("ops"))
    n = _counts(F.col("ops"))
    return ops.select("pair_id", n["matches"].alias("matches"), n["mismatches"].alias("mismatches"), n["total_gaps"].alias("total_gaps"), _ratio(n["matches"], n["matches"] + n["mismatches"]).alias("identity_ungapped"), _ratio(n["total_gaps"], F.length("ops")).alias("gap_fraction"))


def quality(pairs: DataFrame) -> DataFrame:
    """Conservation, transitions per transversion and matches per thousand columns; 0 without columns."""
    two = F.array_join(F.zip_with(symbols(F.col("a1")), symbols(F.col("a2")), lambda x, y: F.when((x == "-") | (y == "-") | (x == y), "").when(F.concat(F.upper(x), F.upper(y)).isin("AG", "GA", "CT", "TC"), "t").otherwise("v")), "")
    rows = with_classes(pairs).withColumn("_tv", two)
    n = _counts(F.col("ops"))
    return rows.select(
        "pair_id", (_ratio(n["matches"], n["total_aligned"]) * 100).alias("identity_percentage"), (_ratio(n["total_gaps"], n["total_aligned"]) * 100).alias("gap_percentage"),
        (_ratio(n["matches"] * 2 - n["mismatches"], n["total_aligned"] * 2) * 100).alias("conservation_score"),
        times(F.col("_tv"), "t").cast("long").alias("transitions"), times(F.col("_tv"), "v").cast("long").alias("transversions"),
        (times(F.col("_tv"), "t") / (times(F.col("_tv"), "v") + 1)).alias("ti_tv_ratio"), (_ratio(n["matches"], n["total_aligned"]) * 1000).alias("matches_per_kb"))


def score_of(ops: Column, gap_open: float, gap_extend: float, match: float = 1.0, mismatch: float | None = None) -> Column:
    """Matches, mismatches (priced as ``gap_open`` unless given), and affine gaps; a change of side opens
    again, and double gaps are as if they weren't there."""
    ops = F.replace(ops, F.lit("M"))
    opens = F.regexp_count(ops, F.lit("(?<!I)I")) + F.regexp_count(ops, F.lit("(?<!D)D"))
    longer = times(ops, "I") + times(ops, "D") - opens
    return times(ops, "=") * match + times(ops, "X") * (gap_open if mismatch is None else mismatch) + opens * gap_open + longer * gap_extend


def alignment_score(pairs: DataFrame, gap_open: float = -2.0, gap_extend: float = -0.5) -> DataFrame:
    return with_classes(pairs).select("pair_id", score_of(F.col("ops"), gap_open, gap_extend).cast("double").alias("score"))


def cigar_of(ops: Column) -> Column:
    runs = F.regexp_extract_all(ops, F.lit("(=+|X+|I+|D+|M+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), "")


def cigar(pairs: DataFrame) -> DataFrame:
    return with_classes(pairs).select("pair_id", cigar_of(F.col("ops")).alias("cigar"))


def cigar_decode(rows: DataFrame) -> DataFrame:
    """(pair_id, cigar, s1, s2) -> (pair_id, a1, a2): gapped strings again; N skips the second sequence.

    Symbols meet the columns that take one; sorting by column puts them among the gaps.
    """
    runs = F.regexp_extract_all(F.col("cigar"), F.lit(r"(\d+[MIDNX=])"), F.lit(1))
    ops = F.array_join(F.transform(runs, lambda r: F.repeat(F.right(r, F.lit(1)), F.regexp_extract(r, r"\d+", 0).cast("int"))), "")

    def side(c: Column, seq: Column, gaps: str) -> Column:
        spots = F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        taking = F.filter(spots, lambda y: ~y["x"].isin(*gaps))
        full = F.zip_with(taking, symbols(seq), lambda y, z: F.struct(y["i"].alias("i"), F.when(y["x"] == "N", "").otherwise(F.coalesce(z, F.lit(""))).alias("z")))
        free = F.transform(F.filter(spots, lambda y: y["x"].isin(*gaps)), lambda y: F.struct(y["i"].alias("i"), F.when(y["x"] == "N", "").otherwise("-").alias("z")))
        return F.array_join(F.transform(F.array_sort(F.concat(full, free)), lambda y: y["z"]), "")

    return rows.select("pair_id", let(symbols(ops), lambda c: side(c, F.col("s1"), "IN")).alias("a1"), let(symbols(ops), lambda c: side(c, F.col("s2"), "D")).alias("a2"))


def gap_runs(pairs: DataFrame) -> DataFrame:
    """Maximal runs of columns with a gap on either side, numbered from 0."""
    runs = F.regexp_extract_all(F.col("ops"), F.lit("[IDM]+"), F.lit(0))
    return with_classes(pairs).select("pair_id", F.posexplode(runs).alias("run", "r")).select("pair_id", "run", F.length("r").alias("length"))


def gap_histogram(pairs: DataFrame) -> DataFrame:
    return gap_runs(pairs).groupBy("length").agg(F.count("*").alias("runs"))


def gap_bins(pairs: DataFrame, most: int = 20) -> DataFrame:
    """Gap runs in min(``most``, longest run) bins of equal width from the shortest to the longest: bin, low, high, runs.

    The last bin holds its upper border; where all runs are equally long the range is half a symbol on either side.
    """
    runs = gap_runs(pairs)
    ends = runs.agg(F.min("length").alias("a"), F.max("length").alias("b")).where("b is not null")
    ends = ends.select(F.least(F.lit(most), "b").alias("bins"), F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a").cast("double")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b").cast("double")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    counted = runs.groupBy("length").agg(F.count("*").alias("n")).join(F.broadcast(ends))  # one row
    counted = counted.select(F.least(F.floor((F.col("length") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))), F.col("bins") - 1).cast("int").alias("bin"), "n")
    every = ends.select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), F.col("lo"), width.alias("w"))
    sums = counted.groupBy("bin").agg(F.sum("n").alias("runs"))
    return every.join(sums, "bin", "left").select("bin", (F.col("lo") + F.col("w") * F.col("bin")).alias("low"), (F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("high"), F.coalesce("runs", F.lit(0)).alias("runs"))


def gap_explosion(pairs: DataFrame, run: int = 30, fraction: float = 0.15) -> DataFrame:
    """Whether the longest gap run or the share of gap columns reaches its limit; empty alignments don't."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.col("ops"), F.lit("[IDM]+"), F.lit(0)), F.length)), F.lit(0))
    gaps = times(F.col("ops"), "I") + times(F.col("ops"), "D") + times(F.col("ops"), "M")
    return with_classes(pairs).select("pair_id", longest.alias("longest_run"), gaps.alias("gap_columns"), ((F.length("ops") > 0) & ((longest >= run) | (_ratio(gaps, F.length("ops")) >= fraction))).alias("exploded"))


def _windows(rows: DataFrame, size: int | Column, full_only: bool = False) -> DataFrame:
    """Tumbling windows of ``ops``: start and ``w``, the window's classes.  One pass over ``ops`` cuts them all, as
    ``substring`` would walk from the beginning for every window."""
    least = "" if full_only else "1,"
    pattern = F.lit(f".{{{least}{size}}}") if isinstance(size, int) else F.concat(F.lit(".{" + least), size.cast("int").cast("string"), F.lit("}"))
    rows = rows.withColumn("_size", (F.lit(size) if isinstance(size, int) else size).cast("int"))
    rows = rows.select("*", F.posexplode(F.regexp_extract_all("ops", pattern, F.lit(0))).alias("_nth", "w"))
    return rows.withColumn("start", F.col("_nth") * F.col("_size"))


def coverage_windows(pairs: DataFrame, size: int = 100) -> DataFrame:
    rows = _windows(with_classes(pairs), size)
    s = statistics(F.col("w"))
    return rows.select("pair_id", "start", (F.col("start") + F.length("w")).alias("end"), (s["identity"] * 100).alias("identity"), s["matches"].alias("matches"), s["mismatches"].alias("mismatches"), s["total_gaps"].alias("gaps"), s["gap_percentage"].alias("gap_percentage"))


def window_pyramid(pairs: DataFrame, size: int = 100, factor: int = 10, levels: int = 3) -> DataFrame:
    """Windows for plots at any zoom: pair_id, level, start, end and counts; a level's windows are ``factor`` times as wide
    as those of the one below, and sums of them: the columns are read once."""
    rows = _windows(with_classes(pairs), size)
    n = _counts(F.col("w"))
    names = ("matches", "mismatches", "gaps")
    level = rows.select("pair_id", F.col("_nth").alias("nth"), (F.col("start") + F.length("w")).alias("end"), n["matches"].alias("matches"), n["mismatches"].alias("mismatches"), n["total_gaps"].alias("gaps"))
    out, width = [], size
    for i in range(levels):
        out.append(level.select("pair_id", F.lit(i).alias("level"), (F.col("nth") * width).cast("int").alias("start"), "end", *names))
        level = level.groupBy("pair_id", F.floor(F.col("nth") / factor).cast("int").alias("nth")).agg(F.max("end").alias("end"), *[F.sum(c).alias(c) for c in names])
        width *= factor
    return reduce(DataFrame.union, out)


def heatmap_windows(pairs: DataFrame, least: int = 100, parts: int = 50) -> DataFrame:
    """Full windows of max(least, length / parts) columns with strict matches."""
    rows = pairs.select("pair_id", classes(F.col("a1"), F.col("a2"), True).alias("ops"))
    rows = _windows(rows, F.greatest(F.lit(least), F.floor(F.length("ops") / parts)), full_only=True)
    n = _counts(F.col("w"))
    gaps = F.length("w") - n["matches"] - n["mismatches"]
    return rows.select("pair_id", "start", n["matches"].alias("matches"), n["mismatches"].alias("mismatches"), gaps.cast("long").alias("gaps"), _ratio(n["matches"], n["matches"] + n["mismatches"]).alias("identity"))


def identity_curve(pairs: DataFrame, least: int = 100, parts: int = 100) -> DataFrame:
    """Strict identity by position; windows without a column of two bases are left out."""
    rows = pairs.select("pair_id", classes(F.col("a1"), F.col("a2"), True).alias("ops"))
    rows = _windows(rows, F.greatest(F.lit(least), F.floor(F.length("ops") / parts)))
    n = _counts(F.col("w"))
    both = n["matches"] + n["mismatches"]
    return rows.where(both > 0).select("pair_id", "start", (n["matches"] / both).alias("identity"))


def quality_class(pairs: DataFrame) -> DataFrame:
    rows = strict_stats(pairs)
    x = F.col("identity_ungapped")
    return rows.select("pair_id", F.when(x >= 0.9, "EXCELLENT").when(x >= 0.8, "GOOD").when(x >= 0.7, "FAIR").otherwise("POOR").alias("quality_class"))


def sampled_states(pairs: DataFrame, points: int = 1000) -> DataFrame:
    """Every length / min(points, length)-th column as -1 mismatch, 0 gap or 1 strict match."""
    rows = pairs.select("pair_id", classes(F.col("a1"), F.col("a2"), True).alias("ops")).where(F.length("ops") > 0)
    step = F.floor(F.length("ops") / F.least(F.lit(points), F.length("ops"))).cast("int")
    rows = rows.withColumn("_step", step).withColumn("_c", symbols(F.col("ops")))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("ops") - 1, F.col("_step"))))
    c = F.element_at("_c", F.col("pos") + 1)
    return rows.select("pair_id", "pos", F.when(c == "=", 1).when(c == "X", -1).otherwise(0).alias("state"))


def base_composition(pairs: DataFrame) -> DataFrame:
    """Counts of A, C, G and T on each side."""
    return pairs.select("pair_id", *[times(F.col(a), b).cast("long").alias(f"{a}_{b.lower()}") for a in ("a1", "a2") for b in "ACGT"])


def partial_overlaps(pairs: DataFrame) -> DataFrame:
    """Columns whose base sets meet but differ."""

    @F.arrow_udf("long")
    def overlaps(a1: pa.Array, a2: pa.Array) -> pa.Array:
        both = ((x.as_py(), y.as_py()) for x, y in zip(a1, a2))
        return pa.array((None if x is None or y is None else partial_columns(x, y) for x, y in both), pa.int64())

    return pairs.select("pair_id", overlaps("a1", "a2").alias("partial_overlaps"))


def good_ends(ops: str, least: float, width: int) -> tuple[int, int]:
    """The first column whose window forward has ``least`` matches a column, and behind the last whose window backward has;
    both windows are differences of running counts."""
    c = np.frombuffer(ops.encode(), np.uint8)
    n, at = len(c), np.arange(len(c))
    matches, real = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (c == ord("="), c != ord("M")))

    def good(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = real[hi] - real[lo]
        return np.flatnonzero((total > 0) & ((matches[hi] - matches[lo]) / np.maximum(total, 1) >= least))

    ahead, back = good(at, np.minimum(at + width, n)), good(np.maximum(at - width + 1, 0), at + 1)
    return int(ahead[0]) if len(ahead) else 0, int(back[-1]) + 1 if len(back) else n


def trim_ends(pairs: DataFrame, least: float = 0.1, width: int = 10) -> DataFrame:
    """Cut badly conserved ends: from the first column whose window forward has ``least`` matches a column
    (double gaps aside) to the last whose window backward has; unchanged where nothing is left."""

    @F.pandas_udf("start int, end int")
    def ends(ops: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([good_ends(o or "", least, width) for o in ops], columns=["start", "end"])

    rows = with_classes(pairs).withColumn("_e", ends("ops")).select("*", "_e.start", "_e.end")
    keep = F.col("start") < F.col("end")
    cut = lambda a: F.when(keep, F.substring(F.col(a), F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col(a))
    return rows.select("pair_id", cut("a1").alias("a1"), cut("a2").alias("a2"))


def validate_alignment(pairs: DataFrame, longest: int = 1000) -> DataFrame:
    """Problems of a pair: lengths, symbols, all-gap sides, and gap runs over ``longest`` columns."""
    bad = f"[^{VALID[:-1]}{VALID[:-1].lower()}-]"
    n = F.least(F.length("a1"), F.length("a2"))
    wrong = lambda a: F.regexp_count(F.substring(F.col(a), F.lit(1), n), F.lit(bad))
    runs = F.transform(F.regexp_extract_all(F.col("ops"), F.lit("[IDM]+"), F.lit(0)), F.length)
    rows = with_classes(pairs)
    rows = rows.select("pair_id", (F.length("a1") != F.length("a2")).alias("length_mismatch"), (wrong("a1") + wrong("a2")).cast("long").alias("invalid_symbols"), ((ungapped(F.col("a1")) == "") | (ungapped(F.col("a2")) == "")).alias("all_gaps"), (F.coalesce(F.array_max(runs), F.lit(0)) > longest).alias("long_gap"))
    return rows.withColumn("valid", ~F.col("length_mismatch") & (F.col("invalid_symbols") == 0) & ~F.col("all_gaps") & ~F.col("long_gap"))


def positional_identity(pairs: DataFrame) -> DataFrame:
    n = _counts(F.col("ops"))
    return with_classes(pairs).select("pair_id", (_ratio(n["matches"], n["matches"] + n["mismatches"]) * 100).alias("identity"))


def quick_score(pairs: DataFrame, match: float = 1.0) -> DataFrame:
    """Equal symbols at equal positions, gaps included."""
    equal = F.size(F.filter(F.zip_with(symbols(F.col("a1")), symbols(F.col("a2")), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda b: b))
    return pairs.select("pair_id", (equal * match).cast("double").alias("score"))
