"""Profiles of sequences and of measurements: FASTA statistics, k-mers, features, compatibility, run metrics."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import VALID
from ..functions.features import entropy, gc_percent, times, ungapped, window_heuristic
from .columns import symbols
from .kernels import column_classes


def fasta_stats(sequences: DataFrame) -> DataFrame:
    """Number of sequences, total, least, greatest and mean length, GC percent over all bases."""
    n, gc = F.length("seq"), times(F.upper("seq"), "G") + times(F.upper("seq"), "C")
    rows = sequences.agg(F.count("seq").alias("sequences"), F.coalesce(F.sum(n), F.lit(0)).alias("total_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"), F.sum(gc).alias("_gc"))
    return rows.select("sequences", "total_length", "min_length", "max_length", "avg_length", F.when(F.col("total_length") > 0, F.col("_gc") / F.col("total_length") * 100).otherwise(0.0).alias("gc_percent"))


def gc_entropy(sequences: DataFrame, key: str = "doc_id") -> DataFrame:
    return sequences.select(key, F.length(ungapped(F.col("seq"))).alias("length"), gc_percent(F.col("seq")).alias("gc"), entropy(F.col("seq")).alias("entropy"))


def kmer_counts(sequences: DataFrame, k: int = 3, key: str = "doc_id") -> DataFrame:
    """Counts and frequencies of k-mers; each row is counted in an Arrow pass, and only its different k-mers are exploded and shuffled."""

    @F.arrow_udf("array<struct<kmer:string,c:long>>")
    def counted(seqs: pa.Array) -> pa.Array:
        offsets, found, counts = [0], [], []
        for s in seqs:
            words, c = _counted(s.as_py() or "", k)
            found += words
            counts += c
            offsets.append(len(found))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(counts, pa.int64())], ["kmer", "c"]))

    rows = sequences.select(key, F.greatest(F.length(ungapped(F.col("seq"))) - (k - 1), F.lit(0)).alias("_n"), F.explode(counted(F.upper(ungapped(F.col("seq"))))).alias("k"))
    return rows.groupBy(key, F.col("k.kmer").alias("kmer"), "_n").agg(F.sum("k.c").alias("n")).select(key, "kmer", "n", (F.col("n") / F.col("_n")).alias("frequency"))


def _counted(seq: str, k: int) -> tuple[list[str], list[int]]:
    """Different k-mers of any symbols and their counts: up to seven ASCII symbols are one number."""
    if not seq.isascii() or k > 7:
        found = Counter(seq[i : i + k] for i in range(len(seq) - k + 1))
        return list(found), list(found.values())
    raw = np.frombuffer(seq.encode(), np.uint8)
    n = max(0, len(raw) - k + 1)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code = code << 8 | raw[i : n + i]
    code, counts = np.unique(code, return_counts=True)
    return [c.to_bytes(k).decode() for c in code.tolist()], counts.tolist()


_BASES = np.full(256, -1, np.int64)
_BASES[list(b"ACGT")] = range(4)


def _kmer_codes(seq: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of a sequence's k-mers over A, C, G and T, and their counts."""
    codes = _BASES[np.frombuffer((seq or "").replace("-", "").upper().encode("latin-1", "replace"), np.uint8)]
    n = max(0, len(codes) - k + 1)
    code, good = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = codes[i : n + i]
        code, good = code * 4 + part, good & (part >= 0)
    return np.unique(code[good], return_counts=True)


def kmer_cosine(pairs: DataFrame, k: int = 3) -> DataFrame:
    """(pair_id, s1, s2) -> cosine of their k-mer counts over A, C, G, T; 0 where one has none.  Counts stay in the
    row: no shuffle.  ``k`` up to 31."""

    return pairs.select("pair_id", _cosine(k)("s1", "s2").alias("cosine"))


def _cosine(k: int):
    @F.arrow_udf("double")
    def cosine(first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for s1, s2 in zip(first, second):
            (x, a), (y, b) = _kmer_codes(s1.as_py(), k), _kmer_codes(s2.as_py(), k)
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            norm = math.sqrt(int((a * a).sum())) * math.sqrt(int((b * b).sum()))
            out.append(int((a[i] * b[j]).sum()) / norm if norm else 0.0)
        return pa.array(out, pa.float64())

    return cosine


def _identity():
    """Percent of equal symbols of either case among the places where neither sequence has a gap, up to the shorter one's end."""

    @F.arrow_udf("double")
    def identity(first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for s1, s2 in zip(first, second):
            ops = column_classes(s1.as_py() or "", s2.as_py() or "")
            same, other = ops.count("="), ops.count("X")
            out.append(same / (same + other) * 100 if same + other else 0.0)
        return pa.array(out, pa.float64())

    return identity


def pair_features(pairs: DataFrame) -> DataFrame:
    """Ten features of a pair (pair_id, s1, s2)."""
    rows = pairs.select(
        "pair_id", gc_percent(F.col("s1")).alias("seq1_gc"), gc_percent(F.col("s2")).alias("seq2_gc"),
        entropy(F.col("s1")).alias("seq1_entropy"), entropy(F.col("s2")).alias("seq2_entropy"),
        F.length(ungapped(F.col("s1"))).alias("seq1_length"), F.length(ungapped(F.col("s2"))).alias("seq2_length"),
        _identity()("s1", "s2").alias("seq_identity"), _cosine(3)("s1", "s2").alias("_cosine"))
    return rows.withColumns({"gc_ratio_diff": F.abs(F.col("seq1_gc") - F.col("seq2_gc")), "length_diff": F.abs(F.col("seq1_length") - F.col("seq2_length")), "kmer_similarity": F.col("_cosine")}).drop("_cosine")


def window_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", window_heuristic(F.length("s1"), F.length("s2")).alias("window"))


def alphabet_problems(sequences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per sequence: whether it is empty, and its different symbols outside the alphabet, joined in order."""
    bad = F.array_sort(F.array_distinct(F.filter(symbols(F.col("seq")), lambda c: ~c.rlike(f"^[{VALID[:-1]}{VALID[:-1].lower()}-]$"))))
    return sequences.select(key, (F.length("seq") == 0).alias("empty"), F.size(bad).alias("invalid_symbols"), (F.size(bad) == 0).alias("valid"))


def compatibility(pairs: DataFrame, ratio: float = 100.0, gc_points: float = 50.0) -> DataFrame:
    """Whether two sequences can be aligned, and why not: empty, too different in length or in GC."""
    n1, n2 = F.length("s1"), F.length("s2")
    least = F.least(n1, n2)
    apart = F.abs(gc_percent(F.col("s1")) - gc_percent(F.col("s2")))
    reason = F.when(least == 0, "empty").when(F.greatest(n1, n2) / F.when(least > 0, least) > ratio, "length ratio").when(apart > gc_points, "gc difference").otherwise("")
    return pairs.select("pair_id", (reason == "").alias("compatible"), reason.alias("reason"))


def run_metrics(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Count, extremes, mean and sample deviation (0 for one sample)."""
    return samples.groupBy(by).agg(F.count(value).alias("samples"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("avg_value"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_value"))


def speedups(timed: DataFrame, by: str, slow: str, fast: str) -> DataFrame:
    """Mean, least and greatest ratio of two timings."""
    r = F.col(slow) / F.when(F.col(fast) != 0, F.col(fast))
    return timed.groupBy(by).agg(F.avg(r).alias("avg_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"))
