"""Band widths learned from alignments: a linear model of a pair's ten features, fitted from sums that Spark adds up.

What is learned is the least band that loses nothing: the furthest that an alignment strays from the diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import window_heuristic

FEATURES = ("seq1_gc", "seq2_gc", "gc_ratio_diff", "seq1_entropy", "seq2_entropy", "seq1_length", "seq2_length", "length_diff", "seq_identity", "kmer_similarity")


def needed_band(aligned: DataFrame) -> DataFrame:
    """(pair_id, band): the greatest difference of places in both sequences along an alignment (pair_id, a1, a2)."""

    @F.pandas_udf("long")
    def furthest(a1: pd.Series, a2: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a1, a2):
            x, y = (np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8) != 45 for s in (x, y))
            n = min(len(x), len(y))
            out.append(int(np.abs(np.cumsum(x[:n]) - np.cumsum(y[:n], dtype=np.int64)).max(initial=0)))
        return pd.Series(out)

    return aligned.select("pair_id", furthest("a1", "a2").alias("band"))


def moments(rows: DataFrame, target: str = "band", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(a, b, value) for all pairs of features, the constant ``one`` and the target: means of their products.

    One aggregation of sums, partial in each task; its size depends on the number of features alone.
    """
    names = ("one", *features, target)
    value = {"one": F.lit(1.0), **{n: F.col(n).cast("double") for n in (*features, target)}}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.agg(*[F.avg(value[a] * value[b]).alias(f"m{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m{i}").alias("value")) for i, (a, b) in enumerate(pairs)])).alias("m")).select("m.*")


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    spread: float  # of what the model leaves unexplained


def fit(means: DataFrame, target: str = "band", ridge: float = 1e-9) -> Model | None:
    """Weights from ``moments`` by the normal equations; None where there was nothing to learn from."""
    held = {(r.a, r.b): r.value for r in means.collect()}
    if not held or held[target, target] is None:
        return None
    names = tuple(dict.fromkeys(a for a, _ in held if a != target))
    at = lambda a, b: held.get((a, b), held.get((b, a)))
    x = np.array([[at(a, b) for b in names] for a in names])
    y = np.array([at(a, target) for a in names])
    scale = np.sqrt(np.maximum(x.diagonal(), 1e-12))
    x, y = x / scale[:, None] / scale[None, :], y / scale
    w = np.linalg.solve(x + ridge * np.eye(len(names)), y)
    left = max(0.0, held[target, target] - 2 * w @ y + w @ x @ w)
    return Model(names, tuple((w / scale).tolist()), float(np.sqrt(left)))


def predicted(model: Model | None, spreads: float = 2.0, least: int = 10) -> Column:
    """Band of a row of features: the model's value and ``spreads`` of its spread more, at least ``least`` and what the lengths
    differ by; without a model the rule of lengths."""
    n1, n2 = F.col("seq1_length"), F.col("seq2_length")
    if model is None:
        return window_heuristic(n1, n2)
    value = sum((F.lit(w) * (F.lit(1.0) if n == "one" else F.col(n)) for n, w in zip(model.names, model.weights)), F.lit(spreads * model.spread))
    return F.greatest(F.ceil(value), F.lit(least), F.abs(n1 - n2)).cast("int")
