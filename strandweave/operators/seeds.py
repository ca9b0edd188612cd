"""Seeds of sequences (key, seq): s-mer hashes, open syncmers, randstrobes.

A hash depends on content alone: the base-4 code of the s-mer times a fixed multiplier modulo a fixed prime.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import let
from .columns import symbols

# Fixed values of the hash.
MULTIPLIER = 2654435761
PRIME = 4294967291


def smer_hashes(seq: Column, s: int) -> Column:
    """Hashes of all s-mers of a sequence over A, C, G and T."""
    codes = F.transform(symbols(seq), lambda b: (F.instr(F.lit("ACGT"), b) - 1).cast("long"))
    n = F.length(seq) - s

    def one(c: Column, p: Column) -> Column:
        code = F.get(c, p)
        for i in range(1, s):
            code = code * 4 + F.get(c, p + i)
        return F.pmod(code * MULTIPLIER, F.lit(PRIME))

    return F.when(n >= 0, let(codes, lambda c: F.transform(F.sequence(F.lit(0), n), lambda p: one(c, p)))).otherwise(F.expr("cast(array() as array<bigint>)"))


def syncmer_marks(seq: Column, k: int = 10, s: int = 3, offset: int = 2) -> Column:
    """Array of (pos, hash) of a sequence's open syncmers: k-mers whose least s-mer hash, the rightmost among equals,
    lies at ``offset``."""
    width = k - s + 1

    def chosen(h: Column, p: Column) -> Column:
        m = F.get(h, p + offset)
        later = F.slice(h, p + offset + 2, F.lit(width - offset - 1))
        last = ~F.array_contains(later, m) if offset < width - 1 else F.lit(True)
        return (m == F.array_min(F.slice(h, p + 1, F.lit(width)))) & last

    def found(h: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(h) - width), lambda p: chosen(h, p))
        return F.transform(places, lambda p: F.struct(p.alias("pos"), F.get(h, p + offset).alias("hash")))

    none = F.expr("cast(array() as array<struct<pos:int,hash:bigint>>)")
    return let(smer_hashes(seq, s), lambda h: F.when(F.size(h) >= width, found(h)).otherwise(none))


_CODES = np.full(256, -1, np.int64)
_CODES[list(b"ACGT")] = range(4)


def syncmer_places(seq: str, k: int, s: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of one sequence's open syncmers; the rule of ``syncmer_marks`` over arrays."""
    codes = _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    width, n = k - s + 1, len(codes) - s + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = codes[:n].copy()
    for i in range(1, s):
        code = code * 4 + codes[i : n + i]
    h = code * MULTIPLIER % PRIME
    m = n - width + 1
    mine, good = h[offset : offset + m], np.ones(m, bool)
    for i in range(width):
        if i != offset:
            good &= mine <= h[i : i + m] if i < offset else mine < h[i : i + m]
    at = np.flatnonzero(good)
    return at, mine[at]


def _joined(parts) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _rows(key: pa.Array, sizes: list[int], columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    owner = key.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    return pa.RecordBatch.from_arrays([owner, *(pa.array(v.astype(np.int64 if n == "hash" else np.int32)) for n, v in columns.items())], ["key", *columns])


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumnRenamed("key", key)


def syncmers(seqs: DataFrame, key: str = "doc_id", k: int = 10, s: int = 3, offset: int = 2) -> DataFrame:
    """Open syncmers of each sequence, a row each.  Narrow: one Arrow pass, each sequence in its own row."""

    def run(batches):
        for batch in batches:
            found = [syncmer_places(t, k, s, offset) for t in batch.column(1).fill_null("").to_pylist()]
            yield _rows(batch.column(0), [len(p) for p, _ in found], {n: _joined(f[i] for f in found) for i, n in enumerate(("pos", "hash"))})

    return _named(seqs.select(key, "seq").mapInArrow(run, f"key {seqs.schema[key].dataType.simpleString()}, pos int, hash long"), key)


def dense(strobes: DataFrame, bits: int = 8) -> DataFrame:
    """Keep strobes whose lowest ``bits`` hash bits are 0."""
    return strobes.where(F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)) == 0)


def randstrobes(marks: DataFrame, key: str = "doc_id", k: int = 10, w_min: int = 10, w_max: int = 30) -> DataFrame:
    """Link each syncmer with the one ``w_min``..``w_max`` ahead that makes the XOR of hashes least (the first
    among equals).  An equi-join on position buckets of ``w_max``, so that a long sequence is dealt out."""
    first = marks.select(key, F.col("pos").alias("pos1"), F.col("hash").alias("h1"))
    first = first.withColumn("_b", F.explode(F.sequence(F.floor((F.col("pos1") + w_min) / w_max), F.floor((F.col("pos1") + w_max) / w_max))))
    second = marks.select(key, F.col("pos").alias("pos2"), F.col("hash").alias("h2"), F.floor(F.col("pos") / w_max).alias("_b"))
    both = first.join(second, [key, "_b"]).where(F.col("pos2").between(F.col("pos1") + w_min, F.col("pos1") + w_max))
    best = both.groupBy(key, "pos1").agg(F.min(F.struct(F.col("h1").bitwiseXOR(F.col("h2")).alias("hash"), F.col("pos2"))).alias("b"))
    return best.select(key, "pos1", F.col("b.pos2").alias("pos2"), F.col("b.hash").alias("hash"), (F.col("b.pos2") - F.col("pos1")).alias("span"), F.lit(2 * k).alias("length"))


def linked(pos: np.ndarray, h: np.ndarray, w_min: int, w_max: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos1, pos2, hash) of one sequence's randstrobes from its syncmers in order; by blocks, so that long ones need no long
    tables."""
    out = []
    for a in range(0, len(pos), step):
        p, g = pos[a : a + step], h[a : a + step]
        lo, hi = np.searchsorted(pos, p + w_min), np.searchsorted(pos, p + w_max, "right")
        real = np.flatnonzero(hi > lo)
        n = (hi - lo)[real]
        if not len(n):
            continue
        first = np.cumsum(n) - n
        other = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(lo[real], n)
        both = np.repeat(g[real], n) ^ h[other]
        least = np.minimum.reduceat(both, first)
        # The first of equals: others are pushed behind the end.
        at = np.minimum.reduceat(np.where(both == np.repeat(least, n), other, len(pos)), first)
        out.append((p[real], pos[at], least))
    return tuple(_joined(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def strobes(seqs: DataFrame, key: str = "doc_id", k: int = 10, s: int = 3, offset: int = 2, w_min: int = 10, w_max: int = 30) -> DataFrame:
    """Randstrobes of each sequence (key, seq), as ``randstrobes`` of its syncmers gives them: one Arrow pass, no shuffle."""

    def run(batches):
        for batch in batches:
            found = [linked(*syncmer_places(t, k, s, offset), w_min, w_max) for t in batch.column(1).fill_null("").to_pylist()]
            columns = {n: _joined(f[i] for f in found) for i, n in enumerate(("pos1", "pos2", "hash"))}
            span = columns["pos2"] - columns["pos1"]
            yield _rows(batch.column(0), [len(f[0]) for f in found], columns | {"span": span, "length": np.full(len(span), 2 * k)})

    kind = seqs.schema[key].dataType.simpleString()
    return _named(seqs.select(key, "seq").mapInArrow(run, f"key {kind}, pos1 int, pos2 int, hash long, span int, length int"), key)


def strobe_index(strobes: DataFrame, key: str = "doc_id", most: int = 200) -> DataFrame:
    """Positions of each hash that occurs at most ``most`` times in its sequence."""
    rows = strobes.groupBy(key, "hash").agg(F.count("*").alias("occurrences"), F.sort_array(F.collect_list("pos1")).alias("positions"))
    return rows.where(F.col("occurrences") <= most)


def capped(strobes: DataFrame, key: str = "doc_id", most: int = 200) -> DataFrame:
    """Strobes whose hash occurs at most ``most`` times in their sequence; counted before they are joined."""
    rare = strobes.groupBy(key, "hash").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).drop("_n")
    return strobes.join(rare, [key, "hash"], "left_semi")
