"""Alignment of pairs (pair_id, s1, s2) as DataFrame operators around the kernels."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import columns, kernels, lockstep

ALIGNED = "pair_id long, score double, a1 string, comp string, a2 string, status string"


def _tasks(rows: DataFrame) -> int:
    """Three tasks a core: pairs of a task are aligned together, so many small tasks would cost more."""
    return 3 * rows.sparkSession.sparkContext.defaultParallelism


def _gathered(batches, of: list[str], rows: int = 10_000, symbols: int = 1 << 25):
    """Arrow batches put together up to so many rows or symbols of the columns ``of``: kernels take many pairs at once, however small
    the session's batches are."""
    held, n, size = [], 0, 0
    for pdf in batches:
        held.append(pdf)
        n, size = n + len(pdf), size + sum(int(pdf[c].str.len().sum()) for c in of)
        if n >= rows or size >= symbols:
            yield pd.concat(held, ignore_index=True)
            held, n, size = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _each(pairs: DataFrame, columns: list[str], schema: str, many) -> DataFrame:
    """Apply ``many`` to each Arrow batch's ``columns``, a list of rows in and one out; pair_id goes along.

    Rows are dealt out before, to a set number of tasks: a row is little data and much work, so tasks must not be put together by
    their bytes.
    """

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in _gathered(batches, columns):
            found = many([tuple(v or "" for v in row) for row in zip(*(pdf[c] for c in columns))])
            yield pd.DataFrame([(key, *row) for key, row in zip(pdf["pair_id"], found)], columns=names)

    return pairs.select("pair_id", *columns).repartition(_tasks(pairs), "pair_id").mapInPandas(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], types: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), types)], [n for n, _ in types])


def _window(a: str, b: str) -> int:
    """The band is a fifth of the shorter, 10 to 100."""
    return min(100, max(10, min(len(a), len(b)) // 5))


def overlap_align(pairs: DataFrame, match: float = 1.0, mismatch: float = -1.0, gap: float = -1.0) -> DataFrame:
    """Global alignment with linear gaps."""
    return _each(pairs, ["s1", "s2"], "pair_id long, score double, a1 string, a2 string", lambda rows: [r[:3] for r in lockstep.affine(rows, match, mismatch, gap, gap)])


def beam_align(pairs: DataFrame, gap_open: float = -2.0, gap_extend: float = -0.5, width: int = 30) -> DataFrame:
    """Banded beam alignment with the full one as fallback."""
    return _each(pairs, ["s1", "s2"], ALIGNED, lambda rows: lockstep.align_safely(rows, gap_open, gap_extend, [_window(*r) for r in rows], width))


def affine_align(pairs: DataFrame, local: bool = False, match: float = 1.0, mismatch: float = -1.0, gap_open: float = -2.0, gap_extend: float = -0.5) -> DataFrame:
    """Three-state affine alignment, global or local, with the places where it starts."""
    schema = "pair_id long, score double, a1 string, a2 string, start1 int, start2 int"
    return _each(pairs, ["s1", "s2"], schema, lambda rows: lockstep.affine(rows, match, mismatch, gap_open, gap_extend, local))


def align_chunks(pairs: DataFrame, chunks: DataFrame, gap_open: float = -2.0, gap_extend: float = -0.5, width: int = 30) -> DataFrame:
    """Chunks joined with their sequences, each aligned by itself: chunk columns, score, a1, comp, a2, status."""
    names = ["cid", "q_start", "q_end", "t_start", "t_end"]
    rows = chunks.groupBy("pair_id").agg(F.collect_list(F.struct(*names)).alias("chunks")).join(pairs.select("pair_id", "s1", "s2"), "pair_id")

    def cut(batches):
        """A pair's sequences are read once, whatever the number of its chunks; many pairs' chunks go on together."""
        held, size = [], 0
        for batch in batches:
            keys, parts, s1s, s2s = batch.columns
            ends = parts.offsets.to_pylist()
            flat = parts.values.flatten() if isinstance(parts.values, pa.StructArray) else []
            places = list(zip(*(c.to_pylist() for c in flat)))
            for i, key in enumerate(keys.to_pylist()):
                s1, s2 = s1s[i].as_py(), s2s[i].as_py()
                for p in places[ends[i] : ends[i + 1]]:
                    held.append((key, *p, s1[p[1] : p[2]], s2[p[3] : p[4]]))
                    size += p[2] - p[1] + p[4] - p[3]
                    if len(held) >= 10_000 or size >= 1 << 23:
                        yield _batch(held, cut_types)
                        held, size = [], 0
        if held:
            yield _batch(held, cut_types)

    cut_types = [("pair_id", pairs.schema["pair_id"].dataType.simpleString()), *[(n, "int") for n in names], ("x", "string"), ("y", "string")]
    # Little data and much work: dealt out by number, as tasks must not be put together by their bytes.
    rows = rows.select("pair_id", "chunks", "s1", "s2").repartition(_tasks(pairs), "pair_id")
    rows = rows.mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in cut_types))

    def run(batches):
        for pdf in _gathered(batches, ["x", "y"]):
            both = list(zip(pdf.x, pdf.y))
            got = lockstep.align_safely(both, gap_open, gap_extend, [_window(*r) for r in both], width)
            out = pdf[["pair_id", "cid", "q_start", "q_end", "t_start", "t_end"]].copy()
            for i, name in enumerate(("score", "a1", "comp", "a2", "status")):
                out[name] = [g[i] for g in got]
            yield out

    return rows.repartition(_tasks(pairs), "pair_id", "cid").mapInPandas(run, "pair_id long, cid int, q_start int, q_end int, t_start int, t_end int, score double, a1 string, comp string, a2 string, status string")


def stitch_blocks(aligned: DataFrame) -> DataFrame:
    """Alignments of pairs in blocks: (pair_id, block, a1, a2), whatever the length of a pair.

    A junction join: each chunk meets only its successor, in a row of two chunks' strings, and gives the columns from where its
    predecessors end to where the successor goes on alone.  How far chunks before it reach is a running maximum over
    rows of numbers only.  Blocks in order, put together, are the whole alignment.
    """
    by = Window.partitionBy("pair_id").orderBy("cid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    reach = aligned.select("pair_id", "cid", F.lead("cid").over(by).alias("next"), *[F.coalesce(F.max(f"{s}_end").over(before), F.lit(0)).alias(f"{s}_reach") for s in "qt"])
    names = ["q_start", "q_end", "t_start", "t_end", "a1", "a2"]
    right = aligned.select("pair_id", F.col("cid").alias("next"), *[F.col(n).alias(f"r_{n}") for n in names])
    both = aligned.select("pair_id", "cid", *names).join(reach, ["pair_id", "cid"]).join(right, ["pair_id", "next"], "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                left, after = kernels.Piece(r.q_start, r.t_start, r.a1, r.a2), None
                if isinstance(r.r_a1, str):
                    after = kernels.Piece(int(r.r_q_start), int(r.r_t_start), r.r_a1, r.r_a2)
                ends = (int(r.r_q_end), int(r.r_t_end)) if after else (0, 0)
                rows.append((r.pair_id, r.cid, *kernels.junction(left, after, (r.q_reach, r.t_reach), (r.q_end, r.t_end), ends)))
            yield pd.DataFrame(rows, columns=["pair_id", "block", "a1", "a2"])

    return both.mapInPandas(run, "pair_id long, block int, a1 string, a2 string")


def measure_blocks(blocks: DataFrame, gap_open: float = -2.0, gap_extend: float = -0.5) -> DataFrame:
    """Statistics and score of each pair's alignment from its blocks (pair_id, block, a1, a2): no pair's strings in one row.

    What a block can't know is whether a gap goes on from the block before.  Each block hands on the class of its last column, for the
    score that of its last column but double gaps; blocks that have none hand on what they got.  A gap
    that goes on at a seam is priced as an extension, and is no new opening.
    """
    rows = columns.with_classes(blocks)
    ops, bare = F.col("ops"), F.replace(F.col("ops"), F.lit("M"))
    s = columns.statistics(ops)
    parts = ("matches", "mismatches", "insertions", "deletions", "gap_openings")
    last = lambda c: F.nullif(F.right(c, F.lit(1)), F.lit(""))
    rows = rows.select(
        "pair_id", "block", *[s[n].alias(n) for n in parts], columns.score_of(ops, gap_open, gap_extend).cast("double").alias("score"), F.length(ops).cast("long").alias("columns"),
        F.left(ops, F.lit(1)).alias("first"), last(ops).alias("last"), F.left(bare, F.lit(1)).alias("first_bare"), last(bare).alias("last_bare"))
    before = Window.partitionBy("pair_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"got{x}": F.coalesce(F.last(f"last{x}", True).over(before), F.lit("")) for x in ("", "_bare")})
    seam = F.col("first").isin("I", "D") & F.col("got").isin("I", "D", "M")
    on = F.col("first_bare").isin("I", "D") & (F.col("first_bare") == F.col("got_bare"))
    rows = rows.withColumns({"gap_openings": F.col("gap_openings") - seam.cast("long"), "score": F.col("score") + F.when(on, gap_extend - gap_open).otherwise(0.0)})
    sums = rows.groupBy("pair_id").agg(*[F.sum(n).alias(n) for n in (*parts, "score", "columns")], F.count("*").alias("blocks"))
    aligned = F.col("matches") + F.col("mismatches") + F.col("insertions") + F.col("deletions")
    sums = sums.withColumns({"total_aligned": aligned, "total_gaps": F.col("insertions") + F.col("deletions")})
    return sums.withColumn("identity", F.when(F.col("total_aligned") > 0, F.col("matches") / F.col("total_aligned")).otherwise(0.0))


def stitch_chunks(aligned: DataFrame) -> DataFrame:
    """One alignment a pair as whole strings: pair_id, total_score (the chunks' sum), a1, comp, a2.

    For pairs whose strings fit a row; ``stitch_blocks`` has no such limit.
    """
    total = aligned.groupBy("pair_id").agg(F.sum("score").alias("total_score"))
    parts = stitch_blocks(aligned).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("block", "a1", "a2"))).alias("p"))
    rows = parts.select("pair_id", *[F.array_join(f"p.{a}", "").alias(a) for a in ("a1", "a2")]).join(total, "pair_id")
    comp = F.translate(columns.classes(F.col("a1"), F.col("a2")), "=XIDM", "|    ")
    return rows.select("pair_id", "total_score", "a1", comp.alias("comp"), "a2")


def chunk_topk(aligned: DataFrame, k: int) -> DataFrame:
    """The ``k`` best-scoring chunks of each pair; the first among equals."""
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("score"), "cid"))
    return aligned.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def score_filter(aligned: DataFrame, least: float) -> DataFrame:
    return aligned.where(F.col("score") >= least)


def chunk_counts(aligned: DataFrame) -> DataFrame:
    """Matches and gaps of each chunk's columns."""
    from ..functions.features import times

    gaps = times(F.col("a1"), "-") + times(F.col("a2"), "-")
    return aligned.select("pair_id", "cid", F.length("a1").alias("columns"), times(F.col("comp"), "|").alias("matches"), gaps.alias("gaps"))
