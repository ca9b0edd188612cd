"""Packing documents into sequences: minimum bin slack over a histogram of lengths.

Every document is tokenized, its end id added, and cut into full windows and one remainder.  The planner
sees only how many remainders have which length (at most ``window`` numbers, whatever the input's size).  The
longest remaining length opens a window; a bitset subset-sum program finds the multiset of remaining
lengths that fills it closest to capacity, and walking the bitsets back gives the counts.  The same filling is
taken as often as the counts allow, so there are few more fillings than lengths.  Remainders
get their places from their rank among those of equal length.

Nulls and empty texts hold the end id alone.  Rows with equal ids are packed each for itself.  A table without
rows gives none.  Further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .tokens import codec


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is the largest up to ``capacity``."""
    reach, steps, full = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, unit = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(unit, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, unit = left - take, unit * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, per sequence, first sequence, offset) that place every remainder."""
    left, taken, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c - (n == longest) > 0}
        used = best_fill(rest, window - longest)
        used[longest] = used.get(longest, 0) + 1
        times, offset = min(left[n] // c for n, c in used.items()), 0
        for n in sorted(used, reverse=True):
            c = used[n]
            rows.append((n, taken[n], taken[n] + c * times, c, sequence, offset))
            offset += c * n
            taken[n] += c * times
            left[n] -= c * times
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def pieces(docs: DataFrame, path: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Full windows and remainders of every document: id, start, length, ids_crc32, doc_tokens, ids (or null)."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for key, ids in zip(part.column(0).to_pylist(), codec(path).encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.array(end_id, ids.dtype)).astype("<u4")
                    for s in range(0, len(ids), window):
                        raw = ids[s : s + window].tobytes()
                        for k, v in zip(rows, (key, s, len(raw) // 4, zlib.crc32(raw), len(ids), raw if keep_ids else None)):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema([(k, pa.binary() if k == "ids" else pa.int64()) for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "ids")])
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return out.mapInArrow(cut, "id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False, salts: int | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``keep_ids``, ids.

    A sequence's pieces lie side by side from offset 0; nothing but a sequence's end is padding.  Pieces are numbered in
    ``salts`` parts for each length (16 times as many for full ones).
    """
    spark = docs.sparkSession
    if id_col != "doc_id":
        docs = docs.drop("doc_id") if "doc_id" in docs.columns else docs
    cut = written(pieces(docs, path, end_id, window, id_col, text, keep_ids).withColumn("_at", F.monotonically_increasing_id()), "pieces")
    salts = salts or max(64, cut.count() // 1_000_000)  # windows that number pieces: none grows with the table
    at = F.when(F.col("id").isNull(), F.col("_at"))  # rows without id are dealt by their place
    short = cut.where(F.col("length") < window).withColumn("_salt", F.pmod(F.xxhash64("id", at), F.lit(salts)).cast("int"))
    full = cut.where(F.col("length") == window).withColumn("_salt", F.pmod(F.xxhash64("id", "start", at), F.lit(salts * 16)).cast("int"))

    def ranked(df, keys, counts):
        before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.select(*keys, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
        own = Window.partitionBy(*keys, "_salt").orderBy("id", "start", "_at")
        return df.join(base, [*keys, "_salt"]).withColumn("_rank", F.col("_base") + F.row_number().over(own) - 1)

    counts = short.groupBy("length", "_salt").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most window rows
    rows = plan(histogram, window)
    sequences = max((r[4] + (r[2] - r[1]) // r[3] for r in rows), default=0)
    by_length: dict[int, np.ndarray] = {n: np.array([r[1:] for r in rows if r[0] == n], np.int64) for n in histogram}
    shared = spark.sparkContext.broadcast(by_length)  # a few thousand rows: fillings exhaust lengths
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(6).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows_of in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[rows_of[0]])
                table = shared.value[n]
                row = table[np.searchsorted(table[:, 0], rank[rows_of], "right") - 1]
                nth = rank[rows_of] - row[:, 0]
                sequence[rows_of] = row[:, 3] + nth // row[:, 2]
                offset[rows_of] = row[:, 4] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
    placed = ranked(short, ["length"], counts).select(*names, "_rank").mapInArrow(place, schema)
    whole = ranked(full, [], full.groupBy("_salt").count()).select(*names, (F.col("_rank") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = placed.union(whole).withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")
