"""Token-id output: a content-addressed store of id chunks.

Rolling hashes cut every document's id stream into chunks, so copies and shared passages give equal
chunks; a chunk is stored once under the SHA-256 of its bytes.  A document's recipe lists its chunks, its
Merkle root covers them, and a tree of roots in id order ends in the manifest's one root.

Layout of a store folder (Parquet): ``stored/kind=chunk`` (digest, n_ids, ids little-endian),
``stored/kind=recipe`` (ascending id: digests, root), ``index`` (ascending id: start, n_tokens, root) and ``manifest``
(level, node, first and last position, hash).

Nulls and empty texts are encoded as empty (the end id alone).  Every row gets a recipe, repeated rows too;
rows with equal ids keep their number and are ordered by their roots.  An empty table makes an empty store.
Further columns of the table are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, real_id, running_starts, safe_id, written
from .tokens import codec, slices

WINDOW_DOUBLINGS = 4  # the rolling hash sees 2**4 ids
FANOUT = 1024
_DIGEST = 32


def _gear(size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, size, np.uint64)


def cut(ids: np.ndarray, doc_ends: np.ndarray, gear: np.ndarray, mean: int = 1024, least: int = 256, most: int = 8192) -> list[list[int]]:
    """Ends of the chunks of each document in a row of id streams: a chunk ends where the rolling hash's top
    bits are 0.  What the hash sees of the document before is without effect, as ``least`` exceeds its window."""
    h = gear[ids & (len(gear) - 1)]
    for k in range(WINDOW_DOUBLINGS):
        shift = 1 << k
        if len(h) > shift:
            h = np.concatenate([h[:shift], h[shift:] + (h[:-shift] << np.uint64(shift))])
    marks = np.flatnonzero((h >> np.uint64(20)) % np.uint64(mean) == 0) + 1
    splits = np.searchsorted(marks, doc_ends, "right").tolist()
    marks, out, at, first = marks.tolist(), [], 0, 0
    for end, last in zip(doc_ends.tolist(), splits):
        ends = []
        for m in marks[first:last]:
            while m - at > most:
                at += most
                ends.append(at)
            if m - at >= least:
                ends.append(m)
                at = m
        while end - at > most:
            at += most
            ends.append(at)
        if at < end:
            ends.append(end)
        at, first = end, last
        out.append(ends)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node goes up unchanged."""
    level = [hashlib.sha256(b"\x00" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the store.  Each text is encoded once; payloads are shuffled once, after
    each task has dropped the chunks it has already sent."""
    spark = docs.sparkSession

    def encode(batches):
        gear, part, n = _gear(), (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, stop in slices(texts):
                piece = batch.slice(at, stop - at)
                streams = codec(path).encode(texts[at:stop])
                end = np.array([end_id], streams[0].dtype)
                flat = np.concatenate([x for ids in streams for x in (ids, end)])
                doc_ends = np.cumsum([len(ids) + 1 for ids in streams])
                cuts, size = cut(flat, doc_ends, gear), flat.dtype.itemsize
                raw, last, fresh = memoryview(flat.tobytes()), 0, []
                keys, bodies, roots, sizes = [], [], [], []
                for ends in cuts:
                    digests = []
                    for e in ends:
                        digests.append(d := hashlib.sha256(raw[last * size : e * size]).digest())
                        if d not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen.add(d)
                            fresh.append((d, e - last, raw[last * size : e * size]))
                        last = e
                    n += 1
                    keys.append(part.to_bytes(5, "big") + n.to_bytes(6, "big"))
                    bodies.append(b"".join(digests))
                    roots.append(merkle(digests))
                sizes = np.diff(doc_ends, prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(["draft"] * len(keys)), pa.array(keys, pa.binary()), piece.column(0), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary()), pa.array(roots, pa.binary())], schema=schema)
                if fresh:
                    keys, sizes, bodies = zip(*fresh)
                    none = pa.nulls(len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * len(keys)), pa.array(keys, pa.binary()), none.cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary()), none.cast(pa.binary())], schema=schema)

    schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("id", pa.int64()), ("n_ids", pa.int32()), ("body", pa.binary()), ("root", pa.binary())])
    rows = docs.select(safe_id(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(encode, "kind string, key binary, id long, n_ids int, body binary, root binary")
    # Sorted aggregation keeps one row a key, in each task before the shuffle's rows are written.
    dealt = rows.repartition("kind", "key").sortWithinPartitions("kind", "key")
    one = dealt.groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in ("id", "n_ids", "body", "root")])
    one.select("key", "id", "n_ids", "body", "root", "kind").write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/stored")
    # Recipes come out by key; what is stored lies in ascending order of ids.
    drafts = spark.read.schema("key binary, id long, n_ids int, body binary, root binary").parquet(f"{folder}/stored/kind=draft") if _has(spark, f"{folder}/stored/kind=draft") else spark.createDataFrame([], "key binary, id long, n_ids int, body binary, root binary")
    placed = running_starts(drafts, "id", "n_ids", "start", ties=("root", "key"), number="position")
    ascending = placed.repartitionByRange("position").sortWithinPartitions("position")
    ascending.select("key", "id", "n_ids", "body", "root").write.option("compression", "zstd").parquet(f"{folder}/stored/kind=recipe")
    ascending.select("id", "start", F.col("n_ids").cast("long").alias("n_tokens"), "root").write.option("compression", "zstd").parquet(f"{folder}/index")
    _write_manifest(placed.select("position", F.col("root").alias("hash")), folder)
    drop_folder(spark, f"{folder}/stored/kind=draft")


def _has(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _write_manifest(nodes: DataFrame, folder: str) -> None:
    """Levels of ``FANOUT`` hashes each over rows (position, hash), in id order, up to one root."""
    spark, level = nodes.sparkSession, 0
    while True:
        _level(nodes, level).write.mode("append").parquet(f"{folder}/manifest")
        nodes = spark.read.parquet(f"{folder}/manifest").where(F.col("level") == level).select(F.col("node").alias("position"), "hash")
        if nodes.limit(2).count() < 2:
            return
        level += 1


def _level(nodes: DataFrame, level: int) -> DataFrame:
    up = nodes.groupBy(F.expr(f"position div {FANOUT}").alias("node")).agg(
        F.min("position").alias("first"), F.max("position").alias("last"),
        F.unhex(F.sha2(F.expr("array_join(transform(array_sort(collect_list(struct(position, hash))), x -> hex(x.hash)), '')").cast("binary"), 256)).alias("hash"))
    return up.withColumn("level", F.lit(level))


def _manifest_holds(nodes: DataFrame, folder: str) -> bool:
    """Whether the levels over rows (position, hash), made anew, are the stored manifest's, up to its one root."""
    spark = nodes.sparkSession
    stored = spark.read.schema("node long, first long, last long, hash binary, level int").parquet(f"{folder}/manifest")
    columns = ("node", "first", "last", "hash")
    level = 0
    while True:
        made, kept = written(_level(nodes, level), "token-manifest").select(*columns), stored.where(F.col("level") == level).select(*columns)
        if not made.exceptAll(kept).isEmpty() or not kept.exceptAll(made).isEmpty():
            return False
        nodes = made.select(F.col("node").alias("position"), "hash")
        if nodes.limit(2).count() < 2:
            return stored.where(F.col("level") > level).isEmpty()
        level += 1


# -- reading ------------------------------------------------------------------------------------
_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC-32 polynomial (bit-reflected), elementwise."""
    out = np.zeros(len(b), np.uint32)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _shift(n: np.ndarray) -> np.ndarray:
    """x to the power 8 n modulo the polynomial."""
    out, base = np.full(len(n), 1 << 31, np.uint32), np.array([1 << 23], np.uint32)
    while n.any():
        out = np.where(n & 1, _times(out, np.broadcast_to(base, out.shape)), out)
        base, n = _times(base, base), n >> 1
    return out


def joined_crc(crcs: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """CRC-32 of each group's parts in a row, from the parts' CRCs and byte sizes; ``groups``: first part of each."""
    if not len(groups):
        return np.zeros(0, np.int64)
    total = np.cumsum(sizes)
    ends = np.append(groups[1:], len(sizes)) - 1
    after = np.repeat(total[ends], np.diff(np.append(groups, len(sizes)))) - total
    return np.bitwise_xor.reduceat(_times(_shift(after.astype(np.int64)), crcs.astype(np.uint32)), groups).astype(np.int64)


def read_store(spark: SparkSession, folder: str, least_hot: int = 10_000) -> DataFrame:
    """What the files hold, per document: id, start, n_tokens, ids_crc32 (little-endian 32-bit ids), verified.

    Every stored chunk is hashed again and its CRC-32 taken where it lies; only those short rows are
    joined with the recipes.  Digests that more than a thousandth of all recipe entries name (so fewer than a thousand)
    are joined by broadcast: a passage of every document makes no large task.  Ids are as wide as a chunk's bytes and number
    of ids say.  ``verified``: digests, recipe, Merkle root and index agree, the start is the sum of what was read before,
    and the manifest made anew from all recipes is the stored one; if it is not, no row is verified.
    """
    import zlib

    def wide(body: bytes, n: int) -> bytes | None:
        size = len(body) // n if n else 0
        return np.frombuffer(body, f"<u{size}").astype("<u4").tobytes() if size in (1, 2, 4) and size * n == len(body) else None

    def check(batches):
        for batch in batches:
            rows = []
            for digest, body, n in zip(*(c.to_pylist() for c in batch.columns)):
                ids = wide(body, n)
                rows.append((len(ids or b"") // 4, zlib.crc32(ids or b""), ids is not None and hashlib.sha256(body).digest() == digest))
            sizes, crcs, good = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], ["digest", "n", "crc", "good"])

    stored = spark.read.schema("key binary, id long, n_ids int, body binary, root binary, kind string").parquet(f"{folder}/stored")
    chunks = stored.where("kind = 'chunk'").select("key", "body", "n_ids").mapInArrow(check, "digest binary, n int, crc long, good boolean")
    recipes = stored.where("kind = 'recipe'").select("id", "key", F.explode(F.expr(f"transform(sequence(0, length(body) div {_DIGEST} - 1), i -> struct(i as seq, substring(body, i * {_DIGEST} + 1, {_DIGEST}) as digest))")).alias("c"))
    named = recipes.select("id", "key", "c.*")
    chunks = written(chunks, "token-chunks")
    uses = written(named.groupBy("digest").count(), "token-uses")
    least = max(least_hot, (uses.agg(F.sum("count")).first()[0] or 0) // 1000)
    hot = F.broadcast(uses.where(F.col("count") > least).select("digest"))
    parts = named.join(hot, "digest", "left_anti").join(chunks, "digest", "left")
    parts = parts.union(named.join(hot, "digest", "left_semi").join(F.broadcast(chunks.join(hot, "digest", "left_semi")), "digest", "left"))
    docs = parts.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "good", "digest"))).alias("parts"))

    def assemble(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, first = lists.flatten(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            number = lambda k: flat.field(k).fill_null(0).to_numpy(zero_copy_only=False)
            sizes, crcs, digests = number("n").astype(np.int64), number("crc"), flat.field("digest").to_pylist()
            good = np.logical_and.reduceat(flat.field("good").fill_null(False).to_numpy(zero_copy_only=False), first) if len(first) else np.zeros(0, bool)
            ends = np.append(first[1:], len(digests)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.add.reduceat(sizes, first) if len(first) else [], pa.int64()), pa.array(joined_crc(crcs, sizes * 4, first), pa.int64()), pa.array([merkle(digests[a:b]) for a, b in zip(first.tolist(), ends)], pa.binary()), pa.array(good)],
                ["id", "n_read", "ids_crc32", "root_read", "good"])

    read = written(docs.select("id", "parts").mapInArrow(assemble, "id long, n_read long, ids_crc32 long, root_read binary, good boolean"), "token-read")
    read = running_starts(read, "id", "n_read", "start_read", ties=("root_read",), number="position")
    whole = _manifest_holds(read.select("position", F.col("root_read").alias("hash")), folder)
    index = spark.read.schema("id long, start long, n_tokens long, root binary").parquet(f"{folder}/index")
    # Index rows and recipes pair up by their places, so rows without id or with equal ones make no large key.
    index = running_starts(index, "id", "n_tokens", "_sum", ties=("root", "start"), number="position").drop("_sum")
    both = index.join(read.withColumnRenamed("id", "id_read"), "position", "full").withColumn("_same", F.col("id") == F.col("id_read")).withColumn("id", F.coalesce("id", "id_read"))
    return both.select(real_id("id").alias("id"), "start", F.col("n_read").alias("n_tokens"), "ids_crc32", F.coalesce(F.col("_same") & F.col("good") & (F.col("root") == F.col("root_read")) & (F.col("n_read") == F.col("n_tokens")) & (F.col("start_read") == F.col("start")) & F.lit(whole), F.lit(False)).alias("verified"))
