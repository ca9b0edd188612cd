"""Embedding near-duplicates: PCA-ordered tiled comparison.

Equal vectors are one class (counted, smallest id).  The classes' second moments, taken over all of them, give
the principal axes; a tree over the leading ones, fitted on at most ``sample`` vectors, deals the
classes into tiles.  Two tiles meet in one group, with those of their vectors that lie near enough to the other tile's
box along the leading axes.  Within a group blocks accumulate the leading axes first; what the rest can add is
at most the product of the suffix norms, so most pairs stop there, and only those that may reach the threshold get
their cosine in double precision.  A group returns, per class, how many vectors it links with and the smallest class
of its local component: rows, never pairs.

The comparison is exact, so vectors without leading axes (an even spectrum) meet in all tiles: each is then sent to
as many groups as there are tiles.  Tiles grow with the table, from ``least_tile`` up to ``tile_rows`` vectors
and ``tile_bytes`` as doubles (a task holds some ten times that), to keep that number small; above ``max_tiles`` tiles they grow further, so that what is broadcast stays bounded.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing and are their own
component.  Only vectors of equal length are compared.  Rows with equal ids are different vectors, each with its own
links.  Vectors are scaled by a power of two first, so components of any size count.  Inside, a class goes by the
64-bit hash of its vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keyed_join, real_id, safe_id, written

LEAD = 8
STEPS = (16, 32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled exactly first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1]) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column, d: int) -> np.ndarray:
    """Rows of a list column of ``d`` numbers each."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, d)), *(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for c in parts)])


def local_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest node reachable by the links (left, right) among nodes 0..n-1."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def close_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool, block: int = 2048):
    """Blocks of index pairs (i, j) with cosine >= threshold; ``same``: a is b, and only i < j count."""
    da, db = unit(a), unit(b)
    ra, rb = (da @ basis).astype(np.float32), (db @ basis).astype(np.float32)
    d, slack = ra.shape[1], 1e-4
    steps = [s for s in STEPS if s < d]
    rest = lambda r: {s: np.sqrt((r[:, s:].astype(np.float64) ** 2).sum(1)).astype(np.float32) for s in steps}
    na, nb = rest(ra), rest(rb)
    for i in range(0, len(a), block):
        for j in range(i if same else 0, len(b), block):
            x, y = slice(i, i + block), slice(j, j + block)
            lead = steps[0] if steps else d
            dots = ra[x, :lead] @ rb[y, :lead].T
            if steps:
                dots += np.outer(na[lead][x], nb[lead][y])
            p, q = np.nonzero(dots >= threshold - slack)
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            if len(steps) > 1 and len(p):
                s = steps[1]
                keep = np.concatenate([np.einsum("ij,ij->i", ra[p[k : k + 200_000], :s], rb[q[k : k + 200_000], :s]) + na[s][p[k : k + 200_000]] * nb[s][q[k : k + 200_000]] >= threshold - slack for k in range(0, len(p), 200_000)])
                p, q = p[keep], q[keep]
            for k in range(0, len(p), 200_000):
                u, v = p[k : k + 200_000], q[k : k + 200_000]
                near = np.einsum("ij,ij->i", da[u], db[v]) >= threshold
                if near.any():
                    yield u[near], v[near]


def _tree(sample: np.ndarray, tiles: int) -> list[tuple[int, float]]:
    """Median splits along the widest leading axis, as a heap: node k has children 2k + 1 and 2k + 2."""
    depth = max(0, math.ceil(math.log2(max(1, tiles))))
    heap: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    parts = {0: sample}
    for node in range(len(heap)):
        part = parts.pop(node)
        axis = int(part.var(0).argmax()) if len(part) else 0
        at = float(np.median(part[:, axis])) if len(part) else 0.0
        heap[node] = (axis, at)
        right = part[:, axis] > at
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return heap


def _leaf(points: np.ndarray, heap: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if heap:
        axes, cuts = np.array([h[0] for h in heap]), np.array([h[1] for h in heap])
        for _ in range((len(heap) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - len(heap)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", tile_rows: int = 65_536, tile_bytes: int = 1 << 25, least_tile: int = 512, max_tiles: int = 4096, sample: int = 20_000) -> DataFrame:
    """Per vector: id, n_links (others linked directly), component_id (smallest reachable id), kept."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(safe_id(id_col).alias("id"), F.col(vector).cast(kind).alias("v")).withColumn("cls", F.xxhash64("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    classes = written(rows.where(good).groupBy("cls", "v").agg(F.min("id").alias("low_id"), F.count("*").alias("n")).withColumn("d", F.size("v")), "vector-classes")
    links = None
    for (d,) in classes.select("d").distinct().collect():  # the lengths of the vectors: one, as a rule
        own = _links(classes.where(F.col("d") == d), d, threshold, min(tile_rows, max(1, tile_bytes // (8 * d))), least_tile, max_tiles, sample)
        links = own if links is None else links.union(own)
    if links is None:
        links = spark.createDataFrame([], "cls long, n_links long, low long")
    links = written(links, "vector-links")
    counts = links.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    found = components(links.where("cls != low").select(F.col("cls").alias("a"), F.col("low").alias("b")), "vector-components")
    state = classes.select("cls", "n", "low_id").join(counts, "cls", "left").join(found.withColumnRenamed("id", "cls"), "cls", "left")
    # Members of a class link with each other too.
    state = written(state.select("cls", "n", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "low_id", F.coalesce("component", "cls").alias("component")), "vector-state")
    least = written(state.groupBy("component").agg(F.min("low_id").alias("component_id"), F.count("*").alias("classes")), "vector-least")
    result = written(keyed_join(state.select("cls", "n", "n_links", "component"), least, ["component"], "classes").select("cls", "n", "n_links", "component_id"), "vector-result")
    out = keyed_join(rows.where(good).select("id", "cls"), result, ["cls"], "n").select("id", "n_links", "component_id")
    out = out.union(rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long"), "id"))
    return out.select(real_id("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), real_id("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, d: int, threshold: float, tile_rows: int, least_tile: int, max_tiles: int, sample: int) -> DataFrame:
    """Rows (cls, n_links, low) of the groups of two tiles, for vectors of ``d`` components."""
    total = classes.count()
    tiles = min(max_tiles, max(-(-total // tile_rows), min(16, total // least_tile)))
    kind = classes.schema["v"].dataType.simpleString()

    def moments(batches):
        sums = np.zeros((d, d))
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                x = unit(matrix(batch.column(0).slice(k, 4096), d))
                sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(sums), pa.list_(pa.float64()))], ["i", "row"])

    second = np.zeros((d, d))
    parts = classes.select("v").mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # d x d numbers
        second[r["i"], r["j"]] = r["x"]
    basis = np.linalg.eigh((second + second.T) / 2)[1][:, ::-1].copy()
    lead = basis[:, :LEAD]
    heap = []
    if tiles > 1:
        share = min(1.0, sample / max(1, total))
        chosen = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v")
        heap = _tree(unit(np.array([r["v"] for r in chosen.limit(2 * sample).collect()], np.float64).reshape(-1, d)) @ lead, tiles)
    leaves = len(heap) + 1

    def place(batches):
        for batch in batches:
            y = unit(matrix(batch.column(2), d)) @ lead
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_leaf(y, heap).astype(np.int32)), pa.array(list(y), pa.list_(pa.float64()))], [*batch.schema.names, "tile", "y"])

    rows = classes.select("cls", "n", "v")
    if leaves == 1:
        dealt = rows.withColumns({"tile": F.lit(0), "p": F.lit(0), "q": F.lit(0)})
    else:
        placed = written(rows.mapInArrow(place, f"cls long, n long, v {kind}, tile int, y array<double>"), "vector-tiles")
        wide = min(LEAD, d)
        boxes = placed.groupBy("tile").agg(*[f(F.col("y")[i]).alias(f"{n}{i}") for i in range(wide) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        low, high = np.full((leaves, wide), np.inf), np.full((leaves, wide), np.inf)
        for r in boxes:  # of an empty tile nothing is near
            low[r["tile"]], high[r["tile"]] = [r[f"lo{i}"] for i in range(wide)], [r[f"hi{i}"] for i in range(wide)]

        def deal(batches):
            """Each vector once for each tile whose box is within reach."""
            for whole in batches:
                for k in range(0, whole.num_rows, 2000):
                    batch = whole.slice(k, 2000)
                    y, own = matrix(batch.column(4), wide), batch.column(3).to_numpy()
                    row, other = np.nonzero(np.stack([(np.maximum(0, np.maximum(low[t] - y, y - high[t])) ** 2).sum(1) <= reach**2 for t in range(leaves)], 1))
                    for part in range(0, len(row), 20_000):
                        at, to = row[part : part + 20_000], other[part : part + 20_000].astype(np.int32)
                        some = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(np.minimum(own[at], to)), pa.array(np.maximum(own[at], to))], ["cls", "n", "v", "tile", "p", "q"])

        dealt = placed.mapInArrow(deal, f"cls long, n long, v {kind}, tile int, p int, q int")

    def compare(key, table):
        p, q = key[0].as_py(), key[1].as_py()
        tile, names, n = (table.column(c).to_numpy() for c in ("tile", "cls", "n"))
        same = p == q
        order = np.lexsort((names, tile))
        first = order[tile[order] == p]
        second_ = first if same else order[tile[order] == q]
        schema = pa.schema([("cls", pa.int64()), ("n_links", pa.int64()), ("low", pa.int64())])
        if not len(first) or not len(second_):
            return schema.empty_table()
        x = matrix(table.column("v"), d)
        a = x[first]
        b = a if same else x[second_]
        at = first if same else np.concatenate([first, second_])
        nodes, weight = names[at], n[at]
        shift, counts, label = 0 if same else len(a), np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        order = np.argsort(nodes, kind="stable")  # so that the smallest label is the smallest name
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        for u, v in close_pairs(a, b, basis, threshold, same):
            v = v + shift
            np.add.at(counts, u, weight[v])
            np.add.at(counts, v, weight[u])
            own = local_labels(len(nodes), label[rank[u]], label[rank[v]])
            label = own[label]
        linked = counts > 0
        return pa.Table.from_arrays([pa.array(nodes[linked]), pa.array(counts[linked]), pa.array(nodes[order][label[rank]][linked])], schema=schema)

    return dealt.select("cls", "n", "v", "tile", "p", "q").groupBy("p", "q").applyInArrow(compare, "cls long, n_links long, low long")
