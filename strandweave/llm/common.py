"""Pieces that several operators share: written stages, prefix sums, components, blob hashing."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Stands for a null id inside operators, which join on ids.
NO_ID = -(1 << 62)


def safe_id(column: str) -> Column:
    """Ids are integers (or strings of digits); what can't be one is a cast error, never a row left out."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def real_id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Inside, Arrow batches sent to Python hold at most ``most`` rows, for rows of packed values; then as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none (tests, a laptop) gets one beside its warehouse; on a cluster that folder may
    lie on each machine's own disk, so there it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: stages need a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more."""
    for t in tables:
        drop_folder(t.sparkSession, t._stage_folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a stage's folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def running_starts(df: DataFrame, order: str, amount: str, out: str, blocks: int | None = None, ties: tuple[str, ...] = (), number: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before a row by ``order`` and ``ties``; nulls count as 0 and come
    first.  ``number``: also add how many rows come before.

    Rows are dealt into ranges of ``order`` by Spark's own sampled borders, so wide, null or unevenly spread values
    make no large block; each task adds up its range, and the one ordered pass has a row a block (at most 65 536).
    ``df`` is read three times, so it should be a table.
    """
    if blocks is None:
        blocks = min(1 << 16, max(8, df.count() // 100_000))

    def sums(batches):
        part, total, count = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n) + total
            rows = np.arange(count, count + len(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(rows)], [*batch.schema.names, "_block", "_within", "_nth"])
            if len(n):
                total, count = int(ends[-1]), count + len(n)

    at = df.columns.index(amount)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_block int, _within long, _nth long"])
    dealt = written(df.repartitionByRange(blocks, order, *ties).sortWithinPartitions(order, *ties).mapInArrow(sums, schema), "running")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.groupBy("_block").agg(F.sum(amount).alias("_sum"), F.count("*").alias("_rows"))
    total = total.select("_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("_sum", "_before"), ("_rows", "_first"))))
    added = dealt.join(F.broadcast(total), "_block").withColumn(out, F.col("_before") + F.col("_within"))
    if number:
        added = added.withColumn(number, F.col("_first") + F.col("_nth"))
    return added.drop("_block", "_within", "_nth", "_before", "_first")


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, least: int = 2_000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which holds one row a key and in ``size`` about how many ``rows`` have it.

    Keys with more than a thousandth of all rows (and than ``least``) are joined by broadcast, fewer than a thousand of
    them, so no task gets all rows of a hot key; the others are shuffled.  Both inputs are read twice and should be tables.
    """
    total, most = table.agg(F.sum(size), F.max(size)).first()
    bound = max(least, (total or 0) // 1000)
    if (most or 0) <= bound:
        return rows.join(table, keys)
    hot = F.col(size) > bound
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot), keys)
    return rows.join(F.broadcast(table.where(hot)), keys).unionByName(rest)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` for every id of the undirected ``edges(a, b)``: its smallest reachable id.

    Alternating large-star and small-star rounds; each round is written to the shared folder, and the
    driver sees three sums per round.  A hub's partners are pre-aggregated (a minimum), never gathered.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    last = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, both.u == low.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, large.u == low.n)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        done, edges = edges, written(small.where("u != v"), name)
        forget(done)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state[0] == state[2] and state == last:
            break
        last = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
