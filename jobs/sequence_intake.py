"""Takes sequences in as their files arrive, checks and profiles them, and keeps an index of their seeds.

    python -m jobs.sequence_intake SOURCE OUT [--config jobs/sequence_intake.json]

SOURCE: Parquet files (or a folder or pattern of them) with doc_id, text, lang, source.  A file stream with a checkpoint reads
each file once, so a run takes only what is new since the last one, and ends when it has all of it.  OUT holds

* ``records/batch=/status=``: a row an id, its sequence, length, GC, entropy, seeds and digest; status is ``valid``,
  ``short`` (below ``min_length``), ``empty`` (no symbol, a null text too) or ``unnamed`` (no id);
* ``seeds/batch=``: syncmers of valid sequences whose lowest ``seed_bits`` hash bits are 0, for looking up relatives;
* ``totals/batch=``: sums by language and status, merged over batches into ``summary/status=``;
* ``log/batch=``: rows read, taken and known before; ``_checkpoint``: what the stream has read.

An id's first delivery stands: later batches' rows of it are left out, and of several in one batch the one with the least digest
is taken.  A batch writes into its own partitions and looks for known ids in the batches before it alone, so a batch that
is run again after a failure replaces what it wrote with the same rows.  Rows without id can't be told apart and are
all kept.  Other columns are not read.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.functions.features import entropy, gc_percent, times
from strandweave.operators.seeds import dense, syncmer_marks, syncmers

from . import settings

LOG = logging.getLogger("jobs.sequence_intake")
INPUT = "doc_id long, text string, lang string, source string"
RECORDS = "doc_id long, lang string, source string, seq string, length long, gc double, entropy double, seeds int, least_seed long, digest string, batch long, status string"
TOTALS = "lang string, status string, sequences long, bases long, gc_bases long, seeds long, batch long"
LOGGED = "read long, taken long, known long, batch long"


@dataclass(frozen=True)
class Settings:
    min_length: int = 50
    max_files: int = 100
    k: int = 10
    s: int = 3
    offset: int = 2
    seed_bits: int = 2


def profiled(docs: DataFrame, c: Settings) -> DataFrame:
    """The rows of ``records`` for rows of INPUT; narrow."""
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", ""))
    rows = docs.select("doc_id", "lang", "source", seq.alias("seq"))
    rows = rows.withColumn("_marks", syncmer_marks(F.col("seq"), c.k, c.s, c.offset))
    n = F.length("seq")
    status = F.when(F.col("doc_id").isNull(), "unnamed").when(n == 0, "empty").when(n < c.min_length, "short").otherwise("valid")
    return rows.select(
        "doc_id", "lang", "source", "seq", n.cast("long").alias("length"), gc_percent(F.col("seq")).alias("gc"), entropy(F.col("seq")).alias("entropy"),
        F.size("_marks").alias("seeds"), F.array_min(F.transform("_marks", lambda m: m["hash"])).alias("least_seed"), F.md5("seq").alias("digest"), status.alias("status"))


def one_an_id(rows: DataFrame) -> DataFrame:
    """Of rows of one id the one with the least digest, then language and source; rows without id all stay.

    Rows without id are dealt out by a number of their own, so they are no group.
    """
    deal = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy("doc_id", "_deal").orderBy("digest", "lang", "source"))
    return rows.withColumn("_deal", deal).withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_deal", "_nth")


def pattern(source: str) -> str:
    """``source`` as a pattern of itself: a file stream takes single files only so."""
    source = source.rstrip("/")
    return source if set(source) & set("*?[{") else f"{source[:-1]}[{source[-1]}]"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write partitions in place of those of the same values; the session's own mode stays as it is."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(batch: DataFrame, number: int, out: str, c: Settings) -> None:
    """One batch: records first, everything else from what was written."""
    spark, paths = batch.sparkSession, {name: f"{out}/{name}" for name in ("records", "seeds", "totals", "log")}
    seen = Observation()
    rows = one_an_id(profiled(batch.observe(seen, F.count("*").alias("read")), c))
    if number:
        before = _table(spark, paths["records"], RECORDS).where(F.col("batch") < number).select("doc_id")
        rows = rows.join(before, "doc_id", "left_anti")
    _replace(rows.withColumn("batch", F.lit(number).cast("long")), paths["records"], "batch", "status")
    taken = _table(spark, paths["records"], RECORDS).where(F.col("batch") == number)
    marks = syncmers(taken.where("status = 'valid'").select("doc_id", "seq"), "doc_id", c.k, c.s, c.offset)
    _replace(dense(marks, c.seed_bits).withColumn("batch", F.lit(number).cast("long")), paths["seeds"], "batch")
    gc = times(F.col("seq"), "G") + times(F.col("seq"), "C")
    totals = taken.groupBy("lang", "status").agg(F.count("*").alias("sequences"), F.sum("length").alias("bases"), F.sum(gc).cast("long").alias("gc_bases"), F.sum("seeds").cast("long").alias("seeds"))
    _replace(totals.withColumn("batch", F.lit(number).cast("long")), paths["totals"], "batch")
    read, kept = seen.get["read"], _table(spark, paths["totals"], TOTALS).where(F.col("batch") == number).agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0]
    _replace(spark.createDataFrame([(read, kept, read - kept, number)], LOGGED).coalesce(1), paths["log"], "batch")
    LOG.info("batch %d: %d rows read, %d taken, %d known before", number, read, kept, read - kept)


def summarise(spark: SparkSession, out: str) -> DataFrame:
    """Totals of all batches by status and language, written anew."""
    totals = _table(spark, f"{out}/totals", TOTALS)
    merged = totals.groupBy("status", "lang").agg(*[F.sum(n).alias(n) for n in ("sequences", "bases", "gc_bases", "seeds")])
    merged = merged.withColumn("gc", F.when(F.col("bases") > 0, F.col("gc_bases") / F.col("bases") * 100).otherwise(0.0))
    merged.write.mode("overwrite").partitionBy("status").json(f"{out}/summary")
    return merged


def run(spark: SparkSession, source: str, out: str, c: Settings | None = None) -> dict[str, int]:
    """Take in what is new in ``source``; returns what this run read, took and knew before."""
    c = c or Settings()
    docs = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", c.max_files).parquet(pattern(source))
    done: list[int] = []

    def batch(rows: DataFrame, number: int) -> None:
        take(rows, number, out, c)
        done.append(number)

    stream = docs.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    counts = dict.fromkeys(("read", "taken", "known"), 0)
    if done:
        log = _table(spark, f"{out}/log", LOGGED).where(F.col("batch").between(min(done), max(done)))
        counts = log.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts]).first().asDict()
        summarise(spark, out)
    LOG.info("%s: %d batches, %s; written to %s", source, len(done), counts, out)
    return counts


def main() -> None:
    p = argparse.ArgumentParser(prog="sequence_intake")
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--config")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("sequence_intake").getOrCreate()
    try:
        run(spark, args.source, args.out, settings.load(spark, Settings, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
