"""Streams of FASTA files: the same transformations as they arrive."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import seeds


def fasta_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Records of files as they come to ``folder``: path, seq_id, description, seq.  Each file is whole."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", max_files).text(folder)
    v = F.regexp_replace(F.regexp_replace("value", r"\r", ""), "^>", "")
    head = F.split(v, "\n", 2)
    rows = raw.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"), F.get(head, F.lit(0)).alias("description"), F.upper(F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "")).alias("seq"))
    return rows.withColumn("seq_id", F.regexp_extract("description", r"^(\S*)", 1))


def windowed_counts(records: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sequences and bases by arrival window; rows later than ``late`` behind the newest are left out."""
    rows = records.withWatermark("arrived", late).groupBy(F.window("arrived", window))
    return rows.agg(F.count("*").alias("sequences"), F.sum(F.length("seq")).alias("bases")).select("window.start", "window.end", "sequences", "bases")


def deliveries(records: DataFrame) -> DataFrame:
    """What came under each id so far: (seq_id, digest, deliveries, differing), an update whenever it comes again.

    The content that arrived first stands, the least digest of several that arrived together; ``differing`` counts deliveries of
    another one.  The state is three values an id, kept in the checkpoint, so a restart goes on where it was, and files that
    come late are counted but change nothing.
    """

    def step(key: tuple, parts, state: GroupState):
        first, counts, held = None, Counter(), state.get if state.exists else None
        for pdf in parts:
            counts.update(pdf["digest"].tolist())
            least = min(zip(pdf["arrived"].tolist(), pdf["digest"].tolist()))
            first = min(first, least) if first else least
        digest, n, differing = held or (first[1], 0, 0)
        total = sum(counts.values())
        n, differing = n + total, differing + total - counts[digest]
        state.update((digest, n, differing))
        yield pd.DataFrame([(key[0], digest, n, differing)], columns=["seq_id", "digest", "deliveries", "differing"])

    kept = "digest string, deliveries long, differing long"
    rows = records.select("seq_id", "arrived", F.md5("seq").alias("digest"))
    return rows.groupBy("seq_id").applyInPandasWithState(step, f"seq_id string, {kept}", kept, "update", GroupStateTimeout.NoTimeout)


def anchors_with(records: DataFrame, library: DataFrame, most: int = 200, k: int = 10, s: int = 3, offset: int = 2, w_min: int = 10, w_max: int = 30) -> DataFrame:
    """Anchors of arriving sequences with a standing library of strobes (lib_id, pos1, hash, span): seq_id, lib_id, qpos, tpos, span,
    hash, diag.  A stream-static join; hashes that occur more than ``most`` times in one library sequence give none."""
    found = seeds.strobes(records.select("seq_id", "seq"), "seq_id", k, s, offset, w_min, w_max)
    rare = seeds.capped(library, "lib_id", most).select("lib_id", "hash", F.col("pos1").alias("tpos"))
    both = found.select("seq_id", "hash", F.col("pos1").alias("qpos"), "span").join(rare, "hash")
    return both.select("seq_id", "lib_id", "qpos", "tpos", "span", "hash", (F.col("tpos") - F.col("qpos")).alias("diag"))


def process(records: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch function on every micro-batch that is there, then stop."""
    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
