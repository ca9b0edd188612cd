"""A run that tells what it did: chunks written with metrics and metadata beside them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sinks.files import write_chunks


def write_reported(chunks: DataFrame, folder: str) -> dict:
    """Write chunks (pair_id, cid, ..., score) to ``folder``/chunks, and what the run took to ``folder``/metrics and /metadata.

    The counts are observed while the chunks are written, so nothing is read twice.  ``metrics``: one row of chunks, least,
    greatest and summed score and seconds, as JSON; ``metadata``: a row a file with its chunks and bytes, as JSON.
    """
    seen, began = Observation("chunks"), time.time()
    score = F.col("score").cast("double")
    write_chunks(chunks.observe(seen, F.count("*").alias("chunks"), F.min(score).alias("least_score"), F.max(score).alias("greatest_score"), F.sum(score).alias("total_score")), f"{folder}/chunks")
    found = dict(seen.get) | {"seconds": time.time() - began}
    spark = chunks.sparkSession
    kinds = "chunks long, least_score double, greatest_score double, total_score double, seconds double"
    spark.createDataFrame([tuple(found[n.split()[0]] for n in kinds.split(", "))], kinds).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
    files = spark.read.parquet(f"{folder}/chunks").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files.groupBy("file", "bytes").agg(F.count("*").alias("chunks")).write.mode("overwrite").json(f"{folder}/metadata")
    return found
