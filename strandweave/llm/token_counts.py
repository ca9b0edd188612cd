"""Token counts: a map-side two-tier lookup.

Tier one is a compact table (pre-token -> number of ids) of frequent pre-tokens, broadcast; it holds at
most ``table_units`` entries and is fitted on about ``sample_docs`` documents, chosen by a hash of their texts over
the whole table, whose pre-tokens are counted by the workers: the driver sees counts only.  It only decides
what is looked up where: a miss goes to the worker's bounded cache, which the library fills, so counts
are the library's for every text, and no pre-token is ever shuffled.

Nulls and empty texts have 0 tokens.  Rows are kept as they are, repeated ones too; a table without rows
gives none.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Codec, codec


def frequent_table(docs: DataFrame, path: str, text: str = "text", table_units: int = 50_000, sample_docs: int = 1_000) -> dict[str, int]:
    """Tier one: the most frequent pre-tokens of a bounded sample and their numbers of ids."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select(F.col(text).alias("text")).where("text != ''")

    def units(batches):
        seen, cut = Counter(), codec(path, True)

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(cut.pretokens(t) or ())
                if len(seen) > 200_000:
                    yield rows()
        yield rows()

    top = chosen.mapInArrow(units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table_units)
    keys = [r["unit"] for r in top.collect()]
    return dict(zip(keys, Codec(path, counts_only=True).unit_counts(keys)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096, table_units: int = 50_000, sample_docs: int = 1_000) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens (the library's, no added specials), over_limit."""
    spark = docs.sparkSession
    table = frequent_table(docs, path, text, table_units, sample_docs)
    stamp = hashlib.sha256(repr(sorted(table.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(table)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        for batch in batches:
            n = codec(path, True, shared.value, stamp).encode(batch.column(1).to_pylist())
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
