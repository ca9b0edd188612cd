"""Sequences as numbers: one-hot tensors of fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_ROWS = np.zeros((256, 4), np.uint8)
_ROWS[:] = (1, 0, 0, 0)  # symbols outside the four count as A
for _i, _c in enumerate("ACGT"):
    _ROWS[[ord(_c), ord(_c.lower())]] = np.eye(4, dtype=np.uint8)[_i]


def one_hot(sequences: DataFrame, length: int, key: str = "doc_id") -> DataFrame:
    """(key, tensor, symbols): the first ``length`` symbols as bytes (length, 4) in the order A, C, G, T, zeros behind the end.

    All tensors have 4 x ``length`` bytes, so a batch of rows is one array (rows, length, 4).  A null sequence is empty.
    """

    def run(batches):
        for batch in batches:
            texts = [(t or "")[:length].encode("latin-1", "replace") for t in batch.column(1).to_pylist()]
            out = np.zeros((len(texts), length, 4), np.uint8)
            for row, t in zip(out, texts):
                row[: len(t)] = _ROWS[np.frombuffer(t, np.uint8)]
            flat = pa.Array.from_buffers(pa.binary(4 * length), len(texts), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array([len(t) for t in texts], pa.int32())], ["key", "tensor", "symbols"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(key, "seq").mapInArrow(run, f"key {kind}, tensor binary, symbols int").withColumnRenamed("key", key)


def as_array(rows: pa.Table, length: int) -> np.ndarray:
    """Collected rows of ``one_hot`` as one array (rows, length, 4)."""
    return np.frombuffer(b"".join(rows.column("tensor").to_pylist()), np.uint8).reshape(-1, length, 4)
