"""SQL functions of this package: temporary UDFs of kernels, and SQL expressions as named functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import kernels
from ..operators.seeds import linked, syncmer_places
from .alphabet import CODES, MASKS


_CLEAN = f"upper(regexp_replace(s, '[^{CODES[:-1]}{CODES[:-1].lower()}-]', 'N'))"
_DIGITS = f"translate({_CLEAN}, '{CODES}', '{MASKS}')"
_MATCH = "coalesce(x <> '-' AND y <> '-' AND upper(x) = upper(y), false)"
_SYMBOLS = "filter(split(substring({0}, 1, least(length(a1), length(a2))), ''), c -> c <> '')"
_CLASSES = (
    f"array_join(zip_with({_SYMBOLS.format('a1')}, {_SYMBOLS.format('a2')}, (x, y) -> "
    f"CASE WHEN x = '-' AND y = '-' THEN 'M' WHEN x = '-' THEN 'I' WHEN y = '-' THEN 'D' WHEN {_MATCH} THEN '=' ELSE 'X' END), '')"
)
_BARE = "upper(replace(s, '-', ''))"
#: signature -> body; the same rules as the Column functions of these names.
_EXPRESSIONS = {
    "iupac_match(x STRING, y STRING) RETURNS BOOLEAN": _MATCH,
    "pack4(s STRING) RETURNS BINARY": f"unhex(CASE WHEN length({_DIGITS}) % 2 = 1 THEN concat({_DIGITS}, 'F') ELSE {_DIGITS} END)",
    "kmers(s STRING, k INT) RETURNS ARRAY<STRING>": f"CASE WHEN length({_BARE}) < k THEN cast(array() AS ARRAY<STRING>) ELSE transform(sequence(1, length({_BARE}) - k + 1), i -> substring({_BARE}, i, k)) END",
    "cigar(a1 STRING, a2 STRING) RETURNS STRING": f"array_join(transform(regexp_extract_all({_CLASSES}, '(=+|X+|I+|D+|M+)', 1), r -> concat(cast(length(r) AS STRING), left(r, 1))), '')",
}


_GAP_RUNS = f"SELECT run, length(r) FROM (SELECT posexplode(regexp_extract_all({_CLASSES}, '([IDM]+)', 1)) AS (run, r))"


class _Syncmers:
    def eval(self, seq: str, k: int, s: int, at: int):
        places, hashes = syncmer_places(seq or "", k, s, at)
        yield from zip(places.tolist(), hashes.tolist())


class _Randstrobes:
    def eval(self, seq: str, k: int, s: int, at: int, w_min: int, w_max: int):
        yield from zip(*(x.tolist() for x in linked(*syncmer_places(seq or "", k, s, at), w_min, w_max)))


def register(spark: SparkSession) -> None:
    """``nw_align(s1, s2)`` and ``sw_align(s1, s2)`` (structs), ``gc_percent(s)``, ``iupac_match(x, y)``, ``pack4(s)``,
    ``kmers(s, k)`` and ``cigar(a1, a2)``; and for LATERAL joins the table functions ``syncmers(seq, k, s, at)``,
    ``randstrobes(seq, k, s, at, w_min, w_max)`` and ``gap_runs(a1, a2)``.  Alignments and the first two table functions are Python over whole sequences, the others SQL that
    Catalyst inlines."""

    @F.pandas_udf("score double, a1 string, comp string, a2 string, status string")
    def nw_align(s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.align_safely(a or "", b or "") for a, b in zip(s1, s2)], columns=["score", "a1", "comp", "a2", "status"])

    @F.pandas_udf("score double, a1 string, a2 string, start1 int, start2 int")
    def sw_align(s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.affine(a or "", b or "", local=True) for a, b in zip(s1, s2)], columns=["score", "a1", "a2", "start1", "start2"])

    spark.udf.register("nw_align", nw_align)
    spark.udf.register("sw_align", sw_align)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gc_percent(s STRING) RETURNS DOUBLE RETURN CASE WHEN length(replace(s, '-', '')) = 0 THEN 0D ELSE 100D * length(regexp_replace(upper(s), '[^GC]', '')) / length(replace(s, '-', '')) END")
    spark.udtf.register("syncmers", F.udtf(_Syncmers, returnType="pos int, hash bigint"))
    spark.udtf.register("randstrobes", F.udtf(_Randstrobes, returnType="pos1 int, pos2 int, hash bigint"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION gap_runs(a1 STRING, a2 STRING) RETURNS TABLE(run INT, length INT) RETURN {_GAP_RUNS}")
    for signature, body in _EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
