"""Nucleotide symbols as Column expressions: cleaning, 4-bit packing, IUPAC masks and predicates.

Each code is a 4-bit mask of bases (A 1, C 2, G 4, T 8), so set operations are bit operations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their masks as hexadecimal digits.
CODES = "ACGTRYSWKMBDHVN-"
MASKS = "12485A69C3EDB7F0"
BY_MASK = "-ACMGRSVTWYHKDBN"
VALID = "ACGTURYSWKMBDHVN-"

GAP = "-"


def clean(seq: Column) -> Column:
    """Upper-case codes; anything unknown (also U) becomes N.  Filtered before upper-casing, which may expand."""
    return F.upper(F.regexp_replace(seq, f"[^{CODES[:-1]}{CODES[:-1].lower()}-]", "N"))


def only(text: Column, codes: str, other: str = "") -> Column:
    """``text`` in upper case with every symbol that isn't one of ``codes``, in either case, replaced by ``other`` (one ASCII symbol, or
    none): one Arrow pass over bytes, as a pattern's matcher takes much longer symbol by symbol.  ``codes`` are ASCII, so of a
    longer symbol's bytes the first stands for it."""
    known = (codes.upper() + codes.lower()).encode()
    table = bytes(ord(chr(b).upper()) if b in known else ord(other or "-") for b in range(256))
    drop = bytes(b for b in range(256) if (0x80 <= b < 0xC0 if other else b not in known))

    @F.arrow_udf("string")
    def mapped(raw: pa.Array) -> pa.Array:
        return pa.array((None if v is None else v.translate(table, drop) for v in _values(raw)), pa.binary()).cast(pa.string())

    return mapped(text.cast("binary"))


def _values(raw: pa.Array):
    """One value at a time: the batch is not held a second time as Python objects."""
    return (v.as_py() for v in raw)


def pack4(seq: Column) -> Column:
    """Two symbols a byte, the first in the high half; an odd tail is filled with N's mask."""
    digits = F.translate(clean(seq), CODES, MASKS)
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("F"))).otherwise(digits))


def unpack4(buf: Column, length: Column, start: Column | int = 0, end: Column | int | None = None) -> Column:
    """Symbols [start, end) of a packed sequence; the end is held to its length, an empty range gives ''."""
    start = F.lit(start) if isinstance(start, int) else start
    end = length if end is None else F.least(F.lit(end) if isinstance(end, int) else end, length)
    symbols = F.translate(F.hex(buf), "0123456789ABCDEF", BY_MASK)
    return F.when(start < end, F.substring(symbols, start + 1, end - start)).otherwise("")


def mask(symbol: Column) -> Column:
    """Base mask of one symbol: U counts as T, unknown as N, the gap has a bit of its own."""
    symbol = F.upper(symbol)
    place = F.instr(F.lit("ACGTURYSWKMBDHVN"), symbol)
    values = F.array(*[F.lit(v) for v in (1, 2, 4, 8, 8, 5, 10, 6, 9, 12, 3, 14, 13, 11, 7, 15)])
    return F.when(symbol.isNull(), None).when(symbol == GAP, 16).when(place > 0, F.element_at(values, F.greatest(place, F.lit(1)))).otherwise(15)


def is_match(x: Column, y: Column) -> Column:
    """Equal symbols of either case, neither a gap; equal ambiguity codes match; null is false."""
    return F.coalesce((x != GAP) & (y != GAP) & (F.upper(x) == F.upper(y)), F.lit(False))


def is_strict_match(x: Column, y: Column) -> Column:
    """A match between plain bases only."""
    return is_match(x, y) & F.upper(x).isin("A", "C", "G", "T", "U")


def is_partial_overlap(x: Column, y: Column) -> Column:
    """Base sets that meet but differ; null is false."""
    return F.coalesce((mask(x).bitwiseAND(mask(y)) != 0) & (mask(x) != mask(y)), F.lit(False))
