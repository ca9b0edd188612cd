"""Sequence features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, also where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def times(s: Column, symbol: str) -> Column:
    """Occurrences of one symbol."""
    return F.length(s) - F.length(F.replace(s, F.lit(symbol)))


def ungapped(s: Column) -> Column:
    return F.replace(s, F.lit("-"))


def gc_percent(s: Column) -> Column:
    """Percent of G and C among all symbols but gaps; 0 for none."""
    s = F.upper(ungapped(s))
    return F.when(F.length(s) == 0, 0.0).otherwise((times(s, "G") + times(s, "C")) / F.length(s) * 100.0)


def entropy(s: Column) -> Column:
    """Shannon entropy over A, T, C and G in bits; other symbols count in the length only."""
    s = F.upper(ungapped(s))
    total = F.lit(0.0)
    for base in "ATCG":
        p = times(s, base) / F.length(s)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(F.length(s) == 0, 0.0).otherwise(total)


def window_heuristic(n1: Column, n2: Column) -> Column:
    """Band width for two lengths: wider when they differ by more than three tenths of the longer one."""
    longest, least, apart = F.greatest(n1, n2), F.least(n1, n2), F.abs(n1 - n2)
    base = F.when(apart / F.when(longest > 0, longest) > 0.3, F.greatest(F.lit(100), F.floor(least / 5))).otherwise(F.greatest(F.lit(50), F.floor(least / 10)))
    return F.greatest(base, apart + 10).cast("int")


def kmers(s: Column, k: int) -> Column:
    """All k-mers of the ungapped sequence, those of each offset in a row: k passes, each linear."""
    one = lambda t, o: F.regexp_extract_all(F.substring(t, F.lit(o + 1), F.length(t)), F.lit(f".{{{k}}}"), F.lit(0))
    return let(F.upper(ungapped(s)), lambda t: F.flatten(F.array(*[one(t, o) for o in range(k)])))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers and letters without case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "\x01")
