"""Regular-expression spans with code-point positions, made of built-in functions only.

``split`` gives the text between matches and ``regexp_extract_all`` the matches; both walk the same
matches, so running lengths are positions.  Patterns are written so that Java's matcher neither recurses
(possessive groups) nor restarts inside a run that has failed (look-behinds), which keeps very long texts linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,s:int,e:int,m:string,g:string,b:string,a:string>"


def spans(kind: str, text: Column, pattern: str, group: int = 0, around: int = 32) -> Column:
    """Array of SPAN: kind, start, end, match, the group's text, the characters before (up to the last
    match) and the character after.  No match: an empty array."""
    parts = F.split(text, pattern, -1)
    rows = F.arrays_zip(
        parts.alias("p"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
        F.slice(parts, 2, F.size(parts)).alias("n"),
    )
    zero = F.expr(f"cast(named_struct('pos', 0, 'out', array()) as struct<pos:int,out:array<{SPAN}>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), x["m"].alias("m"), x["g"].alias("g"), F.right(x["p"], F.lit(around)).alias("b"), F.coalesce(F.left(x["n"], F.lit(1)), F.lit("")).alias("a"))
        return F.struct(F.coalesce(end, start).alias("pos"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    found = F.aggregate(rows, zero, step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def joined(spans_: Column, keys: list[Column] | None = None) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in its order."""
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
