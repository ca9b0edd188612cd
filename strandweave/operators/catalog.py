"""Named sequences (seq_id, seq): natural order, ranges, resolving and combining names, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import natural_key


def listed(names: DataFrame, column: str = "seq_id", limit: int = 0) -> DataFrame:
    """Names in natural order, the first ``limit`` of them (0: all)."""
    rows = names.select(column).orderBy(natural_key(F.col(column)), column)
    return rows.limit(limit) if limit else rows


def _bound(names: DataFrame, column: str, wanted: str, last: bool) -> Column:
    low, w = F.lower(F.col(column)), wanted.strip().lower()
    exact, part = low == w, low.contains(w)
    number = (F.regexp_extract(F.col(column), r"(\d+)", 1) == wanted.strip()) if wanted.strip().isdigit() else F.lit(False)
    level = F.when(exact, 0).when(part, 1).when(number, 2)
    # The last exact name counts, else the first that holds the bound, else the first with its number.
    return F.min_by("rn", F.struct(level, F.when(level == 0, -F.col("rn")).otherwise(F.col("rn")))).alias("hi" if last else "lo"), level.isNotNull()


def name_range(names: DataFrame, spec: str, column: str = "seq_id") -> DataFrame:
    """Names from ``start`` to ``end`` of ``start:end``, both included, in natural order; swapped ends are
    set right.  An end that no name answers to raises ValueError."""
    if ":" not in spec:
        raise ValueError(f"a range is start:end, not {spec!r}")
    start, end = spec.split(":", 1)
    # Names are few (headers, not bases); ranks need one ordered pass over them.
    ranked = names.select(column).withColumn("rn", F.row_number().over(Window.orderBy(natural_key(F.col(column)), column)))
    found = []
    for wanted, last in ((start, False), (end, True)):
        pick, some = _bound(ranked, column, wanted, last)
        row = ranked.where(some).agg(pick).first()
        if row[0] is None:
            raise ValueError(f"no name answers to {wanted.strip()!r}")
        found.append(row[0])
    return ranked.where(F.col("rn").between(min(found), max(found))).drop("rn")


def variants(name: Column) -> Column:
    """Spellings of a name in the order they are tried."""
    bare = F.regexp_replace(F.lower(name), "^chr", "")
    return F.array(name, F.lower(name), F.upper(name), F.concat(F.lit("chr"), bare), F.concat(F.lit("Chr"), bare), F.concat(F.lit("CHR"), F.upper(bare)), bare)


def resolve(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(name) -> (name, seq_id): the first spelling that exists, without one the first name in natural order
    that holds the wanted one or is held by it, without case.  Names without an answer are left out."""
    tried = wanted.select("name").distinct().select("name", F.posexplode(variants(F.col("name"))).alias("level", "seq_id"))
    exact = tried.join(names.select("seq_id"), "seq_id").groupBy("name").agg(F.min_by("seq_id", "level").alias("seq_id"))
    rest = wanted.select("name").distinct().join(exact, "name", "left_anti")
    # Only names without a spelling of their own are compared with all names: a short list by its nature.
    near = rest.join(names.select("seq_id"), F.lower("seq_id").contains(F.lower("name")) | F.lower("name").contains(F.lower("seq_id")))
    near = near.groupBy("name").agg(F.min_by("seq_id", F.struct(natural_key(F.col("seq_id")), "seq_id")).alias("seq_id"))
    return exact.union(near)


def combined(specs: DataFrame, sequences: DataFrame, separator: str = "") -> DataFrame:
    """(spec) of names joined by ``+`` -> (spec, seq): their sequences in the spec's order."""
    parts = specs.select("spec", F.posexplode(F.split("spec", r"\+")).alias("ord", "name")).withColumn("name", F.trim("name"))
    rows = parts.join(resolve(parts, sequences), "name").join(sequences.select("seq_id", "seq"), "seq_id")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "seq")))
    return rows.groupBy("spec").agg(F.array_join(F.transform(ordered, lambda p: p["seq"]), separator).alias("seq"))


def regions(specs: DataFrame, sequences: DataFrame) -> DataFrame:
    """(spec) of the form ``name:start-end`` (from 1, both included) -> spec, seq_id, start, end, seq: those
    parts.  Specs of another form, or of names that aren't there, give no row."""
    form = r"^(.+):([\d,]+)-([\d,]+)$"
    number = lambda i: F.regexp_replace(F.regexp_extract("spec", form, i), ",", "").cast("int")
    asked = specs.where(F.col("spec").rlike(form)).select("spec", F.regexp_extract("spec", form, 1).alias("seq_id"), number(2).alias("start"), number(3).alias("end"))
    rows = asked.join(sequences.select("seq_id", "seq"), "seq_id")
    return rows.select("spec", "seq_id", "start", "end", F.substring(F.col("seq"), F.col("start"), F.col("end") - F.col("start") + 1).alias("seq"))


def last_wins(records: DataFrame) -> DataFrame:
    """One sequence a name: the last record's."""
    return records.groupBy("seq_id").agg(F.max_by("seq", F.struct("path", "seq_idx")).alias("seq"))
