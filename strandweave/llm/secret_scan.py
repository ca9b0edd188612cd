"""Secret scans over an incremental blob ledger, in built-in functions only.

Every version of every text is content-addressed by the SHA-256 of its bytes.  The ledger (a folder of
two Parquet tables) holds which (blob, rule@version) pairs have been scanned and what was found.  A run scans
only unseen pairs, one representative row for each blob, appends to the ledger, and joins the findings back to
all rows that carry the blob.

Null and empty texts are the empty blob and have no findings.  Rows are kept one by one, repeated ones
too; a blob that a third of all rows share is scanned once, and its one findings row meets the rows in a join whose
hot partitions Spark may split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import real_id, safe_id, text_of
from .spans import joined, spans

BASE = ("assign", "access", "hex")
#: rule -> (version, pattern, group, least length of the group).  The first three are the base.
RULES = {
    "assign": (1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    "pem": (1, r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----", 0, 1),
    "github": (2, r"\bgh[pousr]_[A-Za-z0-9]{36,}+", 0, 1),
    "slack": (2, r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", 0, 1),
    # Only the first start in a run is tried, as later ones can't succeed where it fails; the group is the token.
    "jwt": (2, r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=\beyJ))(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", 1, 1),
}
#: Rules whose span is their group, which ends the match.
ENDING = ("jwt",)
FOUND = "array<struct<kind:string,s:int,e:int>>"
_SCANNED = "blob string, rule string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _scan(text: Column, needed: Column, rules: dict) -> Column:
    def one(rule: str) -> Column:
        version, pattern, group, least = rules[rule]
        kept = F.filter(spans(rule, text, pattern, group), lambda x: F.length(x["g"]) >= least)
        short = F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), (x["e"] - F.length(x["g"]) if rule in ENDING else x["s"]).alias("s"), x["e"].alias("e")))
        return F.when(F.array_contains(needed, f"{rule}@{version}"), short).otherwise(F.expr(f"cast(array() as {FOUND})"))

    return F.concat(*[one(r) for r in rules])


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text: str = "text", rules: dict | None = None) -> DataFrame:
    """Scan what the ledger has not seen, append to it, and return id, blob and ``found`` for every row.

    Findings come from the ledger for the rules' present versions only.
    """
    spark, rules = docs.sparkSession, rules or RULES
    names = F.array(*[F.lit(f"{r}@{v[0]}") for r, v in rules.items()])
    rows = docs.select(safe_id(id_col).alias("id"), text_of(text).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    seen = _read(spark, f"{ledger}/scanned", _SCANNED).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    one = rows.groupBy("blob").agg(F.min("id").alias("id"))
    todo = one.join(seen, "blob", "left").select("blob", "id", F.array_except(names, F.coalesce("seen", F.expr("cast(array() as array<string>)"))).alias("needed")).where(F.size("needed") > 0)
    unseen = rows.join(todo, ["id", "blob"]).select("blob", "needed", _scan(F.col("text"), F.col("needed"), rules).alias("found"))
    unseen = unseen.groupBy("blob").agg(F.first("needed").alias("needed"), F.first("found").alias("found"))
    run = f"{ledger}/runs/{uuid.uuid4().hex}"
    unseen.write.parquet(run)
    done = spark.read.schema(f"blob string, needed array<string>, found {FOUND}").parquet(run)
    done.where(F.size("found") > 0).select("blob", "found", "needed").write.mode("append").parquet(f"{ledger}/findings")
    done.select("blob", F.explode("needed").alias("rule")).write.mode("append").parquet(f"{ledger}/scanned")
    now = {r: f"{r}@{v[0]}" for r, v in rules.items()}
    # A finding counts if the run that made it scanned the rule's present version.
    known = _read(spark, f"{ledger}/findings", f"blob string, found {FOUND}, needed array<string>")
    current = F.filter("found", lambda x: F.array_contains(F.col("needed"), F.coalesce(*[F.when(x["kind"] == r, F.lit(n)) for r, n in now.items()], F.lit(""))))
    known = known.select("blob", current.alias("found")).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r, i)])
    keyed = F.transform("found", lambda x: F.struct(x["s"].alias("s"), F.element_at(place, x["kind"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    known = known.select("blob", F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("found"))
    out = rows.select("id", "blob").join(known, "blob", "left")
    return out.select(real_id("id").alias(id_col), "blob", F.coalesce("found", F.expr(f"cast(array() as {FOUND})")).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and the list of all spans."""
    n = [F.size(F.expr(f"filter(found, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select(id_col, *n, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
