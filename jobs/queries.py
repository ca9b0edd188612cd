"""The jobs as queries: each runs twice into one new folder, and what stands there afterwards is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.plans.queries import COUNTS, PAIRS, RUNS, SYNCMERS
from strandweave.sinks.folders import scratch

from . import pair_report, sequence_intake


def job1_sequence_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents, with the seeds that the index holds of each."""
    out = scratch(spark, "sequence-intake")
    for _ in range(2):
        sequence_intake.run(spark, f"{sf_dir}/documents.parquet", out)
    rows, seeds = spark.read.parquet(f"{out}/records"), spark.read.parquet(f"{out}/seeds")
    held = seeds.groupBy("doc_id").agg(F.count("*").alias("indexed"))
    rows = rows.join(held, "doc_id", "left").withColumns({"gc": F.round("gc", 9), "entropy": F.round("entropy", 9)})
    return rows.select("doc_id", "lang", "source", "status", "length", "gc", "entropy", "seeds", "least_seed", "digest", F.coalesce("indexed", F.lit(0)).alias("indexed"))


def job2_pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all pairs, with the number and the least identity of each one's windows."""
    out = scratch(spark, "pair-report")
    for _ in range(2):
        pair_report.run(spark, f"{sf_dir}/documents.parquet", out)
    rows, windows = spark.read.parquet(f"{out}/pairs"), spark.read.parquet(f"{out}/windows")
    seen = windows.groupBy("pair_id").agg(F.count("*").alias("windows"), F.round(F.min("identity"), 9).alias("least_identity"))
    rows = rows.withColumns({n: F.round(n, 9) for n in ("identity", "gap_percentage")})
    return rows.join(seen, "pair_id", "left").select("pair_id", *pair_report.STATISTICS, "score", "cigar", "quality_class", "exploded", F.coalesce("windows", F.lit(0)).alias("windows"), "least_identity")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_sequence_intake, job2_pair_report)}

_ENTROPY = " + ".join(f"(CASE WHEN {b} = 0 THEN 0.0 ELSE -({b}/n)*log2({b}/n) END)" for b in "atcg")

ORACLE_SQL: dict[str, str] = {
    "job1_sequence_intake": f"""WITH {SYNCMERS}, k AS (SELECT doc_id, count(*) AS seeds, min(hash) AS least_seed, count(*) FILTER (hash & 3 = 0) AS indexed FROM sy GROUP BY 1),
c AS (SELECT doc_id, seq, length(seq) AS n, {', '.join(f"length(seq) - length(replace(seq, '{b.upper()}', '')) AS {b}" for b in 'atcg')} FROM (SELECT d.doc_id, coalesce(seq, '') AS seq FROM documents d LEFT JOIN seqs USING (doc_id)))
SELECT c.doc_id, lang, source, CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'short' ELSE 'valid' END AS status, n AS length, round(CASE WHEN n = 0 THEN 0.0 ELSE (g+c)/n*100 END, 9) AS gc,
 round(CASE WHEN n = 0 THEN 0.0 ELSE {_ENTROPY} END, 9) AS entropy, coalesce(seeds, 0)::INTEGER AS seeds, least_seed, md5(seq) AS digest, CASE WHEN n < 50 THEN 0 ELSE coalesce(indexed, 0) END AS indexed
FROM c JOIN documents USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "job2_pair_report": f"""WITH {RUNS.format(flag='op')}, t AS (SELECT p.pair_id, length(any_value(a1)) AS len, {COUNTS}, count(*) FILTER (gap) AS gaps FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1),
o AS (SELECT pair_id, count(*) FILTER (op IN ('I','D') AND (before IS NULL OR before IN ('=','X'))) AS opened FROM (SELECT *, lag(op) OVER (PARTITION BY pair_id ORDER BY pos) AS before FROM ops) GROUP BY 1),
z AS (SELECT pair_id, sum(CASE WHEN op = '=' THEN 1.0 WHEN op = 'X' THEN -2.0 WHEN before = op THEN -0.5 ELSE -2.0 END) AS score FROM (SELECT *, lag(op) OVER (PARTITION BY pair_id ORDER BY pos) AS before FROM ops WHERE op <> 'M') GROUP BY 1),
g AS (SELECT pair_id, string_agg(len || v, '' ORDER BY spot) AS cigar FROM runs GROUP BY 1),
x AS (SELECT pair_id, max(len) AS longest FROM (SELECT pair_id, part, count(*) AS len FROM (SELECT pair_id, pos - row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS part FROM ops WHERE gap) GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT pair_id, count(*) AS windows, round(min(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE m/(m+mm+i+d)*100 END), 9) AS least_identity FROM (SELECT pair_id, pos // 100 AS nth, {COUNTS} FROM ops GROUP BY 1, 2) GROUP BY 1)
SELECT t.pair_id, m AS matches, mm AS mismatches, i AS insertions, d AS deletions, m+mm+i+d AS total_aligned, i+d AS total_gaps, round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE m/(m+mm+i+d) END, 9) AS identity,
 coalesce(opened, 0) AS gap_openings, round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE (i+d)/(m+mm+i+d)*100 END, 9) AS gap_percentage, coalesce(score, 0.0)::DOUBLE AS score, coalesce(cigar, '') AS cigar,
 CASE WHEN m+mm = 0 OR m/(m+mm) < 0.7 THEN 'POOR' WHEN m/(m+mm) < 0.8 THEN 'FAIR' WHEN m/(m+mm) < 0.9 THEN 'GOOD' ELSE 'EXCELLENT' END AS quality_class,
 len > 0 AND (coalesce(longest, 0) >= 30 OR gaps >= 0.15 * len) AS exploded, coalesce(windows, 0) AS windows, least_identity
FROM t LEFT JOIN o USING (pair_id) LEFT JOIN z USING (pair_id) LEFT JOIN g USING (pair_id) LEFT JOIN x USING (pair_id) LEFT JOIN w USING (pair_id)""",
}
