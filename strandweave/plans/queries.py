"""Queries over the driver's tables, each with the same question in DuckDB's SQL where SQL can express it.

Sequences are the texts' A, C, G and T; aligned pairs are neighbouring texts with everything else as gaps.
Ratios are rounded on both sides to ten places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import alphabet, registry
from ..operators import align, anchors, band, catalog, columns, profiles, reanchor, seeds, tensors
from ..sinks import files, folders
from ..sources import fasta
from . import report
from .config import Config
from .pipeline import align_and_measure, align_in_blocks, align_pairs, align_reanchored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    """Whole texts are long: a Python worker holds a few of them at once, whatever the table's size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(500, int(spark.conf.get(key))) if int(spark.conf.get(key)) > 0 else 500))


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    _small_batches(spark)
    return _table(spark, sf, "documents").select("doc_id", alphabet.only(F.col("text"), "ACGT").alias("seq"))


def _next_to(rows: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Pairs of rows with ids one apart."""
    left = rows.select(F.col("doc_id").alias("pair_id"), F.col(value).alias(a))
    return left.join(rows.select((F.col("doc_id") - 1).alias("pair_id"), F.col(value).alias(b)), "pair_id")


def _seq_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _next_to(_sequences(spark, sf), "seq", "s1", "s2")


def _pairs(spark: SparkSession, sf: str, codes: str = "ACGTN") -> DataFrame:
    """Aligned pairs, cut to the shorter side."""
    _small_batches(spark)
    docs = _table(spark, sf, "documents").select("doc_id", alphabet.only(F.col("text"), codes, "-").alias("a"))
    rows = _next_to(docs, "a", "a1", "a2")
    n = F.least(F.length("a1"), F.length("a2"))
    return rows.select("pair_id", F.substring("a1", F.lit(1), n).alias("a1"), F.substring("a2", F.lit(1), n).alias("a2"))


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 10) for n in names})


def _pairs_sql(codes: str = "ACGTN") -> str:
    return f"""docs AS (SELECT doc_id, upper(regexp_replace(text, '[^{codes}{codes.lower()}]', '-', 'g')) AS a FROM documents),
pairs AS (SELECT d.doc_id AS pair_id, substr(d.a, 1, least(length(d.a), length(e.a))) AS a1, substr(e.a, 1, least(length(d.a), length(e.a))) AS a2
  FROM docs d JOIN docs e ON e.doc_id = d.doc_id + 1),
cols AS (SELECT pair_id, n, pos, substr(a1, pos + 1, 1) AS x, substr(a2, pos + 1, 1) AS y
  FROM (SELECT *, length(a1) AS n, unnest(range(0, length(a1))) AS pos FROM pairs)),
ops AS (SELECT *, CASE WHEN x = '-' AND y = '-' THEN 'M' WHEN x = '-' THEN 'I' WHEN y = '-' THEN 'D' WHEN x = y THEN '=' ELSE 'X' END AS op,
  x = y AND x IN ('A','C','G','T','U') AS strict, x = '-' OR y = '-' AS gap FROM cols)"""


PAIRS = _pairs_sql()
SEQS = "seqs AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"
SEQ_PAIRS = SEQS + ", sp AS (SELECT a.doc_id AS pair_id, a.seq AS s1, b.seq AS s2 FROM seqs a JOIN seqs b ON b.doc_id = a.doc_id + 1)"
COUNTS = """count(*) FILTER (op = '=') AS m, count(*) FILTER (op = 'X') AS mm, count(*) FILTER (op = 'I') AS i, count(*) FILTER (op = 'D') AS d"""
RUNS = PAIRS + """, marked AS (SELECT *, CASE WHEN lag({flag}) OVER w IS DISTINCT FROM {flag} THEN 1 ELSE 0 END AS new FROM ops WINDOW w AS (PARTITION BY pair_id ORDER BY pos)),
runs AS (SELECT pair_id, {flag} AS v, g, min(pos) AS spot, count(*) AS len FROM (SELECT *, sum(new) OVER (PARTITION BY pair_id ORDER BY pos) AS g FROM marked) GROUP BY ALL)"""


# -- aligned columns --------------------------------------------------------------------------
@query(f"""WITH {PAIRS}, o AS (SELECT *, lag(op) OVER (PARTITION BY pair_id ORDER BY pos) AS before FROM ops),
c AS (SELECT p.pair_id, {COUNTS}, count(*) FILTER (op IN ('I','D') AND (before IS NULL OR before IN ('=','X'))) AS g FROM pairs p LEFT JOIN o USING (pair_id) GROUP BY 1)
SELECT pair_id, m AS matches, mm AS mismatches, i AS insertions, d AS deletions, m+mm+i+d AS total_aligned, i+d AS total_gaps,
 round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE m/(m+mm+i+d) END, 10) AS identity, round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE (mm+i+d)/(m+mm+i+d) END, 10) AS divergence,
 g AS gap_openings, round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE (i+d)/(m+mm+i+d)*100 END, 10) AS gap_percentage FROM c""")
def alignment_stats(spark, sf):
    return _round(columns.alignment_stats(_pairs(spark, sf)), "identity", "divergence", "gap_percentage")


@query(f"""WITH {PAIRS}, c AS (SELECT p.pair_id, length(any_value(a1)) AS n, count(*) FILTER (strict) AS m, count(*) FILTER (NOT gap AND NOT strict) AS mm, count(*) FILTER (op IN ('I','D')) AS g
 FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1)
SELECT pair_id, m AS matches, mm AS mismatches, g AS total_gaps, round(CASE WHEN m+mm = 0 THEN 0.0 ELSE m/(m+mm) END, 10) AS identity_ungapped,
 round(CASE WHEN n = 0 THEN 0.0 ELSE g/n END, 10) AS gap_fraction FROM c""")
def viz_stats_strict(spark, sf):
    return _round(columns.strict_stats(_pairs(spark, sf)), "identity_ungapped", "gap_fraction")


@query(f"""WITH {PAIRS}, c AS (SELECT p.pair_id, {COUNTS}, count(*) FILTER (op = 'X' AND x || y IN ('AG','GA','CT','TC')) AS ti FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1), t AS (SELECT *, m+mm+i+d AS n FROM c)
SELECT pair_id, round(CASE WHEN n = 0 THEN 0.0 ELSE m/n*100 END, 10) AS identity_percentage, round(CASE WHEN n = 0 THEN 0.0 ELSE (i+d)/n*100 END, 10) AS gap_percentage,
 round(CASE WHEN n = 0 THEN 0.0 ELSE (2*m-mm)/(2*n)*100 END, 10) AS conservation_score, ti AS transitions, mm-ti AS transversions, round(ti/(mm-ti+1), 10) AS ti_tv_ratio,
 round(CASE WHEN n = 0 THEN 0.0 ELSE m/n*1000 END, 10) AS matches_per_kb FROM t""")
def alignment_quality(spark, sf):
    return _round(columns.quality(_pairs(spark, sf)), "identity_percentage", "gap_percentage", "conservation_score", "ti_tv_ratio", "matches_per_kb")


@query(f"""WITH {PAIRS}, o AS (SELECT *, lag(op) OVER (PARTITION BY pair_id ORDER BY pos) AS before FROM ops WHERE op <> 'M')
SELECT p.pair_id, coalesce(sum(CASE WHEN op = '=' THEN 1.0 WHEN op = 'X' THEN -2.0 WHEN before = op THEN -0.5 WHEN op IS NULL THEN 0.0 ELSE -2.0 END), 0.0)::DOUBLE AS score FROM pairs p LEFT JOIN o USING (pair_id) GROUP BY 1""")
def alignment_score(spark, sf):
    return columns.alignment_score(_pairs(spark, sf), -2.0, -0.5)


@query(f"""WITH {RUNS.format(flag='op')} SELECT p.pair_id, coalesce(string_agg(len || v, '' ORDER BY spot), '') AS cigar FROM pairs p LEFT JOIN runs USING (pair_id) GROUP BY 1""")
def cigar_encode(spark, sf):
    return columns.cigar(_pairs(spark, sf))


@query(f"""WITH {PAIRS} SELECT p.pair_id, coalesce(string_agg(x, '' ORDER BY pos) FILTER (op <> 'M'), '') AS a1, coalesce(string_agg(y, '' ORDER BY pos) FILTER (op <> 'M'), '') AS a2 FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1""")
def cigar_decode(spark, sf):
    """Encode, then decode from the ungapped sequences; columns of two gaps have nothing to come back from."""
    rows = columns.with_classes(_pairs(spark, sf))
    rows = rows.select("pair_id", columns.cigar_of(F.replace("ops", F.lit("M"))).alias("cigar"), F.replace("a1", F.lit("-")).alias("s1"), F.replace("a2", F.lit("-")).alias("s2"))
    return columns.cigar_decode(rows)


@query(f"""WITH {RUNS.format(flag='gap')} SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY spot) - 1)::INTEGER AS run, len::INTEGER AS length FROM runs WHERE v""")
def gap_runs(spark, sf):
    return columns.gap_runs(_pairs(spark, sf))


@query(f"""WITH {RUNS.format(flag='gap')} SELECT len::INTEGER AS length, count(*) AS runs FROM runs WHERE v GROUP BY 1""")
def gap_histogram(spark, sf):
    return columns.gap_histogram(_pairs(spark, sf))


@query(f"""WITH {RUNS.format(flag='gap')}, r AS (SELECT len FROM runs WHERE v), e AS (SELECT least(20, max(len)) AS n, CASE WHEN min(len) = max(len) THEN min(len) - 0.5 ELSE min(len) END::DOUBLE AS lo, CASE WHEN min(len) = max(len) THEN max(len) + 0.5 ELSE max(len) END::DOUBLE AS hi FROM r),
b AS (SELECT least(floor((len - lo) * n / (hi - lo)), n - 1)::INTEGER AS bin, count(*) AS runs FROM r, e GROUP BY 1)
SELECT i::INTEGER AS bin, round(lo + (hi - lo) / n * i, 6) AS low, round(lo + (hi - lo) / n * (i + 1), 6) AS high, coalesce(runs, 0) AS runs FROM (SELECT *, unnest(range(0, n)) AS i FROM e) x LEFT JOIN b ON bin = i""")
def gap_bins(spark, sf):
    rows = columns.gap_bins(_pairs(spark, sf))
    return rows.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "runs")


@query(f"""WITH {PAIRS} SELECT p.pair_id, 0 AS cid, length(any_value(p.a1))::INTEGER AS columns, count(*) FILTER (op = '=')::INTEGER AS matches, (coalesce(sum((x = '-')::INTEGER + (y = '-')::INTEGER), 0))::INTEGER AS gaps FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1""")
def chunk_counts(spark, sf):
    rows = columns.with_classes(_pairs(spark, sf)).select("pair_id", F.lit(0).alias("cid"), "a1", "a2", F.translate("ops", "=XIDM", "|    ").alias("comp"))
    return align.chunk_counts(rows)


@query(f"""WITH {RUNS.format(flag='gap')}, r AS (SELECT pair_id, max(len) FILTER (v) AS l, sum(len) FILTER (v) AS g FROM runs GROUP BY 1)
SELECT p.pair_id, coalesce(l, 0)::INTEGER AS longest_run, coalesce(g, 0)::INTEGER AS gap_columns, length(a1) > 0 AND (coalesce(l, 0) >= 30 OR coalesce(g, 0) >= 0.15 * length(a1)) AS exploded FROM pairs p LEFT JOIN r USING (pair_id)""")
def gap_explosion(spark, sf):
    return columns.gap_explosion(_pairs(spark, sf))


@query(f"""WITH {PAIRS}, c AS (SELECT pair_id, pos // 100 AS w, any_value(n) AS n, {COUNTS} FROM ops GROUP BY 1, 2)
SELECT pair_id, (w*100)::INTEGER AS start, least(w*100+100, n)::INTEGER AS "end", round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE m/(m+mm+i+d)*100 END, 10) AS identity, m AS matches, mm AS mismatches, i+d AS gaps,
 round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE (i+d)/(m+mm+i+d)*100 END, 10) AS gap_percentage FROM c""")
def coverage_windows(spark, sf):
    return _round(columns.coverage_windows(_pairs(spark, sf)), "identity", "gap_percentage")


@query(f"""WITH {PAIRS}, s AS (SELECT *, greatest(100, n // 50) AS size FROM ops), c AS (SELECT pair_id, size, pos // size AS w, count(*) AS k, count(*) FILTER (strict) AS m, count(*) FILTER (NOT gap AND NOT strict) AS mm FROM s GROUP BY 1, 2, 3)
SELECT pair_id, (w*size)::INTEGER AS start, m AS matches, mm AS mismatches, k-m-mm AS gaps, round(CASE WHEN m+mm = 0 THEN 0.0 ELSE m/(m+mm) END, 10) AS identity FROM c WHERE k = size""")
def heatmap_windows(spark, sf):
    return _round(columns.heatmap_windows(_pairs(spark, sf)), "identity")


@query(f"""WITH {PAIRS}, s AS (SELECT *, greatest(100, n // 100) AS size FROM ops), c AS (SELECT pair_id, size, pos // size AS w, count(*) FILTER (strict) AS m, count(*) FILTER (NOT gap) AS k FROM s GROUP BY 1, 2, 3)
SELECT pair_id, (w*size)::INTEGER AS start, round(m/k, 10) AS identity FROM c WHERE k > 0""")
def identity_curve(spark, sf):
    return _round(columns.identity_curve(_pairs(spark, sf)), "identity")


@query(f"""WITH {PAIRS}, c AS (SELECT p.pair_id, count(*) FILTER (strict) AS m, count(*) FILTER (NOT gap) AS k FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1), r AS (SELECT pair_id, CASE WHEN k = 0 THEN 0.0 ELSE m/k END AS x FROM c)
SELECT pair_id, CASE WHEN x >= 0.9 THEN 'EXCELLENT' WHEN x >= 0.8 THEN 'GOOD' WHEN x >= 0.7 THEN 'FAIR' ELSE 'POOR' END AS quality_class FROM r""")
def quality_class(spark, sf):
    return columns.quality_class(_pairs(spark, sf))


@query(f"""WITH {PAIRS} SELECT pair_id, pos::INTEGER AS pos, CASE WHEN gap THEN 0 WHEN strict THEN 1 ELSE -1 END AS state FROM ops WHERE pos % (n // least(1000, n)) = 0""")
def sample_states(spark, sf):
    return columns.sampled_states(_pairs(spark, sf))


@query(f"""WITH {PAIRS} SELECT pair_id, {', '.join(f"length(a{i}) - length(replace(a{i}, '{b}', '')) AS a{i}_{b.lower()}" for i in (1, 2) for b in 'ACGT')} FROM pairs""")
def base_composition(spark, sf):
    return columns.base_composition(_pairs(spark, sf))


@query(f"""WITH {PAIRS}, f AS (SELECT *, count(*) FILTER (op = '=') OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS fm,
 count(*) FILTER (op <> 'M') OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS fn,
 count(*) FILTER (op = '=') OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS bm,
 count(*) FILTER (op <> 'M') OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS bn FROM ops),
e AS (SELECT pair_id, coalesce(min(pos) FILTER (fn > 0 AND fm / fn >= 0.1), 0) AS s, coalesce(max(pos) FILTER (bn > 0 AND bm / bn >= 0.1) + 1, max(n)) AS t FROM f GROUP BY 1)
SELECT p.pair_id, CASE WHEN s < t THEN substr(a1, s + 1, t - s) ELSE a1 END AS a1, CASE WHEN s < t THEN substr(a2, s + 1, t - s) ELSE a2 END AS a2 FROM pairs p LEFT JOIN e USING (pair_id)""")
def trim_ends(spark, sf):
    return columns.trim_ends(_pairs(spark, sf))


@query(f"""WITH {RUNS.format(flag='gap')}, r AS (SELECT pair_id, max(len) FILTER (v) AS l FROM runs GROUP BY 1)
SELECT p.pair_id, length(a1) <> length(a2) AS length_mismatch, 0::BIGINT AS invalid_symbols, replace(a1, '-', '') = '' OR replace(a2, '-', '') = '' AS all_gaps, coalesce(l, 0) > 1000 AS long_gap,
 NOT (replace(a1, '-', '') = '' OR replace(a2, '-', '') = '' OR coalesce(l, 0) > 1000) AS valid FROM pairs p LEFT JOIN r USING (pair_id)""")
def validate_alignment(spark, sf):
    return columns.validate_alignment(_pairs(spark, sf))


@query(f"""WITH {PAIRS}, c AS (SELECT p.pair_id, count(*) FILTER (op = '=') AS m, count(*) FILTER (NOT gap) AS k FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1)
SELECT pair_id, round(CASE WHEN k = 0 THEN 0.0 ELSE m/k*100 END, 10) AS identity FROM c""")
def positional_identity(spark, sf):
    return _round(columns.positional_identity(_pairs(spark, sf)), "identity")


@query(f"""WITH {PAIRS} SELECT p.pair_id, (count(*) FILTER (x = y))::DOUBLE AS score FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1""")
def quick_scores(spark, sf):
    return columns.quick_score(_pairs(spark, sf))


_MASK = "list_extract([1,2,4,8,8,5,10,6,9,12,3,14,13,11,7,15], greatest(1, strpos('ACGTURYSWKMBDHVN', {0})))"


@query(f"""WITH {_pairs_sql('ACGTURYSWKMBDHVN')}, m AS (SELECT pair_id, CASE WHEN x = '-' THEN 16 ELSE {_MASK.format('x')} END AS p, CASE WHEN y = '-' THEN 16 ELSE {_MASK.format('y')} END AS q FROM cols)
SELECT pairs.pair_id, count(*) FILTER (p & q <> 0 AND p <> q) AS partial_overlaps FROM pairs LEFT JOIN m USING (pair_id) GROUP BY 1""")
def iupac_partial(spark, sf):
    return columns.partial_overlaps(_pairs(spark, sf, "ACGTURYSWKMBDHVN"))


# -- formats ----------------------------------------------------------------------------------
def _named(spark, sf):
    return _pairs(spark, sf).withColumns({"name1": F.concat(F.lit("doc"), F.col("pair_id").cast("string")), "name2": F.concat(F.lit("doc"), (F.col("pair_id") + 1).cast("string"))})


@query(f"""WITH {RUNS.format(flag='op')}, c AS (SELECT pair_id, string_agg(len || v, '' ORDER BY spot) AS cigar, sum(len) FILTER (v = '=') AS m, sum(len) FILTER (v <> 'M') AS n FROM runs GROUP BY 1),
l AS (SELECT *, length(replace(a1, '-', '')) AS l1, length(replace(a2, '-', '')) AS l2 FROM pairs)
SELECT pair_id, concat_ws(chr(9), 'doc' || pair_id, l1, 0, l1, '+', 'doc' || (pair_id + 1), l2, 0, l2, coalesce(m, 0)::BIGINT, coalesce(n, 0)::BIGINT, 255, 'cg:Z:' || coalesce(cigar, '')) AS line FROM l LEFT JOIN c USING (pair_id)""")
def paf_lines(spark, sf):
    return files.paf_lines(_named(spark, sf))


@query(f"""WITH {PAIRS}, l AS (SELECT *, length(replace(a1, '-', '')) AS l1, length(replace(a2, '-', '')) AS l2 FROM pairs)
SELECT pair_id, 0 AS nth, 'a' AS line FROM l UNION ALL SELECT pair_id, 1, 's doc' || pair_id || ' 0 ' || l1 || ' + ' || l1 || ' ' || a1 FROM l UNION ALL SELECT pair_id, 2, 's doc' || (pair_id + 1) || ' 0 ' || l2 || ' + ' || l2 || ' ' || a2 FROM l""")
def maf_lines(spark, sf):
    return files.maf_lines(_named(spark, sf))


@query(f"""WITH {PAIRS}, h AS (SELECT * FROM ops WHERE pos < 100) SELECT pair_id, (pos // 50 * 50 + 1)::INTEGER AS start, string_agg(x, '' ORDER BY pos) AS seq1, string_agg(CASE WHEN op = '=' THEN '|' ELSE ' ' END, '' ORDER BY pos) AS comp, string_agg(y, '' ORDER BY pos) AS seq2 FROM h GROUP BY 1, 2""")
def snippet_blocks(spark, sf):
    return files.snippet_blocks(_pairs(spark, sf))


@query(f"""WITH {SEQS} SELECT doc_id, regexp_replace('>doc' || doc_id || chr(10) || coalesce((SELECT string_agg(substr(seq, i * 60 + 1, 60), chr(10) ORDER BY i) FROM unnest(range(0, (length(seq) + 59) // 60)) t(i)), ''), '', '') AS record FROM seqs""")
def fasta_records(spark, sf):
    return _sequences(spark, sf).select("doc_id", files.fasta_text(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("seq")).alias("record"))


@query(f"""WITH {PAIRS} SELECT p.pair_id, {', '.join(f"coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER ({c}), '') AS {n}" for n, c in (('matches', "op = '='"), ('mismatches', "op = 'X'"), ('gaps', 'gap')))} FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1""")
def plot_places(spark, sf):
    rows = files.column_places(_pairs(spark, sf))
    return rows.select("pair_id", *[F.array_join(F.transform(n, lambda p: p.cast("string")), ",").alias(n) for n in ("matches", "mismatches", "gaps")])


_METRICS = ("matches", "mismatches", "insertions", "deletions", "total_aligned", "total_gaps", "identity", "divergence", "gap_openings", "gap_percentage")


@query(f"""WITH s AS ({ORACLE_SQL['alignment_stats']}) SELECT pair_id, m[1] AS metric, m[2]::DOUBLE AS value FROM (SELECT pair_id, unnest([{', '.join(f"['{m}', {m}::VARCHAR]" for m in _METRICS)}]) AS m FROM s)""")
def stats_long(spark, sf):
    """All ten metrics, a row each."""
    return _round(files.stats_long(_pairs(spark, sf)), "value")


@query(f"""WITH s AS ({ORACLE_SQL['alignment_stats']}), q AS ({ORACLE_SQL['alignment_score']}) SELECT pair_id, array_to_string(['ALIGNMENT SUMMARY', printf('Total score: %.2f', score), 'Matches: ' || matches, 'Mismatches: ' || mismatches, 'Insertions: ' || insertions, 'Deletions: ' || deletions,
 'Total aligned: ' || total_aligned, 'Total gaps: ' || total_gaps], ' | ') AS head, 'Gap openings: ' || gap_openings AS openings FROM s JOIN q USING (pair_id)""")
def summary_lines(spark, sf):
    """The readable summary's lines of counts."""
    rows = columns.with_classes(_pairs(spark, sf))
    text = F.split(files.summary_text(F.col("ops"), columns.score_of(F.col("ops"), -2.0, -0.5).cast("double")), "\n")
    return rows.select("pair_id", F.array_join(F.slice(text, 1, 8), " | ").alias("head"), F.element_at(text, 11).alias("openings"))


@query(f"""WITH {SEQ_PAIRS}, n AS (SELECT pair_id, length(s2) AS l, unnest(range(0, length(s1), 90)) AS q0 FROM sp), p AS (SELECT *, q0 + 60 AS q1, 5.0 + 0.9 * q0 AS a, 5.0 + 0.9 * (q0 + 60) AS b FROM n),
o AS (SELECT *, a < 0 OR b < 0 OR a > l OR b > l OR abs(b - a) > 600 AS off, l / greatest(1, l) AS scale FROM p)
SELECT pair_id, q0::INTEGER AS q_start, trunc(greatest(0.0, least(l, CASE WHEN off THEN q0 * scale ELSE a END)))::INTEGER AS t_start, trunc(greatest(0.0, least(l, CASE WHEN off THEN q1 * scale ELSE b END)))::INTEGER AS t_end FROM o""")
def projected_ranges(spark, sf):
    """Ranges of the first sequence carried over to the second by a line, or by place where it leaves it."""
    rows = _seq_pairs(spark, sf).where("length(s1) > 0").select("pair_id", F.length("s2").alias("l2"), F.explode(F.sequence(F.lit(0), F.length("s1") - 1, F.lit(90))).alias("q_start"))
    t0, t1 = anchors.projected(F.col("q_start"), F.col("q_start") + 60, F.lit(5.0), F.lit(0.9), F.col("l2"))
    return rows.select("pair_id", "q_start", t0.alias("t_start"), t1.alias("t_end"))


@query(f"""WITH {SEQS} SELECT 'doc' || doc_id || ':101-1,160' AS spec, 'doc' || doc_id AS seq_id, 101 AS start, 1160 AS "end", substr(seq, 101, 1060) AS seq FROM seqs""")
def region_slices(spark, sf):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    rows = _sequences(spark, sf).select(name.alias("seq_id"), "seq")
    return catalog.regions(rows.select(F.concat("seq_id", F.lit(":101-1,160")).alias("spec")), rows)


# -- sequences --------------------------------------------------------------------------------
@query(f"""WITH {SEQS} SELECT count(*) AS sequences, sum(length(seq))::BIGINT AS total_length, min(length(seq))::INTEGER AS min_length, max(length(seq))::INTEGER AS max_length, round(avg(length(seq)), 10) AS avg_length,
 round(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / sum(length(seq)) * 100, 10) AS gc_percent FROM seqs""")
def fasta_stats(spark, sf):
    return _round(profiles.fasta_stats(_sequences(spark, sf)), "avg_length", "gc_percent")


_ENT = " + ".join(f"(CASE WHEN {b} = 0 THEN 0.0 ELSE -({b}/n)*log2({b}/n) END)" for b in "atcg")


@query(f"""WITH {SEQS}, c AS (SELECT doc_id, length(seq) AS n, {', '.join(f"length(seq) - length(replace(seq, '{b.upper()}', '')) AS {b}" for b in 'atcg')} FROM seqs)
SELECT doc_id, n::INTEGER AS length, round(CASE WHEN n = 0 THEN 0.0 ELSE (g+c)/n*100 END, 9) AS gc, round(CASE WHEN n = 0 THEN 0.0 ELSE {_ENT} END, 9) AS entropy FROM c""")
def gc_entropy(spark, sf):
    return profiles.gc_entropy(_sequences(spark, sf)).withColumns({"gc": F.round("gc", 9), "entropy": F.round("entropy", 9)})


_KMERS = "km AS (SELECT doc_id, length(seq) - 2 AS n, substr(seq, p::INTEGER, 3) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 1)) AS p FROM seqs))"


@query(f"""WITH {SEQS}, {_KMERS} SELECT doc_id, kmer, count(*) AS n, round(count(*) / any_value(n), 10) AS frequency FROM km GROUP BY doc_id, kmer""")
def kmer_counts(spark, sf):
    return _round(profiles.kmer_counts(_sequences(spark, sf)), "frequency")


_COS = f"""{SEQS}, {_KMERS}, kc AS (SELECT doc_id, kmer, count(*) AS c FROM km GROUP BY 1, 2), nn AS (SELECT doc_id, sum(c*c)::DOUBLE AS s FROM kc GROUP BY 1),
dt AS (SELECT a.doc_id AS pair_id, sum(a.c*b.c)::DOUBLE AS ab FROM kc a JOIN kc b ON b.doc_id = a.doc_id + 1 AND a.kmer = b.kmer GROUP BY 1),
pr AS (SELECT a.doc_id AS pair_id, a.seq AS s1, b.seq AS s2 FROM seqs a JOIN seqs b ON b.doc_id = a.doc_id + 1),
co AS (SELECT pr.pair_id, coalesce(ab / (sqrt(x.s) * sqrt(y.s)), 0.0) AS cosine FROM pr LEFT JOIN dt USING (pair_id) LEFT JOIN nn x ON x.doc_id = pr.pair_id LEFT JOIN nn y ON y.doc_id = pr.pair_id + 1)"""


@query(f"WITH {_COS} SELECT pair_id, round(cosine, 9) AS cosine FROM co")
def kmer_cosine(spark, sf):
    return profiles.kmer_cosine(_seq_pairs(spark, sf)).withColumn("cosine", F.round("cosine", 9))


@query(f"""WITH {_COS}, p AS (SELECT *, length(s1) AS n1, length(s2) AS n2, {', '.join(f"length(s{i}) - length(replace(s{i}, '{b.upper()}', '')) AS {b}{i}" for i in (1, 2) for b in 'atcg')} FROM pr),
sa AS (SELECT pair_id, count(*) FILTER (substr(s1, i::INTEGER, 1) = substr(s2, i::INTEGER, 1)) AS m FROM (SELECT *, unnest(range(1, least(length(s1), length(s2)) + 1)) AS i FROM pr) GROUP BY 1),
f AS (SELECT p.*, CASE WHEN n1 = 0 THEN 0.0 ELSE (g1+c1)/n1*100 END AS gc1, CASE WHEN n2 = 0 THEN 0.0 ELSE (g2+c2)/n2*100 END AS gc2 FROM p)
SELECT f.pair_id, round(gc1, 9) AS seq1_gc, round(gc2, 9) AS seq2_gc, round(abs(gc1-gc2), 9) AS gc_ratio_diff, {', '.join('round(CASE WHEN n%d = 0 THEN 0.0 ELSE %s END, 9) AS seq%d_entropy' % (i, ' + '.join(f"(CASE WHEN {b}{i} = 0 THEN 0.0 ELSE -({b}{i}/n{i})*log2({b}{i}/n{i}) END)" for b in 'atcg'), i) for i in (1, 2))},
 n1::INTEGER AS seq1_length, n2::INTEGER AS seq2_length, abs(n1-n2)::INTEGER AS length_diff, round(CASE WHEN least(n1, n2) = 0 THEN 0.0 ELSE coalesce(m, 0)/least(n1, n2)*100 END, 9) AS seq_identity, round(cosine, 9) AS kmer_similarity
FROM f LEFT JOIN sa USING (pair_id) JOIN co USING (pair_id)""")
def pair_features(spark, sf):
    rows = profiles.pair_features(_seq_pairs(spark, sf))
    return rows.withColumns({n: F.round(n, 9) for n, t in rows.dtypes if t == "double"})


@query(f"""WITH {SEQ_PAIRS}, n AS (SELECT pair_id, length(s1) AS a, length(s2) AS b FROM sp)
SELECT pair_id, greatest(CASE WHEN greatest(a, b) > 0 AND abs(a-b)/greatest(a, b) > 0.3 THEN greatest(100, least(a, b) // 5) ELSE greatest(50, least(a, b) // 10) END, abs(a-b) + 10)::INTEGER AS "window" FROM n""")
def window_heuristic(spark, sf):
    return profiles.window_sizes(_seq_pairs(spark, sf))


@query(f"""WITH {SEQ_PAIRS}, n AS (SELECT pair_id, length(s1) AS a, length(s2) AS b, length(regexp_replace(s1, '[^GC]', '', 'g')) AS g, length(regexp_replace(s2, '[^GC]', '', 'g')) AS h FROM sp),
r AS (SELECT pair_id, CASE WHEN least(a, b) = 0 THEN 'empty' WHEN greatest(a, b)/least(a, b) > 100 THEN 'length ratio' WHEN abs(g/a*100 - h/b*100) > 50 THEN 'gc difference' ELSE '' END AS reason FROM n)
SELECT pair_id, reason = '' AS compatible, reason FROM r""")
def pair_compatibility(spark, sf):
    return profiles.compatibility(_seq_pairs(spark, sf))


@query("""WITH c AS (SELECT doc_id, substr(text, i::INTEGER, 1) AS s FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM documents)),
b AS (SELECT doc_id, count(DISTINCT s) FILTER (NOT regexp_matches(s, '^[ACGTURYSWKMBDHVNacgturyswkmbdhvn-]$')) AS k FROM c GROUP BY 1)
SELECT d.doc_id, length(text) = 0 AS empty, coalesce(k, 0)::INTEGER AS invalid_symbols, coalesce(k, 0) = 0 AS valid FROM documents d LEFT JOIN b USING (doc_id)""")
def validate_alphabet(spark, sf):
    return profiles.alphabet_problems(_table(spark, sf, "documents").select("doc_id", F.col("text").alias("seq")))


@query("""WITH c AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTRYSWKMBDHVNacgtryswkmbdhvn-]', 'N', 'g')) AS s FROM documents)
SELECT doc_id, translate(s, 'ACGTRYSWKMBDHVN-', '12485A69C3EDB7F0') || CASE WHEN length(s) % 2 = 1 THEN 'F' ELSE '' END AS packed, s AS unpacked, substr(s, 3, 4) AS part FROM c""")
def pack4_unpack4(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", alphabet.pack4(F.col("text")).alias("buf"), F.length("text").alias("n"))
    return rows.select("doc_id", F.hex("buf").alias("packed"), alphabet.unpack4(F.col("buf"), F.col("n")).alias("unpacked"), alphabet.unpack4(F.col("buf"), F.col("n"), 2, 6).alias("part"))


# -- seeds, anchors, chunks -------------------------------------------------------------------
def _sync_sql(k: int, s: int, offset: int) -> str:
    code = " + ".join(f"(strpos('ACGT', substr(seq, p + {i + 1}, 1)) - 1) * {4 ** (s - 1 - i)}" for i in range(s))
    return SEQS + f""", sm AS (SELECT doc_id, length(seq) AS n, p, ({code})::BIGINT * 2654435761 % 4294967291 AS h
 FROM (SELECT *, unnest(range(0, length(seq) - {s - 1}))::INTEGER AS p FROM seqs)),
mn AS (SELECT *, min(h) OVER w AS m, max(p) OVER w AS last, arg_max(p, (4294967291 - h) * 1000000000::HUGEINT + p) OVER w AS spot FROM sm WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - s} FOLLOWING)),
sy AS (SELECT doc_id, p AS pos, m AS hash FROM mn WHERE last = p + {k - s} AND spot = p + {offset})"""


def _rand_sql(sync: str, least: int, most: int) -> str:
    return sync + f""", st AS (SELECT a.doc_id, a.pos AS pos1, min_by(b.pos, xor(a.hash, b.hash) * 1000000000::HUGEINT + b.pos) AS pos2, min(xor(a.hash, b.hash)) AS hash FROM sy a JOIN sy b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + {least} AND a.pos + {most} GROUP BY 1, 2)"""


_SYNC = SYNCMERS = _sync_sql(10, 3, 2)
_RAND = _rand_sql(_SYNC, 10, 30)
_SHIPPED = Config()
_ANCH = _RAND + """, cp AS (SELECT doc_id, hash FROM st GROUP BY 1, 2 HAVING count(*) <= 200),
an AS (SELECT a.doc_id AS pair_id, a.pos1 AS qpos, b.pos1 AS tpos, a.pos2 - a.pos1 AS span, a.hash AS hash, b.pos1 - a.pos1 AS diag FROM st a JOIN st b ON b.doc_id = a.doc_id + 1 AND a.hash = b.hash JOIN cp ON cp.doc_id = b.doc_id AND cp.hash = b.hash)"""


def _marks(spark, sf):
    return seeds.syncmers(_sequences(spark, sf))


def _strobes(spark, sf):
    return seeds.strobes(_sequences(spark, sf))


def _sides(spark, sf):
    """Both sides of neighbouring documents: the strobes are worked out once, as a table."""
    rows = folders.stored(_strobes(spark, sf), "strobes")
    return rows.withColumn("pair_id", F.col("doc_id")), rows.withColumn("pair_id", F.col("doc_id") - 1)


@query(f"WITH {_SYNC} SELECT doc_id, pos, hash FROM sy")
def syncmers(spark, sf):
    return _marks(spark, sf)


@query(f"WITH {_RAND} SELECT doc_id, pos1, pos2, hash, pos2 - pos1 AS span, 20 AS length FROM st")
def randstrobes(spark, sf):
    return _strobes(spark, sf)


@query(f"WITH {_sync_sql(_SHIPPED.k, _SHIPPED.s, _SHIPPED.sync_offset)} SELECT doc_id, pos, hash FROM sy")
def syncmers_shipped(spark, sf):
    """With the settings that alignments use."""
    return seeds.syncmers(_sequences(spark, sf), "doc_id", _SHIPPED.k, _SHIPPED.s, _SHIPPED.sync_offset)


@query(f"WITH {_rand_sql(_sync_sql(_SHIPPED.k, _SHIPPED.s, _SHIPPED.sync_offset), _SHIPPED.w_min, _SHIPPED.w_max)} SELECT doc_id, pos1, pos2, hash, pos2 - pos1 AS span, {2 * _SHIPPED.k} AS length FROM st")
def randstrobes_shipped(spark, sf):
    """By joining the syncmers, for sequences too long for one row's arrays."""
    return seeds.randstrobes(syncmers_shipped(spark, sf), "doc_id", _SHIPPED.k, _SHIPPED.w_min, _SHIPPED.w_max)


@query(f"WITH {_RAND} SELECT doc_id, pos1, pos2, hash, pos2 - pos1 AS span, 20 AS length FROM st WHERE hash & 7 = 0")
def dense_strobes(spark, sf):
    return seeds.dense(_strobes(spark, sf), 3)


@query(f"WITH {_RAND} SELECT doc_id, hash, count(*) AS occurrences, string_agg(pos1::VARCHAR, ',' ORDER BY pos1) AS positions FROM st GROUP BY 1, 2 HAVING count(*) <= 3")
def strobe_index_capped(spark, sf):
    rows = seeds.strobe_index(_strobes(spark, sf), most=3)
    return rows.withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query(f"WITH {_ANCH} SELECT * FROM an")
def strobe_anchors(spark, sf):
    return anchors.anchors(*_sides(spark, sf))


@query(f"""WITH {_RAND}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY pos1) AS nth FROM st)
SELECT a.doc_id AS pair_id, a.pos1 AS qpos, b.pos1 AS tpos, a.pos2 - a.pos1 AS span, a.hash AS hash, b.pos1 - a.pos1 AS diag FROM st a JOIN b ON b.doc_id = a.doc_id + 1 AND a.hash = b.hash WHERE nth <= 10""")
def merge_anchors(spark, sf):
    """At most ten partners a hash."""
    return anchors.merged_anchors(*_sides(spark, sf))


_LOCAL = _RAND + """, sq AS (SELECT a.doc_id AS pair_id, length(a.seq) AS n1, length(b.seq) AS n2 FROM seqs a JOIN seqs b ON b.doc_id = a.doc_id + 1),
ch AS (SELECT pair_id, (s // 180)::INTEGER AS cid, s AS q_start, least(s + 200, n1) AS q_end, s AS t_start, least(s + 200, n2) AS t_end FROM (SELECT *, unnest(range(0, least(n1, n2), 180)) AS s FROM sq)),
la AS (SELECT ch.pair_id, cid, pos1 - q_start AS q, hash, pos2 - pos1 AS span FROM ch JOIN st ON st.doc_id = ch.pair_id AND pos1 >= q_start AND pos1 < q_end),
lb AS (SELECT ch.pair_id, cid, pos1 - t_start AS t, hash, count(*) OVER (PARTITION BY ch.pair_id, cid, hash) AS n FROM ch JOIN st ON st.doc_id = ch.pair_id + 1 AND pos1 >= t_start AND pos1 < t_end),
lo AS (SELECT pair_id, cid, q::INTEGER AS q, t::INTEGER AS t, span, hash, (row_number() OVER (PARTITION BY pair_id, cid ORDER BY q, t))::INTEGER AS nth FROM la JOIN lb USING (pair_id, cid, hash) WHERE n <= 2)"""


def _local(spark, sf):
    rows = _seq_pairs(spark, sf).select("pair_id", F.length("s1").alias("l1"), F.length("s2").alias("l2"))
    chunks = anchors.diagonal_chunks(rows, 200, 20)
    return chunks, reanchor.local_anchors(chunks, *_sides(spark, sf), most=2)


@query(f"WITH {_LOCAL} SELECT * FROM lo WHERE nth <= 50")
def local_anchors(spark, sf):
    """The first fifty anchors inside each chunk, counted from its start."""
    return _local(spark, sf)[1]


@query(f"""WITH {_LOCAL}, k AS (SELECT * FROM lo WHERE nth <= 50), n AS (SELECT pair_id, cid, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT pair_id, cid, q, t FROM k JOIN n USING (pair_id, cid) JOIN ch USING (pair_id, cid) WHERE nth = n // 2 + 1 AND q > 10 AND q < q_end - q_start - 10 AND t > 10 AND t < t_end - t_start - 10""")
def chunk_splits(spark, sf):
    """Where chunks would be split: their median anchors."""
    return reanchor.median_splits(*_local(spark, sf))


@query(f"""WITH {_RAND}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos1) AS rn FROM st)
SELECT a.doc_id AS pair_id, a.pos1 AS qpos, b.pos1 AS tpos, greatest(a.pos2 - a.pos1, b.pos2 - b.pos1) AS span, xor(a.hash, b.hash) AS hash, b.pos1 - a.pos1 AS diag FROM r a JOIN r b ON b.doc_id = a.doc_id + 1 AND a.rn = b.rn""")
def zip_anchors(spark, sf):
    return anchors.zipped_anchors(*_sides(spark, sf))


@query(f"""WITH {_ANCH}, f AS (SELECT pair_id, count(*) AS n, regr_slope(tpos, qpos) AS m, regr_intercept(tpos, qpos) AS b, min(diag) AS d FROM an GROUP BY 1)
SELECT pair_id, round(CASE WHEN n < 2 OR m IS NULL OR isnan(m) THEN 1.0 ELSE greatest(-10.0, least(10.0, m)) END, 6) AS slope, round(CASE WHEN n < 2 OR m IS NULL OR isnan(m) THEN d ELSE b END, 6) AS intercept FROM f""")
def anchor_regression(spark, sf):
    return anchors.regression(anchors.anchors(*_sides(spark, sf))).select("pair_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"""WITH {SEQ_PAIRS}, g AS (SELECT pair_id, length(s1) AS a, length(s2) AS b, unnest(range(0, greatest(length(s1), length(s2)), 90)) AS s FROM sp)
SELECT pair_id, (s // 90)::INTEGER AS cid, s::INTEGER AS q_start, least(s + 100, a)::INTEGER AS q_end, s::INTEGER AS t_start, least(s + 100, b)::INTEGER AS t_end FROM g WHERE s < a AND s < b""")
def diagonal_chunks(spark, sf):
    rows = _seq_pairs(spark, sf).select("pair_id", F.length("s1").alias("l1"), F.length("s2").alias("l2"))
    return anchors.diagonal_chunks(rows, 100, 10)


@query(f"""WITH {SEQ_PAIRS}, g AS (SELECT pair_id, length(s1) AS a, length(s2) AS b, unnest(range(0, least(length(s1), length(s2)), 90)) AS s FROM sp)
SELECT pair_id, (s // 90)::INTEGER AS cid, s::INTEGER AS q_start, (CASE WHEN s + 90 >= least(a, b) THEN a ELSE least(s + 100, a) END)::INTEGER AS q_end, s::INTEGER AS t_start, (CASE WHEN s + 90 >= least(a, b) THEN b ELSE least(s + 100, b) END)::INTEGER AS t_end FROM g""")
def diagonal_chunks_to_the_end(spark, sf):
    """The shipped form: the last chunk goes on to both ends."""
    rows = _seq_pairs(spark, sf).select("pair_id", F.length("s1").alias("l1"), F.length("s2").alias("l2"))
    return anchors.diagonal_chunks(rows, 100, 10, cover_tail=True)


@query(f"""WITH {SEQ_PAIRS}, g AS (SELECT pair_id, length(s1) AS a, length(s2) AS b, unnest(range(0, least(length(s1), length(s2)), 90)) AS s FROM sp)
SELECT pair_id, (s // 90)::INTEGER AS cid, s::INTEGER AS q_start, least(s + 100, a, s + 60)::INTEGER AS q_end, s::INTEGER AS t_start, least(s + 100, b, s + 60)::INTEGER AS t_end FROM g""")
def chunk_cap(spark, sf):
    return anchors.capped_chunks(diagonal_chunks(spark, sf), 60)


@query(f"WITH {_RAND} SELECT doc_id AS pair_id, pos1 AS qpos, pos1 AS tpos, pos2 - pos1 AS span, hash, 0 AS diag FROM st")
def self_anchors(spark, sf):
    return anchors.self_anchors(_strobes(spark, sf).withColumnRenamed("doc_id", "pair_id"))


@query(f"""WITH {SEQ_PAIRS}, l AS (SELECT pair_id, length(s1) AS a, length(s2) AS b FROM sp WHERE length(s1) > 0), k AS (SELECT *, greatest(1, a // 100) AS n FROM l), g AS (SELECT *, unnest(range(0, n)) AS i FROM k),
q AS (SELECT *, trunc(a / n * i) AS q0, CASE WHEN i = n - 1 THEN a ELSE trunc(a / n * (i + 1)) END AS q1 FROM g), t AS (SELECT *, trunc(q0 / a * greatest(1, b)) AS t0, trunc(q1 / a * greatest(1, b)) AS t1 FROM q)
SELECT pair_id, i::INTEGER AS cid, q0::INTEGER AS q_start, (q0 + greatest(q1 - q0, t1 - t0))::INTEGER AS q_end, t0::INTEGER AS t_start, (t0 + greatest(q1 - q0, t1 - t0))::INTEGER AS t_end FROM t""")
def fallback_tiles(spark, sf):
    rows = _seq_pairs(spark, sf).select("pair_id", F.lit(0).alias("q0"), F.length("s1").alias("q1"), F.lit(0).alias("t0"), F.length("s2").alias("t1"))
    return anchors.fallback_tiles(rows, 100)


def _chains(spark, sf):
    rows = folders.stored(seeds.strobes(_sequences(spark, sf), k=15, s=7, offset=3), "strobes")
    found = anchors.anchors(rows.withColumn("pair_id", F.col("doc_id")), rows.withColumn("pair_id", F.col("doc_id") - 1))
    return folders.stored(anchors.chain_anchors(folders.stored(found, "anchors")), "chains")


@query(f"""WITH {_rand_sql(_sync_sql(15, 7, 3), 10, 30)}, cp AS (SELECT doc_id, hash FROM st GROUP BY 1, 2 HAVING count(*) <= 200)
SELECT a.doc_id AS pair_id, a.pos1 AS qpos, b.pos1 AS tpos, a.pos2 - a.pos1 AS span, a.hash AS hash, b.pos1 - a.pos1 AS diag, true AS rises
FROM st a JOIN st b ON b.doc_id = a.doc_id + 1 AND a.hash = b.hash JOIN cp ON cp.doc_id = b.doc_id AND cp.hash = b.hash""")
def chained_anchors(spark, sf):
    """Every anchor is in one chain, and each is behind the one before it on both axes (links and scores: the tests' plain rule)."""
    w = Window.partitionBy("pair_id", "chain_id").orderBy("rank")
    up = lambda c: F.coalesce(F.col(c) > F.lag(c).over(w), F.col("rank") == 0)
    rows = _chains(spark, sf).withColumn("rises", up("qpos") & up("tpos"))
    return rows.select("pair_id", "qpos", "tpos", "span", "hash", "diag", "rises")


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, 0 AS first, 0::BIGINT AS holes, true AS reaches FROM sp WHERE length(s1) > 0")
def chain_chunks(spark, sf):
    """Chunks along chains and between them: from the first symbol of the first sequence to its last one no place is left out."""
    rows = _seq_pairs(spark, sf).select("pair_id", F.length("s1").alias("l1"), F.length("s2").alias("l2"))
    before = Window.partitionBy("pair_id").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    hole = F.col("q_start") > F.coalesce(F.max("q_end").over(before), F.lit(0))
    found = anchors.chains_to_chunks(_chains(spark, sf), rows, 100).withColumn("hole", hole.cast("int")).join(rows, "pair_id")
    return found.groupBy("pair_id").agg(F.min("q_start").alias("first"), F.sum("hole").alias("holes"), (F.max("q_end") >= F.max("l1")).alias("reaches"))


@query(f"WITH {_SYNC} SELECT hash % 256 AS bucket, count(*) AS n FROM sy GROUP BY 1")
def hash_buckets(spark, sf):
    return _marks(spark, sf).groupBy(F.pmod("hash", F.lit(256)).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_RAND} SELECT DISTINCT a.doc_id AS pair_id, a.pos1, a.hash FROM st a WHERE EXISTS (SELECT 1 FROM st b WHERE b.doc_id = a.doc_id + 1 AND b.hash = a.hash)")
def shared_strobes(spark, sf):
    first, second = _sides(spark, sf)
    return first.join(second.select("pair_id", "hash"), ["pair_id", "hash"], "left_semi").select("pair_id", "pos1", "hash").distinct()


# -- alignment kernels ------------------------------------------------------------------------
_NAMES = "n AS (SELECT p_partkey AS k, upper(replace(p_name, ' ', '')) AS s FROM part), p AS (SELECT a.k AS pair_id, a.s AS s1, b.s AS s2 FROM n a JOIN n b ON b.k = a.k + 1)"


def _name_pairs(spark, sf):
    """Neighbouring part names: sequences so short that SQL can fill whole matrices."""
    n = _table(spark, sf, "part").select(F.col("p_partkey").alias("pair_id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("s1"))
    return n.join(n.select((F.col("pair_id") - 1).alias("pair_id"), F.col("s1").alias("s2")), "pair_id")


def _affine_sql(local: bool) -> str:
    """Rows of the three-state recursion as lists: f ends in a gap of the second, pl in none or that, h in any."""
    first, f0, h0, floor = ("0.0", "-1e18::DOUBLE", "0.0", ", 0.0") if local else ("CASE WHEN j = 0 THEN 0.0 ELSE -2.0 - 0.5 * (j - 1) END", "-2.0 - 0.5 * i", "f2[1]", "")
    return f"""WITH RECURSIVE {_NAMES}, r(pair_id, s1, s2, i, h, f, best) AS (
SELECT pair_id, s1, s2, 0::BIGINT, list_transform(range(0, length(s2) + 1), lambda j: ({first})::DOUBLE), list_transform(range(0, length(s2) + 1), lambda j: -1e18::DOUBLE), 0::DOUBLE FROM p
UNION ALL SELECT pair_id, s1, s2, i + 1, h2, f2, greatest(best, list_max(h2)) FROM (SELECT *, list_transform(range(0, length(s2) + 1), lambda j: greatest(pl[j + 1], coalesce(list_max(list_transform(range(0, j), lambda k: pl[k + 1] - 2.0 - 0.5 * (j - k - 1))), -1e18))::DOUBLE) AS h2
 FROM (SELECT *, list_transform(range(0, length(s2) + 1), lambda j: (CASE WHEN j = 0 THEN {h0} ELSE greatest(h[j] + CASE WHEN substr(s1, i + 1, 1) = substr(s2, j, 1) THEN 1.0 ELSE -1.0 END, f2[j + 1]{floor}) END)::DOUBLE) AS pl
  FROM (SELECT *, list_transform(range(0, length(s2) + 1), lambda j: (CASE WHEN j = 0 THEN {f0} ELSE greatest(h[j + 1] - 2.0, f[j + 1] - 0.5) END)::DOUBLE) AS f2 FROM r WHERE i < length(s1)))))
SELECT pair_id, {'best' if local else 'h[length(s2) + 1]'} AS score{'' if local else ', s1, s2'} FROM r WHERE i = length(s1)"""


def _kept(rows: DataFrame, *more: str) -> DataFrame:
    """The sequences that an alignment's gapped strings hold."""
    return rows.select("pair_id", *more, F.replace("a1", F.lit("-")).alias("s1"), F.replace("a2", F.lit("-")).alias("s2"))


@query(f"""WITH RECURSIVE {_NAMES}, r(pair_id, s1, s2, i, h) AS (SELECT pair_id, s1, s2, 0::BIGINT, list_transform(range(0, length(s2) + 1), lambda j: (-j)::BIGINT) FROM p
UNION ALL SELECT pair_id, s1, s2, i + 1, list_transform(range(0, length(s2) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: (CASE WHEN k = 0 THEN -(i + 1) ELSE greatest(h[k] + CASE WHEN substr(s1, i + 1, 1) = substr(s2, k, 1) THEN 1 ELSE -1 END, h[k + 1] - 1) END - (j - k))::BIGINT))) FROM r WHERE i < length(s1))
SELECT pair_id, h[length(s2) + 1]::DOUBLE AS score, s1, s2 FROM r WHERE i = length(s1)""")
def name_overlap_scores(spark, sf):
    """Best linear-gap scores, and that the alignments hold both sequences."""
    return _kept(align.overlap_align(_name_pairs(spark, sf)), "score")


@query(_affine_sql(False))
def name_affine_scores(spark, sf):
    return _kept(align.affine_align(_name_pairs(spark, sf)), "score")


@query(_affine_sql(True))
def name_local_scores(spark, sf):
    return align.affine_align(_name_pairs(spark, sf), local=True).select("pair_id", "score")


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, s1, s2 FROM sp")
def beam_sequences(spark, sf):
    """Whatever the beam loses is aligned after all: both sequences come back."""
    return _kept(align.beam_align(_seq_pairs(spark, sf)))


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, s1, s2 FROM sp WHERE length(s1) > 0 AND length(s2) > 0")
def stitched_sequences(spark, sf):
    """Overlapping chunks aligned one by one and joined hold both sequences, each symbol once."""
    return _kept(align_pairs(_seq_pairs(spark, sf), Config(chunk_size=200, overlap=40)))


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, s1, s2 FROM sp WHERE length(s1) > 0 AND length(s2) > 0")
def anchored_sequences(spark, sf):
    """The same with chunks along anchor chains."""
    return _kept(align_pairs(_seq_pairs(spark, sf), Config(chunk_size=200, overlap=40), anchored=True))


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, s1, s2 FROM sp WHERE length(s1) > 0 AND length(s2) > 0")
def reanchored_sequences(spark, sf):
    """Chunks whose gaps explode are split at anchors inside them and aligned again: both sequences come back."""
    c = Config(chunk_size=200, overlap=40, k=10, s=3, w_min=10, w_max=30)
    return _kept(align.stitch_chunks(align_reanchored(_seq_pairs(spark, sf), c)))


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, length(s1)::BIGINT AS symbols1, length(s2)::BIGINT AS symbols2, md5(s1) AS md5_1, md5(s2) AS md5_2 FROM sp WHERE length(s1) > 0 AND length(s2) > 0")
def stitched_blocks(spark, sf):
    """Alignments in blocks: in order, they hold both sequences, each symbol once."""
    rows = align_in_blocks(_seq_pairs(spark, sf), Config(chunk_size=200, overlap=40))
    bare = rows.select("pair_id", "block", *[F.replace(a, F.lit("-")).alias(a) for a in ("a1", "a2")])
    whole = bare.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("block", "a1", "a2"))).alias("b"))
    joined = [F.array_join(f"b.a{i}", "") for i in (1, 2)]
    return whole.select("pair_id", *[F.length(j).cast("long").alias(f"symbols{i}") for i, j in enumerate(joined, 1)], *[F.md5(j).alias(f"md5_{i}") for i, j in enumerate(joined, 1)])


@query(f"""WITH {PAIRS}, o AS (SELECT *, lag(op) OVER (PARTITION BY pair_id ORDER BY pos) AS before FROM ops), z AS (SELECT *, lag(op) OVER (PARTITION BY pair_id ORDER BY pos) AS before FROM ops WHERE op <> 'M'),
s AS (SELECT pair_id, sum(CASE WHEN op = '=' THEN 1.0 WHEN op = 'X' THEN -2.0 WHEN before = op THEN -0.5 ELSE -2.0 END) AS score FROM z GROUP BY 1),
c AS (SELECT pair_id, {COUNTS}, count(*) FILTER (op IN ('I','D') AND (before IS NULL OR before IN ('=','X'))) AS g, count(*) AS n FROM o GROUP BY 1)
SELECT pair_id, m AS matches, mm AS mismatches, i AS insertions, d AS deletions, g AS gap_openings, coalesce(score, 0.0)::DOUBLE AS score, n AS columns, ((n + 96) // 97)::BIGINT AS blocks, m+mm+i+d AS total_aligned, i+d AS total_gaps,
 round(CASE WHEN m+mm+i+d = 0 THEN 0.0 ELSE m/(m+mm+i+d) END, 10) AS identity FROM c LEFT JOIN s USING (pair_id)""")
def block_statistics(spark, sf):
    """Statistics and score of alignments cut into blocks: gaps that go on at a seam count once."""
    cut = lambda a: F.regexp_extract_all(a, F.lit(".{1,97}"), F.lit(0))
    rows = _pairs(spark, sf).select("pair_id", F.posexplode(F.arrays_zip(cut("a1").alias("a1"), cut("a2").alias("a2"))).alias("block", "c"))
    return _round(align.measure_blocks(rows.select("pair_id", "block", "c.a1", "c.a2")), "identity")


def _agrees(rows: DataFrame, mismatch: float, gap_open: float, gap_extend: float) -> DataFrame:
    """Adds ``agrees``: whether the strings, valued by their column classes, give the score that came with them."""
    told = columns.score_of(F.col("ops"), gap_open, gap_extend, mismatch=mismatch)
    return columns.with_classes(rows).withColumn("agrees", F.abs(told - F.col("score")) < 1e-6)


_AGREE = f"WITH {SEQ_PAIRS} SELECT pair_id, true AS agrees, s1, s2 FROM sp"


@query(_AGREE)
def nw_overlap_align(spark, sf):
    """Whole alignments hold both sequences, and their strings are worth their scores (the best: ``name_overlap_scores``)."""
    return _kept(_agrees(align.overlap_align(_seq_pairs(spark, sf)), -1.0, -1.0, -1.0), "agrees")


@query(_AGREE)
def nw_beam_align(spark, sf):
    return _kept(_agrees(align.beam_align(_seq_pairs(spark, sf)), -2.0, -2.0, -0.5), "agrees")


@query(_AGREE)
def affine_global_align(spark, sf):
    return _kept(_agrees(align.affine_align(_seq_pairs(spark, sf)), -1.0, -2.0, -0.5), "agrees")


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, true AS agrees, true AS placed FROM sp")
def local_align(spark, sf):
    """Local alignments are worth their scores, and hold the sequences from where they are said to start."""
    pairs = _seq_pairs(spark, sf)
    rows = _agrees(align.affine_align(pairs, local=True), -1.0, -2.0, -0.5).join(pairs, "pair_id")
    bare = [F.replace(F.col(f"a{i}"), F.lit("-")) for i in (1, 2)]
    there = [F.substring(f"s{i}", F.col(f"start{i}") + 1, F.length(x)) == x for i, x in enumerate(bare, 1)]
    return rows.select("pair_id", "agrees", (there[0] & there[1]).alias("placed"))


@query(f"WITH {SEQ_PAIRS} SELECT pair_id, length(s1)::BIGINT AS symbols1, length(s2)::BIGINT AS symbols2, true AS cigar_agrees FROM sp WHERE length(s1) > 0 AND length(s2) > 0")
def chunked_align_stitch(spark, sf):
    """The whole pipeline: statistics and CIGAR account for every symbol of both sequences."""
    rows = align_and_measure(_seq_pairs(spark, sf), Config(chunk_size=200, overlap=40))
    runs = F.regexp_extract_all("cigar", F.lit("([0-9]+[=XID])"), F.lit(1))
    n = lambda kinds: F.aggregate(F.filter(runs, lambda r: F.right(r, F.lit(1)).isin(*kinds)), F.lit(0).cast("long"), lambda a, r: a + F.regexp_extract(r, "[0-9]+", 0).cast("long"))
    one, two = F.col("matches") + F.col("mismatches") + F.col("deletions"), F.col("matches") + F.col("mismatches") + F.col("insertions")
    agrees = (n("=") == F.col("matches")) & (n("=XD") == one) & (n("=XI") == two)
    return rows.select("pair_id", one.alias("symbols1"), two.alias("symbols2"), agrees.alias("cigar_agrees"))


_BAND = ["one", *band.FEATURES, "band"]
_MEANS = ", ".join(f"struct_pack(a := '{a}', b := '{b}', value := round(avg({a}::DOUBLE * {b}::DOUBLE), 3))" for i, a in enumerate(_BAND) for b in _BAND[i:])


@query(f"""WITH pf AS ({ORACLE_SQL['pair_features']}), {PAIRS}, c AS (SELECT pair_id, abs(sum((x <> '-')::INTEGER) OVER w - sum((y <> '-')::INTEGER) OVER w) AS apart FROM cols WINDOW w AS (PARTITION BY pair_id ORDER BY pos)),
b AS (SELECT p.pair_id, coalesce(max(apart), 0)::BIGINT AS band FROM pairs p LEFT JOIN c USING (pair_id) GROUP BY 1), t AS (SELECT *, 1.0 AS one FROM pf JOIN b USING (pair_id))
SELECT m.a, m.b, m.value FROM (SELECT unnest([{_MEANS}]) AS m FROM t)""")
def band_moments(spark, sf):
    """What the band model is fitted from: means of products of ten features and the band that an alignment needs."""
    rows = pair_features(spark, sf).join(band.needed_band(_pairs(spark, sf)), "pair_id")
    return band.moments(rows).withColumn("value", F.round("value", 3))


# -- SQL functions ----------------------------------------------------------------------------
@query(f"WITH {_RAND} SELECT doc_id, pos1, pos2, hash FROM st")
def sql_randstrobes(spark, sf):
    """The table function, in a lateral join."""
    registry.register(spark)
    return spark.sql("SELECT doc_id, pos1, pos2, hash FROM {seqs} AS d, LATERAL randstrobes(d.seq, 10, 3, 2, 10, 30)", seqs=_sequences(spark, sf))


@query(f"WITH {_SYNC} SELECT doc_id, count(*) AS seeds, sum(hash)::BIGINT AS total FROM sy GROUP BY 1")
def sql_syncmers(spark, sf):
    registry.register(spark)
    return spark.sql("SELECT doc_id, count(*) AS seeds, sum(hash) AS total FROM {seqs} AS d, LATERAL syncmers(d.seq, 10, 3, 2) GROUP BY doc_id", seqs=_sequences(spark, sf))


@query(f"""WITH {RUNS.format(flag='gap')} SELECT pair_id, count(*) AS runs, max(len)::INTEGER AS longest FROM runs WHERE v GROUP BY 1""")
def sql_gap_runs(spark, sf):
    registry.register(spark)
    return spark.sql("SELECT pair_id, count(*) AS runs, max(length) AS longest FROM {pairs} AS p, LATERAL gap_runs(p.a1, p.a2) GROUP BY pair_id", pairs=_pairs(spark, sf))


# -- tensors, plots, metrics ------------------------------------------------------------------
@query(f"""WITH {SEQS} SELECT doc_id, rpad(replace(replace(replace(replace(substr(seq, 1, 500), 'A', '01000000'), 'C', '00010000'), 'G', '00000100'), 'T', '00000001'), 4000, '0') AS tensor, least(length(seq), 500)::INTEGER AS symbols FROM seqs""")
def one_hot(spark, sf):
    return tensors.one_hot(_sequences(spark, sf), 500).withColumn("tensor", F.hex("tensor"))


@query(f"""WITH {PAIRS}, l AS (SELECT *, unnest([0, 1, 2]) AS level FROM ops), w AS (SELECT *, (100 * 10 ** level)::BIGINT AS size FROM l)
SELECT pair_id, level::INTEGER AS level, (pos // size * size)::INTEGER AS start, (max(pos) + 1)::INTEGER AS "end", count(*) FILTER (op = '=') AS matches, count(*) FILTER (op = 'X') AS mismatches, count(*) FILTER (op IN ('I', 'D')) AS gaps FROM w GROUP BY pair_id, level, size, pos // size""")
def window_pyramid(spark, sf):
    return columns.window_pyramid(_pairs(spark, sf))


@query("""SELECT count(*) AS chunks, round(min(l_extendedprice), 2)::DOUBLE AS least_score, round(max(l_extendedprice), 2)::DOUBLE AS greatest_score, round(sum(l_extendedprice), 0)::DOUBLE AS total_score, count(*) AS in_files FROM lineitem""")
def run_report(spark, sf):
    """Metrics observed while chunks are written, and the metadata beside them, read back."""
    n = F.col("l_linenumber")
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair_id"), n.alias("cid"), (n * 10).alias("q_start"), (n * 10 + 5).alias("q_end"), F.lit(0).alias("t_start"), F.lit(7).alias("t_end"), F.col("l_extendedprice").alias("score"))
    folder = folders.scratch(spark, "report")
    report.write_reported(rows, folder)
    files_ = spark.read.json(f"{folder}/metadata").agg(F.sum("chunks").alias("in_files"))
    told = spark.read.json(f"{folder}/metrics").select("chunks", *[F.round(c, d).alias(c) for c, d in (("least_score", 2), ("greatest_score", 2), ("total_score", 0))])
    return told.join(F.broadcast(files_))  # one row each


# -- names ------------------------------------------------------------------------------------
_KEY = "array_to_string(list_transform(regexp_extract_all(lower({0}), '(\\d+|\\D+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 20, '0') ELSE r END), chr(1))"


@query(f"""WITH n AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY {_KEY.format('source')}, source) AS rn FROM n)
SELECT source, rn::INTEGER AS place FROM r WHERE rn BETWEEN (SELECT rn FROM r WHERE source = 'src2') AND (SELECT rn FROM r WHERE source = 'src11')""")
def natural_sort_range(spark, sf):
    names = _table(spark, sf, "documents").select("source").distinct()
    ranked = names.withColumn("place", F.row_number().over(Window.orderBy(catalog.natural_key(F.col("source")), "source")))
    return catalog.name_range(names, "src11:src2", "source").join(ranked, "source")


@query("""WITH s AS (SELECT n_nationkey, n_name FROM nation), p AS (SELECT a.n_name || '+' || b.n_name AS spec, upper(regexp_replace(a.n_name, '[^ACGTacgt]', '', 'g')) || upper(regexp_replace(b.n_name, '[^ACGTacgt]', '', 'g')) AS seq FROM s a JOIN s b ON b.n_nationkey = a.n_nationkey + 1) SELECT * FROM p""")
def combined_sequences(spark, sf):
    n = _table(spark, sf, "nation")
    specs = n.join(n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("other")), "n_nationkey").select(F.concat_ws("+", F.lower("n_name"), "other").alias("asked"), F.concat_ws("+", "n_name", "other").alias("spec"))
    found = catalog.combined(specs.select(F.col("asked").alias("spec")), n.select(F.col("n_name").alias("seq_id"), F.upper(F.regexp_replace("n_name", "[^ACGTacgt]", "")).alias("seq")))
    return found.withColumnRenamed("spec", "asked").join(specs, "asked").select("spec", "seq")


# -- measurements -----------------------------------------------------------------------------
@query("""SELECT event_type, count(value) AS samples, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS avg_value, round(coalesce(stddev_samp(value), 0), 6) AS std_value FROM events GROUP BY 1""")
def perf_rollup(spark, sf):
    rows = profiles.run_metrics(_table(spark, sf, "events"), "event_type", "value")
    return rows.withColumns({n: F.round(n, 6) for n in ("min_value", "max_value", "avg_value", "std_value")})


@query("""SELECT l_returnflag, round(avg(l_extendedprice / l_quantity), 6) AS avg_ratio, round(min(l_extendedprice / l_quantity), 6) AS min_ratio, round(max(l_extendedprice / l_quantity), 6) AS max_ratio FROM lineitem GROUP BY 1""")
def timing_ratios(spark, sf):
    rows = profiles.speedups(_table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")
    return rows.withColumns({n: F.round(n, 6) for n in ("avg_ratio", "min_ratio", "max_ratio")})


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) SELECT l_orderkey AS pair_id, l_linenumber AS cid, l_extendedprice AS score FROM r WHERE k <= 3""")
def chunk_topk(spark, sf):
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("cid"), F.col("l_extendedprice").alias("score"))
    return align.chunk_topk(rows, 3)


# -- files ------------------------------------------------------------------------------------
def _fasta_folder(spark: SparkSession, sf: str) -> str:
    """The sequences of all documents, written as FASTA."""
    rows = _sequences(spark, sf).where(F.length("seq") > 0)
    path = folders.scratch(spark, "fasta")
    rows.select(files.fasta_text(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(" of documents")), F.col("seq"))).write.text(path)
    return path


@query(f"WITH {SEQS} SELECT 'doc' || doc_id AS seq_id, 'doc' || doc_id || ' of documents' AS description, seq FROM seqs WHERE length(seq) > 0")
def fasta_read_back(spark, sf):
    return fasta.read_fasta(spark, _fasta_folder(spark, sf)).select("seq_id", "description", "seq")


@query(f"WITH {SEQS} SELECT 'doc' || doc_id AS seq_id FROM seqs WHERE length(seq) > 0")
def fasta_ids(spark, sf):
    return fasta.read_ids(spark, _fasta_folder(spark, sf)).select("seq_id")


@query(f"""WITH {SEQ_PAIRS} SELECT pair_id, 'a' AS name1, 'b' AS name2, s1, s2 FROM sp WHERE pair_id = (SELECT min(pair_id) FROM sp WHERE length(s1) > 0 AND length(s2) > 0)""")
def fasta_pair(spark, sf):
    """First records of two files: the first pair with symbols, written and loaded again."""
    pair = _seq_pairs(spark, sf).where("length(s1) > 0 and length(s2) > 0").orderBy("pair_id").limit(1)
    key = pair.first()["pair_id"]
    paths = {}
    for name, column in (("a", "s1"), ("b", "s2")):
        paths[name] = folders.scratch(spark, f"fasta-{name}")
        pair.select(files.fasta_text(F.lit(name), F.col(column))).coalesce(1).write.text(paths[name])
    return fasta.read_pair(spark, paths["a"], paths["b"]).select(F.lit(key).alias("pair_id"), "name1", "name2", "s1", "s2")


def _written(spark: SparkSession, sf: str) -> dict[str, str]:
    named = _pairs(spark, sf).select("pair_id", F.concat(F.lit("a"), "pair_id").alias("name1"), F.concat(F.lit("b"), "pair_id").alias("name2"), F.lit(0.0).alias("total_score"), "a1", "a2")
    return files.write_all(named, folders.scratch(spark, "results"))


@query(f"""WITH {RUNS.format(flag='op')}, c AS (SELECT p.pair_id, coalesce(string_agg(len || v, '' ORDER BY spot), '') AS cigar FROM pairs p LEFT JOIN runs USING (pair_id) GROUP BY 1) SELECT cigar, count(*) AS pairs FROM c GROUP BY 1""")
def written_cigars(spark, sf):
    rows = spark.read.schema("value string").text(_written(spark, sf)["cigar"])
    return rows.groupBy(F.col("value").alias("cigar")).agg(F.count("*").alias("pairs"))


@query(f"""WITH {PAIRS}, c AS (SELECT p.pair_id, length(any_value(a1))::BIGINT AS columns, {COUNTS} FROM pairs p LEFT JOIN ops USING (pair_id) GROUP BY 1)
SELECT pair_id, columns, m AS matches, mm AS mismatches, i AS insertions, d AS deletions FROM c""")
def results_read_back(spark, sf):
    rows = fasta.read_results(spark, _written(spark, sf)["json"])
    return rows.select("metadata.pair_id", F.col("alignment.length").alias("columns"), *[f"statistics.{c}" for c in ("matches", "mismatches", "insertions", "deletions")])


@query(f"""WITH {PAIRS}, m AS (SELECT pair_id, unnest([('a1', a1), ('a2', a2)]) AS x FROM pairs) SELECT left(x[1], 2) AS side, count(*) AS records, sum(length(replace(x[2], '-', '')))::BIGINT AS symbols FROM m WHERE length(replace(x[2], '-', '')) > 0 GROUP BY 1""")
def ungapped_files(spark, sf):
    paths = _written(spark, sf)
    sides = [fasta.read_fasta(spark, paths[f"ungapped{i}"]).select(F.lit(f"a{i}").alias("side"), "seq") for i in (1, 2)]
    return sides[0].union(sides[1]).where(F.length("seq") > 0).groupBy("side").agg(F.count("*").alias("records"), F.sum(F.length("seq")).cast("long").alias("symbols"))


@query("""SELECT l_orderkey AS pair_id, l_linenumber AS cid, l_linenumber * 10 AS q_start, l_linenumber * 10 + 5 AS q_end, 0 AS t_start, 7 AS t_end, l_extendedprice AS score FROM lineitem WHERE l_extendedprice >= 20000""")
def chunk_store(spark, sf):
    """Chunks written, read back by score, and listed without their strings."""
    n = F.col("l_linenumber")
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair_id"), n.alias("cid"), (n * 10).alias("q_start"), (n * 10 + 5).alias("q_end"), F.lit(0).alias("t_start"), F.lit(7).alias("t_end"), F.col("l_extendedprice").alias("score"), F.lit("ACGT").alias("a1"))
    path = folders.scratch(spark, "chunks")
    files.write_chunks(align.score_filter(rows, 20_000), path)
    assert fasta.read_chunks(spark, path).columns[-1] == "a1"
    return fasta.chunk_metadata(spark, path)
