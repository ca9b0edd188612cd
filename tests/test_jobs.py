"""Jobs over growing copies of a table: what is new is taken once, and a rerun changes nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from jobs import pair_report, sequence_intake, settings
from jobs.queries import ORACLE_SQL, QUERIES
from test_oracle import SF, duck, rows  # noqa: F401

SEQ = "ACGTTGCAAC" * 12
DOCS = "doc_id long, text string, lang string, source string, extra int, batch string"


def add(spark, folder, data, name):
    """One more file of documents; ``batch`` clashes with a column of the job's."""
    spark.createDataFrame([(*d, "en", "s", 1, "x") for d in data], DOCS).coalesce(1).write.parquet(f"{folder}/{name}")


def standing(spark, path, *but):
    df = spark.read.parquet(path).drop(*but)
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_intake_grows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, source, [(1, SEQ), (2, "acgt"), (3, None), (4, "zzz"), (None, SEQ), (None, SEQ), (5, SEQ + "A"), (5, SEQ + "C")], "a")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert sequence_intake.run(spark, f"{source}/*", out) == {"read": 8, "taken": 7, "known": 1}
    first = standing(spark, f"{out}/records")
    assert sequence_intake.run(spark, f"{source}/*", out) == {"read": 0, "taken": 0, "known": 0}
    assert standing(spark, f"{out}/records") == first
    add(spark, source, [(1, "TTTT" * 30), (6, SEQ[:70])], "b")
    assert sequence_intake.run(spark, f"{source}/*", out) == {"read": 2, "taken": 1, "known": 1}
    got = spark.read.parquet(f"{out}/records")
    assert {(r.doc_id, r.status) for r in got.collect()} == {(1, "valid"), (2, "short"), (3, "empty"), (4, "empty"), (None, "unnamed"), (5, "valid"), (6, "valid")}
    assert got.where("doc_id = 1").first().seq == SEQ and got.where("doc_id is null").count() == 2
    assert {r[0] for r in spark.read.parquet(f"{out}/seeds").select("doc_id").collect()} <= {1, 5, 6}
    want = {(r.status, r.n, r.b) for r in got.groupBy("status").agg(F.count("*").alias("n"), F.sum("length").alias("b")).collect()}
    summary = spark.read.json(f"{out}/summary")
    assert {(r.status, r.n, r.b) for r in summary.groupBy("status").agg(F.sum("sequences").alias("n"), F.sum("bases").alias("b")).collect()} == want
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_intake_batch_again(spark, tmp_path):
    """A batch that failed after it wrote is run again: the same rows stand."""
    out, c = str(tmp_path / "out"), sequence_intake.Settings()
    one = spark.createDataFrame([(1, SEQ, "en", "s"), (2, "acgt", None, "s")], sequence_intake.INPUT)
    two = spark.createDataFrame([(2, SEQ, "en", "s"), (3, SEQ, "en", "s")], sequence_intake.INPUT)
    for number, batch in ((0, one), (1, two)):
        sequence_intake.take(batch, number, out, c)
    kept = [standing(spark, f"{out}/{t}") for t in ("records", "seeds", "totals", "log")]
    sequence_intake.take(two, 1, out, c)
    assert [standing(spark, f"{out}/{t}") for t in ("records", "seeds", "totals", "log")] == kept
    assert [(r[0], r[1]) for r in spark.read.parquet(f"{out}/records").orderBy("doc_id").select("doc_id", "status").collect()] == [(1, "valid"), (2, "short"), (3, "valid")]


def test_intake_nothing(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [], "a")
    assert sequence_intake.run(spark, str(tmp_path / "in" / "a") + "/", str(tmp_path / "out"))["taken"] == 0


def test_report_grows(spark, tmp_path):
    source, out, c = str(tmp_path / "in"), str(tmp_path / "out"), pair_report.Settings(block_pairs=10, window=50)
    texts = [(i, SEQ[i % 7 :] + "N" * (i % 3)) for i in range(35)] + [(50, None), (51, ""), (None, SEQ)]
    add(spark, source, texts, "a")
    first = pair_report.run(spark, f"{source}/*", out, c)
    assert first == {"read": 38, "blocks": 7, "pairs": 35}  # -1 to 34 and 49 to 51 by tens
    done = {t: standing(spark, f"{out}/{t}") for t in ("pairs", "windows", "marks")}
    at = {p: os.path.getmtime(p) for p in map(str, (tmp_path / "out" / "pairs").rglob("*.parquet"))}
    assert pair_report.run(spark, f"{source}/*", out, c) == first | {"blocks": 0, "pairs": 0}
    add(spark, source, [(35, SEQ), (36, "ACGT")], "b")
    assert pair_report.run(spark, f"{source}/*", out, c) == {"read": 40, "blocks": 1, "pairs": 6}
    now = {p: os.path.getmtime(p) for p in map(str, (tmp_path / "out" / "pairs").rglob("*.parquet"))}
    assert sum(now.get(p) == t for p, t in at.items()) == len(at) - sum("block=3" in p for p in at)  # other blocks' files are the same
    whole = str(tmp_path / "anew")
    pair_report.run(spark, f"{source}/*", whole, c)
    for t in done:
        assert standing(spark, f"{out}/{t}") == standing(spark, f"{whole}/{t}")
    assert sum(r.pairs for r in spark.read.json(f"{out}/rollup").collect()) == 37
    # An open mark, as a failed run leaves it, is made good; blocks that vanished go.
    spark.read.parquet(f"{out}/marks").where("block = 2").withColumn("done", F.lit(False)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{out}/marks")
    assert pair_report.run(spark, f"{source}/*", out, c)["blocks"] == 1
    assert pair_report.run(spark, f"{source}/b", out, c) == {"read": 2, "blocks": 1, "pairs": 1}
    assert [r.pair_id for r in spark.read.parquet(f"{out}/pairs").collect()] == [35]
    # Other settings are another report.
    assert pair_report.run(spark, f"{source}/b", out, pair_report.Settings(block_pairs=10, window=7))["blocks"] == 1


def test_report_nothing(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [], "a")
    assert pair_report.run(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out")) == {"read": 0, "blocks": 0, "pairs": 0}


def test_settings(spark, tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for kind, name in ((sequence_intake.Settings, "sequence_intake"), (pair_report.Settings, "pair_report")):
        assert settings.load(spark, kind, f"{here}/jobs/{name}.json") == kind()
    (tmp_path / "c.json").write_text(json.dumps({"window": 9}))
    assert settings.load(spark, pair_report.Settings, str(tmp_path / "c.json")) == pair_report.Settings(window=9)
    with pytest.raises(ValueError):
        settings.load(spark, sequence_intake.Settings, str(tmp_path / "c.json"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):  # noqa: F811
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
