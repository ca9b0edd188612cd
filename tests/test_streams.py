"""Streams of FASTA files: late files, restarts from the checkpoint, anchors with a standing library; small new operators."""

import os

import numpy as np
from pyspark.sql import functions as F

from strandweave.cli import run
from strandweave.operators import anchors, columns, seeds, tensors
from strandweave.plans import config
from strandweave.sinks import files
from strandweave.sources import fasta
from strandweave.streaming import records

HOUR = 3600
SEQ = "ACGTTGCAACGGATTACAGCATTGACCA" * 8


def put(folder, name, text, at):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def test_deliveries(spark, tmp_path):
    source, seen = tmp_path / "in", []

    def go():
        out = records.deliveries(records.fasta_stream(spark, str(source)))
        keep = lambda df, n: seen.append({tuple(r) for r in df.select("seq_id", "deliveries", "differing").collect()})
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return set().union(*seen)

    put(source, "a.fa", ">one\nACGT\n>two\nAAAA\n>one\nACGT\n", 1_700_000_000)
    assert go() == {("one", 2, 0), ("two", 1, 0)}
    seen.clear()
    put(source, "late.fa", ">one\nTTTT\n>three\nCC\n", 1_700_000_000 - 50 * HOUR)  # older than all, after a restart: it changes nothing
    assert go() == {("one", 3, 1), ("three", 1, 0)}
    seen.clear()
    assert go() == set()


def test_windows_and_late_files(spark, tmp_path):
    source, rows, t = tmp_path / "in", {}, 1_700_000_000 // HOUR * HOUR

    def go():
        def keep(df, n):
            rows.update({int(r.start.timestamp()) - t: (r.sequences, r.bases) for r in df.select(F.col("start"), "sequences", "bases").collect()})

        counted = records.windowed_counts(records.fasta_stream(spark, str(source), max_files=1))
        counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    put(source, "a.fa", ">a\nACGT\n>b\nAC\n", t + 60)
    put(source, "b.fa", ">c\nACG\n", t + 3 * HOUR)
    go()
    assert rows == {0: (2, 6), 3 * HOUR: (1, 3)}
    put(source, "c.fa", ">d\nACGTA\n", t + 120)  # more than an hour behind the newest: left out
    put(source, "d.fa", ">e\nA\n", t + 3 * HOUR - 600)  # late, but not so much
    go()
    assert rows == {0: (2, 6), 3 * HOUR: (1, 3), 3 * HOUR - 600: (1, 1)}


def test_anchors_with_a_library(spark, tmp_path):
    library = seeds.strobes(spark.createDataFrame([(7, SEQ), (8, "ACGT")], "lib_id long, seq string"), "lib_id")
    put(tmp_path / "in", "a.fa", f">x\n{SEQ}\n>y\nA\n", 1_700_000_000)
    got = []
    stream = records.anchors_with(records.fasta_stream(spark, str(tmp_path / "in")), library)
    stream.writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    own = seeds.strobes(spark.createDataFrame([(7, SEQ)], "pair_id long, seq string"), "pair_id")
    want = [("x", 7, *tuple(r)[1:]) for r in anchors.anchors(own, own).select("pair_id", "qpos", "tpos", "span", "hash", "diag").collect()]
    assert sorted(got) == sorted(want) and want


def test_bands_give_the_same_chains(spark):
    import random

    r = random.Random(5)
    rows = [(key, q, q + d, 20, r.randrange(9), d) for key in range(3) for d0 in (0, 15_000, 70_000, -90_000) for q, d in ((r.randrange(5000), d0 + r.randrange(300)) for _ in range(60)) if q + d >= 0]
    table = spark.createDataFrame(rows, "pair_id long, qpos int, tpos int, span int, hash long, diag int")
    assert {x.pair_id: x.n for x in anchors.diagonal_bands(table).groupBy("pair_id").agg(F.countDistinct("band").alias("n")).collect()} == {0: 2, 1: 2, 2: 2}
    got = {}
    for x in anchors.chain_anchors(table).collect():
        got.setdefault((x.pair_id, x.chain_id), []).append((x["rank"], x.qpos, x.tpos))
    want = []
    for key in range(3):
        points = sorted((p[1:4] for p in rows if p[0] == key), key=lambda p: (p[1], p[0], p[2]))
        want += [(key, [points[i][:2] for i in c]) for c in anchors.chain(points)]
    assert sorted((k[0], [p[1:] for p in sorted(v)]) for k, v in got.items()) == sorted(want)
    # Chains are numbered by where they start.
    for key in range(3):
        starts = [min(got[k])[2] for k in sorted(k for k in got if k[0] == key)]
        assert starts == sorted(starts)


def test_tensors(spark):
    rows = spark.createDataFrame([(1, "ACGTN"), (2, None), (3, "acgtacgt")], "doc_id long, seq string")
    t = tensors.as_array(tensors.one_hot(rows, 6).orderBy("doc_id").toArrow(), 6)
    assert t.shape == (3, 6, 4) and t[1].sum() == 0
    assert np.array_equal(t[0, :4], np.eye(4)) and t[0, 4].tolist() == [1, 0, 0, 0] and t[0, 5].sum() == 0
    assert np.array_equal(t[2, 4:], np.eye(4)[:2])


def test_files_and_settings(spark, tmp_path):
    pairs = spark.createDataFrame([(k, "a", "b", 1.0, "ACGT-" * 50, "AC-TT" * 50) for k in range(40)], "pair_id long, name1 string, name2 string, total_score double, a1 string, a2 string")
    paths = files.write_all(pairs, str(tmp_path / "out"))
    assert run(spark, ["plot-data", paths["json"], "--out", str(tmp_path / "plots")]) == 0
    windows = spark.read.json(str(tmp_path / "plots" / "windows"))
    assert {(x.level, x.n, x.m) for x in windows.groupBy("level").agg(F.count("*").alias("n"), F.sum("matches").alias("m")).collect()} == {(0, 120, 6000), (1, 40, 6000), (2, 40, 6000)}
    assert spark.read.json(str(tmp_path / "plots" / "raw")).where("quality_class = 'EXCELLENT'").count() == 40
    chunks = pairs.selectExpr("pair_id", "0 as cid", "0 as q_start", "250 as q_end", "0 as t_start", "250 as t_end", "total_score as score", "a1")
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    assert sorted(fasta.read_chunks(spark, str(tmp_path / "chunks")).columns) == sorted(chunks.columns)
    assert len({p.parent.name for p in (tmp_path / "chunks").rglob("*.parquet")}) > 3
    for name in ("c.yaml", "c.json"):
        config.save(config.load(preset="fast"), str(tmp_path / name))
        assert config.load(str(tmp_path / name)) == config.load(preset="fast")


def test_strobes_both_ways(spark):
    rows = spark.createDataFrame([(1, SEQ), (2, "ACG"), (3, ""), (4, None), (5, "A" * 90)], "doc_id long, seq string")
    joined = seeds.randstrobes(seeds.syncmers(rows))
    assert sorted(map(tuple, seeds.strobes(rows).select(*joined.columns).collect())) == sorted(map(tuple, joined.collect()))
    marks = rows.select("doc_id", F.explode(seeds.syncmer_marks(F.coalesce("seq", F.lit("")))).alias("m")).select("doc_id", "m.*")
    assert sorted(map(tuple, marks.collect())) == sorted(map(tuple, seeds.syncmers(rows).collect()))
    assert columns.window_pyramid(spark.createDataFrame([], "pair_id long, a1 string, a2 string")).count() == 0


def test_band_model(spark):
    import random

    from strandweave.operators import align, band, profiles

    r = random.Random(3)
    rows = []
    for key in range(60):
        a = "".join(r.choice("ACGT") for _ in range(r.randrange(40, 160)))
        cut = r.randrange(1, len(a))
        rows.append((key, a, a[:cut] + "T" * r.randrange(0, 20) + a[cut:]))
    pairs = spark.createDataFrame(rows, "pair_id long, s1 string, s2 string")
    told = profiles.pair_features(pairs).join(band.needed_band(align.overlap_align(pairs)), "pair_id")
    model = band.fit(band.moments(told))
    data = told.toPandas()
    x = np.column_stack([np.ones(len(data)), data[list(band.FEATURES)].to_numpy(float)])
    want = np.linalg.lstsq(x, data.band.to_numpy(float), rcond=None)[0]
    got = x @ np.array(model.weights)
    assert np.abs(got - x @ want).max() < 1e-2
    held = told.select(F.avg((band.predicted(model) >= F.col("band")).cast("double")).alias("recall"), F.avg(band.predicted(model)).alias("mean"), F.avg(band.predicted(None)).alias("rule")).first()
    assert held.recall >= 0.95 and held.mean < held.rule
    assert band.fit(band.moments(told.limit(0))) is None
