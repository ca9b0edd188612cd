"""Operators on small hand-made inputs, sources and sinks by round trips."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import alphabet, features
from strandweave.functions.registry import register
from strandweave.operators import anchors, catalog, columns, profiles
from strandweave.plans import config
from strandweave.plans.pipeline import align_pairs
from strandweave.sinks import files
from strandweave.sources import fasta
from strandweave.streaming import records


def pairs(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "pair_id long, a1 string, a2 string")


def test_statistics(spark):
    df = pairs(spark, ("ACGT-ACGT", "ACGTTACGT"), ("A-", "-A"), ("", ""), ("ACGT", "ACGA"), ("--", "--"))
    got = {r.pair_id: r for r in columns.alignment_stats(df).collect()}
    assert (got[0].matches, got[0].insertions, got[0].gap_openings, got[0].total_aligned) == (8, 1, 1, 9)
    assert (got[1].insertions, got[1].deletions, got[1].gap_openings) == (1, 1, 1)
    assert got[2].total_aligned == 0 and got[2].identity == 0 and got[4].total_aligned == 0
    assert got[3].identity == 0.75
    cigars = [r.cigar for r in columns.cigar(df).orderBy("pair_id").collect()]
    assert cigars == ["4=1I4=", "1D1I", "", "3=1X", "2M"]
    assert [r.score for r in columns.alignment_score(df).orderBy("pair_id").collect()] == [6.0, -4.0, 0.0, 1.0, 0.0]


def test_cigar_round_trip(spark):
    df = spark.createDataFrame([(0, "3=1I2X1D", "ACGTAC", "ACGGTT"), (1, "", "", ""), (2, "2=2N1=", "ACG", "ACTTG")], "pair_id long, cigar string, s1 string, s2 string")
    got = [(r.a1, r.a2) for r in columns.cigar_decode(df).orderBy("pair_id").collect()]
    assert got == [("ACG-TAC", "ACGGTT-"), ("", ""), ("ACG", "ACG")]


def test_predicates(spark):
    df = spark.createDataFrame([("A", "A"), ("a", "A"), ("A", "C"), ("A", "-"), ("-", "-"), ("N", "A"), ("R", "G"), ("N", "N"), (None, "A")], "x string, y string")
    got = df.select(alphabet.is_match(F.col("x"), F.col("y")), alphabet.is_strict_match(F.col("x"), F.col("y")), alphabet.is_partial_overlap(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (True, True, False), (False, False, False), (False, False, False), (False, False, False), (False, False, True), (False, False, True), (True, False, False), (False, False, False)]


def test_packing(spark):
    df = spark.createDataFrame([("ACG",), ("ACGT",), ("ACGTN",), ("U",), ("",), ("acgtACGTacgt",)], "s string")
    got = df.select(F.hex(alphabet.pack4(F.col("s"))).alias("h"), alphabet.unpack4(alphabet.pack4(F.col("s")), F.length("s"), 2, 6).alias("p")).collect()
    assert [r.h for r in got] == ["124F", "1248", "1248FF", "FF", "", "124812481248"]
    assert got[5].p == "GTAC" and got[4].p == ""


def test_catalog(spark):
    names = spark.createDataFrame([(f"chr{i}",) for i in range(1, 13)] + [("chrX",)], "seq_id string")
    assert [r[0] for r in catalog.listed(names, limit=3).collect()] == ["chr1", "chr2", "chr3"]
    assert [r[0] for r in catalog.name_range(names, "chr1:chr10").orderBy(catalog.natural_key(F.col("seq_id"))).collect()] == [f"chr{i}" for i in range(1, 11)]
    with pytest.raises(ValueError):
        catalog.name_range(names, "chr1:nothing")
    seqs = spark.createDataFrame([("chr1", "AA"), ("Chr2", "CC")], "seq_id string, seq string")
    specs = spark.createDataFrame([("chr1+CHR2",), ("2+1",)], "spec string")
    assert {r.spec: r.seq for r in catalog.combined(specs, seqs).collect()} == {"chr1+CHR2": "AACC", "2+1": "CCAA"}
    asked = spark.createDataFrame([("chr1:2-2",), ("chr1",), ("none:1-2",)], "spec string")
    assert [r.seq for r in catalog.regions(asked, seqs).collect()] == ["A"]


def test_spans_and_projection(spark):
    one = spark.range(1)
    at = lambda *v: [F.lit(x) for x in v]
    assert tuple(one.select(*anchors.equal_spans(*at(0, 100, 0, 200))).first()) == (0, 200, 0, 200)
    assert tuple(one.select(*anchors.equal_spans(*at(0, 200, 0, 100))).first()) == (0, 200, 0, 200)
    a, b, c, d = one.select(*anchors.equal_spans(*at(0, 100, 0, 200, 150, 300))).first()
    assert b - a == d - c == 150
    assert tuple(one.select(*anchors.projected(*at(0, 100, 50.0, 1.0, 1000))).first()) == (50, 150)
    assert tuple(one.select(*anchors.projected(*at(0, 100, -100.0, 1.0, 100))).first()) == (0, 100)


def test_diagonal_chunks(spark):
    df = spark.createDataFrame([(0, 5000, 5000), (1, 10000, 3000), (2, 0, 0)], "pair_id long, l1 int, l2 int")
    got = [tuple(r) for r in anchors.diagonal_chunks(df, 5000, 500).orderBy("pair_id", "cid").collect()]
    assert got == [(0, 0, 0, 5000, 0, 5000), (0, 1, 4500, 5000, 4500, 5000), (1, 0, 0, 5000, 0, 3000)]
    tail = [tuple(r)[2:] for r in anchors.diagonal_chunks(df, 5000, 500, True).where("pair_id = 1").collect()]
    assert tail == [(0, 10000, 0, 3000)]


def test_align_pairs(spark):
    import random

    r = random.Random(3)
    a = "".join(r.choice("ACGT") for _ in range(700))
    b = a[:300] + a[310:600] + "ACGTAC" + a[600:]
    df = spark.createDataFrame([(0, a, b), (1, a, a)], "pair_id long, s1 string, s2 string")
    for anchored in (False, True):
        rows = {x.pair_id: x for x in align_pairs(df, config.Config(chunk_size=200, overlap=40, k=15, s=7, sync_offset=3), anchored).collect()}
        assert rows[0].a1.replace("-", "") == a and rows[0].a2.replace("-", "") == b
        assert rows[1].a1 == rows[1].a2 == a


def test_features(spark):
    df = spark.createDataFrame([(0, "ACGT", "ACGT"), (1, "AC", "ACGT"), (2, "", "A")], "pair_id long, s1 string, s2 string")
    got = {r.pair_id: r for r in profiles.pair_features(df).collect()}
    assert got[0].seq1_gc == 50.0 and got[0].seq1_entropy == 2.0 and abs(got[0].kmer_similarity - 1) < 1e-9
    assert got[1].kmer_similarity == 0.0 and got[2].seq_identity == 0.0


def test_fasta_and_sinks(spark, tmp_path):
    src = tmp_path / "a.fa"
    src.write_text(">one first\r\nACGT\r\nacg\n>two\nTTTT\nGG\n>three\n\n")
    rows = fasta.read_fasta(spark, str(src)).orderBy("seq_idx").collect()
    assert [(r.seq_idx, r.seq_id, r.seq) for r in rows] == [(0, "one", "ACGTACG"), (1, "two", "TTTTGG"), (2, "three", "")]
    assert [r.seq_id for r in fasta.read_ids(spark, str(src)).collect()] == ["one", "two", "three"]
    assert fasta.problems(spark, str(src)) == ["empty record"]
    (tmp_path / "b.fa").write_text("ACGT\n")
    (tmp_path / "c.fa").write_text("")
    assert fasta.problems(spark, str(tmp_path / "b.fa")) == ["does not start with >"]
    assert fasta.problems(spark, str(tmp_path / "c.fa")) == ["empty"]
    assert fasta.problems(spark, str(tmp_path / "none.fa")) == ["not found"]
    df = spark.createDataFrame([(0, "x", "y", 3.0, "AC-T", "ACGT")], "pair_id long, name1 string, name2 string, total_score double, a1 string, a2 string")
    paths = files.write_all(df, str(tmp_path / "out"), configuration={"beam_width": 30})
    assert spark.read.text(paths["cigar"]).first()[0] == "2=1I1="
    assert spark.read.text(paths["paf"]).first()[0].split("\t")[:12] == ["x", "3", "0", "3", "+", "y", "4", "0", "4", "3", "4", "255"]
    assert fasta.read_fasta(spark, paths["ungapped1"]).first().seq == "ACT"
    assert fasta.read_results(spark, paths["json"]).first().statistics.matches == 3
    assert spark.read.json(paths["json"]).first().configuration.beam_width == 30
    told = {r.metric: r.description for r in spark.read.option("header", True).csv(paths["csv"]).collect()}
    assert len(told) == 10 and all(told.values())
    assert fasta.latest_file(spark, str(tmp_path), "*.fa") is not None


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_text(">one\nACGT\n>two\nGG\n")
    seen = []
    q = records.process(records.fasta_stream(spark, str(folder)), lambda df, _: seen.extend(r.seq for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(seen) == ["ACGT", "GG"]


def test_config_and_functions(spark, tmp_path):
    assert config.problems(config.load()) == []
    assert len(config.problems(config.load(gap_open=10, beam_width=0))) >= 2
    with pytest.raises(ValueError):
        config.load(nothing=1)
    register(spark)
    row = spark.sql("select nw_align('ACGT', 'ACGT').score as s, gc_percent('AC-G') as g").first()
    assert row.s == 4 and abs(row.g - 200 / 3) < 1e-9
    rows = [("AC-GT", "ACCGA"), ("--", "A-"), ("acgt", "ACGTT"), ("", "A"), ("NRYU", "NGCT"), (None, "ACG")]
    spark.createDataFrame(rows, "a1 string, a2 string").createOrReplaceTempView("sql_functions")
    got = spark.sql("select iupac_match(left(a1, 1), left(a2, 1)) as m, hex(pack4(a1)) as p, kmers(a2, 2) as k, cigar(a1, a2) as c from sql_functions").collect()
    t = spark.table("sql_functions")
    a, b = F.col("a1"), F.col("a2")
    due = t.select(
        alphabet.is_match(F.left(a, F.lit(1)), F.left(b, F.lit(1))), F.hex(alphabet.pack4(a)), F.array_sort(features.kmers(b, 2)), columns.cigar_of(columns.classes(a, b))
    ).collect()
    assert [(r.m, r.p, sorted(r.k), r.c) for r in got] == [tuple(r) for r in due]


def test_command_line(spark, tmp_path, capsys):
    from strandweave.cli import run

    (tmp_path / "a.fa").write_text(">chr1\nACGTACGTTGCAACGT\n>chr2\nGGGGCCCC\n")
    (tmp_path / "b.fa").write_text(">x\nACGTACGTGCAACGT\n")
    a, b = str(tmp_path / "a.fa"), str(tmp_path / "b.fa")
    assert run(spark, ["list", a, "--range", "1:2"]) == 0
    assert capsys.readouterr().out.split() == ["chr1", "chr2"]
    assert run(spark, ["check", a, b]) == 0
    assert run(spark, ["align", a, b, "--diagonal", "--out", str(tmp_path / "out")]) == 0
    assert spark.read.text(str(tmp_path / "out/paf")).first()[0].startswith("chr1\t16\t0\t16")
    assert run(spark, ["align", a, b, "--names1", "1+2", "--names2", "x", "--gap-open", "0", "--diagonal", "--out", str(tmp_path / "out2")]) == 0
    assert spark.read.text(str(tmp_path / "out2/paf")).first()[0].startswith("1+2\t24\t0\t24")
    assert run(spark, ["config", str(tmp_path / "c.json")]) == 0


def test_good_ends_of_a_long_alignment():
    """By running counts: a million columns take one pass, and windows are those of a plain loop."""
    import random

    from strandweave.operators.columns import good_ends

    r = random.Random(1)
    for _ in range(200):
        ops = "".join(r.choice("=XIDMMM") for _ in range(r.randint(0, 30)))
        ok = lambda w: any(x != "M" for x in w) and w.count("=") / sum(x != "M" for x in w) >= 0.3
        ahead = [i for i in range(len(ops)) if ok(ops[i : i + 4])]
        back = [i for i in range(len(ops)) if ok(ops[max(0, i - 3) : i + 1])]
        assert good_ends(ops, 0.3, 4) == (ahead[0] if ahead else 0, back[-1] + 1 if back else len(ops))
    assert good_ends("X" * 500_000 + "=" + "I" * 500_000, 0.1, 10) == (499_991, 500_010)


def test_symbols_are_kept_by_bytes(spark):
    texts = [None, "", "aÉc\U0001F600g\n-tN\x00ſK", "ü", "nACGTacgtu" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for codes, other in (("ACGT", ""), ("ACGTN", "-"), ("ACGTURYSWKMBDHVN", "-")):
        plain = F.upper(F.regexp_replace("text", f"[^{codes}{codes.lower()}]", other))
        got = rows.select("id", alphabet.only(F.col("text"), codes, other).alias("got"), plain.alias("want")).orderBy("id").collect()
        assert [r["got"] for r in got] == [r["want"] for r in got]


def test_pairs_are_cut_out_in_arrow_passes(spark, tmp_path):
    from strandweave.plans import queries

    spark.createDataFrame([(i, "ACGTN and text") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries._pairs(spark, str(tmp_path)), queries._sequences(spark, str(tmp_path)), queries.iupac_partial(spark, str(tmp_path)), queries.plot_places(spark, str(tmp_path))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "zip_with" not in plan and "ArrowEvalPython" in plan


def test_partial_columns_against_the_predicate(spark):
    rows = [(0, "ARN-UTſ", "RGA-TUCC"), (1, None, "A"), (2, "", ""), (3, "nrykB", "NYRMV")]
    df = spark.createDataFrame(rows, "pair_id long, a1 string, a2 string")
    got = {r[0]: r[1] for r in columns.partial_overlaps(df).collect()}
    long = df.where("a1 is not null").select("pair_id", F.explode(F.arrays_zip(F.split("a1", "").alias("x"), F.split("a2", "").alias("y"))).alias("c"))
    want = {r[0]: r[1] for r in long.groupBy("pair_id").agg(F.sum(alphabet.is_partial_overlap(F.col("c.x"), F.col("c.y")).cast("int"))).collect()}
    assert got == {**want, 1: None}


def test_written_formats_share_one_cigar(spark, tmp_path, monkeypatch):
    from strandweave.sinks import files

    calls, plain = [], files.cigar_of
    monkeypatch.setattr(files, "cigar_of", lambda ops: calls.append(1) or plain(ops))
    df = spark.createDataFrame([(0, "a", "b", 1.0, "AC-T", "ACGT")], "pair_id long, name1 string, name2 string, total_score double, a1 string, a2 string")
    paths = files.write_all(df, str(tmp_path / "all"))
    assert len(calls) == 1
    assert spark.read.text(paths["cigar"]).first()[0] == "2=1I1="
    assert spark.read.text(paths["paf"]).first()[0].endswith("cg:Z:2=1I1=")
    assert spark.read.json(paths["json"]).first()["alignment"]["cigar"] == "2=1I1="


def test_pair_queries_hold_few_texts_a_batch(spark, tmp_path):
    from strandweave.plans import queries

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.createDataFrame([(i, "ACGTN and text") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        for f in (queries._pairs, queries._sequences):
            spark.conf.set(key, "10000")
            f(spark, str(tmp_path))
            assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)


def test_small_batches_are_aligned_together():
    import pandas as pd
    from strandweave.operators import align

    batches = [pd.DataFrame({"x": ["AC"] * 3 + [None], "y": ["A"] * 4}) for _ in range(5)]
    assert [len(b) for b in align._gathered(iter(batches), ["x", "y"])] == [20]
    assert [len(b) for b in align._gathered(iter(batches), ["x", "y"], rows=8)] == [8, 8, 4]
    assert [len(b) for b in align._gathered(iter(batches), ["x"], symbols=6)] == [4] * 5
    assert list(align._gathered(iter([]), ["x"])) == []


def test_kmers_are_counted_in_the_row(spark):
    texts = [(0, "acg-tACGTT"), (1, None), (2, "AC"), (3, "ÉaÉaÉaé"), (4, "AAAA"), (4, "AAAT")]
    df = spark.createDataFrame(texts, "doc_id long, seq string")
    for k in (3, 8):
        counted = profiles.kmer_counts(df, k)
        assert "regexp_extract_all" not in counted._jdf.queryExecution().optimizedPlan().toString()
        plain = df.select("doc_id", F.explode(features.kmers(F.col("seq"), k)).alias("kmer")).groupBy("doc_id", "kmer").count()
        assert sorted((r["doc_id"], r["kmer"], r["n"]) for r in counted.collect()) == sorted(map(tuple, plain.collect()))


def test_pair_features_join_nothing(spark):
    """All ten features come from the pair's row; identity counts places without gaps, of either case."""
    df = spark.createDataFrame([(1, "ACGTac-t", "ACCTAC"), (2, "", "A"), (3, "---", "-A-"), (4, "acgt", "ACGTTT")], "pair_id long, s1 string, s2 string")
    rows = profiles.pair_features(df)
    assert "Join" not in rows._jdf.queryExecution().toString()
    got = {r.pair_id: r for r in rows.collect()}
    assert [round(got[i].seq_identity, 6) for i in (1, 2, 3, 4)] == [round(500 / 6, 6), 0.0, 0.0, 100.0]
    assert got[2].kmer_similarity == 0.0 and got[4].length_diff == 2
