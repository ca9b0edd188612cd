"""Token caches, counts, the token store and packing against the libraries themselves."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import packing, token_counts, token_store
from strandweave.llm.queries import tokenizer_file
from strandweave.llm.tokens import Codec

ODD = [
    None, "", " ", "\n", "a  b ", "\n\nx\n y", "don't can't'S '' 's 'x", "<|endoftext|> a<|endoftext|>b", "a\tb　c", "ÀÉß ﬁ ½ é İstanbul ΣΑΣ", "a▁b ▁▁ c",
    " lead", "tail\n", "12 345a6", "a\x1cb .\x1c", "x" * 5000, "\n a", "a \nb", " \n", "«a» … “q”", "A\n\n\nB  \n  C", "×a÷b", "é×é", "12é3", "…é—x", "a\x00b", "l'été d'un", "  \n  x  ",
]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
CODECS = {f: Codec(tokenizer_file(f)) for f in FILES}


def library(f, text):
    return CODECS[f].library([text or ""])[0]


@pytest.mark.parametrize("f", FILES)
def test_odd_texts(f):
    for t, got in zip(ODD, CODECS[f].encode(ODD)):
        assert np.array_equal(got, library(f, t)), t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB é'1.,-\n ×<|>", max_size=30), min_size=1, max_size=5), st.sampled_from(FILES))
def test_any_text(texts, f):
    for t, got in zip(texts, CODECS[f].encode(texts)):
        assert np.array_equal(got, library(f, t)), t


def test_small_cache_gives_the_same():
    small = Codec(tokenizer_file(FILES[0]), max_units=3)
    texts = ["one two three four", "five six", "one two"] * 3
    assert all(np.array_equal(a, library(FILES[0], t)) for a, t in zip(small.encode(texts, group_chars=5), texts))


def docs(spark, texts, extra=False):
    rows = [(i if i % 7 != 5 else None, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


def test_counts(spark):
    got = token_counts.count_tokens(docs(spark, ODD), tokenizer_file(FILES[2]), limit=100).collect()
    want = sorted((len((t or "").encode()), len(library(FILES[2], t)), len(library(FILES[2], t)) > 100) for t in ODD)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(docs(spark, ODD).limit(0), tokenizer_file(FILES[2])).count() == 0


@pytest.mark.parametrize("f", FILES)
def test_counts_for_every_kind_of_tokenizer(spark, f):
    texts = [*ODD, *("word Haus l'été 12 x" * k for k in range(1, 30))]
    got = token_counts.count_tokens(docs(spark, texts), tokenizer_file(f), limit=100, table_units=20).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((t or "").encode()), len(library(f, t))) for t in texts)


def test_upper_case_contractions():
    texts = ["DON'T WE'LL 'S 's I'Ve", "'S\nébcdc,cd0m’ c'“cé1d2,d1"]
    for f in FILES:
        assert all(np.array_equal(got, library(f, t)) for t, got in zip(texts, CODECS[f].encode(texts)))


def test_hash_rows_against_a_dictionary():
    from strandweave.llm.tokens import HashRows

    r, table, want = np.random.default_rng(3), HashRows(2), {}
    for _ in range(40):
        h = r.integers(0, 400, 50).astype(np.uint64) * np.uint64(1 << r.integers(0, 40))
        rows = table.find(h)
        assert rows.tolist() == [want.get(x, -1) for x in h.tolist()]
        new = np.unique(h[rows < 0])
        want.update(zip(new.tolist(), table.add(new).tolist()))
    assert len(table) == len(want)


def test_store_with_a_chunk_of_every_document(spark, tmp_path):
    table = spark.createDataFrame([(i, "same words " * 300 + f"end {i}") for i in range(60)], "doc_id long, text string")
    token_store.write_store(table, tokenizer_file(FILES[0]), str(tmp_path / "h"), end_id=2)
    cold = token_store.read_store(spark, str(tmp_path / "h")).orderBy("id").collect()
    hot = token_store.read_store(spark, str(tmp_path / "h"), least_hot=5).orderBy("id").collect()
    assert hot == cold and all(r.verified for r in hot)
    recipes = spark.read.parquet(str(tmp_path / "h/stored/kind=recipe")).collect()
    assert len(recipes) == 60


def test_store(spark, tmp_path):
    texts = [*ODD, "same text " * 400, "same text " * 400]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    token_store.write_store(table, tokenizer_file(FILES[0]), str(tmp_path / "s"), end_id=2)
    got = {r.id: r for r in token_store.read_store(spark, str(tmp_path / "s")).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*library(FILES[0], t).tolist(), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].verified) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        at += len(ids)
    assert spark.read.parquet(str(tmp_path / "s/manifest")).count() >= 1


def test_store_of_nothing_and_of_repeated_ids(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(none, tokenizer_file(FILES[0]), str(tmp_path / "n"), end_id=2)
    assert token_store.read_store(spark, str(tmp_path / "n")).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    token_store.write_store(twice, tokenizer_file(FILES[0]), str(tmp_path / "t"), end_id=2)
    assert sorted((r.id or -1, r.n_tokens, r.verified) for r in token_store.read_store(spark, str(tmp_path / "t")).collect()) == [(-1, 2, True), (1, 2, True), (1, 2, True)]


def test_rows_without_ids_make_no_large_key(spark, tmp_path):
    """A table of null ids and one text: every row keeps its place, whatever its neighbours, in many tasks."""
    text = "a b c " * 40
    table = spark.createDataFrame([(None, text)] * 900 + [(None, None)] * 100, "doc_id long, text string").repartition(4)
    token_store.write_store(table, tokenizer_file(FILES[0]), str(tmp_path / "z"), end_id=2)
    size = len(library(FILES[0], text)) + 1
    got = sorted(token_store.read_store(spark, str(tmp_path / "z")).collect(), key=lambda r: r.start)
    assert len(got) == 1000 and all(r.id is None and r.verified for r in got)
    assert sorted(r.n_tokens for r in got) == [1] * 100 + [size] * 900
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    rows = packing.pack(table, tokenizer_file(FILES[1]), end_id=1, window=64, salts=8)
    rows = rows.collect()
    n = len(library(FILES[1], text)) + 1
    assert sum(r.length for r in rows) == 900 * n + 100
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert sorted(places) == list(range(len(places)))
    assert all(a[1] == b[0] for parts in map(sorted, places.values()) for a, b in zip(parts, parts[1:]))


def test_store_with_wide_ids(spark, tmp_path):
    """Four bytes an id: the width comes from the chunks themselves."""
    import hashlib

    token_store.write_store(spark.createDataFrame([(5, "one two three")], "doc_id long, text string"), tokenizer_file(FILES[0]), str(tmp_path / "s"), end_id=2)
    (chunk,) = spark.read.parquet(str(tmp_path / "s/stored/kind=chunk")).collect()
    body = np.frombuffer(chunk.body, "<u2").astype("<u4").tobytes()
    digest = hashlib.sha256(body).digest()
    root = token_store.merkle([digest])
    schema = "key binary, id long, n_ids int, body binary, root binary, kind string"
    (recipe,) = spark.read.parquet(str(tmp_path / "s/stored/kind=recipe")).collect()
    rows = [(digest, None, chunk.n_ids, body, None, "chunk"), (recipe.key, 5, recipe.n_ids, digest, root, "recipe")]
    spark.createDataFrame(rows, schema).write.partitionBy("kind").parquet(str(tmp_path / "w/stored"))
    spark.createDataFrame([(5, 0, recipe.n_ids, root)], "id long, start long, n_tokens long, root binary").write.parquet(str(tmp_path / "w/index"))
    token_store._write_manifest(spark.createDataFrame([(0, root)], "position long, hash binary"), str(tmp_path / "w"))
    got, want = (token_store.read_store(spark, str(tmp_path / x)).collect() for x in "ws")
    assert got == want and got[0].verified


def test_store_with_losses(spark, tmp_path):
    """A document lost with its index row, and a changed start, are told; an intact store of repeated ids is verified."""
    table = spark.createDataFrame([(i // 2 if i % 9 else None, f"text {i}") for i in range(2500)], "doc_id long, text string")
    source = str(tmp_path / "s")
    token_store.write_store(table, tokenizer_file(FILES[0]), source, end_id=2)
    assert spark.read.parquet(f"{source}/manifest").select("level").distinct().count() == 2
    assert {r.verified for r in token_store.read_store(spark, source).collect()} == {True}
    whole = {n: spark.read.parquet(f"{source}/{n}") for n in ("stored", "index", "manifest")}

    def changed(name, **parts):
        for n, df in (whole | parts).items():
            df.write.partitionBy(*(["kind"] if n == "stored" else [])).parquet(str(tmp_path / name / n))
        return [r.verified for r in token_store.read_store(spark, str(tmp_path / name)).collect()]

    last = 1249  # nothing follows, so only the manifest tells
    lost = changed("lost", stored=whole["stored"].where(f"kind = 'chunk' or id != {last}"), index=whole["index"].where(f"id != {last}"))
    assert 2490 < len(lost) < 2500 and not any(lost)
    moved = changed("moved", index=whole["index"].selectExpr("id", "if(id = 1200, start + 1, start) as start", "n_tokens", "root"))
    assert 1 <= moved.count(False) <= 2
    assert not any(changed("root", manifest=whole["manifest"].selectExpr("node", "first", "last", "if(level = 1, unhex('00'), hash) as hash", "level")))


def test_joined_crc():
    parts = [b"abc", b"", b"defgh", b"i", b"jklm"]
    crcs, sizes = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts])
    assert token_store.joined_crc(crcs, sizes, np.array([0, 3])).tolist() == [zlib.crc32(b"abcdefgh"), zlib.crc32(b"ijklm")]


def brute_fill(counts, capacity):
    best = {0}
    for n, c in counts.items():
        best = {b + n * k for b in best for k in range(c + 1) if b + n * k <= capacity}
    return max(best)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6), st.integers(0, 40))
def test_best_fill(counts, capacity):
    used = packing.best_fill(counts, capacity)
    assert sum(n * k for n, k in used.items()) == brute_fill(counts, capacity)
    assert all(k <= counts[n] for n, k in used.items())


def test_packing(spark):
    texts = [*ODD, *("word " * k for k in range(1, 300, 7))]
    rows = packing.pack(docs(spark, texts), tokenizer_file(FILES[1]), end_id=1, window=64).collect()
    sequences, total = {}, 0
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(len(library(FILES[1], t)) + 1 for t in texts)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs(spark, ODD).limit(0), tokenizer_file(FILES[1]), end_id=1).count() == 0
    whole = packing.pack(spark.createDataFrame([(3, "a b c")], "doc_id long, text string"), tokenizer_file(FILES[1]), end_id=1, keep_ids=True).first()
    assert np.frombuffer(whole.ids, "<u4").tolist() == [*library(FILES[1], "a b c").tolist(), 1]
