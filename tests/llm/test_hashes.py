"""Words whose patterns cancel out in a power series modulo 2^64, and tables of very few rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from strandweave.llm import ngram_join, token_store, tokens
from strandweave.llm.shingles import shingle_sets


def twins(n):
    """Two different words of n letters: each doubled with swapped letters until it is long enough."""
    a, b = "ab", "ba"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [256, 1024, 2048, 4096])
def test_twin_words(n):
    a, b = shingle_sets(twins(n), 4)
    assert a.tolist() != b.tolist()
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        codec = tokens.Codec(public_tokenizers.path(name))
        texts = [f"x {t} y" for t in twins(n)]
        want = codec.library(texts)
        assert [g.tolist() for g in codec.encode(texts)] == [w.tolist() for w in want]


def test_twin_documents(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(twins(1024))), "doc_id long, text string")
    assert [r.component_id for r in ngram_join.jaccard_components(docs, k=4, percent=85).orderBy("doc_id").collect()] == [0, 1]
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = str(tmp_path / "store")
    token_store.write_store(docs, path, folder, end_id=2)
    lib = tokens.Codec(path)
    for row, text in zip(token_store.read_store(spark, folder).orderBy("id").collect(), twins(1024)):
        ids = [*lib.library([text])[0].tolist(), 2]
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and row.verified


def test_joined_otherwise(monkeypatch):
    """Where the library cuts joined pre-tokens otherwise, each goes by itself."""
    codec = tokens.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.measure = codec.measure * 0
    texts = ["one two three", "three four"]
    assert [g.tolist() for g in codec.encode(texts)] == [w.tolist() for w in codec.library(texts)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_few_rows(spark, n):
    r = random.Random(n)
    words = [" ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(40)) for _ in range(n)]
    if n > 2:
        words[2] = words[0] + " more"
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(docs, k=4, percent=85).collect()}
    assert got == {i: 0 if i == 2 else i for i in range(n)}


def test_few_long_rows(spark):
    r = random.Random(5)
    long = " ".join(str(r.randrange(10**6)) for _ in range(1_500_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in ngram_join.jaccard_components(docs, k=4, percent=85).collect()} == {1: 1, 2: 1, 3: 3}
