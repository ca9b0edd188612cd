"""Near duplicates, repeated strings and embeddings against brute force, hot groups included."""

import hashlib
import random

import numpy as np

from strandweave.llm import common, embedding_dedup, ngram_join, suffix_dedup
from strandweave.llm.shingles import shingle_sets


def components_of(nodes, links):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


def words_set(text, k):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_texts(r, n):
    base = [" ".join(r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.randint(1, 60))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(20))
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(r.randrange(4)):
            w = b.split()
            w[r.randrange(len(w))] = "new" + str(r.randrange(1000))
            texts.append(" ".join(w))
        if r.random() < 0.4:
            texts.append(b + " " + passage)
    hot = [f"h{i}" for i in range(60)]
    for _ in range(80):
        w = list(hot)
        for _ in range(r.randrange(5)):
            w[r.randrange(60)] = "x" + str(r.randrange(50))
        texts.append(" ".join(w))
    return [*texts, texts[0].upper(), texts[0], "", None, " \t\n", "one", "ONE", "one two", "Straße É", "straße É"]


def test_ngram_join(spark, monkeypatch):
    r = random.Random(11)
    texts = near_texts(r, 60)
    table = spark.createDataFrame([(i * 3, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, cls string, token int")
    for k, percent, few, chunk in ((4, 85, 16, 512), (5, 80, 2, 7)):
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        monkeypatch.setattr(ngram_join, "PIVOTS", 2)
        sets = {i * 3: words_set(t, k) for i, t in enumerate(texts)}
        ids = list(sets)
        links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        low = components_of(ids, links)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(table, k, percent).collect()}
        assert got == {i: (len(sets[i]), low[i]) for i in ids}


def test_near_pairs_by_early_places(spark):
    """Groups pair up under enough of their first shingles, not under late ones."""
    from strandweave.llm.ngram_join import near_pairs

    early = [(1, 500, p, 2, 500, p) for p in (0, 40, 80, 120)]
    late = [(3, 500, 200 + p, 4, 500, 200 + p) for p in range(40)]
    few = [(5, 500, p, 6, 500, p) for p in (0, 40, 80)]
    short = [(7, 3, 0, 8, 3, 0)]
    met = spark.createDataFrame(early + late + few + short, "g long, n int, place int, g2 long, n2 int, place2 int")
    assert sorted(tuple(r) for r in near_pairs(met, 80).collect()) == [(1, 2), (7, 8)]


def test_ngram_join_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(none).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert ngram_join.jaccard_components(odd).count() == 4


def test_ngram_join_null_and_repeated_ids(spark):
    """Rows of one id, or of none, are one document of several sets, each of which links."""
    r = random.Random(3)
    texts = near_texts(r, 25)
    no_id = -1
    ids = [r.choice([i, i, i, 1000 + i % 9, no_id if i % 20 == 0 else i]) for i in range(len(texts))]
    for none in (True, False):  # the component of the rows without id is large: once without them
        kept = [(i, t) for i, t in zip(ids, texts) if none or i != no_id]
        table = spark.createDataFrame([(None if i == no_id else i, t) for i, t in kept], "doc_id long, text string")
        sets = [words_set(t, 4) for _, t in kept]
        links = [(kept[a][0], kept[b][0]) for a in range(len(kept)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        low = components_of({i for i, _ in kept}, links)
        real = lambda i: None if i == no_id else i
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(table, 4, 85).collect()), key=str)
        assert got == sorted(((real(i), len(s), real(low[i])) for (i, _), s in zip(kept, sets)), key=str)


def test_shingles():
    texts = ["a b c d e", "A  b\tC\nd E", "a b", "b a", "", None]
    sets = shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0]
    assert np.array_equal(sets[0], sets[1]) and sets[2][0] != sets[3][0]


def brute_repeats(raw, length):
    seen = {}
    for i, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((i, s))
    marks = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                marks[i][s : s + length] = True
    return marks


def repeating_texts(r):
    pool = ["".join(r.choice("ab é\n") for _ in range(r.randint(20, 90))) for _ in range(8)]
    texts = ["".join(r.choice(pool) if r.random() < 0.4 else "".join(r.choice("abcdef") for _ in range(r.randint(1, 50))) for _ in range(r.randint(1, 8))) for _ in range(60)]
    texts += [f"{i}" + pool[0] * 2 + f"{i * 7}" for i in range(40)]
    return [*texts, texts[0], "a" * 300, "ab" * 100, "", None, "x" * 39]


def test_suffix_dedup(spark):
    texts = repeating_texts(random.Random(2))
    raw = [(t or "").encode() for t in texts]
    table = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, lo int")
    for heavy in (64, 2):
        got = {x.doc_id: x for x in suffix_dedup.remove_repeats(table, length=40, gram=12, heavy=heavy).collect()}
        for i, (b, m) in enumerate(zip(raw, brute_repeats(raw, 40))):
            kept = np.frombuffer(b, np.uint8)[~m].tobytes()
            runs = int((np.diff(np.concatenate([[0], m.astype(np.int8)])) == 1).sum())
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, bytes(got[i].kept)) == (len(b), int(m.sum()), runs, hashlib.sha256(kept).hexdigest(), kept), i


def test_suffix_dedup_hot_anchor_in_some_batches(spark):
    """A passage with different edges everywhere: marked in one task, below the mark in others, and not at all in some."""
    r = random.Random(13)
    passage = "".join(r.choice("abcdefgh") for _ in range(60))
    odd = lambda: "".join(r.choice("ijklmnop") for _ in range(r.randint(45, 70)))
    texts = [odd() + passage + odd() for _ in range(40)] + [odd() for _ in range(30)] + [odd() + passage[:45] + odd(), odd() + passage[10:] + odd()]
    raw = [t.encode() for t in texts]
    rows = list(enumerate(texts))
    for cut in (72, 36, 41):
        table = spark.createDataFrame(rows[:cut], "doc_id long, text string").coalesce(1)
        if cut < len(rows):
            table = table.union(spark.createDataFrame(rows[cut:], "doc_id long, text string").repartition(9))
        for heavy in (2, 5):
            got = {x.doc_id: x.kept_sha256 for x in suffix_dedup.remove_repeats(table, length=40, gram=12, heavy=heavy).collect()}
            assert got == {i: hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest() for i, (b, m) in enumerate(zip(raw, brute_repeats(raw, 40)))}


def test_suffix_dedup_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    t = "q" * 10 + "abcdefghijklmnopqrstuvwxyz" * 9
    odd = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None)], "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.n_removed) for x in suffix_dedup.remove_repeats(odd).collect()) == [(-1, 0), (-1, len(t)), (1, len(t)), (1, len(t))]


def test_spans_over_blocks():
    raw = [(t or "").encode() for t in repeating_texts(random.Random(5))]
    raw.append(b"".join(raw))
    for block in (40, 41, 97, 1000, 1 << 20):
        text, lo, hi, h, _ = suffix_dedup.spans_of(raw, 40, 12, block)
        windows = [(t, s) for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist()) for s in range(a, b + 1)]
        assert sorted(windows) == [(i, s) for i, b in enumerate(raw) for s in range(len(b) - 39)]
        anchors = {}
        for (t, s), x in zip(windows, np.repeat(h, hi - lo + 1).tolist()):
            assert anchors.setdefault(raw[t][s : s + 40], x) == x


def test_suffix_dedup_beyond_16_mib(spark):
    """A passage behind byte 2**24 of a text repeats in a short text, and another one within the long text."""
    long = random.Random(7).randbytes(8_600_000).hex()
    far, inner = long[16_900_000:16_901_000], long[17_000_000:17_000_700]
    texts = [long + "x" + inner + "x", "y" + far + "y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.remove_repeats(table, keep_bytes=False).collect()}
    assert got == {0: (len(texts[0]), 1000 + 2 * 700, 3), 1: (1002, 1000, 1)}
    kept = suffix_dedup.remove_repeats(table).where("doc_id = 0").first()
    assert bytes(kept.kept).decode() == texts[0].replace(far, "").replace(inner, "")


def test_two_stage_order():
    r = random.Random(4)
    for _ in range(40):
        bodies = ["".join(r.choice("abc") for _ in range(r.randint(12, 60))).encode() for _ in range(r.randint(1, 6))]
        counts = [len(b) - 9 for b in bodies]
        got = suffix_dedup.repeated_windows(bodies, counts, 10)
        seen = {}
        for b, c in zip(bodies, counts):
            for s in range(c):
                seen[b[s : s + 10]] = seen.get(b[s : s + 10], 0) + 1
        assert [g.tolist() for g in got] == [[seen[b[s : s + 10]] > 1 for s in range(c)] for b, c in zip(bodies, counts)]


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 24))
    rows = [base[r.integers(60)] + r.normal(size=24) * r.choice([0.01, 0.2, 0.5]) for _ in range(400)]
    rows += [rows[0]] * 30
    vectors = [(i, v.tolist(), 1) for i, v in enumerate(rows)]
    odd = [None, [0.0] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] + [0.0] * 23, [], [1.0, 0.0], [2.0, 0.0]]
    vectors += [(len(rows) + i, v, 1) for i, v in enumerate(odd)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, n int")
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    links = list(zip(*np.nonzero(close)))
    n = len(vectors)
    low = components_of(range(n), [*links, (n - 2, n - 1)])
    want = {i: (int(close[i].sum()) if i < len(rows) else int(i >= n - 2), low[i], low[i] == i) for i in range(n)}
    for tile in (8192, 40):
        got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in embedding_dedup.near_duplicates(table, 0.9, tile_rows=tile).collect()}
        assert got == want
    scaled = spark.createDataFrame([(i, [c * 10.0 ** ([160, -170, 0][i % 3]) if c is not None else None for c in v] if v is not None else None) for i, v, _ in vectors], "vec_id long, embedding array<double>")
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in embedding_dedup.near_duplicates(scaled, 0.9, tile_bytes=8 * 24 * 40).collect()}
    assert got == want
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_of_equal_ids_and_clear_axes(spark):
    """Rows of one id are vectors of their own; tiles along clear axes meet few others."""
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((v.vec_id or -1, v.n_links, v.component_id or -1) for v in embedding_dedup.near_duplicates(two, 0.9).collect())
    assert got == sorted([(1, 2, -1), (1, 1, 1), (2, 2, -1), (3, 1, 1), (-1, 2, -1)])
    r = np.random.default_rng(5)
    rows = [(i, (np.eye(12)[i % 12] + r.normal(size=12) * 0.05).tolist()) for i in range(600)]
    got = {v.vec_id: (v.n_links, v.component_id) for v in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9, tile_rows=50).collect()}
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    low = components_of(range(600), list(zip(*np.nonzero(close))))
    assert got == {i: (int(close[i].sum()), low[i]) for i in range(600)}


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    low = components_of(nodes, [(a, b) for a, b in links if a != b])
    assert got == low


def test_running_starts(spark):
    table = spark.createDataFrame([(i * 1000 - 77, i % 5) for i in range(300)], "k long, n int")
    at = 0
    for x in common.running_starts(table, "k", "n", "s", blocks=7).orderBy("k").collect():
        assert x.s == at
        at += x.n


def test_running_starts_of_wide_null_and_equal_orders(spark):
    rows = [(-9 * 10**18, 1, 0), (9 * 10**18, 2, 0), *((None, 5, t) for t in range(3)), *((7, 1, t) for t in range(200)), *((i, None, 0) for i in range(100, 120))]
    table = spark.createDataFrame(rows, "k long, n int, t int")
    at = 0
    for i, x in enumerate(sorted(common.running_starts(table, "k", "n", "s", blocks=5, ties=("t",), number="p").collect(), key=lambda x: x.p)):
        assert (x.s, x.p) == (at, i) and (x.k is None) == (i < 3)
        at += x.n or 0
    assert common.running_starts(table.limit(0), "k", "n", "s").count() == 0
