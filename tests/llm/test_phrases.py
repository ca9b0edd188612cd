"""Phrases and word passages against brute force: small chunks and ranges, nulls, ties, repeated rows, long texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandweave.llm import cover_dedup, phrases

DOCS = "doc_id long, text string, lang string, word string, a long, hi long"


def brute_phrases(rows, least, top, subsumed=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        real = {p: a for p, a in counts.items() if a >= least}
        inside = {q for p, a in real.items() if len(p) > 2 for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i : i + k]] if 100 * a >= subsumed * real[q]}
        rows = []
        for p, a in real.items():
            if len(p) > 1 and p not in inside:
                score, k = min((2_000_000 * a // (real[p[:k]] + real[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), real[p[:k]], real[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def prose(r, n, words):
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "\n", " !", "\t"]) for _ in range(n))


@pytest.mark.parametrize(("chunk", "a_range", "top"), [(400, 40, 2000), (1 << 24, 1 << 20, 7)])
def test_phrases(spark, chunk, a_range, top):
    r = random.Random(3)
    words = ["the", "The", "of", "a", "É", "ß", "ſ", "K", "naïve", "𝛼", "x_1"] + [f"w{i}" for i in range(8)]
    rows = [(prose(r, r.randrange(120), words), r.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [("very common line here again", "en")] * 200 + [("", "en"), (None, "de"), (" \t\n", None), ("...", "fr"), ("one", "fr"), (prose(r, 20_000, words), "en")]
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, t, lang, "x", 0, 0) for i, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    got = phrases.mine(docs, least=5, top=top, chunk_bytes=chunk, a_range=a_range)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == brute_phrases(rows, 5, top)


def test_no_phrases(spark):
    for rows in ([], [(1, None, None, "", 0, 0)], [(1, "one word each. only", "en", "", 0, 0)]):
        assert phrases.mine(spark.createDataFrame(rows, DOCS), least=2).collect() == []


def test_keys_sorted():
    r = np.random.default_rng(1)
    hi, lo = (r.integers(0, 1 << 64, 5000, np.uint64) >> np.uint64(s) for s in (60, 62))
    order = phrases.radix_order(hi, lo)
    assert np.array_equal(order, np.lexsort((lo, hi)))
    a, b, n = phrases.counted(hi, lo, np.ones(5000, np.int64))
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(hi.tolist(), lo.tolist()))


def test_scores_beyond_64_bits(spark):
    """The quotient is worked out in decimals."""
    got = spark.sql("select (cast(2000000 as decimal(38, 0)) * 9000000000000 div (cast(9000000000001 as decimal(38, 0)) + 9000000000000)) as s").first().s
    assert got == 2_000_000 * 9_000_000_000_000 // 18_000_000_000_001


def brute_cover(rows, width):
    """rows (id, text): kept words by row; rows repeated as a whole are one document."""
    order = sorted({(i is not None, i or 0, t) for i, t in rows})
    seen, out = set(), {}
    for real, i, t in order:
        w = t.encode().split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - width + 1):
            x = tuple(w[s : s + width])
            gone[s : s + width] |= x in seen
            seen.add(x)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i if real else None, t] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("chunk", "width", "period", "cover"), [(300, 20, 13, (0, 1, 3, 9)), (1 << 24, 20, 13, (0, 1, 3, 9)), (2000, 9, 7, (0, 1, 3)), (700, 7, 7, (0, 1, 3))])
def test_cover_dedup(spark, chunk, width, period, cover):
    r = random.Random(width + chunk)
    vocabulary = [f"{c}{i}" for c in "aé𝛼" for i in range(40)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, line, base = some(70), some(23), some(150)
    texts = []
    for i in range(150):
        w = some(r.randrange(60))
        w += {0: passage, 1: line, 2: passage[r.randrange(40) :], 3: passage[: r.randrange(70)]}.get(i % 6, [])
        texts.append(" ".join(w + some(r.randrange(30))))
    for _ in range(60):  # near copies
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(150)] = r.choice(vocabulary)
        texts.append(r.choice([" ", "\n", "\t\v "]).join(w))
    texts += [" ".join(base)] * 40 + ["", " ", "one", " ".join(["same"] * 90), " ".join(["ab", "cd"] * 50), " ".join(passage[:width]), " ".join(passage[: width - 1]), " ".join(some(30_000) + passage + passage)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows[5], rows[6] = (7, texts[5]), (7, texts[6])  # one id, different texts
    nulls = [(None, texts[9] + " end"), (None, " ".join(base))]
    rows += nulls + [nulls[1], rows[30], (None, None)]  # repeated rows, a null text
    docs = spark.createDataFrame([(i, t, "l", "k", 0, 0) for i, t in rows], DOCS).repartition(4)
    got = cover_dedup.remove_repeats(docs, width, period=period, cover=cover, chunk=chunk, keep_text=True)
    # Texts of one id come by hash: brute force is told that order through the text's rank.
    hashes = {x.text: x.h for x in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = {t: k for k, t in enumerate(sorted(hashes, key=hashes.get))}
    want = brute_cover([(None if i is None else i, Ranked(t or "", order)) for i, t in rows], width)
    want = Counter((i, *want[i, Ranked(t or "", order)]) for i, t in rows)
    out = got.collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in out) == want
    assert all(hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 for x in out)


class Ranked(str):
    """A text that is compared by its rank."""

    def __new__(cls, text, order):
        self = super().__new__(cls, text)
        self.rank = order[text]
        return self

    def __lt__(self, other):
        return self.rank < other.rank

    __hash__ = str.__hash__


def test_cover_dedup_edges(spark):
    assert cover_dedup.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    (row,) = cover_dedup.remove_repeats(spark.createDataFrame([(None, None, None, None, None, None)], DOCS)).collect()
    assert tuple(row) == (None, 0, 0, hashlib.sha256(b"").hexdigest())
    for cover, width in (((0, 1, 3), 20), ((0, 1, 3, 9), 12)):
        with pytest.raises(ValueError):
            cover_dedup.checked_cover(width, 13, cover)
