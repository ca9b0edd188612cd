"""Language, contamination, personal data and secrets on small texts, and the pipeline against a plain version."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandweave.llm import decontaminate, language_id, private_data, secret_scan


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, kind string, s int")


def luhn(x):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0


def base_private(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base_secrets(t):
    out = []
    for i, (kind, p, g, least) in enumerate((("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        out += [(m.start(), i, kind, m.end()) for m in re.finditer(p, t, re.A) if len(m[g]) >= least]
    return [(k, a, b) for a, _, k, b in sorted(out)]


PRIVATE = [
    None, "", "mail a.b@c.d.ef, x@y z@q.w.@a@b.c", "a@b.c.d@e.f", "é 1.2.3.4.5.6.7.8 and 256.1.1.1 001.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
    "99999999999999999999999", "1" * 40, "ß+49 30 123456 x@é.de", "@" * 50, "a." * 5000, "1." * 3000, "🙂 me@x.org 🙂 10.0.0.1", "mr. Smith", "x" * 20000, "0 " * 9000,
]
SECRETS = [
    None, "", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "PassWord: abc password=abcdef api_key='zz/zz+z=' APIKEY = short", "AKIA" + "A" * 16, "AKIAKIA" + "B" * 12, "é" * 3 + "deadbeef" * 3 + "G", "deadbeef" * 2,
    "token == abc", "secret\t=abcdefg", "tokenKtoken:123456", "a" * 5000, "-----BEGIN RSA PRIVATE KEY-----", "🙂 token: abcdef🙂",
]


def test_private_data(spark):
    r = random.Random(1)
    texts = PRIVATE + ["".join(r.choice("ab1234567890.@+- ()\n") for _ in range(200)) for _ in range(60)]
    got = {x.doc_id: x for x in private_data.find(table(spark, texts)).select("doc_id", "base", "all").collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == base_private(t or ""), t
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i]["all"]))
    assert private_data.find(table(spark, PRIVATE[:1]).limit(0)).count() == 0


def test_masking(spark):
    rows = private_data.masked(private_data.find(table(spark, ["é me@x.org, 10.0.0.1!", "clean", None]))).orderBy("doc_id").collect()
    assert [x.text for x in rows] == ["é <EMAIL>, <IP>!", "clean", None]


def test_reliabilities():
    good, bad = ("email", 1, 1, 1, 1), ("email", -1, -1, 0, -1)
    post = private_data.fit_reliabilities({good: 80, bad: 50, ("email", 1, -1, 0, 1): 5})
    assert post[good] > 0.9 and post[bad] < 0.1


def test_reliabilities_span_by_span():
    """The same model over single spans instead of counts of vote patterns, and the classifier over single rows."""
    r = random.Random(12)
    counts = {(k, c, g, x, b): r.randint(1, 12) for k in ("phone", "ident") for c in (-1, 0, 1) for g in (-1, 0, 1) for x in (-1, 0, 1) for b in (-1, 0) if r.random() < 0.5}
    spans = [k for k, n in counts.items() for _ in range(n)]
    votes = np.array([k[1:] for k in spans])
    kind = np.array([k[0] for k in spans])
    live = votes[:, 0] >= 0
    post = np.select([~live, votes.sum(1) > 0, votes.sum(1) < 0], [0, 0.9, 0.1], 0.5)
    for _ in range(60):
        odds = np.zeros(len(spans))
        for name in ("phone", "ident"):
            for j in range(4):
                own = live & (kind == name) & (votes[:, j] != 0)
                if not own.any():
                    continue
                held, up = max(10, own.sum() / 2), votes[own, j] > 0
                yes = [(w[up].sum() + held * a) / (w.sum() + held) for w, a in ((1 - post[own], 0.1), (post[own], 0.9))]
                odds[own] += np.where(up, np.log(yes[1] / yes[0]), np.log((1 - yes[1]) / (1 - yes[0])))
        post = np.where(live, 1 / (1 + np.exp(-odds)), 0)
    got = private_data.fit_reliabilities(counts)
    assert max(abs(got[k] - p) for k, p in zip(spans, post)) < 1e-4
    names = sorted({f for k in counts for f in private_data._features((*k, 1))})
    x = np.array([[float(f in private_data._features((*k, 1))) for f in names] for k in spans])
    w = np.zeros(len(names))
    for _ in range(200):
        w -= 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - post) / len(x) + 1e-3 * w * (x.sum(0) > 0))
    fitted = private_data.fit_classifier([((*k, 1), n, got[k]) for k, n in counts.items()])
    assert max(abs(fitted[f] - v) for f, v in zip(names, w)) < 1e-3


def test_added_spans(spark):
    """Loose spans among decoys of the same shapes: those the labelers speak for are added, and no others."""
    r = random.Random(3)
    fill = lambda n: " ".join(r.choice("the er in on at re house river table light moves fast green".split()) for _ in range(n))
    pick = lambda *x: r.choice(x)
    good = {
        "email": lambda: (pick("e-mail: ", "contact ", "write "), f"jane{r.randrange(99)} [at] mail{r.randrange(9)} [dot] example [dot] com"),
        "phone": lambda: (pick("call ", "phone: ", "tel. "), f"(212) 555-{r.randrange(10000):04}"),
        "ident": lambda: (pick("SSN ", "ssn: ", "passport "), f"{r.randint(100, 665)}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}"),
        "person": lambda: (pick("dear ", "signed ", "name: "), pick("Mr ", "Dr. ", "Frau ") + pick("Anna", "Maria", "Peter") + " " + pick("Stone", "Berg", "Klein")),
    }
    bad = [
        lambda: pick("version ", "page ", "isbn ") + f"{r.randint(100, 665)}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}",
        lambda: pick("section ", "figure ", "no. ") + f"212.555.{r.randrange(10000):04}",
        lambda: f"from 300.1.2.{r.randrange(9)}", lambda: f"code 98079157628044{r.randrange(100):02}",
    ]
    base = [lambda: f"mail me@x{r.randrange(99)}.org", lambda: f"host 10.2.{r.randrange(255)}.4", lambda: f"tel +1 (212) 555-{r.randrange(10000):04}"]
    rows, want = [], set()
    for i in range(400):
        t, kind = fill(8) + " ", r.choice([*good, "bad", "bad", "base", "base", "none", "none"])
        if kind in good:
            before, span = good[kind]()
            t += before
            want.add((i, kind, len(t), len(t) + len(span)))
            t += span
        elif kind != "none":
            t += r.choice(bad if kind == "bad" else base)()
        rows.append((i, t + " " + fill(5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, s.kind, s.s, s.e) for x in private_data.find(docs).collect() for s in x["all"] if s not in x["base"]}
    assert got == want
    assert sorted(private_data.digest(private_data.find(docs, keep_text=False)).collect()) == sorted(private_data.digest(private_data.find(docs)).collect())


def test_secrets(spark, tmp_path):
    r = random.Random(1)
    texts = SECRETS + ["".join(r.choice("0af=: 'tokensecret") for _ in range(200)) for _ in range(60)] + SECRETS
    ledger = str(tmp_path / "ledger")
    for _ in range(2):  # the second time everything comes from the ledger
        got = {x.doc_id: x for x in secret_scan.scan(table(spark, texts), ledger).collect()}
        for i, t in enumerate(texts):
            assert [tuple(s) for s in got[i].found if s.kind in secret_scan.BASE] == base_secrets(t or ""), t
    assert spark.read.parquet(f"{ledger}/scanned").count() == len({t or "" for t in texts}) * len(secret_scan.RULES)
    newer = secret_scan.RULES | {"hex": (2, "[0-9a-f]{200,}", 0, 1)}
    again = {x.doc_id: x for x in secret_scan.scan(table(spark, texts), ledger, rules=newer).collect()}
    assert not any(s.kind == "hex" and s.e - s.s < 200 for x in again.values() for s in x.found)
    assert secret_scan.scan(table(spark, texts).limit(0), str(tmp_path / "none")).count() == 0


def test_long_secrets(spark, tmp_path):
    jwt = "eyJ" + "h" * 30 + ".eyJ" + "p" * 5000 + "." + "s" * 3000
    tokens = {"jwt": jwt, "github": "ghp_" + "a1" * 400, "slack": "xoxb-" + "1-2" * 300}
    texts = ["é 🙂 " + t + " end" for t in tokens.values()] + ["x-" + jwt + ",", "-eyJ" * 100_000, "xoxb-" * 100_000, "ééyJ _eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".cccccccccccc"]
    got = {x.doc_id: [(s.kind, s.s, s.e) for s in x.found if s.kind in tokens] for x in secret_scan.scan(table(spark, texts), str(tmp_path / "ledger")).collect()}
    assert [got[i] for i in range(3)] == [[(k, 4, 4 + len(t))] for k, t in tokens.items()]
    assert got[3] == [("jwt", 2, 2 + len(jwt))]
    assert got[4] == [] and got[5] == [("slack", 0, 500_000)] and got[6] == []


def test_language(spark):
    r = random.Random(1)
    made = {"en": ["the", "house", "river", "walks"], "fr": ["une", "maison", "fleuve", "marche"], "de": ["das", "haus", "fluss", "geht"]}
    rows = [(i, " ".join(r.choice(made[lang]) for _ in range(20)), lang) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    rows += [(100, "hauses flusses", None), (101, "", "en"), (102, None, "en"), (103, "123 ...", "en"), (104, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:90])
    assert got[100].lang_pred == "de" and got[101].lang_pred == got[102].lang_pred == got[103].lang_pred == "und"
    assert all(0 <= x.score <= 1 for x in got.values()) and got[104].lang_pred in made
    unlearned = language_id.identify(docs.where("lang is null")).collect()
    assert {x.lang_pred for x in unlearned} == {"und"}


def plain_language(train, texts):
    """Word-first backoff by plain counters: (language, score) of each text."""
    counts = {n: {} for n in range(6)}
    for t, lang in train:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            for n in range(6):
                for g in [w] if n == 0 else list(w) if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]:
                    own = counts[n].setdefault(g, Counter())
                    own[lang] += 1
    langs = sorted({lang for _, lang in train})
    kept = {n: {g: {x: k for x, k in c.items() if k > 1 or n == 1} for g, c in counts[n].items()} for n in counts}
    total = {(x, n): sum(c.get(x, 0) for c in kept[n].values()) + 1 for x in langs for n in kept}
    logs = lambda n, g: [math.log((kept[n][g].get(x) or 0.1) / total[x, n]) for x in langs]
    out = []
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not words:
            out.append(("und", 0.0))
            continue
        sums = [0.0] * len(langs)
        for w in words:
            for n in (0, 5, 4, 3, 2, 1):
                units = [w] if n == 0 else list(w) if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
                held = [logs(n, g) for g in units if kept[n].get(g)]
                if held:
                    sums = [a + sum(h[i] for h in held) / len(held) for i, a in enumerate(sums)]
                    break
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        out.append((langs[best], 1 / sum(math.exp((a - sums[best]) / len(words) * min(len(words), 20)) for a in sums)))
    return out


def test_language_against_a_plain_scorer(spark):
    r = random.Random(4)
    made = {"en": ["the", "house", "river", "walks", "thing"], "fr": ["une", "maison", "fleuve", "marche", "élan"], "de": ["das", "haus", "fluss", "geht", "über"]}
    other = ["".join(r.choice("abdehinrsuéü") for _ in range(r.randint(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(made[x] + other) for _ in range(r.randint(1, 25))) + r.choice(["", " 12, 3-4!", "..."]), x) for i, x in enumerate([*made] * 60)]
    letterless = ["", None, "½ ² Ⅷ", "①②", "123 ...", "__ _", "٣", "\x00"]
    rows += [(1000 + i, t, None) for i, t in enumerate([*letterless, "½ haus ②", "ÉLAN", "ß"])]
    docs = spark.createDataFrame([(*x, "en", 7.0) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {x.doc_id: x for x in language_id.identify(docs).collect()}
    train = [(t, x) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 3 != 1]
    for (i, t, _), (lang, score) in zip(rows, plain_language(train, [t for _, t, _ in rows])):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3, t
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(got[1000 + i].lang_pred == "und" and got[1000 + i].score == 0 for i in range(len(letterless)))
    assert language_id.identify(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the tables")
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(rows) > 20 and sum(x.lang == x.lang_pred for x in rows) >= 0.95 * len(rows)


def test_decontamination_of_nothing(spark):
    bench, none = table(spark, ["an item", None]).withColumnRenamed("doc_id", "item_id"), table(spark, ["a"]).limit(0)
    assert decontaminate.contained(none, bench).count() == 0
    assert decontaminate.contained(table(spark, ["a", None]), bench.limit(0)).count() == 0


def distance(a, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(6)
    items = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 60))) for _ in range(12)] + [None, "", "  ", "Exact Passage"]
    texts = [None, "", "xx EXACT\n\npassage yy"]
    for _ in range(80):
        t = list(r.choice(items[:12]))
        for _ in range(r.randrange(8)):
            t.insert(r.randrange(len(t) + 1), r.choice("abcdz"))
            if r.random() < 0.5 and t:
                del t[r.randrange(len(t))]
        texts.append("".join(r.choice("abcd ") for _ in range(40)) + "".join(t) + "".join(r.choice("abcd ") for _ in range(40)))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    fold = decontaminate.folded
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            if fold(item) and fold(t):
                d = distance(fold(item), fold(t))
                if d <= decontaminate.budget(fold(item), 0.1):
                    want[i, j] = d
    for size in (4_000_000, 60):
        got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contained(table(spark, texts), bench, 0.1, block_chars=size).collect()}
        assert got == want


def test_pipeline(spark, tmp_path):
    """Each stage's decisions on a small corpus, and pieces that hold exactly what is left."""
    import corpus_pipeline
    from strandweave.llm.queries import tokenizer_file
    from strandweave.llm.tokens import Codec

    r = random.Random(8)
    word = lambda: "".join(r.choice(["the", "er", "in", "on", "at", "re"]) for _ in range(r.randint(1, 3)))
    plain = [" ".join(word() for _ in range(60)) for _ in range(30)]
    item = " ".join(word() for _ in range(30))
    texts = [*plain, plain[0], plain[1] + " extra", plain[2] + " " + item, "1234 5678", None, plain[3].replace("the", "mail me@x.org now", 1) + " tail of another kind altogether " + plain[4]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        left.append({x.doc_id for x in docs.collect()})
    full = set(range(30)) | {30, 31, 32, 35}
    assert left[0] == full
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(texts) if i in full}
    low = {i: min(j for j in full if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in full}
    assert left[1] == {i for i in full if low[i] == i} and not {30, 31} & left[1]
    assert left[2] == left[1] - {32}
    assert left[3] == left[2]
    kept = {x.doc_id: x.text for x in docs.collect()}
    assert "<EMAIL>" in kept[35] and "@" not in kept[35]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = Codec(tokenizer_file("word_bpe_49k.json"))
    for i, t in kept.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == len(lib.library([t])[0]) + 1
    assert {p.doc_id for p in pieces} == set(kept)


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    made = [" ".join("".join(r.choice(["the", "er", "in", "on", "at", "re"]) for _ in range(r.randint(1, 3))) for _ in range(60)) for _ in range(7)]
    rows = [(None, made[0]), (3, made[0]), (2, made[0]), (5, made[1]), (5, made[1]), (5, made[2]), (None, made[3]), (None, made[3]), (None, made[4]), (7, None), (7, None)]
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda docs: sorted(((x.doc_id, x.text) for x in docs.collect()), key=str)
    got = left(corpus_pipeline.near_duplicates(spark, table(rows), str(tmp_path)))
    assert got == sorted([(2, made[0]), (5, made[1]), (5, made[2]), (None, made[3]), (None, made[4]), (7, None), (7, None)], key=str)
    spark.createDataFrame([(0, made[6][:90])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, made[6]), (None, made[0]), (1, made[6]), (1, made[1]), (None, None)]
    got = left(corpus_pipeline.decontamination(spark, table(rows), str(tmp_path)))
    assert got == sorted([(None, made[0]), (1, made[1]), (None, None)], key=str)
