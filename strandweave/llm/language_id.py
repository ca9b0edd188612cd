"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language; an unseen one falls back to its
character 5-grams (with word borders), then to shorter ones, down to single characters.  The model is fitted
on at most about ``sample_docs`` labelled documents (chosen by a hash of the id, so that every run takes the same) and
holds every word and n-gram of them, so that bound is the only one, on the table that is broadcast as well.

A word is a run of letters (and of the number signs that Unicode counts among word characters, like ``²``) with
at least one letter.  A null text, or one without a letter, is ``und`` with score 0, as is every text when there is
nothing to learn from.  Ties go to the language first in order.  Rows are kept one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .worker import held

_WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 5
SAMPLE_DOCS = 3_000  # the bound on labelled rows, and so on the model's size
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    words = _WORDS.findall(text.lower())
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def fit(labelled: DataFrame, id_col: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Counts of words (key ``w``) and n-grams (key: n) per language from a bounded sample of labelled rows."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = labelled.count()
    share = F.lit(min(1.0, sample_docs / max(1, total)))
    sample = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        words: dict[str, Counter] = {}

        def rows():
            got: dict[str, list] = {"lang": [], "n": [], "unit": [], "count": []}
            for name, c in words.items():
                parts = [Counter() for _ in range(LONGEST)]
                for w, k in c.items():
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            parts[n - 1][g] += k
                for n, part in enumerate([c, *parts]):
                    for unit, k in part.items():
                        for key, v in zip(got, (name, n, unit, k)):
                            got[key].append(v)
            words.clear()
            return pa.RecordBatch.from_pydict(got, pa.schema([("lang", pa.string()), ("n", pa.int32()), ("unit", pa.string()), ("count", pa.int64())]))

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(name, Counter()).update(words_of(t))
            if sum(map(len, words.values())) > 200_000:
                yield rows()
        yield rows()

    units = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, n int, unit string, count long")
    units = written(units.groupBy("lang", "n", "unit").agg(F.sum("count").alias("count")), "language-units")
    totals = {(r[0], r[1]): r[2] for r in units.groupBy("lang", "n").agg(F.sum("count")).collect()}
    held = units.select("n", "unit", "lang", "count").toArrow().sort_by([("n", "ascending"), ("unit", "ascending")])
    forget(units)
    langs = sorted(set(held.column("lang").to_pylist()))
    model = {"langs": langs, "units": {}}
    for n in range(LONGEST + 1):
        part = held.filter(pc.equal(held.column("n"), n))
        names = part.column("unit").to_pylist()
        place = np.array([langs.index(x) for x in part.column("lang").to_pylist()], np.int64)
        row = np.cumsum([a != b for a, b in zip(names, [None, *names])]) - 1 if names else np.zeros(0, np.int64)
        total = np.array([totals.get((x, n), 0) + 1 for x in langs], np.float64)
        logs = np.tile(np.log(0.1 / total), (int(row[-1]) + 1 if len(row) else 0, 1))
        if len(row):
            logs[row, place] = np.log(part.column("count").to_numpy() / total[place])
        model["units"][n] = (list(dict.fromkeys(names)), logs.astype(np.float32))
    return model


class Scorer:
    """One worker's scorer: a bounded cache of word vectors over the broadcast model."""

    def __init__(self, model: dict, max_words: int = 300_000):
        self.langs, self.max_words = model["langs"], max_words
        self.units = {n: dict(zip(names, range(len(names)))) for n, (names, _) in model["units"].items()}
        self.logs = {n: logs for n, (_, logs) in model["units"].items()}
        self._reset()

    def _reset(self) -> None:
        from .tokens import _Index

        self.index, self.rows, self.n = _Index(), np.zeros((1 << 12, len(self.langs)), np.float32), 0

    def vector(self, word: str) -> np.ndarray:
        known = self.units[0].get(word)
        if known is not None:
            return self.logs[0][known]
        for n in range(LONGEST, 0, -1):
            held = [v for v in map(self.units[n].get, grams(word, n)) if v is not None]
            if held:
                return self.logs[n][held].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for t in texts:
            words = words_of(t) if t and self.langs else []
            if not words:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            if len(self.index) > self.max_words:
                self._reset()
            rows = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
            if self.index.new:
                new, self.index.new = self.index.new, []
                if self.n + len(new) > len(self.rows):
                    self.rows = np.resize(self.rows, (2 * (self.n + len(new)), len(self.langs)))
                self.rows[self.n : self.n + len(new)] = [self.vector(w) for w in new]
                self.n += len(new)
            total = self.rows[rows].sum(0, dtype=np.float64)
            best = int(total.argmax())
            # Words of a text aren't independent: the odds count as those of at most 20 words.
            odds = np.exp((total - total[best]) / len(words) * min(len(words), 20))
            names.append(self.langs[best])
            scores.append(float(1 / odds.sum()))
        return names, scores


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, lang_pred, score, and the columns in ``keep`` (those named as a result give way).  Only the text is an input."""
    stamp = hashlib.sha256(" ".join(model["langs"]).encode())
    for names, logs in model["units"].values():
        stamp.update(" ".join(names).encode())
        stamp.update(logs.tobytes())
    stamp = stamp.hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *(k for k in keep if k not in (id_col, "lang_pred", "score"))]
    read = docs.select(*names, *([] if text in names else [text]))
    at = read.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*names).schema), "lang_pred string", "score double"])

    def run(batches):
        for batch in batches:
            found, scores = held(("scorer", stamp), lambda: Scorer(shared.value)).predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return read.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The held-out third: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the labelled rows that aren't held out; predict for all: id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(id_col)), id_col, text, lang, sample_docs)
    return predict(docs, model, id_col, text).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
