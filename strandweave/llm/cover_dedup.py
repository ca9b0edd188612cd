"""Removal of word passages that occur earlier, found by anchors at the places of a difference cover.

A window is ``width`` words in a row.  A set of residues modulo ``period`` is a difference cover if any two places,
moved on together by some number below ``period``, both fall on it.  So of two equal windows one shorter string of
``width - period + 1`` words, the anchor, starts at a covered place of either document, at the same offset in both, and
only anchors at covered places (4 of 13) are hashed and sent.

1. Each anchor goes with a hash of its span: all words that windows around it can reach, on both sides.  Tasks keep the
   earliest of equal spans in a chunk of texts and know the others as repeats at once, so that a passage that is
   everywhere has a row a chunk at most, and no key is hot.
2. Anchors meet by hash.  Of equal spans all but the earliest repeat as a whole; an anchor with one span is done.
3. Anchors with different spans are extended: windows around the earliest place of each span are compared word for word by
   two 64-bit hashes, again the earliest of a chunk first.
4. Covered words go back to their documents, which are cut anew.

Documents come in order of their ids, null first; different texts of one id in order of the texts' hash.  A row that is
repeated as a whole counts as one document: each copy gets its result.  Null texts have no words.  A text may have any size,
as long as it fits a row.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import real_id, safe_id, text_of, written
from .shingles import _SPACE, mix, span_hashes, word_spans
from .worker import release

CHUNK_BYTES = 24_000_000
_TABLE = np.random.default_rng(12).integers(1, 1 << 63, (3, 256), np.uint64) | np.uint64(1)
RUN = "id long, key long, lo long, hi long"
_RUN_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def checked_cover(width: int, period: int, cover: tuple[int, ...]) -> int:
    """Length of the anchors."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")
    if not period <= width <= 128:
        raise ValueError(f"windows of {width} words: {period} to 128 are possible")
    return width - period + 1


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many each text has; about a megabyte at a time."""
    hashes, sizes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and size < 1 << 20:
            group.append(texts[at].encode())
            size += len(group[-1])
            at += 1
        flat = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        starts, ends = word_spans(~_SPACE[flat])
        hashes.append(span_hashes(flat, starts, ends))
        sizes.append(np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])]))))
    return np.concatenate(hashes), np.concatenate(sizes)


def _sums(words: np.ndarray, at: np.ndarray, offsets: range, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j, m in zip(offsets, table):
        out += words[at + j] * m
    return mix(out)


class _Texts:
    """A chunk's documents of at least ``width`` words, set apart by gaps of zeros; places in order of (id, key, word)."""

    def __init__(self, ids: list[int], keys: list[int], texts: list[str], width: int, gap: int):
        words, sizes = words_of(texts)
        real = np.flatnonzero(sizes >= width)
        self.ids, self.keys, self.sizes = np.array(ids, np.int64)[real], np.array(keys, np.int64)[real], sizes[real]
        begins = (np.cumsum(sizes) - sizes)[real]
        self.at = np.cumsum(self.sizes + gap) - self.sizes
        self.words = np.zeros(int(self.sizes.sum()) + gap * (len(real) + 1), np.uint64)
        for a, b, n in zip(self.at.tolist(), begins.tolist(), self.sizes.tolist()):
            self.words[a : a + n] = words[b : b + n]
        order = np.lexsort((self.keys, self.ids))
        new = np.ones(len(order), bool)
        new[1:] = (self.ids[order][1:] != self.ids[order][:-1]) | (self.keys[order][1:] != self.keys[order][:-1])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new) - 1

    def everywhere(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, place) of all strings of ``size`` words."""
        n = np.maximum(self.sizes - size + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)


def _earliest(order: np.ndarray, place: np.ndarray, *content: np.ndarray) -> np.ndarray:
    """Whether each row is at the earliest place of its content; ``order`` sorts by content and place."""
    same = np.arange(len(order)) > 0
    for c in content:
        s = c[order]
        same[1:] &= s[1:] == s[:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.zeros(len(order), bool)
    out[order] = place[order] == place[order][head]
    return out


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document that touch or overlap as one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    far = np.maximum.accumulate(hi + doc * (1 << 32))  # a document's ends don't reach into the next one's
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] + doc[1:] * (1 << 32) > far[:-1])
    first = np.flatnonzero(new)
    return doc[first], lo[first], far[np.append(first[1:], len(doc)) - 1] - doc[first] * (1 << 32)


def _chunks(batches, size: int):
    """(ids, keys, texts, other columns) of about ``size`` bytes."""
    kept, total = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            kept.append(row)
            total += len(row[2])
            if total >= size:
                yield list(zip(*kept))
                kept, total = [], 0
    if kept:
        yield list(zip(*kept))


def _rows(schema: pa.Schema, columns: list, step: int = 200_000):
    for a in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + step], t) for c, t in zip(columns, schema.types)], schema=schema)


_MET = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
MET = "h1 long, h2 long, id long, key long, lo long, hi long"


def _sent(t: _Texts, doc: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Rows of MET: the earliest of a chunk's equal contents (``hi`` null), the others as merged runs of words to remove."""
    place = t.rank[doc] * (1 << 32) + pos
    order = np.lexsort((place, h1, h2))
    early = _earliest(order, place, h2, h1)
    d, a, b = _merged(doc[~early], lo[~early], hi[~early])
    at = np.flatnonzero(early)
    yield from _rows(_MET, [h1[at].view(np.int64), h2[at].view(np.int64), t.ids[doc[at]], t.keys[doc[at]], pos[at], pa.nulls(len(at), pa.int64())])
    # Known runs go along under numbers of their own, which spread them over all tasks.
    own = mix(t.keys[d].view(np.uint64) + a.astype(np.uint64)).view(np.int64)
    yield from _rows(_MET, [own, own, t.ids[d], t.keys[d], a, b])


def anchors(docs: DataFrame, width: int, period: int, cover: tuple[int, ...], chunk: int) -> DataFrame:
    """docs(id, key, text) -> MET rows: h1 of the anchor at word ``lo``, h2 of its span."""
    size, reach = checked_cover(width, period, cover), period - 1
    covered = np.zeros(period, bool)
    covered[list(cover)] = True

    def find(batches):
        release()
        for ids, keys, texts in _chunks(batches, chunk):
            t = _Texts(ids, keys, texts, width, reach)
            doc, pos = t.everywhere(size)
            at = np.flatnonzero(covered[pos % period])
            doc, pos = doc[at], pos[at]
            at = t.at[doc] + pos
            anchor, span = _sums(t.words, at, range(size), _TABLE[0]), _sums(t.words, at, range(-reach, size + reach), _TABLE[1])
            yield from _sent(t, doc, pos, anchor, span, np.maximum(pos - reach, 0), np.minimum(pos + size + reach, t.sizes[doc]))

    return docs.select("id", "key", "text").mapInArrow(find, MET)


def windows(docs: DataFrame, width: int, period: int, chunk: int) -> DataFrame:
    """docs(id, key, text, at: words where anchors start) -> MET rows of all windows around them."""

    def find(batches):
        release()
        for ids, keys, texts, places in _chunks(batches, chunk):
            t = _Texts(ids, keys, texts, width, period)
            real = {(i, k): np.array(p, np.int64) for i, k, p in zip(ids, keys, places)}
            docs_, starts = [], []
            for d, (i, k, n) in enumerate(zip(t.ids.tolist(), t.keys.tolist(), t.sizes.tolist())):
                mark = np.zeros(n - width + 2, np.int64)
                p = real[i, k]
                np.add.at(mark, np.clip(p - period + 1, 0, n - width + 1), 1)
                np.add.at(mark, np.clip(p + 1, 0, n - width + 1), -1)
                s = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                docs_.append(np.full(len(s), d))
                starts.append(s)
            if not docs_:
                continue
            doc, pos = np.concatenate(docs_), np.concatenate(starts)
            at = t.at[doc] + pos
            h1, h2 = (_sums(t.words, at, range(width), _TABLE[i]) for i in (1, 2))
            yield from _sent(t, doc, pos, h1, h2, pos, pos + width)

    return docs.select("id", "key", "text", "at").mapInArrow(find, MET)


def _ordered(met: DataFrame) -> DataFrame:
    """``early``: whether a row is at the earliest place of its content."""
    w = Window.partitionBy("h1", "h2").orderBy("id", "key", "lo")
    first = lambda c: F.first(c).over(w) == F.col(c)
    return met.withColumn("early", first("id") & first("key") & first("lo"))


def repeats(docs: DataFrame, width: int = 20, period: int = 13, cover: tuple[int, ...] = (0, 1, 3, 9), chunk: int = CHUNK_BYTES) -> DataFrame:
    """docs(id, key, text) -> runs (id, key, lo, hi) of words that windows with an earlier copy cover; they may overlap."""
    size, reach = checked_cover(width, period, cover), period - 1
    met = _ordered(anchors(docs, width, period, cover, chunk).repartition("h1"))
    by = Window.partitionBy("h1")
    met = met.withColumn("open", F.col("hi").isNull() & F.col("early") & (F.min("h2").over(by) != F.max("h2").over(by)))
    found = written(met.where(F.col("hi").isNotNull() | ~F.col("early") | F.col("open")).select("open", "id", "key", "lo", "hi"), "cover-met", ("open",))
    around = F.greatest(F.col("lo") - reach, F.lit(0)).alias("lo"), F.coalesce("hi", F.col("lo") + size + reach).alias("hi")
    equal = found.where("not open").select("id", "key", F.when(F.col("hi").isNull(), around[0]).otherwise(F.col("lo")).alias("lo"), around[1])
    places = found.where("open").groupBy("id", "key").agg(F.collect_list("lo").alias("at"))
    near = windows(docs.dropDuplicates(["id", "key"]).join(places, ["id", "key"]), width, period, chunk)
    near = _ordered(near).where(F.col("hi").isNotNull() | ~F.col("early")).select("id", "key", "lo", F.coalesce("hi", F.col("lo") + width).alias("hi"))
    return equal.union(near)


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text: str = "text", period: int = 13, cover: tuple[int, ...] = (0, 1, 3, 9),
                   keep_text: bool = False, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, and with ``keep_text`` the words that stay, joined by blanks.

    Removed is each word that a window covers whose words also start earlier, in a smaller id or before it in its own text.
    """
    rows = docs.select(safe_id(id_col).alias("id"), text_of(text).alias("text")).withColumn("key", F.xxhash64("text")).select("id", "key", "text")
    runs = repeats(rows, width, period, cover, chunk)
    # Two numbers below 2^31 in one, as a text holds fewer words than that.
    runs = runs.groupBy("id", "key").agg(F.collect_list(F.expr("shiftleft(lo, 32) | hi")).alias("runs"))

    def cut(batches):
        for batch in batches:
            out = []
            for t, r in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = t.encode().split()
                n = len(words)
                mark = np.zeros(n + 1, np.int64)
                if r.is_valid:
                    r = r.values.to_numpy()
                    np.add.at(mark, np.minimum(r >> 32, n), 1)
                    np.add.at(mark, np.minimum(r & 0xFFFFFFFF, n), -1)
                stays = np.cumsum(mark[:-1]) == 0
                kept = b" ".join(compress(words, stays.tolist()) if r is not None else words)
                out.append((n, n - int(stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = rows.join(runs, ["id", "key"], "left").select("id", "text", "runs").mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return done.select(real_id("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else []))
