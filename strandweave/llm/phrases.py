"""Phrases of two to four words that keep together, counted exactly for each language.

Words that occur ``least`` times in their language get numbers; a phrase that often holds such words alone, so pieces of
text are broken at all others.  Every place in a piece gives one key of 16 bytes: the numbers of its word and the three
after it, zeros behind a break.  Keys sorted, a phrase of two or three words is a run of equal first numbers, so one
sort counts all lengths:

1. tasks cut their texts into chunks, number each chunk's own words and write codes and words with counts;
2. words are counted over all chunks; frequent ones are numbered, and go back to each chunk that has them;
3. chunks become sorted keys with counts (a radix sort by 16 bits, equal keys as one), so a key has a row a chunk at most;
4. borders sampled from the sorted keys deal them into ranges, where a merge and run lengths give the counts.  Runs that
   reach a range's end are summed over ranges;
5. scores, phrases inside longer ones and ranks are joins and aggregations over the phrases that are frequent.

Null texts are empty, a null language is ``und``.  Ids play no part: repeated rows count as often as they are there.
Columns other than the two are not read.  A text may have any size, as long as it fits a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, forget, running_starts, text_of, written
from .shingles import _LOWER, mix, span_hashes, word_spans
from .tokens import HashRows
from .worker import release

UND = "und"
MOST_WORDS = (1 << 32) - 1  # numbers take four bytes each; more frequent words are an error
KEYS_A_ROW = 1 << 12  # 100 kB
ROWS_A_BATCH = 32  # of packed keys, on their way to Python
KEYS_A_RANGE = 1 << 20
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_GAP |= _BREAK


class _Chunk:
    """Texts of one task as codes: a word's row in the chunk's own list plus one, 0 before each piece."""

    def __init__(self):
        self.size, self.rows, self.codes = 0, HashRows(), []
        self.words: list[bytes] = []
        self.langs: list[int] = []
        self.names: dict[str, int] = {}
        self.waiting: list[bytes] = []
        self.tongues: list[int] = []

    def add(self, text: str, lang: str) -> None:
        raw = text.encode()
        self.size += len(raw)
        self.waiting.append(raw)
        self.tongues.append(self.names.setdefault(lang, len(self.names)))
        if sum(map(len, self.waiting)) > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        body = b"\n".join(self.waiting) + b"\n"
        flat = _LOWER[np.frombuffer(body, np.uint8)]
        starts, ends = word_spans(~_GAP[flat])
        doc = np.searchsorted(np.cumsum([len(r) + 1 for r in self.waiting]), starts, side="right")
        lang = np.array(self.tongues, np.int64)[doc]
        hashes = mix(span_hashes(flat, starts, ends) ^ (lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        rows = self.rows.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rows[missing] = self.rows.add(new)[back]
            lower = flat.tobytes()
            at = missing[first]
            self.words += [lower[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            self.langs += lang[at].tolist()
        breaks = np.searchsorted(np.flatnonzero(_BREAK[flat]), starts)
        new = np.diff(breaks, prepend=-1) != 0
        codes = np.zeros(len(rows) + int(new.sum()), "<u4")
        codes[np.arange(len(rows)) + np.cumsum(new)] = rows + 1
        self.codes.append(codes)
        self.waiting, self.tongues = [], []

    def batches(self, chunk: int, schema: pa.Schema):
        self.flush()
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, "<u4")
        if not self.words:
            return
        yield pa.RecordBatch.from_arrays([pa.array(["codes"], pa.string()), pa.array([chunk], pa.int64()), pa.array([codes.tobytes()], pa.binary()), *(pa.nulls(1, t) for t in schema.types[3:])], schema=schema)
        names, counts = list(self.names), np.bincount(codes, minlength=len(self.words) + 1)[1:]
        for a in range(0, len(self.words), 100_000):
            part = self.words[a : a + 100_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["word"] * n, pa.string()), pa.array(np.full(n, chunk)), pa.nulls(n, pa.binary()), pa.array(np.arange(a, a + n), pa.int32()),
                 pa.array([names[i] for i in self.langs[a : a + n]], pa.string()), pa.array([w.decode() for w in part], pa.string()), pa.array(counts[a : a + n], pa.int64())], schema=schema)


def coded(docs: DataFrame, chunk_bytes: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """Written rows of two kinds: ``codes`` (chunk, codes) and ``word`` (chunk, unit, lang, word, n)."""
    schema = "kind string, chunk long, codes binary, unit int, lang string, word string, n long"
    arrow = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("codes", pa.binary()), ("unit", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def cut(batches):
        release()
        part, nth, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                chunk.add(t.as_py(), name.as_py())
                if chunk.size >= chunk_bytes:
                    yield from chunk.batches(part << 32 | nth, arrow)
                    nth, chunk = nth + 1, _Chunk()
        yield from chunk.batches(part << 32 | nth, arrow)

    rows = docs.select(text_of(text).alias("text"), F.coalesce(F.col(lang), F.lit(UND)).alias("lang"))
    return written(rows.mapInArrow(cut, schema), "phrase-codes", ("kind",))


def radix_order(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The order of keys of two 64-bit halves: stable passes by 16 bits (a radix sort in NumPy), lowest first."""
    order = np.arange(len(hi))
    for half in (lo, hi):
        for shift in range(0, 64, 16):
            digit = (half >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys and their sums."""
    order = radix_order(hi, lo)
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n


def keys_of(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and counts of a chunk; ``ids``: number of each code, 0 for breaks and infrequent words."""
    w = np.concatenate([ids[codes], np.zeros(3, np.uint64)])
    n = len(codes)
    at = np.flatnonzero((w[:n] > 0) & (w[1 : n + 1] > 0))
    third = w[at + 2]
    fourth = np.where(third > 0, w[at + 3], np.uint64(0))
    return counted(w[at] << np.uint64(32) | w[at + 1], third << np.uint64(32) | fourth, np.ones(len(at), np.int64))


def _unpacked(table):
    """Keys and counts of packed rows, a row at a time; the first halves are stored as differences."""
    for row in zip(*(table.column(c) for c in ("hi", "lo", "n"))):
        hi, lo, n = (np.frombuffer(x.as_buffer(), "<u8") for x in row)
        yield np.cumsum(hi), lo, n.astype(np.int64)


def _packed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return np.diff(hi, prepend=np.uint64(0)).astype("<u8").tobytes(), lo.astype("<u8").tobytes(), n.astype("<u8").tobytes()


PACKED = "hi binary, lo binary, n binary"


def sorted_keys(codes: DataFrame, numbers: DataFrame) -> DataFrame:
    """codes(chunk, codes) and numbers(of: chunk, unit, id) -> written rows (chunk, size, hi, lo, n) of sorted packed keys."""

    def encode(key, left, right):
        chunk = key[0].as_py()
        rows = []
        for body in left.column("codes").to_pylist():
            raw = np.frombuffer(body, "<u4")
            ids = np.zeros(int(raw.max(initial=0)) + 1, np.uint64)
            ids[right.column("unit").to_numpy() + 1] = right.column("id").to_numpy().astype(np.uint64)
            hi, lo, n = keys_of(raw, ids)
            rows += [(chunk, len(hi[a : a + KEYS_A_ROW]), *_packed(*(x[a : a + KEYS_A_ROW] for x in (hi, lo, n)))) for a in range(0, len(hi), KEYS_A_ROW)]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(("chunk", "size", "hi", "lo", "n"), kinds))})

    both = codes.groupBy("chunk").cogroup(numbers.groupBy("of"))
    return written(both.applyInArrow(encode, f"chunk long, size long, {PACKED}"), "phrase-keys")


def borders(keys: DataFrame, a_range: int, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """First keys of all ranges but the first, from an even sample of at most about ``most`` keys (16 bytes each)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = math.ceil(total / a_range)
    if ranges < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    stride = max(1, total // min(most, 64 * ranges))

    def some(batches):
        for batch in batches:
            for (hi, lo, _), chunk in zip(_unpacked(batch), batch.column("chunk").to_pylist()):
                at = np.arange(chunk * 7919 % stride, len(hi), stride)
                yield pa.RecordBatch.from_arrays([pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64))], ["hi", "lo"])

    with arrow_rows(keys.sparkSession, ROWS_A_BATCH):
        found = keys.mapInArrow(some, "hi long, lo long").toArrow()
    hi, lo = (found.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    order = radix_order(hi, lo)
    at = order[np.arange(1, ranges) * len(order) // ranges]
    hi, lo, _ = counted(hi[at], lo[at], np.ones(len(at), np.int64))
    return hi, lo


def _cut_at(hi: np.ndarray, lo: np.ndarray, to: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted keys come before each border."""
    first, last = np.searchsorted(hi, to[0], "left"), np.searchsorted(hi, to[0], "right")
    for i in np.flatnonzero(last > first).tolist():
        first[i] += np.searchsorted(lo[first[i] : last[i]], to[1][i], "left")
    return first


def run_lengths(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all phrases in a range of sorted keys; below ``least`` only those that other ranges may go on with."""
    out = []
    third = lo & ~np.uint64(0xFFFFFFFF)
    for prefix, real, shared in ((np.zeros(len(lo), np.uint64), third == third, True), (third, third > 0, True), (lo, lo != third, False)):
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (prefix[1:] != prefix[:-1])]))
        sums = np.add.reduceat(n, first)
        keep = sums >= least
        if shared:
            keep[[0, -1]] = True
        first, sums = first[keep & real[first]], sums[keep & real[first]]
        out.append((hi[first], prefix[first], sums))
    return tuple(np.concatenate(x) for x in zip(*out))


def phrase_counts(keys: DataFrame, least: int, a_range: int) -> DataFrame:
    """Written (hi, lo, a) of all phrases that occur ``least`` times."""
    to = borders(keys, a_range)
    shared = keys.sparkSession.sparkContext.broadcast(to)

    def deal(batches):
        for batch in batches:
            for hi, lo, n in _unpacked(batch):
                cuts = np.concatenate([[0], _cut_at(hi, lo, shared.value), [len(hi)]])
                parts = np.flatnonzero(np.diff(cuts))
                rows = [_packed(*(x[cuts[p] : cuts[p + 1]] for x in (hi, lo, n))) for p in parts.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))], ["part", "hi", "lo", "n"])

    def count(key, table):
        hi, lo, n = run_lengths(*counted(*(np.concatenate(x) for x in zip(*_unpacked(table)))), least)
        return pa.table({"hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)), "a": pa.array(n, pa.int64())})

    with arrow_rows(keys.sparkSession, ROWS_A_BATCH):
        dealt = keys.select("hi", "lo", "n").mapInArrow(deal, f"part long, {PACKED}")
        runs = dealt.groupBy("part").applyInArrow(count, "hi long, lo long, a long")
        return written(runs.groupBy("hi", "lo").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrase-counts")


_LOW = "4294967295L"
_W = {"w1": "shiftrightunsigned(hi, 32)", "w2": f"hi & {_LOW}", "w3": "shiftrightunsigned(lo, 32)", "w4": f"lo & {_LOW}"}


def _key(*words: str) -> str:
    """SQL for the two halves of a phrase's key."""
    half = lambda x, y: f"shiftleft({x}, 32)" + (f" | {y}" if y else "")
    w = [*words, None, None, None]
    return f"{half(w[0], w[1])} as h, {half(w[2], w[3]) if w[2] else '0L'} as l"


def _by_size(two: list[str], three: list[str], four: list[str]) -> str:
    return f"case when w4 <> 0 then array({', '.join(four)}) when w3 <> 0 then array({', '.join(three)}) else array({', '.join(two)}) end"


def _cuts() -> str:
    """SQL for a phrase's cuts: (k, x: key of the first k words, y: key of the others)."""
    w = ("w1", "w2", "w3", "w4")
    return _by_size(*[[f"struct({k} as k, struct({_key(*w[:k])}) as x, struct({_key(*w[k:m])}) as y)" for k in range(1, m)] for m in (2, 3, 4)])


def _inside() -> str:
    """SQL for the keys of the phrases inside a phrase of three or four words."""
    w = ("w1", "w2", "w3", "w4")
    return _by_size(["struct(0L as h, 0L as l)"], *[[f"struct({_key(*w[i : i + k])})" for k in range(2, m) for i in range(m - k + 1)] for m in (3, 4)])


def mine(docs: DataFrame, least: int = 30, top: int = 2000, subsumed: int = 80, scale: int = 2_000_000, text: str = "text", lang: str = "lang",
         chunk_bytes: int = 1 << 24, a_range: int = KEYS_A_RANGE) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` occurrences; ``l`` and ``r`` those of the two parts at the lowest-scoring cut, where the score is
    floor(scale * a / (l + r)); ``n`` words of the language.  A phrase inside a longer one that has ``subsumed`` percent of its
    occurrences is left out.  By score, occurrences and text.  No phrase of a task's, a language's or a word's share is cut
    off before the ranks are known.
    """
    parts = coded(docs, chunk_bytes, text, lang)
    units = parts.where("kind = 'word'")
    totals = units.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = written(units.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrase-frequent")
    if frequent.count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} frequent words")
    numbered = running_starts(frequent, "word", "f", "before", ties=("lang",), number="number")
    words = written(numbered.select((F.col("number") + 1).alias("id"), "lang", "word", "f"), "phrase-words")
    numbers = units.join(words, ["lang", "word"]).select(F.col("chunk").alias("of"), "unit", "id")
    keys = sorted_keys(parts.where("kind = 'codes'").select("chunk", "codes"), numbers)
    grams = phrase_counts(keys, least, a_range)
    forget(keys)
    spread = max(1, math.isqrt(grams.count() // top))
    split = grams.selectExpr("*", *[f"{v} as {k}" for k, v in _W.items()])
    known = grams.select("hi", "lo", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")).union(words.selectExpr("shiftleft(id, 32)", "0L", "f", "lang"))
    side = lambda x: known.select(*[F.col(c).alias(f"_{x}_{c}") for c in known.columns])
    cuts = split.selectExpr("hi", "lo", "a", f"explode({_cuts()}) as c").selectExpr("hi", "lo", "a", "c.k as k", "c.x.h as xh", "c.x.l as xl", "c.y.h as yh", "c.y.l as yl")
    cuts = cuts.join(side("x"), (F.col("xh") == F.col("_x_hi")) & (F.col("xl") == F.col("_x_lo"))).join(side("y"), (F.col("yh") == F.col("_y_hi")) & (F.col("yl") == F.col("_y_lo")))
    score = F.expr(f"(cast({scale} as decimal(38, 0)) * a) div (cast(_x_f as decimal(38, 0)) + _y_f)")
    cuts = cuts.select("hi", "lo", "a", "k", F.col("_x_f").alias("l"), F.col("_y_f").alias("r"), F.col("_x_lang").alias("lang"), score.cast("long").alias("score"))
    # The cut after the first word has that word's language.
    scored = cuts.groupBy("hi", "lo", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.max("lang").alias("lang"))
    longer = split.where("w3 <> 0").selectExpr("a", f"explode({_inside()}) as s").selectExpr("s.h as hi", "s.l as lo", "a as longer")
    longer = longer.groupBy("hi", "lo").agg(F.max("longer").alias("longer"))
    alone = F.col("longer").isNull() | F.expr(f"cast(100 as decimal(38, 0)) * longer < cast({subsumed} as decimal(38, 0)) * a")
    left = scored.join(longer, ["hi", "lo"], "left").where(alone).select("hi", "lo", "lang", "a", "c.l", "c.r", "c.score")
    # Ranks in two steps, so no task gets all of a language's phrases; ties stay until their texts are known.
    order = [F.desc("score"), F.desc("a")]
    salt = F.pmod(F.xxhash64("hi", "lo"), F.lit(spread))
    for by in ([F.col("lang"), salt], [F.col("lang")]):
        left = left.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= top).drop("_rank")
    first = written(left, "phrase-first")
    spelled = first.selectExpr("hi", "lo", *[f"{v} as {k}" for k, v in _W.items()]).selectExpr("hi", "lo", "posexplode(filter(array(w1, w2, w3, w4), w -> w <> 0)) as (at, id)").join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("hi", "lo").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = first.join(spelled.select("hi", "lo", F.array_join("w.word", " ").alias("phrase")), ["hi", "lo"])
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    done = written(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    forget(parts, frequent, words, grams, first)
    return done
