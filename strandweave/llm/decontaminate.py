"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space folded to single blanks.  An item of m characters
may differ by k = floor(m * rate) edits; cut into k + 1 pieces, at least one piece of any such occurrence is
exact.  One pass of an Aho-Corasick automaton finds the pieces.  A hit climbs the tree of halves of the item: of
any occurrence's exact pieces one lies in parts of j pieces, each with at most j - 1 edits, up to the whole, so
short comparisons end most chance hits.  Myers' bit-parallel distance decides, there and on the windows around
the hits that are left, merged so that no character is compared with a whole item twice.

Null and empty texts contain nothing, null and empty items are contained nowhere.  Items are read
in blocks of at most ``block_chars`` characters (and one item more): with several, each is fetched, broadcast, matched
and its hits written before the next one, so neither the driver nor a worker holds more than a block.
A text counts once per item, with its smallest distance; repeated rows are kept apart.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .worker import held


def folded(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def cut(item: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` pieces of nearly equal size with their offsets."""
    edges = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


def myers(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text``, and the end of the first such one."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i
        ph <<= 1
        mh <<= 1
        plus = (mh & full) | (full & ~(xv | ph))
        minus = ph & xv & full
    return best, end


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for j, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << j
    return masks


class Matcher:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(key, t) for key, t in ((k, folded(t)) for k, t in items) if t]
        self.limits = [budget(t, rate) for _, t in self.items]
        self.masks: list[dict[str, int] | None] = [None] * len(self.items)
        self.paths: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # (item, offset) -> parts above: start, end, budget
        self.parts: dict[tuple[int, int, int], tuple[str, dict[str, int]]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            leaves = cut(t, self.limits[i] + 1)
            for at, piece in leaves:
                pieces.setdefault(piece, []).append((i, at))
            self._climb(i, [a for a, _ in leaves] + [len(t)], 0, len(leaves), [])
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def _climb(self, i: int, edges: list[int], lo: int, hi: int, above: list[tuple[int, int, int]]) -> None:
        if hi - lo == 1:
            self.paths[i, edges[lo]] = above[:0:-1]  # nearest first; the whole is decided later
            return
        above = [*above, (edges[lo], edges[hi], hi - lo - 1)]
        mid = (lo + hi) // 2
        self._climb(i, edges, lo, mid, above)
        self._climb(i, edges, mid, hi, above)

    def _survives(self, i: int, at: int, start: int, text: str) -> bool:
        """Whether the parts above a piece at ``at``, found so that the item would start at ``start``, are near."""
        for a, b, k in self.paths[i, at]:
            part = self.parts.get((i, a, b))
            if part is None:
                t = self.items[i][1][a:b]
                part = self.parts[i, a, b] = (t, masks_of(t))
            if myers(part[0], part[1], text[max(0, start + a - k) : max(0, start + b + k)])[0] > k:
                return False
        return True

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item key, distance, end in the folded text) for every item within its budget."""
        if self.empty or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, at in places:
                k, m, start = self.limits[i], len(self.items[i][1]), end + 1 - size - at
                lo, hi = max(0, start - k), start + m + k
                if i in windows and windows[i][-1][0] <= lo and hi <= windows[i][-1][1] or not self._survives(i, at, start, text):
                    continue
                own = windows.setdefault(i, [])
                if own and lo <= own[-1][1] and lo >= own[-1][0]:
                    own[-1] = (own[-1][0], max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        found = []
        for i, own in windows.items():
            key, item = self.items[i]
            exact = text.find(item)
            if exact >= 0:
                found.append((key, 0, exact + len(item)))
                continue
            if self.limits[i] == 0:
                continue
            if self.masks[i] is None:
                self.masks[i] = masks_of(item)
            merged: list[list[int]] = []
            for lo, hi in sorted(own):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            best = min(((d, lo + e) for lo, hi in merged for d, e in (myers(item, self.masks[i], text[lo:hi]),)), default=(len(item), 0))
            if best[0] <= self.limits[i]:
                found.append((key, *best))
        return found


def _blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int):
    """(items, whether they are all) in blocks that fit ``block_chars``, by ranges of a running total kept in Spark."""
    from .common import running_starts

    sized = items.where(F.length(item_text) > 0).select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t"), F.length(item_text).cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    if total <= block_chars:
        yield [(r["k"], r["t"]) for r in sized.select("k", "t").collect()], True
        return
    placed = running_starts(sized, "k", "n", "start").withColumn("block", F.expr(f"cast(start div {block_chars} as int)"))
    for b in range(total // block_chars + 1):
        yield [(r["k"], r["t"]) for r in placed.where(F.col("block") == b).select("k", "t").collect()], False


def contained(docs: DataFrame, items: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """Rows (id, item_id, distance, end): items that a text holds within their edit budgets."""
    spark, out = docs.sparkSession, None
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, item_id long, distance int, end long"
    for block, single in _blocks(items, item_id, item_text, block_chars):
        stamp = hashlib.sha256(repr((rate, block)).encode()).hexdigest()
        shared = spark.sparkContext.broadcast(block)

        def run(batches, stamp=stamp, shared=shared):
            find = held(("matcher", stamp), lambda: Matcher(shared.value, rate)).find
            for batch in batches:
                rows = [(key, *hit) for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in find(folded(t))]
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["id", "item_id", "distance", "end"])

        part = own.mapInArrow(run, schema)
        if not single:
            part = written(part, "contained-block")
            shared.destroy()
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)
