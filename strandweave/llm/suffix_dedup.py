"""Suffix-array deduplication of repeated byte strings across a whole collection.

Bytes covered by a string of ``length`` bytes that also starts anywhere else are removed.  The suffix array is
not built over everything at once; content decides which suffixes can meet:

1. every window of ``length`` bytes has an *anchor*, the rightmost least hash among its ``gram``-byte strings, so
   equal windows have equal anchors at equal places.  Neighbouring windows with one anchor form a span;
2. equal spans of one anchor are collapsed, in each task before anything is sent: all their windows repeat.  An
   anchor with one span in the whole collection is done;
3. for the others one span of each content is fetched, and a suffix array is built over the spans of
   a bucket of anchors in two stages: only suffixes smaller than their successors are sorted directly, the others are
   induced from them by scans of the first-byte buckets, and windows whose common prefix with a neighbour reaches
   ``length`` repeat;
4. anchors with very many different spans (the edges of a passage that is everywhere) would fill one bucket.  A task that
   sees more than ``heavy`` of them at once sends them to buckets by the spans' own contents, and to the anchor's
   bucket a mark alone, so that one holds at most ``heavy`` spans a batch; the windows of marked anchors, and of
   those with more than ``heavy`` spans in their bucket, go to buckets of their own contents, one window
   of each content a task, and are counted there.

A null or empty text has no bytes.  Texts shorter than ``length`` are kept.  A repeated row repeats every window
of its text, so both rows lose them.  Rows with null ids are treated like others.  Matches never cross texts.
Texts may have any size: anchors are chosen in blocks that overlap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import safe_id, text_of, written
from .shingles import _BASE, _BYTE, _powers, mix
from .worker import release

_U = np.uint64


def _prefix_sums(flat: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[flat] * _powers(len(flat) + 1)[0][: len(flat)])])


def _substrings(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (sums[hi] - sums[lo]) * _powers(len(sums))[1][lo]


def _grams(flat: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram``-byte strings, by doubling."""
    power = lambda n: _U(pow(int(_BASE), n, 1 << 64))
    have, size, out, done = _BYTE[flat], 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out, done = have, size
            else:
                n = len(flat) - done - size + 1
                out, done = out[:n] * power(size) + have[done : done + n], done + size
        if size * 2 > gram:
            return out
        n = len(flat) - 2 * size + 1
        have, size = have[:n] * power(size) + have[size : size + n], size * 2


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys, size = np.minimum(keys[: len(keys) - size], keys[size:]), size * 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


_PLACE_BITS = 24
BLOCK = 1 << 21


def spans_of(raw: list[bytes], length: int, gram: int, block: int = BLOCK):
    """For a group of texts: arrays (text, lo, hi, anchor hash, span hash); lo..hi are window starts.

    More than ``block`` bytes are seen in blocks of single texts that overlap by ``length - 1`` bytes, so each window
    is in one block and texts may have any size.  A span that a border cuts is two spans of its anchor.
    """
    if not length <= block <= 1 << _PLACE_BITS:
        raise ValueError(f"a block of {block} bytes: {length} to {1 << _PLACE_BITS} are possible")
    if sum(map(len, raw)) <= block:
        return _block_spans(raw, length, gram)
    out = [_block_spans([], length, gram)]
    for i, b in enumerate(raw):
        for a in range(0, len(b) - length + 1, block - length + 1):
            text, lo, hi, h, s = _block_spans([b[a : a + block]], length, gram)
            out.append((text + i, lo + a, hi + a, h, s))
    return tuple(np.concatenate(c) for c in zip(*out))


def _block_spans(raw: list[bytes], length: int, gram: int):
    flat = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if len(flat) < length or not (sizes >= length).any():
        return none, none, none, none.view(_U), none.view(_U)
    grams = mix(_grams(flat, gram))
    place = np.arange(len(grams), dtype=_U)
    low = _U((1 << _PLACE_BITS) - 1)
    keys = (grams & ~low) | (low - place)
    least = _least(keys, length - gram + 1)
    text = np.repeat(np.arange(len(raw)), sizes)[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[text])
    anchor = (low - (least[starts] & low)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], anchor[first]
    sums = _prefix_sums(flat)
    body = mix(_substrings(sums, lo, hi + length) + mix((at - lo).astype(_U) * _U(1 << 20) + (hi - lo).astype(_U)))
    text = text[lo]
    base = (ends - sizes)[text]
    return text, lo - base, hi - base, grams[at], body


LOCAL = -2_000_000_000  # keys of runs that need no group, spread over as many as there are buckets
MARK = 65_535  # in place of a span's number of windows: the anchor has spans in buckets of their own contents


def window_runs(ids: np.ndarray, tags: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Rows (id, tag, first, last) of neighbouring windows of a text."""
    order = np.lexsort((lo, tags, ids))
    ids, tags, lo = ids[order], tags[order], lo[order]
    new = np.ones(len(lo), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (lo[1:] > lo[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1 if len(lo) else first
    return np.stack([ids[first], tags[first], lo[first], lo[last]], 1).astype(np.int64)


def _packed(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, packed columns) rows."""
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return [(int(bucket[p[0]]), *(c[p].tobytes() for c in columns)) for p in parts]


def _groups(batches, group_bytes: int = 1_500_000):
    """(ids, tags, bytes) of runs of texts, each run below ``group_bytes`` where its texts allow."""
    release()
    ids, tags, raw, size = [], [], [], 0
    for batch in batches:
        for i, tag, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
            b = t.encode()
            if raw and size + len(b) > group_bytes:
                yield ids, tags, raw
                ids, tags, raw, size = [], [], [], 0
            ids.append(i)
            tags.append(tag)
            raw.append(b)
            size += len(b)
    if raw:
        yield ids, tags, raw


_SPAN = "bucket int, h binary, s binary, id binary, tag binary, lo binary, hi binary, known binary"
_HITS = "kind string, id long, tag long, lo long, hi long, h long, known boolean, heavy boolean"
_HIT_ARROW = pa.schema([("kind", pa.string()), *((c, pa.int64()) for c in ("id", "tag", "lo", "hi", "h")), ("known", pa.bool_()), ("heavy", pa.bool_())])


def _hits(kind: str, ids, tags, lo, hi, h=None, known=None, heavy=None):
    n = len(ids)
    zero = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(zero if h is None else h.view(np.int64)), pa.array(zero > 0 if known is None else known), pa.array(zero > 0 if heavy is None else heavy)], schema=_HIT_ARROW)


def two_stage(text: np.ndarray, starts: np.ndarray, length: int, window_hash: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``starts`` by their first ``length`` symbols at least (ties as they come).

    ``text`` is a row of byte strings, each followed by zeros; symbols are bytes plus one.  Suffixes no larger than
    their successors by the first two symbols (type B) are sorted directly; the others (type A: first symbol
    larger than the second) are put in place by one scan over the first-symbol buckets.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    kind_a = np.zeros(len(text), bool)
    kind_a[:-1] = text[:-1] > text[1:]
    # A type A suffix needs its successor's place, so the chain down to the next type B suffix joins in.
    need = wanted.copy()
    front = np.flatnonzero(need & kind_a)
    while len(front):
        front = front[front + 1 < len(text)] + 1
        front = front[~need[front]]
        need[front] = True
        front = front[kind_a[front]]
    direct = _sort_direct(text, np.flatnonzero(need & ~kind_a), length, window_hash)
    heads = np.bincount(text[need], minlength=258)
    heads = np.concatenate([[0], np.cumsum(heads)])
    order = np.full(int(need.sum()), -1, np.int64)
    symbols = text[direct]
    # Within a bucket type A suffixes (second symbol smaller) come before type B ones.
    count_a = np.bincount(text[need & kind_a], minlength=258)
    b_heads = heads[:-1] + count_a
    within = np.arange(len(direct)) - np.searchsorted(symbols, symbols)
    order[b_heads[symbols] + within] = direct
    filled = heads[:-1].copy()
    for symbol in np.flatnonzero(np.diff(heads)):
        at, end = heads[symbol], heads[symbol + 1]
        scan = order[at:end]
        before = scan[scan > 0] - 1
        before = before[need[before] & kind_a[before]]
        # Predecessors are larger than this bucket's symbol: they go to later buckets, in this order.
        by = np.argsort(text[before], kind="stable")
        before = before[by]
        ahead = text[before]
        spot = filled[ahead] + np.arange(len(ahead)) - np.searchsorted(ahead, ahead)
        order[spot] = before
        np.add.at(filled, ahead, 1)
    return order[wanted[order]]


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the next four symbols as one number, most significant first."""
    t = np.concatenate([text, np.zeros(4, text.dtype)]).astype(_U)
    n = len(text)
    return (t[:n] << _U(48)) | (t[1 : n + 1] << _U(32)) | (t[2 : n + 2] << _U(16)) | t[3 : n + 3]


def _sort_direct(text: np.ndarray, places: np.ndarray, length: int, window_hash: np.ndarray) -> np.ndarray:
    """Sort suffixes by symbols, four at a time; groups whose whole windows are equal are left as they are."""
    words = _words(text)
    key = words[places]
    order = places[np.argsort(key, kind="stable")]
    depth = 4
    group = np.zeros(len(order), np.int64)
    if len(order):
        group = np.cumsum(np.concatenate([[0], words[order][1:] != words[order][:-1]]))
    while depth < length and len(order):
        first = np.searchsorted(group, group, "left")
        last = np.searchsorted(group, group, "right")
        tied = last - first > 1
        if not tied.any():
            break
        h = window_hash[order]
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[np.flatnonzero((group[1:] == group[:-1]) & (h[1:] != h[:-1])) + 1]] = True
        rows = np.flatnonzero(tied & mixed[group])
        if not len(rows):
            break
        part = order[rows]
        w = words[np.minimum(part + depth, len(text) - 1)]
        by = np.lexsort((w, group[rows]))
        order[rows] = part[by]
        w = w[by]
        split = np.zeros(len(order), np.int64)
        same = (group[rows][1:] == group[rows][:-1]) & (w[1:] != w[:-1])
        split[rows[1:][same]] = 1
        border = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(np.maximum(split, border))
        depth += 4
    return order


def repeated_windows(bodies: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For spans with ``counts`` windows each: which windows also start elsewhere among the spans."""
    gap = 8
    flat = np.frombuffer(b"".join(b + b"\x00" * gap for b in bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.cumsum(sizes + gap) - sizes - gap
    text = flat.astype(np.uint16) + 1
    for j in range(gap):
        text[base + sizes + j] = 0
    counts = np.array(counts, np.int64)
    starts = np.repeat(base - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    sums = _prefix_sums(flat)
    n = len(flat)
    ends = np.minimum(np.arange(n) + length, n)
    window = _substrings(sums, np.arange(n), ends)
    order = two_stage(text, starts, length, window)
    # Adjacent common prefixes, four symbols at a time, up to ``length``.
    words = _words(text)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for depth in range(0, length - 3, 4):
        alive = alive[words[a[alive] + depth] == words[b[alive] + depth]]
        if not len(alive):
            break
    for depth in range(length - length % 4, length):
        alive = alive[text[a[alive] + depth] == text[b[alive] + depth]]
    marked = np.zeros(n, bool)
    marked[a[alive]] = True
    marked[b[alive]] = True
    return [marked[s : s + c] for s, c in zip(base.tolist(), counts.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def repeated(docs: DataFrame, length: int = 200, gram: int = 40, heavy: int = 64, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, tag, lo, hi): windows starting at lo..hi of a text repeat.  ``tag``: xxhash64 of the text."""
    if length - gram >= MARK:
        raise ValueError(f"spans of {length - gram + 1} windows: fewer than {MARK} are possible")
    own = docs.select(safe_id(id_col).alias("id"), F.xxhash64(text_of(text)).alias("tag"), text_of(text).alias("text"))
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = int(max(8, size // 12_000_000))

    def post(batches):
        def collapsed(parts):
            ids, tags, lo, hi, h, s = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((s, h))
            ids, tags, lo, hi, h, s = (c[order] for c in (ids, tags, lo, hi, h, s))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(h))) > 1
            hit = np.repeat(many, np.diff(np.append(first, len(h))))
            yield "hit", (ids[hit], tags[hit], lo[hit], hi[hit])
            h, s, ids, tags, lo, more = h[first], s[first], ids[first], tags[first], lo[first], (hi - lo)[first]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            full = np.diff(edge) > heavy
            wide = np.repeat(full, np.diff(edge))
            where = np.where(wide, buckets + (mix(h ^ s) % _U(buckets)).astype(np.int64), (h % _U(buckets)).astype(np.int64))
            yield "span", (where, h, s, ids, tags, lo, more, many)
            if full.any():
                h = h[edge[:-1][full]]
                zero = np.zeros(len(h), np.int64)
                yield "span", ((h % _U(buckets)).astype(np.int64), h, zero.view(_U), zero, zero, zero, zero + MARK, zero == 0)

        parts, held = [], 0
        for ids, tags, raw in _groups(batches):
            t, lo, hi, h, s = spans_of(raw, length, gram)
            if len(t):
                parts.append((np.array(ids, np.int64)[t], np.array(tags, np.int64)[t], lo, hi, h, s))
                held += len(t)
            if held > 400_000:
                yield from collapsed(parts)
                parts, held = [], 0
        if parts:
            yield from collapsed(parts)

    def posted(batches):
        for kind, columns in post(batches):
            if kind == "hit":
                order = np.lexsort((columns[2], columns[1], columns[0]))
                ids, tags, lo, hi = (c[order] for c in columns)
                # Neighbouring spans of a text become one row.
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (lo[1:] > hi[:-1] + 1)
                first = np.flatnonzero(new)
                if len(first):
                    rows = np.stack([ids[first], tags[first], lo[first], hi[np.append(first[1:], len(ids)) - 1]], 1)
                    cut = np.array_split(rows, max(1, len(rows) // 5000))
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - (i % buckets) for i in range(len(cut))], pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()), *[pa.nulls(len(cut), pa.binary())] * 6], names)
            else:
                where, h, s, ids, tags, lo, more, many = columns
                rows = _packed(where, h, s, ids, tags, lo.astype("<u4"), more.astype("<u2"), many)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if not i else pa.binary()) for i in range(8)], names)

    names = [c.split()[0] for c in _SPAN.split(", ")]

    def match(key, table):
        if key[0].as_py() < 0:
            out = [_hits("hit", *np.frombuffer(b, np.int64).reshape(-1, 4).T) for b in table.column("h").to_pylist()]
            return pa.Table.from_batches(out, _HIT_ARROW)
        read = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()])
        h, s, ids, tags = read("h", _U), read("s", _U), read("id", np.int64), read("tag", np.int64)
        lo, more, known = read("lo", "<u4").astype(np.int64), read("hi", "<u2").astype(np.int64), read("known", bool)
        marked = np.unique(h[more == MARK])
        order = np.lexsort((s, h))
        order = order[more[order] != MARK]
        if not len(order):
            return pa.Table.from_batches([_hits("hit", [], [], [], [])], _HIT_ARROW)
        h, s, ids, tags, lo, more, known = (c[order] for c in (h, s, ids, tags, lo, more, known))
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new = new_h.copy()
        new[1:] |= s[1:] != s[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(h)))
        many = np.repeat(sizes > 1, sizes)
        out = [_hits("hit", ids[many], tags[many], lo[many], (lo + more)[many])]
        # Anchors with different spans, unless all of them are known to repeat; those whose spans also lie elsewhere.
        settled = (sizes > 1) | np.logical_or.reduceat(known, first)
        anchors = np.cumsum(new_h[first]) - 1
        different = np.bincount(anchors)
        spread = np.isin(h[np.flatnonzero(new_h)], marked) if key[0].as_py() < buckets else np.ones(len(different), bool)
        open_ = (different > 1) & (np.bincount(anchors, weights=~settled) > 0) | spread
        ask = open_[anchors]
        at = first[ask]
        out.append(_hits("ask", ids[at], tags[at], lo[at], (lo + more)[at], h[at], settled[ask], ((different > heavy) | spread)[anchors][ask]))
        return pa.Table.from_batches(out, _HIT_ARROW)

    found = written(own.mapInArrow(posted, _SPAN).groupBy("bucket").applyInArrow(match, _HITS), "suffix-spans", ("kind",))
    hits = found.where("kind = 'hit'").select("id", "tag", "lo", "hi")
    asks = found.where("kind = 'ask'").select("id", "tag", F.struct("lo", "hi", "h", "known", "heavy").alias("ask"))
    parts = max(64, asks.count() // 5_000)
    asked = own.join(asks.groupBy("id", "tag").agg(F.collect_list("ask").alias("asks")), ["id", "tag"]).dropDuplicates(["id", "tag"])

    def fetch(batches):
        """Bodies of asked spans by anchor; of heavy anchors the windows' hashes, one of each content a batch."""
        arrow = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in ("h", "id", "tag", "lo", "hi")), ("known", pa.bool_()), ("body", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            wide: list[tuple] = []
            for i, tag, t, asks in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw, sums = t.encode(), None
                for a in asks:
                    if a["heavy"]:
                        if sums is None:
                            sums = _prefix_sums(np.frombuffer(raw, np.uint8))
                        at = np.arange(a["lo"], a["hi"] + 1)
                        wide.append((mix(_substrings(sums, at, at + length) + mix(np.full(len(at), a["h"], np.int64).view(_U))), np.full(len(at), i), np.full(len(at), tag), at, np.full(len(at), a["known"])))
                    else:
                        rows.append((a["h"] % parts, a["h"], i, tag, a["lo"], a["hi"], a["known"], raw[a["lo"] : a["hi"] + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            if wide:
                w, ids, tags, lo, known = (np.concatenate(c) for c in zip(*wide))
                order = np.argsort(w, kind="stable")
                w, ids, tags, lo, known = (c[order] for c in (w, ids, tags, lo, known))
                new = np.ones(len(w), bool)
                new[1:] = w[1:] != w[:-1]
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(w)))
                many = np.repeat(sizes > 1, sizes)
                # Repeats within the batch are found here, as runs of windows; one window of each content goes on.
                many &= ~known
                runs = window_runs(ids[many], tags[many], lo[many])
                local = np.logical_or.reduceat(known, first) | (sizes > 1)
                one = _packed((w[first] % _U(parts)).astype(np.int64), w[first], ids[first], tags[first], lo[first], local)
                body = [runs.tobytes()] if len(runs) else []
                k = [LOCAL + int(runs[0, 0] % parts) for _ in body] + [-1 - r[0] for r in one]
                body += [len(r[1]).to_bytes(8, "little") + b"".join(r[1:]) for r in one]
                none = pa.nulls(len(k), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *[none] * 5, pa.nulls(len(k), pa.bool_()), pa.array(body, pa.binary())], schema=arrow)

    def resolve(key, table):
        bucket = key[0].as_py()
        none = _hits("hit", [], [], [], [])
        if bucket < LOCAL // 2:
            rows = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 4) for b in table.column("body").to_pylist()])
            return pa.Table.from_batches([_hits("hit", *rows.T)], _HIT_ARROW)
        if bucket < 0:
            columns = [[] for _ in range(5)]
            for b in table.column("body").to_pylist():
                n, at = int.from_bytes(b[:8], "little"), 8
                for c, (kind, size) in zip(columns, ((_U, 8), (np.int64, 8), (np.int64, 8), (np.int64, 8), (bool, 1))):
                    c.append(np.frombuffer(b, kind, n // 8, at))
                    at += n // 8 * size
            w, ids, tags, lo, known = map(np.concatenate, columns)
            order = np.argsort(w, kind="stable")
            w, ids, tags, lo, known = (c[order] for c in (w, ids, tags, lo, known))
            same = w[1:] == w[:-1]
            hit = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & ~known
            runs = window_runs(ids[hit], tags[hit], lo[hit])
            return pa.Table.from_batches([_hits("hit", *runs.T)], _HIT_ARROW)
        ids, tags, lo, hi = (table.column(c).to_numpy() for c in ("id", "tag", "lo", "hi"))
        flags = repeated_windows(table.column("body").to_pylist(), (hi - lo + 1).tolist(), length)
        known = table.column("known").to_pylist()
        rows = [(i, t, a + x, a + y) for i, t, a, f, k in zip(ids.tolist(), tags.tolist(), lo.tolist(), flags, known) if not k and f.any() for x, y in _runs(f)]
        return pa.Table.from_batches([_hits("hit", *zip(*rows)) if rows else none], _HIT_ARROW)

    bodies = asked.select("id", "tag", "text", "asks").mapInArrow(fetch, "bucket int, h long, id long, tag long, lo long, hi long, known boolean, body binary")
    more = bodies.groupBy("bucket").applyInArrow(resolve, _HITS).select("id", "tag", "lo", "hi")
    return hits.union(more)


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", gram: int = 40, heavy: int = 64, keep_bytes: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, ``kept`` (the bytes that stay)."""
    hits = repeated(docs, length, gram, heavy, id_col, text)
    hits = hits.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("hits"))
    own = docs.select(F.col(id_col).cast("long").alias("real"), safe_id(id_col).alias("id"), F.xxhash64(text_of(text)).alias("tag"), text_of(text).alias("text"))
    joined = own.join(hits, ["id", "tag"], "left").select("real", "text", "hits")

    def cut(batches):
        for batch in batches:
            rows = []
            for i, t, hits in zip(*(batch.column(c).to_pylist() for c in range(3))):
                raw, kept, at, removed, spans, end = t.encode(), [], 0, 0, 0, -1
                for hit in hits or ():
                    a, b = hit["lo"], hit["hi"] + length
                    if a > end:  # runs that touch are one
                        kept.append(raw[at:a])
                        spans += 1
                        removed += b - a
                    else:
                        removed += max(0, b - end)
                    end = max(end, b)
                    at = end
                kept = b"".join([*kept, raw[at:]])
                rows.append((i, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return out if keep_bytes else out.drop("kept")
