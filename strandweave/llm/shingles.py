"""Word shingles as 64-bit hashes, for whole batches of texts at once.

A word is a run of bytes other than blank and tab to carriage return; A-Z count as a-z.  A text's set holds
the hashes of its ``k``-word shingles, or with fewer words the one of its whole sequence; a text without words has
none.  A word's hash sums each byte's random number times a random number of its place in the word, so no
pattern of bytes cancels out whatever its length; a shingle's does the same with words.  Two different shingles agree with
a chance of about 2^-60, which is taken as equality throughout.
"""

from __future__ import annotations

import numpy as np

from .worker import release

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


_PLACES: list[np.ndarray] = [np.zeros(0, np.uint64)]


def _places(n: int) -> np.ndarray:
    """A random number for each of the places 0 to n - 1 of a byte string."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _PLACES[0][:n]


def span_hashes(flat: np.ndarray, at: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Hashes of the byte strings flat[at:ends] (in order, none empty), by blocks, so that long texts need no long tables."""
    out, sizes = np.zeros(len(at), np.uint64), ends - at
    edges = np.searchsorted(at, np.arange(0, len(flat) + step, step)).tolist()
    for a, b in zip(edges, edges[1:]):
        if a < b:
            n = sizes[a:b]
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            terms = _BYTE[flat[place + np.repeat(at[a:b], n)]] * _places(int(n.max()))[place]
            out[a:b] = np.add.reduceat(terms, first) + n.astype(np.uint64)
    return mix(out)


def word_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def shingle_sets(texts: list[str | None], k: int, group_bytes: int = 1_000_000) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    release()
    out, at = [], 0
    raw = [(t or "").encode() for t in texts]
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < group_bytes):
            size += len(raw[end]) + 1
            end += 1
        out += _group(raw[at:end], k)
        at = end
    return out


def _group(raw: list[bytes], k: int) -> list[np.ndarray]:
    flat = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    ends_of_docs = np.cumsum([len(r) + 1 for r in raw])
    starts, ends = word_spans(~_SPACE[flat])
    words = span_hashes(flat, starts, ends)
    edges = np.searchsorted(starts, np.concatenate([[0], ends_of_docs]))
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * _PLACE[j]
    total = mix(total)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + _PLACE[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
