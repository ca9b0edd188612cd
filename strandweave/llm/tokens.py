"""Pre-token caches for the public tokenizers: library-exact ids without encoding a word twice.

Texts made of the characters in ``_PLAIN`` are cut into the library's own pre-tokens (for sentencepiece:
blank-led units, as no piece has a blank after another character); every other text goes whole through the
library.  New pre-tokens of a group of texts are encoded by the library together, joined so that it cuts
them apart again.

For the other two kinds a group's bytes are classed and cut as arrays, and a pre-token is known by a 64-bit hash of
its bytes (``shingles.span_hashes``: random numbers by byte and place, so no pattern of bytes makes two agree); the
chance that a cache of half a million meets a false match is about 3e-14 a lookup.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .shingles import span_hashes
from .worker import held

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(r"[^\x20-\x7e\nÀ-ÖØ-öø-ÿ«»‘’“”–—…¿¡°€]|<\|")
_CONTRACTED = "'(?:[stmd]|re|ve|ll)"
_BYTE_LEVEL = re.compile(rf"{_CONTRACTED}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WORD_END = re.compile(rf"{_CONTRACTED}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_APOSTROPHE = re.compile("'[stmdrvl]")
_PIECE_UNITS = re.compile(r" +[^ ]+| +")


# Classes of bytes: text border, blank, line feed, letter, digit, other; continuation bytes take their lead's.
_BORDER, _BLANK, _FEED, _LETTER, _DIGIT, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0, 32, 10]] = _BORDER, _BLANK, _FEED
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_CLASS[48:58] = _DIGIT


def _cut_arrays(flat: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts set between zero bytes."""
    kind = _CLASS[flat]
    for _ in range(2):  # leads are followed by two continuation bytes at most
        inner = np.flatnonzero(flat & 0xC0 == 0x80)
        kind[inner] = kind[inner - 1]
    sign = np.flatnonzero(flat[:-1] == 0xC3)
    sign = sign[(flat[sign + 1] == 0x97) | (flat[sign + 1] == 0xB7)]  # the two signs among the letters
    kind[sign] = kind[sign + 1] = _OTHER
    space = (kind == _BLANK) | (kind == _FEED)
    start = np.ones(len(flat), bool)
    if by_word:
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(flat))
        real = ~space[at] & (kind[at] != _BORDER)
        return at[real], ends[real]
    before, after = kind[:-1], kind[1:]
    start[1:] = np.where(space[1:], ~space[:-1], np.where(space[:-1], (before == _FEED) | (after == _BORDER), before != after))
    # Of a run of white space before something the last one stands alone, or leads what follows if it is a blank.
    start[:-1] |= space[:-1] & ~space[1:] & (after != _BORDER)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(flat))
    real = kind[at] != _BORDER
    return at[real], ends[real]


class _Index(dict):
    """Pre-token -> row; unknown ones get the next row and wait in ``new``."""

    def __init__(self, *a):
        super().__init__(*a)
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = row = len(self)
        self.new.append(key)
        return row


class HashRows:
    """64-bit hash -> row, in arrays alone: open addressing, at most half full."""

    def __init__(self, bits: int = 16):
        self.keys, self.rows, self.held = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def __len__(self) -> int:
        return self.held

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The rows of ``hashes``, -1 for unknown ones."""
        last = len(self.keys) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        out = self.rows[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(open_):
            spot = at[open_] = (at[open_] + 1) & last
            out[open_] = self.rows[spot]
            open_ = open_[(out[open_] >= 0) & (self.keys[spot] != hashes[open_])]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Give different unknown ``hashes`` the next rows."""
        new = np.arange(self.held, self.held + len(hashes), dtype=np.int32)
        if 2 * (self.held + len(hashes)) > len(self.keys):
            keep = self.rows >= 0
            keys, rows = self.keys[keep], self.rows[keep]
            bits = (4 * (self.held + len(hashes))).bit_length()
            self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            self._put(keys, rows)
        self._put(hashes, new)
        self.held += len(hashes)
        return new

    def _put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        last = len(self.keys) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        while len(hashes):
            free = self.rows[at] < 0
            self.rows[at[free]], self.keys[at[free]] = rows[free], hashes[free]  # of several for one place the last stays
            left = self.rows[at] != rows
            hashes, rows, at = hashes[left], rows[left], (at[left] + 1) & last


def slices(texts: list[str | None], chars: int = 1_000_000):
    """Borders of runs of texts of about ``chars`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Codec:
    """Encoder of one worker process for one vocabulary file.

    Two tiers: ``frequent`` (pre-token -> number of ids; fixed, broadcast; only used when counting)
    and the pre-tokens met here, emptied when there are more than ``max_units`` or ``max_ids`` ids of them, so memory is
    bounded.
    """

    def __init__(self, path: str, counts_only: bool = False, max_units: int = 500_000, frequent: dict[str, int] | None = None, max_ids: int = 8_000_000):
        self.path, self.counts_only, self.max_units, self.frequent, self.max_ids = path, counts_only, max_units, frequent or {}, max_ids
        if path.endswith(".model"):
            import sentencepiece

            self.kind, self.lib = "piece", sentencepiece.SentencePieceProcessor(model_file=path)
            self.dtype = np.dtype("<u2" if self.lib.get_piece_size() <= 65536 else "<u4")
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            vocab = self.lib.get_vocab(with_added_tokens=True)
            self.kind = "word" if getattr(self.lib.model, "end_of_word_suffix", None) else "byte"
            self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
            self.measure = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of an id; or 1 where a word ends
            for token, i in vocab.items():
                self.measure[i] = token.endswith("</w>") if self.kind == "word" else len(token)
        self._reset()

    def _reset(self) -> None:
        if self.kind == "piece":
            self.index = _Index(zip(self.frequent, range(len(self.frequent))))
        else:
            self.index = HashRows()
            flat = np.frombuffer("".join(self.frequent).encode(), np.uint8)
            ends = np.cumsum([len(k.encode()) for k in self.frequent]).astype(np.int64)
            self.index.add(span_hashes(flat, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if len(ends) else np.zeros(0, np.uint64))
        self.lens = np.zeros(1 << 12, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, self.dtype)
        self.used = 0
        if self.frequent:
            self._store(np.arange(len(self.frequent)), np.fromiter(self.frequent.values(), np.int32, len(self.frequent)), None)

    def _store(self, rows: np.ndarray, lens: np.ndarray, flat: np.ndarray | None, ends: np.ndarray | None = None) -> None:
        """Put new rows' lengths, and where their ids end in ``flat``, which is appended."""
        n = int(rows.max()) + 1 if len(rows) else 0
        if n > len(self.lens):
            self.lens, self.ends = np.resize(self.lens, 2 * n), np.resize(self.ends, 2 * n)
        self.lens[rows] = lens
        if flat is not None and not self.counts_only:
            if self.used + len(flat) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + len(flat)))
            self.flat[self.used : self.used + len(flat)] = flat
            self.ends[rows] = self.used + ends
            self.used += len(flat)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, by the library alone."""
        ids = self.lib.encode(texts, num_threads=1) if self.kind == "piece" else [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return [np.array(i, self.dtype) for i in ids]

    # -- new pre-tokens -----------------------------------------------------------------------
    def _encode_pieces(self) -> None:
        keys, self.index.new = self.index.new, []
        rows = np.arange(len(self.index) - len(keys), len(self.index))
        # The library puts a blank before its input: the unit's own first one, or before a
        # line feed one token more, as no piece holds a line feed.
        alone = np.array([self.lib.piece_to_id("▁")], self.dtype)  # of an empty input it makes nothing
        got = self.library([k[1:] if k[0] == " " else k for k in keys])
        self._store_each(rows, [alone if k == " " else g[1:] if k[0] == "\n" else g for k, g in zip(keys, got)])

    def _encode_spans(self, rows: np.ndarray, flat: np.ndarray, at: np.ndarray, ends: np.ndarray) -> None:
        """Encode the pre-tokens at..ends of ``flat`` for new ``rows``."""
        if self.kind == "word":
            return self._encode_joined(rows, flat, at, ends, None, 32)
        first, second = flat[at], flat[np.minimum(at + 1, len(flat) - 1)]
        sign = (second == 0xC3) & np.isin(flat[np.minimum(at + 2, len(flat) - 1)], (0x97, 0xB7))
        led = (first == 32) & (ends - at > 1) & (_CLASS[second] == _LETTER) & ~sign
        space = lambda b: (b == 32) | (b == 10)
        blank = space(first) & space(flat[ends - 1])
        self._encode_joined(rows[led], flat, at[led], ends[led], None, None)
        rest = ~led & ~blank
        self._encode_joined(rows[rest], flat, at[rest], ends[rest], 10, None)
        if blank.any():
            body = flat.tobytes()
            self._store_each(rows[blank], self.library([body[a:b].decode() for a, b in zip(at[blank].tolist(), ends[blank].tolist())]))

    def _store_each(self, rows: np.ndarray, got: list[np.ndarray]) -> None:
        lens = np.fromiter(map(len, got), np.int64, len(got))
        self._store(rows, lens, np.concatenate(got) if got else np.zeros(0, self.dtype), np.cumsum(lens))

    def _encode_joined(self, rows: np.ndarray, flat: np.ndarray, at: np.ndarray, ends: np.ndarray, lead: int | None, after: int | None) -> None:
        """Pre-tokens that the library cuts apart again: led by a blank, by a line feed (one id more), or before
        blanks that it drops.  Ids are shared out by their bytes, or by the ends of words."""
        extra = int(lead is not None or after is not None)
        for k in range(0, len(rows), 4000):
            lo, sizes = at[k : k + 4000], ends[k : k + 4000] - at[k : k + 4000]
            total = np.cumsum(sizes + extra)
            begins = total - sizes - (extra if after is not None else 0)
            joined = np.full(int(total[-1]), lead or after or 0, np.uint8)
            joined[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = flat[np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            ids = self.library([joined.tobytes().decode()])[0]
            done = np.cumsum(self.measure[ids])
            if after is not None:
                total = np.arange(1, len(lo) + 1)
            if not len(done) or done[-1] != total[-1]:
                body = flat.tobytes()  # the library cut them otherwise: each by itself
                self._store_each(rows[k : k + 4000], self.library([body[a:b].decode() for a, b in zip(lo.tolist(), ends[k : k + 4000].tolist())]))
                continue
            last = np.searchsorted(done, total) + 1
            self._store(rows[k : k + 4000], np.diff(last, prepend=0) - (lead is not None), ids, last)

    def pretokens(self, text: str) -> list[str] | None:
        """Keys of a text's pre-tokens; None: only the library's run over the whole text is certain."""
        if self.kind != "piece":
            flat, at, ends, _, whole = self._cuts([text])
            body = flat.tobytes()
            return None if whole else [body[a:b].decode() for a, b in zip(at.tolist(), ends.tolist())]
        if "▁" in text:
            return None
        if text and text[0] not in " \n" and text[-1] not in " \n" and "  " not in text and " \n" not in text:
            return [w if w[0] == "\n" else " " + w for w in text.replace("\n\n", "\n").replace("\n", " \n").split(" ")] if "\n\n" not in text else _PIECE_UNITS.findall(" " + text)
        return _PIECE_UNITS.findall(" " + text) if text else []

    def unit_counts(self, keys: list[str]) -> list[int]:
        """Numbers of ids of pre-tokens that ``pretokens`` gave."""
        if self.kind == "piece":
            rows = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
            self._encode_pieces()
        else:
            raw = [k.encode() for k in keys]
            flat, ends = np.frombuffer(b"".join(raw) + b"\x00", np.uint8), np.cumsum([len(r) for r in raw]).astype(np.int64)
            at = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            rows = self._known(flat, at, ends) if keys else np.zeros(0, np.int64)
        return self.lens[rows].tolist()

    def encode(self, texts: list[str | None], group_chars: int = 1_000_000) -> list[np.ndarray] | np.ndarray:
        """Ids of each text, or with ``counts_only`` an array of their numbers.  Null counts as empty."""
        out = [self._group([t or "" for t in texts[a:b]]) for a, b in slices(texts, group_chars)]
        if self.counts_only:
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        return [x for part in out for x in part]

    def _rows_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Rows of all pre-tokens in a row, their number for each text, and the texts that go whole."""
        sizes, whole = np.zeros(len(texts), np.int64), []
        if self.kind == "piece":
            parts = []
            for i, t in enumerate(texts):
                keys = self.pretokens(t) if t else []
                if keys is None:
                    whole.append(i)
                elif keys:
                    sizes[i] = len(keys)
                    parts.append(np.fromiter(map(self.index.__getitem__, keys), np.int32, len(keys)))
            if self.index.new:
                self._encode_pieces()
            return np.concatenate(parts) if parts else np.zeros(0, np.int32), sizes, whole
        flat, at, ends, sizes, whole = self._cuts(texts)
        return self._known(flat, at, ends), sizes, whole

    def _known(self, flat: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the pre-tokens at..ends; those not met before are encoded."""
        hashes = span_hashes(flat, at, ends)
        rows = self.index.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            added = self.index.add(new)
            rows[missing] = added[back]
            first = missing[first]
            self._encode_spans(added, flat, at[first], ends[first])
        return rows

    def _cuts(self, texts: list[str]):
        """Bytes of all texts between zero bytes, starts and ends of their pre-tokens, the number of each text's, and the
        texts that go whole."""
        raw, slow, whole = [], [], []
        for i, t in enumerate(texts):
            if t and ("<|" in t or "\x00" in t or not (t.isascii() and t.replace("\n", "").isprintable()) and _PLAIN.search(t)):
                whole.append(i)
                t = ""
            if self.kind == "word":
                t = t.lower()
            if "'" in t and _APOSTROPHE.search(t):
                slow.append(i)
            raw.append(t.encode())
        flat = np.frombuffer(b"\x00" + b"\x00".join(raw) + b"\x00", np.uint8)
        at, ends = _cut_arrays(flat, self.kind == "word")
        borders = np.cumsum([len(r) + 1 for r in raw])
        if slow:  # contractions: the regular expression's cuts take the arrays' place
            first = np.concatenate([[0], borders])
            keep, more = np.ones(len(at), bool), []
            for i in slow:
                lo, hi = np.searchsorted(at, [first[i] + 1, borders[i] + 1])
                keep[lo:hi] = False
                place = int(first[i]) + 1
                t = raw[i].decode()
                for m in (_WORD_END if self.kind == "word" else _BYTE_LEVEL).finditer(t):
                    more.append((place + len(t[: m.start()].encode()), place + len(t[: m.end()].encode())))
            extra = np.array(more, np.int64).reshape(-1, 2)
            at, ends = np.concatenate([at[keep], extra[:, 0]]), np.concatenate([ends[keep], extra[:, 1]])
            order = np.argsort(at, kind="stable")
            at, ends = at[order], ends[order]
        sizes = np.diff(np.searchsorted(at, np.concatenate([[0], borders])))
        return flat, at, ends, sizes, whole

    def _group(self, texts: list[str]):
        if len(self.index) > self.max_units + len(self.frequent) or self.used > self.max_ids:
            self._reset()
        rows, sizes, whole = self._rows_of(texts)
        lens = self.lens[rows].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])
        edges = ends[np.concatenate([[0], np.cumsum(sizes)])]
        direct = dict(zip(whole, self.library([texts[i] for i in whole]))) if whole else {}
        if self.counts_only:
            n = np.diff(edges)
            for i, g in direct.items():
                n[i] = len(g)
            return n
        ids = self.flat[np.repeat(self.ends[rows] - lens - ends[:-1], lens) + np.arange(ends[-1])] if len(rows) else self.flat[:0]
        return [direct[i] if i in direct else ids[edges[i] : edges[i + 1]] for i in range(len(texts))]


def codec(path: str, counts_only: bool = False, frequent: dict[str, int] | None = None, stamp: str = "") -> Codec:
    """This worker's codec, kept across tasks; ``stamp`` tells frequent tables apart."""
    return held(("codec", path, counts_only, stamp), lambda: Codec(path, counts_only, frequent=frequent))
