"""Tokenizing whole texts with the tokenizers library, each distinct unit once.

Both vocabularies of /opt/tokenizers that are used here split a text into
pre-tokens before they merge anything, by patterns that never join certain
neighbours.  So a text can be cut at such places, and its ids are those of the
units between them.  A unit starts

* at the last white-space sign before another sign (the space of " word"), and
  at the first sign of a run of white space;
* after a white-space sign that is no space;
* between a Latin-script letter and an ASCII sign that is no letter, no
  apostrophe and no white space (either way round).

Texts with white space beyond ASCII are left to the library whole.  Units are
told apart by two independent 64-bit hashes of their bytes, computed for all
units of a batch with numpy; only units never seen before reach the library.
Of these, Latin-script words go many to a line, to a copy of the tokenizer that
splits at spaces only; ids that begin or end a word tell them apart again.
Where the vocabulary drops case, Latin letters lose it before units are
compared.  `tests/llm` holds the ids against the library's own encoding of
whole texts, also of random ones.
"""

from __future__ import annotations

import json
import os
import time
from itertools import chain

import numpy as np

from harfmill.llm.bytesops import CHUNK, IDLE, POLY, U64, doc_chunks, lower, mix, ragged

_L, _S, _P, _A, _H = 1, 2, 3, 4, 5
_CLASS = np.full(256, _P, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _L
_CLASS[[9, 10, 11, 12, 13, 32]] = _S
_CLASS[ord("'")] = _A
_CLASS[128:] = _H


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII, and of signs that some patterns count as such."""
    if len(data) < 2:
        return np.flatnonzero((data >= 28) & (data <= 31))
    a, b = data[:-1], data[1:]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (data[:-1] >= 28) & (a <= 31)
    at = np.flatnonzero((a == 0xE1) | (a == 0xE2) | (a == 0xE3))
    at = at[at + 2 < len(data)]
    x, y, z = data[at], data[at + 1], data[at + 2]
    wide = (x == 0xE1) & ((y == 0x9A) & (z == 0x80) | (y == 0xA0) & (z == 0x8E)) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    wide |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
    return np.concatenate([np.flatnonzero(hit), at[wide], np.flatnonzero((data[-1:] >= 28) & (data[-1:] <= 31)) + len(data) - 1])


def unit_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units start, and which units are a space and Latin letters only."""
    kind = _CLASS[data]
    two = np.flatnonzero(data[:-1] == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = _L
    first = np.zeros(len(data), bool)
    left, right = kind[:-1], kind[1:]
    first[1:] = (left == _L) & (right == _P) | (left == _P) & (right == _L)
    space = kind == _S
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1][np.diff(off) > 0]] = True
    begin = space.copy()
    begin[1:] &= ~space[:-1] | edge[1:-1]
    last = space.copy()  # before another sign of the same text
    last[:-1] &= ~space[1:] & ~edge[1:-1]
    last[-1:] = False
    first |= begin | last
    first[1:] |= last[:-1] & (data[:-1] != 32)
    first |= edge[:-1]
    start = np.flatnonzero(first)
    other = np.cumsum((kind != _L).astype(np.int32))
    end = np.append(start[1:], len(data))
    return start, (data[start] == 32) & (other[end - 1] - other[start] == 0) & (end - start > 1)


def _words_only(path: str):
    """The tokenizer for lines of words with a space before each, whether it drops case, and which ids begin or end a word; None if unknown."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as source:
        plan = json.load(source)
    model, split = plan["model"], plan.get("pre_tokenizer") or {}
    steps = [x["type"] for x in (plan.get("normalizer") or {}).get("normalizers", [])]
    if model["type"] != "BPE" or plan.get("post_processor", None) and plan["post_processor"]["type"] != "ByteLevel":
        return None
    if model["end_of_word_suffix"] and split.get("type") == "Sequence" and steps == ["NFC", "Replace", "Lowercase"]:
        behavior, case, edge = "Removed", True, lambda t: t.endswith(model["end_of_word_suffix"])
    elif not model["end_of_word_suffix"] and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not steps:
        behavior, case, edge = "MergedWithNext", False, lambda t: t.startswith("\u0120")
    else:
        return None
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    plan |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": behavior, "invert": False}, level]}}
    marks = np.zeros(max(model["vocab"].values()) + 1, bool)
    marks[[k for t, k in model["vocab"].items() if edge(t)]] = True
    return Tokenizer.from_str(json.dumps(plan)), case, marks


class Known:
    """The units met so far by their two hashes: a table addressed by the first hash's upper bits, and sorted overflow."""

    BITS = 21

    def __init__(self) -> None:
        self.table = np.zeros(1 << self.BITS, np.int32)
        self.count = 1  # entry 0 stands for an empty place
        self.columns = [np.zeros(1 << 16, t) for t in (U64, U64, np.int64, np.int32)]
        self.flat, self.used = np.empty(1 << 18, np.int32), 0
        self.over, self.over_at = np.empty(0, U64), np.empty(0, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each unit, 0 where it is unknown or in the overflow."""
        at = self.table[(key >> U64(64 - self.BITS)).astype(np.int64)]
        return at * ((self.columns[0][at] == key) & (self.columns[1][at] == check))

    def find_over(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.over, key)
        out = np.zeros(len(key), np.int32)
        ok = at < len(self.over)
        ok[ok] = self.over[at[ok]] == key[ok]
        out[ok] = self.over_at[at[ok]]
        return out * (self.columns[1][out] == check)

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New units, and all their ids."""
        n = self.count + len(key)
        while n > len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        for column, values in zip(self.columns, (key, check, self.used + np.cumsum(size) - size, size), strict=True):
            column[self.count : n] = values
        place = np.arange(self.count, n, dtype=np.int32)
        slot = (key >> U64(64 - self.BITS)).astype(np.int64)
        free = self.table[slot] == 0
        self.table[slot[free]] = place[free]
        late = np.flatnonzero(self.table[slot] != place)
        late = late[np.argsort(key[late])]
        where = np.searchsorted(self.over, key[late])
        self.over, self.over_at = np.insert(self.over, where, key[late]), np.insert(self.over_at, where, place[late])
        self.count, self.used = n, self.used + len(ids)


class Encoder:
    """Ids of texts as numpy arrays; remembers up to `limit` distinct units."""

    def __init__(self, path: str, limit: int = 2_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words, self.no_case, self.marks = _words_only(path) or (None, False, None)
        self.limit, self.known = limit, Known()

    def _library(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def _ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units, and each one's number of ids, by the library."""
        raw = data.tobytes()
        ids = self._library([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def _ids_of_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of a space and Latin letters, 128 to a line."""
        if self.words is None or not len(start):
            return self._ids_of(data, start, end)
        raw = data[ragged(start, end - start)].tobytes()
        edge = np.concatenate([[0], np.cumsum(end - start)])[[*range(0, len(start), 128), len(start)]].tolist()
        lines = [raw[a:b].decode() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        if self.no_case:
            lines = [x.lower() for x in lines]
        found = [e.ids for e in self.words.encode_batch_fast(lines, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(length.sum()))
        mark = self.marks[ids]
        per_line = np.add.reduceat(mark, np.cumsum(length) - length, dtype=np.int64) if (length > 0).all() else length
        if not (per_line[:-1] == 128).all() or per_line.sum() != len(start):  # an id that tells nothing about its word
            return self._ids_of(data, start, end)
        at = np.flatnonzero(mark)
        return ids, np.diff(at, prepend=-1) if self.no_case else np.diff(np.append(at, len(ids)))

    def _learn(self, key: np.ndarray, check: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> None:
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        start, end, words = start[order], end[order], int(plain.sum())
        ids, size = zip(self._ids_of_words(data, start[:words], end[:words]), self._ids_of(data, start[words:], end[words:]), strict=True)
        self.known.add(key[order], check[order], np.concatenate(ids), np.concatenate(size))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 bytes and row offsets), concatenated, and each text's number of ids."""
        _USED[0] = time.monotonic()
        parts = [self._encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in doc_chunks(off, 2 * CHUNK)]
        if not parts:
            return np.empty(0, np.int32), np.zeros(len(off) - 1, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        if not len(data):
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        if self.known.count > self.limit or self.known.used > 16 * self.limit:
            self.known = Known()
        text = data
        if self.no_case and not ((data == 0xCC) | (data == 0xCD)).any():  # marks may join a letter of one case only
            data = lower(data)
        start, plain = unit_starts(data, off)
        end = np.append(start[1:], len(data))
        key, check = (mix(p.span(p.prefix(data), start, end) + (end - start).astype(U64)) for p in POLY)
        known = self.known
        entry = known.find(key, check)
        rest = np.flatnonzero(entry == 0)
        if len(rest):
            rest = rest[np.argsort(key[rest])]
            k, c = key[rest], check[rest]
            new = np.ones(len(rest), bool)
            new[1:] = k[1:] != k[:-1]
            if (~new[1:] & (c[1:] != c[:-1])).any():
                return self._whole(text, off)
            head = rest[new]
            if (known.find_over(key[head], check[head]) == 0).any():
                fresh = head[known.find_over(key[head], check[head]) == 0]
                self._learn(key[fresh], check[fresh], data, start[fresh], end[fresh], plain[fresh])
            found = known.find(key[head], check[head])
            entry[rest] = np.repeat(np.where(found > 0, found, known.find_over(key[head], check[head])), np.diff(np.append(np.flatnonzero(new), len(k))))
            if (entry[rest] == 0).any():  # two units with one first hash
                return self._whole(text, off)
        size = known.columns[3][entry]
        ids = known.flat[ragged(known.columns[2][entry], size)]
        edge = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, off)]
        counts = np.diff(edge)
        odd = np.unique(np.searchsorted(off, _wide_space(data), "right") - 1)
        if len(odd):
            pieces = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            for k, x in zip(odd.tolist(), self._library([data[off[k] : off[k + 1]].tobytes().decode() for k in odd.tolist()]), strict=True):
                pieces[k] = np.asarray(x, np.int32)
                counts[k] = len(x)
            ids = np.concatenate(pieces)
        return ids, counts

    def _whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the library alone: where two different units share a hash."""
        ids = self._library([data[a:b].tobytes().decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts


_ENCODERS: dict[str, Encoder] = {}
_USED = [0.0]
_IDLE_SECONDS = 15


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; dropped when other work has gone on for a while."""
    _USED[0] = time.monotonic()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _drop_idle() -> None:
    if time.monotonic() - _USED[0] > _IDLE_SECONDS:
        _ENCODERS.clear()


IDLE.append(_drop_idle)


def with_end(ids: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text."""
    total = size + 1
    out = np.full(int(total.sum()), end, ids.dtype)
    last = np.zeros(len(out), bool)
    last[np.cumsum(total) - 1] = True
    out[~last] = ids
    return out, total
