"""Removal of long repeated byte strings by prefix-free parsing.

Rule: a byte goes if a string of `length` (50) bytes that covers it also
starts in a document with a smaller doc_id.  Strings never cross documents and
are judged on the input.

Routing.  A rolling hash runs over all 16-byte strings.  The smallest hash
inside each 50-byte window is the window's anchor; a maximal run of windows
with one anchor is a stretch (its bytes overlap the next stretch's by 49, so
every window lies in exactly one, and equal windows have equal anchors).
Stretches are dealt to buckets by anchor, so equal windows meet:

1. every batch of documents sends its distinct anchors; a bucket answers which
   of them occur in two documents or more (the others cannot repeat) and which
   are hot;
2. every batch sends its distinct stretches with such anchors, each with the
   smallest doc_id that has it.  A stretch with a hot anchor is cut by where its
   windows hold the anchor, and dealt by the 33 bytes from there to the right or
   left, which lie in the window: a common 16-byte string spreads over buckets;
3. a bucket puts its windows in corpus order (below) and finds for each distinct
   window the smallest doc_id over all stretches that hold it;
4. the answers, one bit a window, go back to the batches, which mark the bytes.

Corpus order, by prefix-free parsing of a bucket's distinct stretches:

* a rolling hash over `GRAM` bytes sets triggers (about one in 8 places); a
  phrase reaches from one trigger to the end of the next, so that no phrase's
  suffix of more than `GRAM` bytes is another's prefix;
* the dictionary holds each distinct phrase once, the parse is the sequence of
  phrase ranks in each stretch;
* suffix arrays of both are built by prefix doubling, each round on the suffixes
  that are not told apart yet;
* the place of a window in corpus order is (rank of its phrase's suffix in the
  dictionary, rank of the parse behind that phrase): equal windows are
  neighbours, and neighbours are compared byte by byte over `length` bytes.

Copies of a stretch within a batch are one entry, and copies of a phrase within
a bucket one dictionary entry, so a passage or a document with a million copies
costs a bucket one entry a batch.  All bytes are compared, not only hashes,
except that two stretches or phrases count as the same when two independent
64-bit hashes and their lengths agree.

Results in odd cases: a null text is empty; a null doc_id counts as larger
than any other, and no null-id row is "smaller" than another; rows with the
same doc_id never remove from each other; texts under 50 bytes stay whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfmill.llm.bytesops import POLY, U64, doc_chunks, expand, mix, ragged, squeeze, string_bytes, trim
from harfmill.llm.shared import NULL_ID, TextBatches, Workspace, release

ANCHOR = 16
STRETCH_WINDOWS = 64
GRAM, _ONE_IN = 4, 3  # a trigger at one in 2**3 places
MESSAGE = "batch int, kind int, bucket int, n long, payload binary"


def _message(batch: list, kind: int, bucket: list, n: list, payload: list) -> pa.Table:
    return pa.table(
        {
            "batch": pa.array(batch, pa.int32()),
            "kind": pa.array([kind] * len(batch), pa.int32()),
            "bucket": pa.array(bucket, pa.int32()),
            "n": pa.array(n, pa.int64()),
            "payload": pa.array(payload, pa.binary()),
        }
    )


def _rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the 16 bytes from each place."""
    h, have = data.astype(U64), 1
    h += U64(1)
    for power in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93):
        h = h[:-have] * U64(power) + h[have:]
        have *= 2
    h ^= h >> U64(32)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    return h


def _windows(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: start, end, anchor; at most STRETCH_WINDOWS long."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, np.empty(0, U64)
    h = _rolling(data)
    span, low, reach = length - ANCHOR + 1, h, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    count = n - length + 1
    size = np.diff(off)
    fit = size >= length
    edge = np.zeros(count + 1, np.int32)
    np.add.at(edge, off[:-1][fit], 1)
    np.add.at(edge, off[1:][fit] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    same = np.zeros(count + 1, bool)
    same[1:-1] = (low[1:] == low[:-1]) & valid[1:] & valid[:-1]
    start = np.flatnonzero(valid & ~same[:-1])
    end = np.flatnonzero(valid & ~same[1:]) + 1
    runs = end - start
    if len(runs) and runs.max() > STRETCH_WINDOWS:
        pieces = -(-runs // STRETCH_WINDOWS)
        at = ragged(np.zeros(len(runs), np.int64), pieces) * STRETCH_WINDOWS
        start, end = np.repeat(start, pieces) + at, np.repeat(end, pieces)
        end = np.minimum(end, start + STRETCH_WINDOWS)
    return start, end, low[start]


class _Parse:
    """The stretches of a batch of documents."""

    def __init__(self, table: pa.Table, length: int, buckets: int, hashes: bool) -> None:
        table = table.sort_by("row")
        self.length, self.buckets = length, buckets
        self.row = table.column("row").to_numpy()
        doc = table.column("doc_id")
        self.doc_null = np.asarray(doc.is_null())
        self.doc = doc.fill_null(NULL_ID).to_numpy()
        self.data, self.off = string_bytes(table.column("text"))
        parts = []
        for lo, hi in doc_chunks(self.off):
            base = self.off[lo]
            data, off = self.data[base : self.off[hi]], self.off[lo : hi + 1] - base
            start, end, trigger = _windows(data, off, length)
            part = [start + base, end + base, mix(trigger), np.searchsorted(off, start, "right") - 1 + lo]
            if hashes:
                part += [p.span(p.prefix(data), start, end + length - 1) for p in POLY]
            parts.append(part)
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 2 + [np.empty(0, U64), np.empty(0, np.int64)] + [np.empty(0, U64)] * 2 * hashes
        self.start, self.end, key, self.at = columns[:4]
        self.hash = columns[4:]
        self.owner = self.doc[self.at]
        self.key = key >> U64(16)  # a cut key can only make more triggers look shared
        order = np.argsort(self.key)
        s = self.key[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        self.unique = s[first]
        self.group = np.empty(len(s), np.int64)
        self.group[order] = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        owner = self.owner[order]
        self.several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads) if len(s) else np.empty(0, bool)
        self.times = np.diff(np.append(heads, len(s)))

    def slices(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Bucket, from, to in sorted keys."""
        bucket = ((keys * U64(self.buckets)) >> U64(48)).astype(np.int64)
        edge = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            yield int(b), int(edge[b]), int(edge[b + 1])

    def shared(self, messages: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch whether its anchor occurs in several documents, and whether it is hot."""
        flags = np.zeros((2, len(self.unique)), bool)
        for b, lo, hi in self.slices(self.unique):
            bits = (hi - lo + 7) // 8
            for k in (0, 1):
                flags[k, lo:hi] = np.unpackbits(np.frombuffer(messages[b], np.uint8, bits, k * bits), count=hi - lo)
        return flags[0][self.group], flags[1][self.group]

    def _cut_hot(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of hot anchors, cut where their windows hold the anchor elsewhere: start, end, key, document."""
        parts = []
        reach, aside = self.length - ANCHOR + 1, (self.length - ANCHOR) // 2
        for lo in range(0, len(which), 4096):
            k = which[lo : lo + 4096]
            n = self.end[k] - self.start[k]
            at, owner = ragged(self.start[k], n), np.repeat(self.at[k], n)
            # The anchor in each window: the leftmost place of the smallest hash, in the bytes of the stretch.
            size = n + self.length - 1
            begin = np.cumsum(size) - size
            low = _rolling(self.data[ragged(self.start[k], size)])
            inside = np.repeat(begin - self.start[k], n) + at
            place = np.argmin(low[inside[:, None] + np.arange(reach)], axis=1)
            right = place <= aside  # the window holds as many bytes right of the anchor, or else left of it
            first = at + place - np.where(right, 0, aside)
            cut = np.ones(len(at), bool)
            cut[1:] = (first[1:] != first[:-1]) | (right[1:] != right[:-1]) | (at[1:] != at[:-1] + 1)
            heads = np.flatnonzero(cut)
            context = self.data[first[heads][:, None] + np.arange(ANCHOR + aside)].astype(U64)
            key = np.zeros(len(heads), U64)
            for column in context.T:
                key = mix(key * U64(0x9E3779B97F4A7C15) + column + U64(1))
            key = mix(key + right[heads].astype(U64)) >> U64(16)
            parts.append((at[heads], np.append(at[heads[1:] - 1], at[-1]) + 1, key, owner[heads]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def dictionary(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Distinct stretches among the shared ones, in order of bucket and hash."""
        used = np.flatnonzero(shared & ~hot)
        self.used_start, self.used_end, key, owner = self.start[used], self.end[used], self.key[used], self.owner[used]
        hashes = [h[used] for h in self.hash]
        if (shared & hot).any():
            start, end, cut_key, at = self._cut_hot(np.flatnonzero(shared & hot))
            size = end - start + self.length - 1
            more = [[], []]
            for lo in range(0, len(start), 4096):
                n = size[lo : lo + 4096]
                begin = np.cumsum(n) - n
                raw = self.data[ragged(start[lo : lo + 4096], n)]
                for k in (0, 1):
                    more[k].append(POLY[k].span(POLY[k].prefix(raw), begin, begin + n))
            self.used_start, self.used_end = np.concatenate([self.used_start, start]), np.concatenate([self.used_end, end])
            key, owner = np.concatenate([key, cut_key]), np.concatenate([owner, self.doc[at]])
            hashes = [np.concatenate([h, *m]) for h, m in zip(hashes, more, strict=True)]
        self.used_owner = owner
        windows = self.used_end - self.used_start
        h = mix(hashes[0] + windows.astype(U64))
        h2 = hashes[1]
        bucket = (key * U64(self.buckets)) >> U64(48)
        order = np.argsort(h)
        order = order[np.argsort(bucket[order].astype(np.uint16), kind="stable")]
        a, b, c, d = h[order], h2[order], windows[order], bucket[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        heads = np.flatnonzero(first)
        self.entry = np.empty(len(a), np.int64)
        self.entry[order] = np.cumsum(first) - 1
        head = order[heads]
        self.entry_start, self.entry_windows = self.used_start[head], windows[head]
        self.entry_bucket = d[heads].astype(np.int64)
        self.entry_doc = np.minimum.reduceat(owner[order], heads) if len(heads) else np.empty(0, np.int64)

    def entry_slices(self) -> Iterator[tuple[int, int, int]]:
        edge = np.searchsorted(self.entry_bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            yield int(b), int(edge[b]), int(edge[b + 1])


def _triggers(table: pa.Table, length: int, buckets: int, hot_times: int) -> pa.Table:
    parse, out = _Parse(table, length, buckets, hashes=False), ([], [], [], [])
    batch = table.column("batch")[0].as_py()
    for b, lo, hi in parse.slices(parse.unique):
        keys = parse.unique[lo:hi]
        values = (batch, b, hi - lo, squeeze((keys & U64(0xFFFFFFFF)).astype(np.uint32), (keys >> U64(32)).astype(np.uint16), np.packbits(parse.several[lo:hi]), np.packbits(parse.times[lo:hi] > hot_times)))
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return _message(out[0], 0, out[1], out[2], out[3])


def _answer_triggers(table: pa.Table, hot_batches: int) -> pa.Table:
    """Which anchors of a bucket occur in several documents, and which are hot: two bits for each that was sent."""
    batch, n = table.column("batch").to_pylist(), table.column("n").to_pylist()
    keys, several, many = [], [], []
    for size, payload in zip(n, table.column("payload").to_pylist(), strict=True):
        raw = expand(payload)
        keys.append(np.frombuffer(raw, np.uint32, size).astype(U64) | np.frombuffer(raw, np.uint16, size, 4 * size).astype(U64) << U64(32))
        bits = (size + 7) // 8
        several.append(np.unpackbits(np.frombuffer(raw, np.uint8, bits, 6 * size), count=size))
        many.append(np.unpackbits(np.frombuffer(raw, np.uint8, bits, 6 * size + bits), count=size))
    key = np.concatenate(keys)
    order = np.argsort(key)
    s = key[order]
    heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    times = np.diff(np.append(heads, len(s)))
    said = [np.maximum.reduceat(np.concatenate(x)[order], heads).astype(bool) for x in (several, many)]
    flags = np.zeros((2, len(s)), bool)
    flags[0, order] = np.repeat(said[0] | (times > 1), times)
    flags[1, order] = np.repeat(said[1] | (times >= hot_batches), times)
    edge = np.concatenate([[0], np.cumsum(n)])
    return _message(batch, 1, table.column("bucket").to_pylist(), n, [np.packbits(flags[0, a:b]).tobytes() + np.packbits(flags[1, a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)])


def _phrases(table: pa.Table, messages: pa.Table, length: int, buckets: int) -> pa.Table:
    if not table.num_rows:
        return _message([], 2, [], [], [])
    parse = _Parse(table, length, buckets, hashes=True)
    parse.dictionary(*parse.shared(dict(zip(messages.column("bucket").to_pylist(), messages.column("payload").to_pylist(), strict=True))))
    batch, out = table.column("batch")[0].as_py(), ([], [], [], [])
    for b, lo, hi in parse.entry_slices():
        windows = parse.entry_windows[lo:hi]
        raw = parse.data[ragged(parse.entry_start[lo:hi], windows + length - 1)]
        for column, value in zip(out, (batch, b, hi - lo, squeeze(parse.entry_doc[lo:hi], windows.astype(np.uint16), raw)), strict=True):
            column.append(value)
    return _message(out[0], 2, out[1], out[2], out[3])


def _ranked(key: np.ndarray) -> np.ndarray:
    """One more than the number of smaller keys."""
    order = np.argsort(key)
    k = key[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))
    out = np.empty(len(k), np.int64)
    out[order] = np.repeat(heads, np.diff(np.append(heads, len(k)))) + 1
    return out


def _doubled(rank: np.ndarray, room: np.ndarray, have: int) -> np.ndarray:
    """Ranks of whole suffixes from ranks by their first `have` symbols; `room`: how many symbols each suffix has.

    Each round doubles the symbols compared, for suffixes that others equal so
    far.  Where a suffix ends it is smaller than any that goes on, so those that
    are equal have all ended or none has.
    """
    todo = np.arange(len(rank))
    while len(todo := todo[room[todo] >= have]):
        behind = np.zeros(len(todo), np.int64)
        more = room[todo] > have
        behind[more] = rank[todo[more] + have]
        key = rank[todo] << 32 | behind
        order = np.argsort(key)
        todo, key = todo[order], key[order]
        old = key >> 32
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        since = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), np.arange(len(key)), 0))
        size = np.diff(np.append(heads, len(key)))
        rank[todo] = old + np.repeat(heads - since[heads], size)
        todo = todo[np.repeat(size > 1, size)]
        have *= 2
    return rank


def _distinct(hashes: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings by two hashes and length: one of each, where each string's is among them, and the order that puts equal ones together."""
    h, h2 = hashes
    order = np.argsort(h)
    a, b, c = h[order], h2[order], size[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(first) - 1
    return order[first], number, order


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string; the strings stand in order and may overlap, but not by more than they advance."""
    out = [], []
    for lo in range(0, len(start), 8192):
        at, end = start[lo : lo + 8192], start[lo : lo + 8192] + size[lo : lo + 8192]
        base = int(at[0])
        part = data[base : int(end.max())]
        for k in (0, 1):
            out[k].append(POLY[k].span(POLY[k].prefix(part), at - base, end - base))
    return tuple(np.concatenate(x) if x else np.empty(0, U64) for x in out)


def parse(text: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of strings that are laid end to end (`edge`: their bounds): start, end, and the phrases left in the string."""
    v = np.zeros(len(text), np.uint32)
    for k in range(GRAM):
        v[: len(text) - k] |= text[k:].astype(np.uint32) << np.uint32(8 * k)
    begin = (v * np.uint32(0x9E3779B1)) >> np.uint32(32 - _ONE_IN) == 0
    for k in range(1, GRAM):  # a trigger lies in one string
        begin[edge[1:] - k] = False
    begin[edge[:-1]] = True
    start = np.flatnonzero(begin)
    string = np.searchsorted(edge, start, "right") - 1
    last = np.append(string[1:] != string[:-1], True)
    end = np.where(last, edge[string + 1], np.append(start[1:], 0) + GRAM)
    after = np.flatnonzero(last)[np.cumsum(np.concatenate([[0], last[:-1]]))]
    return start, end, after - np.arange(len(start)) + 1


def corpus_order(text: np.ndarray, edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `at` (rising), each to the end of its string, in order, and their sort keys in that order.

    Of suffixes with more than GRAM bytes, those with equal keys are equal.
    """
    start, end, left = parse(text, edge)
    size = end - start
    head, number, _ = _distinct(_hashes(text, start, size), size)
    # The dictionary and its suffix array: 7 symbols at first, 0 where a phrase has ended.
    words = size[head]
    words_start = np.cumsum(words) - words
    dictionary = text[ragged(start[head], words)].astype(np.int64) + 1
    room = np.repeat(words_start + words, words) - np.arange(len(dictionary))
    key = np.zeros(len(dictionary), np.int64)
    for k in range(7):
        key <<= 9
        key[: len(key) - k] |= np.where(room[: len(key) - k] > k, dictionary[k:], 0)
    by_word = _doubled(_ranked(key), room, 7)
    # The parse and its suffix array.
    by_parse = _doubled(_ranked(by_word[words_start[number]]), left, 1)
    phrase = np.searchsorted(start, at, "right") - 1
    behind = np.zeros(len(at), np.int64)
    more = left[phrase] > 1
    behind[more] = by_parse[phrase[more] + 1]
    key = by_word[words_start[number[phrase]] + at - start[phrase]] << 32 | behind
    order = np.argsort(key)
    return order, key[order]


def equal_neighbours(text: np.ndarray, at: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares its first `length` bytes with the one before it in order."""
    v = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    for shift in (1, 2, 4):
        v = (v[:-shift] << U64(8 * shift)) | v[shift:]
    same = np.zeros(len(at), bool)
    same[1:] = key[1:] == key[:-1]
    open_ = np.flatnonzero(~same[1:]) + 1
    for step in [*range(0, length - 8, 8), length - 8]:
        open_ = open_[v[at[open_] + step] == v[at[open_ - 1] + step]]
    same[open_] = True
    return same


def _answer_phrases(table: pa.Table, length: int) -> pa.Table:
    """For each window of each phrase that a batch sent, whether a smaller doc_id than the batch's has it."""
    batch, n = table.column("batch").to_pylist(), table.column("n").to_pylist()
    docs, windows, raws = [], [], []
    for size, payload in zip(n, table.column("payload").to_pylist(), strict=True):
        raw = expand(payload)
        docs.append(np.frombuffer(raw, np.int64, size))
        windows.append(np.frombuffer(raw, np.uint16, size, 8 * size).astype(np.int64))
        raws.append(np.frombuffer(raw, np.uint8, offset=10 * size))
    doc, window, data = np.concatenate(docs), np.concatenate(windows), np.concatenate(raws)
    size = window + length - 1
    start = np.cumsum(size) - size
    # Each distinct stretch once, with its smallest doc_id.
    hashes = []
    off = np.concatenate([start, [len(data)]])
    for lo, hi in doc_chunks(off):
        part, at = data[off[lo] : off[hi]], start[lo:hi] - off[lo]
        hashes.append([p.span(p.prefix(part), at, at + size[lo:hi]) for p in POLY])
    head, entry, order = _distinct(tuple(np.concatenate(x) for x in zip(*hashes, strict=True)), window)
    group = np.flatnonzero(np.concatenate([[True], entry[order][1:] != entry[order][:-1]]))
    entry_doc, entry_windows = np.minimum.reduceat(doc[order], group), window[head]
    entry_size = entry_windows + length - 1
    text = data[ragged(start[head], entry_size)]
    edge = np.concatenate([[0], np.cumsum(entry_size)])
    at = ragged(edge[:-1], entry_windows)
    # Equal windows are neighbours in corpus order; the first of their documents.
    suffix, key = corpus_order(text, edge, at)
    group = np.flatnonzero(~equal_neighbours(text, at[suffix], key, length))
    owner = np.repeat(entry_doc, entry_windows)[suffix]
    least = np.empty(len(at), np.int64)
    least[suffix] = np.repeat(np.minimum.reduceat(owner, group), np.diff(np.append(group, len(at))))
    window_start = np.cumsum(entry_windows) - entry_windows
    bits = least[ragged(window_start[entry], window)] < np.repeat(doc, window)
    edge = np.concatenate([[0], np.cumsum(window)])[np.concatenate([[0], np.cumsum(n)])]
    return _message(batch, 2, table.column("bucket").to_pylist(), n, [np.packbits(bits[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)])


def _mark(table: pa.Table, messages: pa.Table, length: int, buckets: int) -> tuple[_Parse, np.ndarray]:
    """The batch's parse, and for each byte whether it goes."""
    parse = _Parse(table, length, buckets, hashes=True)
    kinds = messages.column("kind").to_pylist(), messages.column("bucket").to_pylist(), messages.column("payload").to_pylist()
    said = {(k, b): p for k, b, p in zip(*kinds, strict=True)}
    parse.dictionary(*parse.shared({b: p for (k, b), p in said.items() if k == 1}))
    windows = parse.entry_windows
    bits = np.zeros(int(windows.sum()), bool)
    edge = np.concatenate([[0], np.cumsum(windows)])
    for b, lo, hi in parse.entry_slices():
        bits[edge[lo] : edge[hi]] = np.unpackbits(np.frombuffer(said[2, b], np.uint8), count=int(edge[hi] - edge[lo]))
    size = parse.used_end - parse.used_start
    later = parse.used_owner > parse.entry_doc[parse.entry]
    gone = bits[ragged(edge[:-1][parse.entry], size)] | np.repeat(later, size)
    hit = np.zeros(len(parse.data) + length, np.int32)
    at = ragged(parse.used_start, size)[gone]
    hit[at] += 1
    hit[at + length] -= 1
    # at is free of repeats, as every window lies in one stretch, so both updates are exact
    return parse, np.cumsum(hit[: len(parse.data)]) > 0


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Only characters all of whose bytes go."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return gone
    size = np.diff(np.append(lead, len(data)))
    out = gone.copy()
    out[lead[0] :] = np.repeat(np.minimum.reduceat(gone, lead), size)
    return out


def _results(table: pa.Table, messages: pa.Table, length: int, buckets: int, texts: bool) -> pa.Table:
    parse, gone = _mark(table, messages, length, buckets)
    off, n = parse.off, len(parse.row)
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    heads = off[:-1][np.diff(off) > 0]
    begin[heads] = gone[heads]
    removed = np.concatenate([[0], np.cumsum(gone)])
    spans = np.concatenate([[0], np.cumsum(begin)])
    removed, spans = removed[off[1:]] - removed[off[:-1]], spans[off[1:]] - spans[off[:-1]]
    shas, kept = [], []
    for k in range(n):
        part = parse.data[off[k] : off[k + 1]]
        cut = gone[off[k] : off[k + 1]] if removed[k] else None
        shas.append(hashlib.sha256(part if cut is None else part[~cut]).hexdigest())
        if texts:
            kept.append((part if cut is None else part[~_whole_characters(part, cut)]).tobytes())
    columns = {
        "row": pa.array(parse.row, pa.int64()),
        "doc_id": pa.array(parse.doc, pa.int64(), mask=parse.doc_null),
        "n_bytes": pa.array(np.diff(off), pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()),
        "kept_sha256": pa.array(shas, pa.string()),
    }
    if texts:
        columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
        ordered = table.sort_by("row")
        columns |= {c: ordered.column(c) for c in table.column_names if c.startswith("c_")}
    return pa.table(columns)


def remove_repeats(documents: DataFrame, length: int = 50, batch_bytes: int = 8 << 20, carry: tuple[str, ...] = (), texts: bool = False, hot_batches: int = 256, hot_times: int = 1000) -> DataFrame:
    """Per document: row, doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay.

    With `texts` also the text that stays (a character goes only whole) and the
    carried columns, prefixed by `c_`.  Messages between batches and buckets are
    blocks of numbers; nothing is collected.  `batch_bytes` bounds what one
    Python worker holds: about 15 times that at the peak.  An anchor is hot that
    `hot_batches` batches have, or one batch more than `hot_times` times, so at
    most 256 x 1,000 stretches share one that is not.
    """
    spark = documents.sparkSession
    space = Workspace(spark, "pfp")
    store = TextBatches(space, documents, batch_bytes, carry)
    batches, buckets = store.frame, min(6 * store.count, 65000)
    slim = batches.select("batch", "row", "doc_id", "text")
    sent = slim.groupBy("batch").applyInArrow(lambda t: _trimmed(_triggers, t, length, buckets, hot_times), MESSAGE)
    shared = space.save(store.spread(sent, "bucket").groupBy("bucket").applyInArrow(lambda t: _answer_triggers(t, hot_batches), MESSAGE), "shared")
    del sent
    release(spark)
    sent = slim.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(lambda t, m: _trimmed(_phrases, t, m, length, buckets), MESSAGE)
    known = space.save(store.spread(sent, "bucket").groupBy("bucket").applyInArrow(lambda t: _trimmed(_answer_phrases, t, length), MESSAGE), "known")
    del sent
    release(spark)
    schema = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        carried = [f for f in batches.schema.fields if f.name.startswith("c_")]
        schema += ", text string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)
    source = batches.select("batch", "row", "doc_id", "text", *[f"c_{c}" for c in carry]) if texts else slim
    result = source.groupBy("batch").cogroup(shared.unionByName(known).groupBy("batch")).applyInArrow(lambda t, m: _trimmed(_results, t, m, length, buckets, texts) if t.num_rows else _no_rows(t, texts), schema)
    out = space.save(result, "result")
    space.close("result")
    return out


def _trimmed(f, *args) -> pa.Table:
    out = f(*args)
    trim()
    return out


def _no_rows(table: pa.Table, texts: bool) -> pa.Table:
    columns = {c: pa.array([], t) for c, t in (("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))}
    if texts:
        columns["text"] = pa.array([], pa.string())
        columns |= {c: table.column(c) for c in table.column_names if c.startswith("c_")}
    return pa.table(columns)


def documents_without_repeats(documents: DataFrame, columns: list[str], length: int = 50) -> DataFrame:
    """The documents with repeated passages taken out of their texts; n_chars follows the text.

    Rows and the other columns stay as they are, also where no text is left.
    """
    carry = tuple(c for c in columns if c not in ("doc_id", "text"))
    out = remove_repeats(documents.select(*columns), length, carry=carry, texts=True)
    picked = {c: F.col(f"c_{c}") for c in carry} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in picked:
        picked["n_chars"] = F.length("text").cast("long")
    return out.select(*[picked[c].alias(c) for c in columns])
