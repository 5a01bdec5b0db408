"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file:

* the normaliser: the model's character map (leftmost longest match), removal
  of extra spaces, a leading dummy space, space to U+2581;
* the pieces: a trie over all piece strings, one state a prefix, arcs numbered
  in a sorted table, a piece's id and weight where it ends;
* byte fallback: an arc from a character that is no piece to its UTF-8 bytes'
  pieces (or to the unknown piece), at a cost above all pieces'.

An input is normalised and composed with the other two: every start in it walks
the trie until no arc fits, and the pieces met on the way are the arcs of a
lattice over its positions.  Its shortest path in the tropical semiring gives
the ids: position by position, the cost of a state is the least, over the arcs
that end in it, of the cost where the arc starts plus the arc's weight.

Weights.  For a unigram model an arc costs minus its piece's score.  For a BPE
model piece scores alone do not make the shortest path the BPE result, so the
states remember the last piece, and an arc from piece a to piece b costs 0 if
no merge across the border comes before the merges that make a and b, and
infinity otherwise.  This too is compiled: each piece is split into the two
that its last merge joins, and the border between a and b is followed down
those splits (`_fits`).  A segmentation is BPE's if and only if all its
neighbours fit, so one path has finite cost and each position keeps one state.

No piece of the usual models holds U+2581 after another sign, so the lattice
falls apart before each run of spaces.  The parts of a batch are told apart by
two 64-bit hashes, and those never seen before are composed and solved side by
side with numpy; parts over `LONG` signs are solved alone.  Of a model with
pieces across spaces, whole texts are the parts.

Results in odd cases: null and empty texts give no ids and decode to the empty
text; the model's control strings in a text are ordinary text; invalid byte
sequences in ids decode to U+FFFD; repeated rows repeat; an empty table gives an
empty table.  Models with user-defined pieces, with spaces as suffixes or with
BPE pieces that no merges make raise ValueError.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfmill.llm.bytesops import POLY, U64, mix, ragged, string_bytes, trim
from harfmill.llm.shared import ship
from harfmill.llm.units import Known

SPACE = "▁"
# Piece types and model types of the model file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
LONG = 48
_NONE = -1
_FIT_BITS = 20
_FAR = np.iinfo(np.int64).max


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + size]
            at += size


class Normaliser:
    """The transducer from texts to what the pieces are matched against."""

    def __init__(self, character_map: bytes, dummy: bool, trim_spaces: bool, escape: bool) -> None:
        self.dummy, self.trim, self.escape = dummy, trim_spaces, escape
        self.rules = self._rules(character_map) if character_map else {}
        self.longest = max(map(len, self.rules), default=0)
        heads = "".join(sorted({re.escape(k[0]) for k in self.rules}))
        self.heads = re.compile(f"[{heads}]") if heads else None

    @staticmethod
    def _rules(blob: bytes) -> dict[str, str]:
        """All strings that the character map replaces: its double-array trie, walked from the root."""
        (size,) = struct.unpack_from("<I", blob)
        units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        texts = blob[4 + size :]
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        out: dict[str, str] = {}
        todo = [(offset(units[0]), b"")]
        while todo:
            base, prefix = todo.pop()
            for byte in range(1, 256):
                place = base ^ byte
                if place >= len(units) or units[place] & 0x800000FF != byte:
                    continue
                unit, word = units[place], prefix + bytes([byte])
                child = place ^ offset(unit)
                if unit >> 8 & 1:  # a rule ends here
                    start = units[child] & 0x7FFFFFFF
                    out[word.decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode()
                todo.append((child, word))
        return out

    def _mapped(self, text: str) -> str:
        out, at = [], 0
        while m := self.heads.search(text, at):
            k = m.start()
            for size in range(min(self.longest, len(text) - k), 0, -1):
                found = self.rules.get(text[k : k + size])
                if found is not None:
                    out += [text[at:k], found]
                    at = k + size
                    break
            else:
                out.append(text[at : k + 1])
                at = k + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.heads:
            text = self._mapped(text)
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.dummy:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text


class PieceTransducer:
    """The compiled model; `encode_batch` works on Arrow batches, `encode` and `decode` on one text."""

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        trainer = dict(f for n, v in model if n == 2 for f in _fields(v))
        spec = dict(f for n, v in model if n == 3 for f in _fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with spaces before words are supported")
        self.normalise = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        self.pieces, scores, self.types = [], [], []
        for n, v in model:
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append(f.get(1, b"").decode())
                scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
        if USER in self.types:
            raise ValueError("user-defined pieces are not supported")
        self.scores = np.asarray(scores)
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:-1], 16): k for k, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.ids = {p: k for k, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        shown = [self._shown(p, t) for p, t in zip(self.pieces, self.types, strict=True)]
        self.shown = shown
        self.shown_size = np.fromiter(map(len, shown), np.int64, len(shown))
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.fallback = float(10 - min((self.scores[k] for k in self.ids.values()), default=0.0))
        if self.kind == BPE:
            self._compile_merges()
        self._compile_trie()
        self.limit, self.known = limit, Known()

    @staticmethod
    def _shown(piece: str, kind: int) -> bytes:
        """What an id adds to a decoded text."""
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    # Compilation.

    def _compile_merges(self) -> None:
        """Ranks of pieces by score, all pairs that join to a piece, and the pair that each piece's last merge joins."""
        n = len(self.pieces)
        order = np.unique(-self.scores, return_inverse=True)[1]
        self.rank = np.full(n, -1, np.int64)  # single signs come before all merges
        for p, k in self.ids.items():
            if len(p) > 1:
                self.rank[k] = order[k]
        left, right, whole = [], [], []
        for p, k in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut], _NONE), self.ids.get(p[cut:], _NONE)
                if a >= 0 and b >= 0:
                    left.append(a)
                    right.append(b)
                    whole.append(k)
        left, right, whole = (np.asarray(x, np.int64) for x in (left, right, whole))
        keys = left << 32 | right
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_rank = np.append(keys[by_key], _FAR), np.append(self.rank[whole[by_key]], _FAR)
        self.left, self.right = np.full(n, _NONE), np.full(n, _NONE)
        self.made = np.zeros(n, bool)  # pieces that BPE makes of their own string
        self.made[[k for p, k in self.ids.items() if len(p) == 1]] = True
        # A piece's parts are shorter, so lengths in turn settle which parts there are.
        size = np.fromiter((len(p) for p in self.pieces), np.int64, n)
        for length in range(2, int(size[list(self.ids.values())].max(initial=1)) + 1):
            at = np.flatnonzero((size[whole] == length) & self.made[left] & self.made[right])
            ok = self._fits(left[at], right[at], self.rank[whole[at]])
            at = at[ok]
            self.left[whole[at]], self.right[whole[at]], self.made[whole[at]] = left[at], right[at], True
        parts = np.maximum(self.rank[self.left], self.rank[self.right])[self.made & (self.rank >= 0)]
        if (parts > self.rank[self.made & (self.rank >= 0)]).any():
            raise ValueError("pieces that are made of later pieces are not supported")
        self.fit_known = np.full(1 << _FIT_BITS, _NONE), np.zeros(1 << _FIT_BITS, bool)

    def _fits(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the pieces a and b stay as they are beside each other, down to merges of rank `limit`.

        The merges that made a and b are undone from the last to the first;
        whenever the signs at the border could have joined before the merge that
        was just undone, BPE would have joined them.  Of equal ranks the left
        one comes first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _FAR) if limit is None else limit.copy()
        out, live = np.zeros(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = np.searchsorted(self.pair_keys, x << 32 | y)
            joined = np.where(self.pair_keys[at] == (x << 32 | y), self.pair_rank[at], _FAR)
            live = live[joined >= limit[live]]
            x, y = a[live], b[live]
            split_x, split_y = self.left[x] >= 0, self.left[y] >= 0
            done = ~split_x & ~split_y
            out[live[done]] = True
            on_x = split_x & ((self.rank[x] > self.rank[y]) | ~split_y)
            on_y = ~done & ~on_x
            limit[live[on_x]], a[live[on_x]] = self.rank[x[on_x]], self.right[x[on_x]]
            limit[live[on_y]], b[live[on_y]] = self.rank[y[on_y]] + 1, self.left[y[on_y]]
            live = live[~done]
        return out

    def _compile_trie(self) -> None:
        """Arcs (state, sign) -> state in a sorted table; the piece that ends in each state."""
        arcs: dict[tuple[int, int], int] = {}
        ends = {0: _NONE}
        for p, k in self.ids.items():
            if self.kind == BPE and not self.made[k]:
                continue
            state = 0
            for ch in p:
                state = arcs.setdefault((state, ord(ch)), len(arcs) + 1)
            ends[state] = k
        self.arc_dict = arcs
        keys = np.fromiter((s << 21 | c for s, c in arcs), np.int64, len(arcs))
        order = np.argsort(keys)
        self.arc_keys = np.append(keys[order], _FAR)
        self.arc_to = np.append(np.fromiter(arcs.values(), np.int64, len(arcs))[order], 0)
        self.ends = np.full(len(arcs) + 1, _NONE)
        for s, k in ends.items():
            self.ends[s] = k
        # First steps by a table: the root has an arc for every sign that starts a piece.
        self.first = np.zeros(0x110000 if len(arcs) else 1, np.int32)
        for (s, c), to in arcs.items():
            if s == 0:
                self.first[c] = to

    # Composition and shortest paths, side by side.

    def _lattice(self, codes: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All arcs (start, end, piece) of parts that are laid end to end; `end_of`: where each sign's part ends."""
        start = np.arange(len(codes))
        state = self.first[codes].astype(np.int64)
        found = []
        reach = 1
        while True:
            live = state > 0
            start, state = start[live], state[live]
            if not len(start):
                break
            piece = self.ends[state]
            hit = piece >= 0
            found.append((start[hit], start[hit] + reach, piece[hit]))
            more = start + reach < end_of[start]
            start, state = start[more], state[more]
            key = state << 21 | codes[start + reach]
            at = np.searchsorted(self.arc_keys, key)
            state = np.where(self.arc_keys[at] == key, self.arc_to[at], 0)
            reach += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3

    def _pair_fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_fits`, looked up for pairs met lately: a table of fixed size, in which later pairs replace earlier ones."""
        keys, values = self.fit_known
        key = a << 32 | b
        slot = (key.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - _FIT_BITS)).view(np.int64)
        out, miss = values[slot], np.flatnonzero(keys[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            fits = self._fits(new >> 32, new & 0xFFFFFFFF)
            out[miss] = fits[back]
            keys[slot[miss]], values[slot[miss]] = key[miss], out[miss]
        return out

    def _solve(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that are laid end to end, and how many each has."""
        edge = np.concatenate([[0], np.cumsum(size)])
        part = np.repeat(np.arange(len(size)), size)
        start, end, piece = self._lattice(codes, edge[part + 1])
        # Fallback: an arc for each sign that is no piece itself.
        alone = np.ones(len(codes), bool)
        alone[start[end - start == 1]] = False
        alone = np.flatnonzero(alone)
        start, end, piece = np.concatenate([start, alone]), np.concatenate([end, alone + 1]), np.concatenate([piece, np.full(len(alone), _NONE)])
        weight = np.where(piece >= 0, -self.scores[piece], self.fallback) if self.kind == UNIGRAM else np.where(piece >= 0, 0.0, 1.0)
        # States: a node before each sign, and one behind each part's last; nodes of a part are offset by its number.
        shift = part[start]
        source, target = start + shift, end + shift
        depth = end - edge[shift]
        order = np.lexsort((-(end - start), target, depth))
        source, target, piece, weight, depth = source[order], target[order], piece[order], weight[order], depth[order]
        nodes = len(codes) + len(size)
        first = np.zeros(nodes, bool)
        first[edge[:-1] + np.arange(len(size))] = True
        cost = np.where(first, 0.0, math.inf)
        last, back = np.full(nodes, _NONE), np.full(nodes, _NONE)
        steps = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            s, t, p = source[lo:hi], target[lo:hi], piece[lo:hi]
            c = cost[s] + weight[lo:hi]
            if self.kind == BPE:
                both = np.flatnonzero((last[s] >= 0) & (p >= 0) & (c < math.inf))
                c[both[~self._pair_fits(last[s[both]], p[both])]] = math.inf
            heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            least = np.minimum.reduceat(c, heads)
            best = np.flatnonzero(c == np.repeat(least, np.diff(np.append(heads, len(t)))))
            best = best[np.concatenate([[True], t[best[1:]] != t[best[:-1]]])]  # of equal costs the longest piece
            cost[t[best]], last[t[best]], back[t[best]] = c[best], p[best], s[best]
        # Paths from the ends back, in turn; then in order.
        at = edge[1:] + np.arange(len(size))
        live = np.flatnonzero(size > 0)
        at = at[live]
        out = []
        while len(live):
            out.append((live, at, last[at], at - back[at]))
            at = back[at]
            more = ~first[at]
            live, at = live[more], at[more]
        if not out:
            return np.empty(0, np.int32), np.zeros(len(size), np.int64)
        owner, place, ids, _ = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(place)
        owner, place, ids = owner[order], place[order], ids[order]
        counts = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            signs = codes[place[unknown] - owner[unknown] - 1]
            spelled = [self._spelled(chr(c)) for c in signs.tolist()]
            counts[unknown] = list(map(len, spelled))
            flat = np.repeat(ids, counts)
            flat[flat < 0] = np.concatenate(spelled)
            ids = flat
        return ids.astype(np.int32), np.bincount(owner, counts, len(size)).astype(np.int64)

    def _spelled(self, sign: str) -> list[int]:
        """The byte-fallback transducer's output."""
        return [self.bytes[b] for b in sign.encode()] if self.bytes else [self.unknown]

    def _solve_alone(self, codes: list[int]) -> list[int]:
        """The same for one long part, sign by sign."""
        n, arcs = len(codes), self.arc_dict
        cost, last, back = [0.0] + [math.inf] * n, [_NONE] * (n + 1), [0] * (n + 1)
        fits: dict[tuple[int, int], bool] = {}
        for start in range(n):
            here, before = cost[start], last[start]
            state, end, single = 0, start, False
            while end < n and (state := arcs.get((state, codes[end]), 0)):
                end += 1
                piece = int(self.ends[state])
                if piece < 0:
                    continue
                single |= end == start + 1
                c = here - self.scores[piece] if self.kind == UNIGRAM else here
                if c > cost[end] or c == cost[end] and back[end] < start:
                    continue
                if self.kind == BPE and before >= 0:
                    if (before, piece) not in fits:
                        fits[before, piece] = bool(self._pair_fits(np.array([before]), np.array([piece]))[0])
                    if not fits[before, piece]:
                        continue
                if c < cost[end]:
                    cost[end], last[end], back[end] = c, piece, start
            c = here + (self.fallback if self.kind == UNIGRAM else 1.0)
            if not single and c < cost[start + 1]:
                cost[start + 1], last[start + 1], back[start + 1] = c, _NONE, start
        out, at = [], n
        while at:
            out += [last[at]] if last[at] >= 0 else self._spelled(chr(codes[at - 1]))[::-1]
            at = back[at]
        return out[::-1]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and how many each has."""
        if self.known.count > self.limit or self.known.used > 16 * self.limit:
            self.known = Known()
        lines = [self.normalise(t) for t in texts]
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(length)])
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        begin = np.zeros(len(codes), bool)
        begin[off[:-1][length > 0]] = True
        if self.apart:
            space = codes == ord(SPACE)
            begin[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(codes))
        key, check = (mix(p.span(p.prefix(codes), start, end) + (end - start).astype(U64)) for p in POLY)
        entry = self.known.find(key, check)
        rest = np.flatnonzero(entry == 0)
        if len(rest):
            _, head, back = np.unique(np.stack([key[rest], check[rest]], axis=1), axis=0, return_index=True, return_inverse=True)
            head = rest[head]
            at = self.known.find_over(key[head], check[head])
            new = head[at == 0]
            if len(new):
                at[at == 0] = self._learn(key[new], check[new], codes, start[new], end[new])
            entry[rest] = at[back.ravel()]
        size = self.known.columns[3][entry].astype(np.int64)
        ids = self.known.flat[ragged(self.known.columns[2][entry], size)]
        total = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, off)]
        if not self.bytes:  # signs in a row that no piece has are one unknown piece
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            again[total[:-1][np.diff(total) > 0]] = False
            total = total - np.searchsorted(np.flatnonzero(again), total)
            ids = ids[~again]
        return ids, np.diff(total)

    def _learn(self, key: np.ndarray, check: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Solve new parts; their entries."""
        size = end - start
        short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
        ids, counts = self._solve(codes[ragged(start[short], size[short])], size[short])
        alone = [self._solve_alone(codes[start[k] : end[k]].tolist()) for k in long.tolist()]
        ids = np.concatenate([ids, *[np.asarray(x, np.int32) for x in alone]])
        counts = np.concatenate([counts, np.fromiter(map(len, alone), np.int64, len(alone))])
        order = np.concatenate([short, long])
        out = np.empty(len(key), np.int32)
        out[order] = self.known.count + np.arange(len(key))
        self.known.add(key[order], check[order], ids, counts)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and runs of bytes, without the dummy space."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.normalise.dummy and text.startswith(" ") else text

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of texts decode to, and the offsets of texts; the dummy space is left out."""
        size = self.shown_size[ids]
        data = self.shown_bytes[ragged(self.shown_start[ids], size)]
        off = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        if self.normalise.dummy:
            first = off[:-1][np.diff(off) > 0]
            first = first[data[first] == 32]
            keep = np.ones(len(data), bool)
            keep[first] = False
            off = off - np.searchsorted(first, off)
            data = data[keep]
        return data, off


_MODELS: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    """This worker's compiled model."""
    if path not in _MODELS:
        _MODELS[path] = PieceTransducer(path)
    return _MODELS[path]


def _equal(data: np.ndarray, off: np.ndarray, other: np.ndarray, other_off: np.ndarray) -> np.ndarray:
    """Which rows have the same bytes."""
    size = np.diff(off)
    same = size == np.diff(other_off)
    at, n = np.flatnonzero(same), size[same]
    differs = data[ragged(off[:-1][at], n)] != other[ragged(other_off[:-1][at], n)]
    wrong = np.concatenate([[0], np.cumsum(differs)])
    edge = np.concatenate([[0], np.cumsum(n)])
    same[at] = wrong[edge[1:]] == wrong[edge[:-1]]
    return same


def _run(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    model = transducer(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = part.column("text").fill_null("")
            ids, n = model.encode_batch(texts.to_pylist())
            edge = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            same = _equal(*model.decoded(ids, n), *string_bytes(texts))
            columns = {"doc_id": part.column("doc_id"), "n_pieces": pa.array(n, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()), "decoded_equal": pa.array(same)}
            if keep:
                lists = [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                columns |= {"ids": pa.array(lists, pa.list_(pa.int32())), "decoded": pa.array([model.decode(x) for x in lists], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)
    trim()


def encode_documents(documents: DataFrame, model_path: str, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back.

    With `keep` also ids and the decoded text.  A narrow map without a shuffle.
    """
    ship(documents.sparkSession)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_equal boolean" + (", ids array<int>, decoded string" if keep else "")
    return slim.mapInArrow(lambda it: _run(it, model_path, keep), schema)
