"""A block codec for token ids: adaptive context mixing and a range coder.

Each block of `BLOCK` ids is coded on its own: all state starts anew, nothing
but the number of symbols is needed beside its bytes, and a CRC-32 of its ids
goes into the index.  Three predictions drive the coder:

* order 2: the id that last followed the two ids before (hashed context);
* order 1: the id that last followed the id before (hashed context);
* order 0: how often each id has come up in the block, counted anew at the
  places in `EPOCHS`; what is left goes to a fixed falling curve over all ids.

Orders 2 and 1 come with a confidence state (hits in a row); for each state the
block learns how often such a prediction holds.  The two probabilities are
mixed (added up as independent evidence where both orders name one id, else
order 1 gets its share of what order 2 leaves), and the rest of the interval,
never less than a sixteenth, is shared out by order 0, which in turn leaves a
sixteenth at least, and more the more distinct ids it has met, to ids that are
new to the block.  A 48-bit range coder with 28-bit frequencies turns the
intervals into 16-bit digits; carries are resolved afterwards.

Coding is sequential within a block but not across blocks, so blocks are coded
side by side as lanes of numpy arrays: one step codes one id of every lane.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
LANES = 4096
#: Places in a block at which order 0 counts what has come so far.
EPOCHS = (0, 64, 192, 512)
_SLOTS1, _SLOTS2, _STATES = 512, 512, 16
_BITS0, _BITS = 20, 28
_EMPTY, _LEAST = 0xFFFF, 64
_EDGE, _LAST, _WHOLE = 1 << 32, (1 << 28) - 1, 1 << 28
LARGEST_ID = 0xFFFE


def prior(symbols: int) -> np.ndarray:
    """Bounds of a fixed falling curve over the ids below `symbols`: each gets 1 of 2**20 at least, the last bound is 2**20."""
    weight = (1 << 30) // (np.arange(symbols, dtype=np.int64) + 128)
    freq = 1 + weight * ((1 << _BITS0) - symbols) // int(weight.sum())
    freq[0] += (1 << _BITS0) - int(freq.sum())
    return np.concatenate([[0], np.cumsum(freq)])


def check_ids(ids: np.ndarray) -> np.ndarray:
    """The ids, if the codec can hold them; ValueError otherwise."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) > LARGEST_ID):
        raise ValueError(f"ids must lie between 0 and {LARGEST_ID}")
    return ids


class _Contexts:
    """The predictions of orders 1 and 2 in all lanes, and what they have learnt; row 0 of each array is order 1's.

    A slot holds an id and above it the confidence state; an empty slot is in state 0 and names an id that cannot come.
    """

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2 = lane * _SLOTS1, lanes * _SLOTS1 + lane * _SLOTS2
        self.states = np.arange(2 * lanes, dtype=np.int64).reshape(2, -1) * _STATES
        self.one, self.two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.slot = np.full(lanes * (_SLOTS1 + _SLOTS2), _EMPTY, np.uint32)
        start = np.minimum(30000 + 2500 * np.arange(_STATES), 62000).astype(np.int32)
        start[0] = _LEAST
        self.hold = np.tile(start, 2 * lanes)
        self.at = np.empty((2, lanes), np.int64)
        self.cell = np.empty((2, lanes), np.int64)

    def predict(self) -> None:
        """Guesses, and where the interval of order 2's and that of either's guess ends (order 2's comes first)."""
        np.add(self.one * np.uint32(40503) >> np.uint32(6) & np.uint32(_SLOTS1 - 1), self.base1, out=self.at[0])
        two = self.one * np.uint32(2654435761)
        two += self.two * np.uint32(2246822519)
        two >>= np.uint32(9)
        np.add(two & np.uint32(_SLOTS2 - 1), self.base2, out=self.at[1])
        held = self.slot.take(self.at, mode="clip")
        self.guess, self.state = held & np.uint32(0xFFFF), held >> np.uint32(16)
        np.add(self.states, self.state, out=self.cell)
        self.p = self.hold.take(self.cell, mode="clip")
        p1, p2 = self.p.view(np.uint32)
        rest = np.uint32(65536) - p2
        rest *= p1
        rest >>= np.uint32(16)
        self.w2 = rest * (self.guess[0] == self.guess[1])
        self.w2 += p2
        self.w2 *= np.uint32(3840)
        rest += p2
        rest *= np.uint32(3840)
        self.w12 = rest.astype(np.int64)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """ids as uint32; hit: where each order was right."""
        p, gain = self.p, hit * np.int32(62000)
        gain -= p
        gain >>= 4
        p += gain
        np.maximum(p, _LEAST, out=p)  # no prediction's interval may vanish
        self.hold[self.cell] = p
        state = self.state
        state *= hit
        state += np.uint32(1)
        np.minimum(state, np.uint32(_STATES - 1), out=state)
        state <<= np.uint32(16)
        state |= ids
        self.slot[self.at] = state
        self.two, self.one = self.one, ids


def _share(steps: int, distinct: np.ndarray) -> np.ndarray:
    """Of 2**16 parts of what order 0 gets, those for each id met, with so many distinct ids among `steps`."""
    return np.minimum((steps << 16) // (steps + distinct.astype(np.int64)), 61440) // steps


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b by doubles, which is faster: exact while a is below 2**49, as then a quotient below an integer is further from it than rounding goes."""
    return np.floor(a / b).astype(np.int64)


class _Counts:
    """Order 0 for the decoder: the ids that the lanes have met, as sorted rows; `past` is steps x lanes."""

    def __init__(self, past: np.ndarray) -> None:
        self.steps = len(past)
        if not self.steps:
            return
        rows = np.array(past.T, np.uint32, order="C")
        rows.sort(axis=1)
        first = np.ones(rows.shape, bool)
        np.not_equal(rows[:, 1:], rows[:, :-1], out=first[:, 1:])
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, first.size))
        self.row, self.last = np.arange(len(rows)) * self.steps, self.steps - 1
        # For each id met its number, how many are smaller and how often it was met: one look-up.
        self.cells = np.repeat(rows.ravel()[heads] | heads % self.steps << 16 | size << 32, size)
        self.share = _share(self.steps, first.sum(1))


#: Of each place in a block: in which counts (fields of 10 bits) it takes part, and where the field of the latest before it begins (63: none).
_PART = sum((np.arange(BLOCK) < e).astype(np.uint32) << np.uint32(10 * k) for k, e in enumerate(EPOCHS[1:]))
_FIELD = np.select([np.arange(BLOCK) >= e for e in EPOCHS[:0:-1]], [10 * k for k in range(len(EPOCHS) - 2, -1, -1)], 63).astype(np.uint64)


class _Ranks:
    """Order 0 for the encoder: for each step and lane how many of the ids met at the last count are smaller, and above 2**16 how many are equal."""

    def __init__(self, grid: np.ndarray) -> None:
        steps, n = grid.shape
        self.ranks = np.zeros((steps, n), np.uint32)
        epochs = [e for e in EPOCHS[1:] if e < steps]
        self.share = {e: np.empty(n, np.int64) for e in epochs}
        place = np.arange(steps, dtype=np.uint32)
        field = np.uint32(1023)
        for a in range(0, n if epochs else 0, 64):
            keys = np.ascontiguousarray(grid[:, a : a + 64].T) << np.uint32(10) | place
            keys.sort(axis=1)
            pos = (keys & field).astype(np.int64)
            keys >>= np.uint32(10)
            first = np.ones(keys.shape, bool)
            np.not_equal(keys[:, 1:], keys[:, :-1], out=first[:, 1:])
            heads = np.flatnonzero(first)
            part = _PART.take(pos)
            upto = np.cumsum(part, axis=1, dtype=np.uint32)
            upto -= part  # in each count, those before this place of the row
            below = upto.ravel()[heads]
            met = np.add.reduceat(part.ravel(), heads)
            both = met.astype(np.uint64) << np.uint64(32) | below
            length = np.diff(np.append(heads, first.size))
            lanes = np.searchsorted(heads, np.arange(len(keys)) * steps)
            for k, e in enumerate(epochs):
                self.share[e][a : a + 64] = _share(e, np.add.reduceat(met >> np.uint32(10 * k) & field > 0, lanes, dtype=np.int64))
            found = np.repeat(both, length)
            found >>= _FIELD.take(pos.ravel())
            found &= np.uint64(1023 << 32 | 1023)
            found |= found >> np.uint64(16)
            pos += np.arange(len(keys))[:, None] * steps
            out = np.empty(first.size, np.uint32)
            out[pos.ravel()] = found.astype(np.uint32)
            self.ranks[:, a : a + 64] = out.reshape(keys.shape).T


def _groups(lanes: int) -> list[tuple[int, int]]:
    count = max(1, round(lanes / LANES))
    edge = [lanes * k // count for k in range(count + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def encode(ids: np.ndarray, symbols: int) -> tuple[list[bytes], list[int]]:
    """The coded blocks of an id sequence (all ids below `symbols`) and their checksums."""
    ids = check_ids(ids)
    lanes = -(-len(ids) // BLOCK)
    low0 = prior(symbols)
    blocks: list[bytes] = []
    for lo, hi in _groups(lanes) if lanes else []:
        part = ids[lo * BLOCK : hi * BLOCK]
        n, tail = hi - lo, len(part) - (hi - lo - 1) * BLOCK
        grid = np.zeros(n * BLOCK, np.uint32)
        grid[: len(part)] = part
        blocks += _encode_lanes(np.ascontiguousarray(grid.reshape(n, BLOCK).T), n, tail, low0)
    sums = [zlib.crc32(ids[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, len(ids), BLOCK)]
    return blocks, sums


def _interval(x: np.ndarray, model: _Contexts, hit: np.ndarray, ranks: np.ndarray, since: int, share: np.ndarray | None, low0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lanes' intervals for the ids x begin, and their widths; order 0 has counted at step `since`."""
    w12 = model.w12
    rest = _WHOLE - w12
    if since:
        unit = rest * share
        unit >>= 16
        begin, width = unit * (ranks & np.uint32(0xFFFF)), unit * (ranks >> np.uint32(16))
        begin += w12
        new = np.flatnonzero(ranks < 65536)
        seen = unit[new] * since
        over, left, ids = w12[new] + seen, rest[new] - seen, x[new]
    else:
        begin, width = np.empty_like(rest), np.empty_like(rest)
        new, over, left, ids = slice(None), w12, rest, x
    base = low0.take(ids) * left >> _BITS0
    begin[new] = over + base
    width[new] = (low0.take(ids + np.uint32(1)) * left >> _BITS0) - base
    at = np.flatnonzero(hit[0] | hit[1])
    w2, two = model.w2[at].astype(np.int64), hit[1][at]
    start = w2 * ~two
    begin[at] = start
    width[at] = np.where(two, w2, w12[at]) - start
    return begin, width


def _encode_lanes(grid: np.ndarray, n: int, tail: int, low0: np.ndarray) -> list[bytes]:
    """The last lane ends after `tail` steps; what it codes after that is cut off."""
    model = _Contexts(n)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64)
    steps = BLOCK if n > 1 else tail
    room = 2 * steps + 12
    digits = np.zeros(room * n, np.uint32)
    place = np.arange(n, dtype=np.int64)  # of each lane's next digit: n apart

    def emit(at: np.ndarray) -> None:
        x = low[at]
        digits[place[at]] = x >> 32
        low[at] = (x & 0xFFFFFFFF) << 16
        span[at] <<= 16
        place[at] += n

    def end(lanes: np.ndarray) -> None:
        for _ in range(3):
            emit(lanes)
        low[lanes], span[lanes] = 0, 1 << 48

    ranks, last, since = _Ranks(grid), np.array([n - 1]), 0
    for t in range(steps):
        if t == tail:
            end(last)
            length = int(place[-1]) // n
        if t in EPOCHS:
            since = t
        model.predict()
        hit = model.guess == grid[t]
        begin, width = _interval(grid[t], model, hit, ranks.ranks[t], since, ranks.share.get(since), low0)
        model.learn(grid[t], hit)
        unit = span >> _BITS
        begin *= unit
        low += begin
        np.multiply(unit, width, out=span)
        # A digit of all lanes at once: where none is due, the next one takes its place.
        due = span < _EDGE
        digit = low >> 32
        digits[place] = digit.astype(np.uint32)
        digit *= due
        digit <<= 32
        low -= digit
        shift = due * np.int64(16)
        low <<= shift
        span <<= shift
        place += due * np.int64(n)
        at = np.flatnonzero(span < _EDGE)
        while len(at):
            emit(at)
            at = at[span[at] < _EDGE]
    end(np.arange(n))
    digits[place] = 0
    used = place // n
    if tail < steps:
        used[-1] = length
    digits = digits[: n * int(used.max())]
    at = np.flatnonzero(digits > 0xFFFF)
    digits &= np.uint32(0xFFFF)
    while len(at):
        at -= n
        digits[at] += np.uint32(1)
        at = at[digits[at] > 0xFFFF]
        digits[at] = 0
    out = np.ascontiguousarray(digits.reshape(-1, n).astype(">u2").T)
    return [out[j, :k].tobytes() for j, k in enumerate(used.tolist())]


def decode(blocks: list[bytes], sums: list[int], total: int, symbols: int) -> np.ndarray:
    """The id sequence of coded blocks; raises ValueError where a block's checksum differs."""
    out = np.empty(total, np.uint16)
    low0 = prior(symbols)
    find = np.repeat(np.arange(symbols, dtype=np.uint16), np.diff(low0))
    for lo, hi in _groups(len(blocks)) if blocks else []:
        a, b = lo * BLOCK, min(hi * BLOCK, total)
        out[a:b] = _decode_lanes(blocks[lo:hi], b - a - (hi - lo - 1) * BLOCK, low0, find)
    for k, s in enumerate(sums):
        if zlib.crc32(out[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != s:
            raise ValueError(f"block {k} is damaged: its checksum differs")
    return out


def _decode_lanes(blocks: list[bytes], tail: int, low0: np.ndarray, find: np.ndarray) -> np.ndarray:
    n = len(blocks)
    model = _Contexts(n)
    size = np.fromiter(map(len, blocks), np.int64, n) // 2
    flat = np.concatenate([np.frombuffer(b"".join(b[: 2 * s] for b, s in zip(blocks, size.tolist(), strict=True)), ">u2").astype(np.uint16), np.zeros(8, np.uint16)])
    place = np.cumsum(size) - size
    code = flat[place].astype(np.int64) << 32 | flat[place + 1].astype(np.int64) << 16 | flat[place + 2]
    place += 3
    span = np.full(n, 1 << 48, np.int64)
    steps = BLOCK if n > 1 else tail
    grid = np.zeros((steps, n), np.uint32)
    counts = _Counts(grid[:0])
    for t in range(steps):
        if t in EPOCHS:
            counts = _Counts(grid[:t])
        model.predict()
        w12, unit = model.w12, span >> _BITS
        value = np.minimum(_quotient(code, unit), _LAST)
        rest, ahead = _WHOLE - w12, value - w12
        seen = np.flatnonzero(ahead < 0)
        if counts.steps:
            one = rest * counts.share
            one >>= 16
            nth = _quotient(ahead, one)
            new = np.flatnonzero(nth > counts.last)
            nth += counts.row
            cell = counts.cells.take(nth, mode="clip")
            x = cell.astype(np.uint16).astype(np.uint32)
            width = cell >> 32
            width *= one
            begin = cell >> 16
            begin &= 0xFFFF
            begin *= one
            begin += w12
            met = one[new] * counts.steps
            over, rest, ahead = w12[new] + met, rest[new] - met, ahead[new] - met
        else:
            x, begin, width = np.empty(n, np.uint32), np.empty(n, np.int64), np.empty(n, np.int64)
            new = np.flatnonzero(ahead >= 0)
            over, rest, ahead = w12[new], rest[new], ahead[new]
        if len(new):
            z = find.take(_quotient((ahead + 1 << _BITS0) - 1, rest), mode="clip")
            base = low0.take(z) * rest >> _BITS0
            x[new] = z
            begin[new] = over + base
            width[new] = (low0.take(z + np.uint16(1)) * rest >> _BITS0) - base
        w2 = model.w2[seen].astype(np.int64)
        two = value[seen] < w2
        x[seen] = np.where(two, model.guess[1][seen], model.guess[0][seen])
        start = w2 * ~two
        begin[seen] = start
        width[seen] = np.where(two, w2, w12[seen]) - start
        begin *= unit
        code -= begin
        np.multiply(unit, width, out=span)
        np.minimum(code, span, out=code)  # a damaged block may be beyond its interval
        due = span < _EDGE
        shift = due * np.int64(16)
        code <<= shift
        span <<= shift
        code |= flat.take(place, mode="clip") * due
        place += due
        at = np.flatnonzero(span < _EDGE)
        while len(at):
            code[at] = code[at] << 16 | flat.take(place[at], mode="clip")
            span[at] <<= 16
            place[at] += 1
            at = at[span[at] < _EDGE]
        grid[t] = x
        model.learn(x, model.guess == x)
    return grid.T.reshape(-1)[: (n - 1) * BLOCK + tail] if n > 1 else grid[:tail, 0]
