"""The token codec's work: its cost against bare table look-ups, and order 0 and damaged blocks by definition."""

import time

import numpy as np
import pytest

from harfmill.llm import mixcoder


def _bare(grid):
    """Four look-ups and stores of all lanes a step, and nothing else."""
    steps, lanes = grid.shape
    table, lane = np.zeros(lanes * steps, np.uint32), np.arange(lanes) * steps
    for row in grid:
        at = lane + row % steps
        for k in range(4):
            held = table.take(at, mode="clip")
            held += np.uint32(k)
            table[at] = held


def _seconds(work):
    began = time.process_time()
    work()
    return time.process_time() - began


def test_codec_cost():
    """Coding and decoding together cost less than 8.5 times the bare look-ups (over 9 while digits were put out lane by lane)."""
    ids = np.random.default_rng(5).zipf(1.2, 5888 * mixcoder.BLOCK) % 49_000
    grid = np.ascontiguousarray(ids.reshape(-1, mixcoder.BLOCK).T)

    def there_and_back():
        blocks, sums = mixcoder.encode(ids, 49_000)
        mixcoder.decode(blocks, sums, len(ids), 49_000)

    bare, coded = [], []
    for _ in range(5):
        bare.append(_seconds(lambda: _bare(grid)))
        coded.append(_seconds(there_and_back))
        if min(coded) < 8.5 * min(bare):
            return
    raise AssertionError(f"{min(coded) / min(bare):.1f} times the bare look-ups")


def test_order_0_by_definition():
    grid = (np.random.default_rng(2).zipf(1.4, (700, 131)) % 300).astype(np.uint32)
    found = mixcoder._Ranks(grid)
    for lane in (0, 63, 64, 130):
        for t in range(700):
            since = max(e for e in mixcoder.EPOCHS if e <= t)
            met = grid[:since, lane]
            assert found.ranks[t, lane] == (met < grid[t, lane]).sum() | (met == grid[t, lane]).sum() << 16
        for e in mixcoder.EPOCHS[1:]:
            assert found.share[e][lane] == mixcoder._share(e, np.array([len(set(grid[:e, lane].tolist()))]))[0]


def test_damaged_blocks():
    """Any bytes decode within bounds, and the checksum tells."""
    r = np.random.default_rng(3)
    ids = r.zipf(1.3, 5000) % 49_000
    blocks, sums = mixcoder.encode(ids, 49_000)
    for _ in range(20):
        with pytest.raises(ValueError):
            mixcoder.decode([r.integers(0, 256, len(b), np.uint8).tobytes() for b in blocks], sums, len(ids), 49_000)
