"""Exact top-k inner products from an impact-ordered index, score at a time.

Components are integers, floor(scale * x).  Candidates with equal vectors are
one entry with the ids that can matter: the k + 1 smallest, each with up to k of
its rows.  The entries are cut into blocks, and each block is indexed once and
stored: for each level of the components' magnitude a posting segment of the
(entry, dimension, sign) triples whose quantised magnitude is that level, with
the norms of what the segments so far leave of each entry where the level is a
power of two; and the entries themselves, for rescoring.

A group of queries meets a block's index and adds up its segments by descending
impact.  After a segment the true score of an entry differs from its accumulated
score by at most |query| * |what is left of the entry| (Cauchy-Schwarz).  Once
little is left, entries whose upper bound lies below the k-th largest lower
bound are out, by proof; while too many stay in, further segments are added.
What stays in is rescored exactly, in integers.  Query groups and indexed
blocks meet as a grid of bounded groups, so neither side is broadcast.

Results in odd cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id; vectors of different
lengths don't meet.  Candidates with the query's id are the query itself.
Where an id repeats among the queries, its smallest vector is the query; each
repeated candidate row is a candidate.  Ties go to the smaller id.  Queries
without candidates have no rows.  Components beyond 2**30 after scaling raise.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harfmill.llm.bytesops import expand, ragged, squeeze, trim
from harfmill.llm.shared import Workspace, release
from harfmill.llm.sphere_dedup import valid_vectors

_OUT = "query_id long, vec_id long, score long"
_INDEX = "dim int, cb int, level int, impact long, n long, payload binary"
_QUERIES = "dim int, qb int, asked int, packed binary"
LEVELS = 64
_LARGEST = 1 << 30


class Segment(NamedTuple):
    """Postings of one impact: rows, dimensions and signs, and the norms of all rows' rest after it."""

    impact: int
    row: np.ndarray
    dim: np.ndarray
    sign: np.ndarray
    norm: np.ndarray


def segments(x: np.ndarray, levels: int = LEVELS) -> list[Segment]:
    """The posting segments of a block by descending impact.  Level 0, whose quantised impact is zero, needs none."""
    size = np.abs(x)
    step = 1 << max(0, int(size.max(initial=0)).bit_length() - levels.bit_length() + 1)
    level, rest, out = size // step, x.astype(np.float64), []
    for k in range(int(level.max(initial=0)), 0, -1):
        row, dim = np.nonzero(level == k)
        sign = np.sign(x[row, dim]).astype(np.int8)
        rest[row, dim] -= sign * float(k * step)
        out.append(Segment(k * step, row.astype(np.int32), dim.astype(np.int32), sign, np.sqrt((rest * rest).sum(1))))
    return out


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """A number that at least k places of each row reach: nearly the k-th largest, from the largest of groups of columns where there are many."""
    n = x.shape[1]
    if n <= k:
        return np.full(len(x), -np.inf, x.dtype)
    wide = max(256, 16 * k)
    if n >= 4 * wide:
        x = x[:, : n // wide * wide].reshape(len(x), n // wide, wide).max(1)
    m = x.shape[1]
    return np.partition(x, m - k, axis=1)[:, m - k]


def block_top(
    q_id: np.ndarray,
    q: np.ndarray,
    c_id: np.ndarray,
    c: np.ndarray,
    parts: list[Segment],
    k: int,
    few: int = 4,
    second: np.ndarray | None = None,
    shared: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best entries of one indexed block: query positions, entry positions, scores.

    `c_id` is each entry's smallest id, `second` its next one where `shared`; an entry of the query's id alone is no candidate.
    """
    n, d = c.shape
    size = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    limit = d * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0))
    kind = np.float32 if limit < 2**23 else np.float64  # sums are exact below the mantissa
    length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    error = 4 * (d + 4) * np.finfo(kind).eps * length * size.max(initial=0) + 1e-3
    slack = 1 + 1e-6
    order = np.argsort(c_id, kind="stable")
    begin, end = (np.searchsorted(c_id[order], q_id, side) for side in ("left", "right"))
    own_row, own_col = np.repeat(np.arange(len(q)), end - begin), order[ragged(begin, end - begin)]
    if shared is not None:
        own_row, own_col = own_row[~shared[own_col]], own_col[~shared[own_col]]
    weight = np.column_stack([q, -length * slack]).astype(kind)
    filled = np.zeros((n, d + 1), kind)
    row, col = np.divmod(np.setdiff1d(np.arange(len(q) * n), own_row * n + own_col), n) if not parts else (own_row[:0], own_col[:0])
    for number, part in enumerate(parts):
        filled[part.row, part.dim] = part.sign * kind(part.impact)
        last = number == len(parts) - 1
        if not last and (not len(part.norm) or part.norm.max() > size.mean() / 12):
            continue
        rest = part.norm.astype(np.float64) * slack + 1e-3
        filled[:, d] = rest
        low = weight @ filled.T  # the lower bounds
        low[own_row, own_col] = -np.inf
        least = _kth_largest(low, k) - error
        row, col = np.divmod(np.flatnonzero(low >= (least - 2 * slack * length * rest.max())[:, None].astype(kind)), n)
        reach = low[row, col]
        stay = (reach + 2 * slack * length[row] * rest[col] + error[row] >= least[row]) & (reach > -np.inf)
        row, col = row[stay], col[stay]
        if last or len(row) <= max(few * k * len(q), len(q) * n // 16):
            break
    whole = kind if limit < 2**52 else np.int64
    a, b = q.astype(whole), c.astype(whole)
    exact = np.concatenate([np.einsum("ij,ij->i", a[row[at : at + 65536]], b[col[at : at + 65536]]).astype(np.int64) for at in range(0, len(row), 65536)] or [np.empty(0, np.int64)])
    ids = c_id[col] if second is None else np.where(c_id[col] == q_id[row], second[col], c_id[col])
    order = np.lexsort((ids, -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep], exact[keep]


def _matrix(table: pa.Table) -> np.ndarray:
    d = int(table.column("dim")[0].as_py())
    x = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if len(x) and max(-int(x.min()), int(x.max())) > _LARGEST:
        raise ValueError("components beyond 2**30 after scaling")
    return x


def _packed(table: pa.Table) -> pa.Table:
    """A group of queries as one value: ids and vectors."""
    ids, x = table.column("id").to_numpy(), _matrix(table)
    where = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "qb")}
    return pa.table(where | {"asked": pa.array([len(ids)], pa.int32()), "packed": pa.array([squeeze(ids.astype(np.int64), x.astype(np.int32))], pa.binary())})


def _index(table: pa.Table) -> pa.Table:
    """The stored index of one block: a row for each segment, and one (level 0) with ids, their rows and vectors."""
    x, ids = _matrix(table), table.column("ids").combine_chunks()
    n, out, flat = len(x), [], ids.flatten()
    many = np.diff(ids.offsets.to_numpy()).astype(np.int32)
    out.append((0, 0, n, squeeze(many, x.astype(np.int32), flat.field("id").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int32))))
    parts = segments(x)
    for level, s in enumerate(parts, 1):
        nth = s.impact // parts[-1].impact
        norm = np.nextafter(s.norm.astype(np.float32), np.float32(np.inf)) if nth & (nth - 1) == 0 else s.norm[:0].astype(np.float32)
        out.append((level, s.impact, len(s.row), squeeze(s.row, s.dim, s.sign, norm)))
    level, impact, size, payload = zip(*out, strict=True)
    where = {c: pa.array([table.column(c)[0].as_py()] * len(out), pa.int32()) for c in ("dim", "cb")}
    return pa.table(where | {"level": pa.array(level, pa.int32()), "impact": pa.array(impact, pa.int64()), "n": pa.array(size, pa.int64()), "payload": pa.array(payload, pa.binary())})


class _Block(NamedTuple):
    """Entries: how many ids each has, vectors, all ids and how many rows each stands for; and the segments."""

    many: np.ndarray
    x: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    parts: list[Segment]


def _opened(index: pa.Table) -> _Block:
    d = int(index.column("dim")[0].as_py())
    level, impact, size, payload = (index.sort_by("level").column(c).to_pylist() for c in ("level", "impact", "n", "payload"))
    n, raw, parts = size[0], expand(payload[0]), []
    many = np.frombuffer(raw, np.int32, n)
    x, total, at = np.frombuffer(raw, np.int32, n * d, 4 * n).reshape(n, d), int(many.sum()), 4 * n * (d + 1)
    ids, rows = np.frombuffer(raw, np.int64, total, at), np.frombuffer(raw, np.int32, total, at + 8 * total)
    for w, m, blob in zip(impact[1:], size[1:], payload[1:], strict=True):
        raw = expand(blob)
        parts.append(Segment(w, np.frombuffer(raw, np.int32, m), np.frombuffer(raw, np.int32, m, 4 * m), np.frombuffer(raw, np.int8, m, 8 * m), np.frombuffer(raw, np.float32, offset=9 * m)))
    return _Block(many, x, ids, rows, parts)


def _search(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = [(np.empty(0, np.int64),) * 3]
    if index.num_rows and queries.num_rows:
        block = _opened(index)
        start = np.cumsum(block.many) - block.many
        shared = block.many > 1
        first, second = block.ids[start], block.ids[start + shared]
        d = block.x.shape[1]
        n, raw = queries.column("asked")[0].as_py(), expand(queries.column("packed")[0].as_py())
        q_id, q = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int32, n * d, 8 * n).reshape(n, d)
        for lo in range(0, n, 512):
            a, b, s = block_top(q_id[lo : lo + 512], q[lo : lo + 512], first, block.x, block.parts, k, second=second, shared=shared)
            # An entry's rows, without the query's own.
            at = ragged(start[b], block.many[b])
            a, s = np.repeat(q_id[lo + a], block.many[b]), np.repeat(s, block.many[b])
            other = block.ids[at] != a
            at, a, s = at[other], a[other], s[other]
            order = np.lexsort((block.ids[at], -s, a))
            times = block.rows[at[order]]
            at, a, s = np.repeat(at[order], times), np.repeat(a[order], times), np.repeat(s[order], times)
            head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
            keep = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a)))) < k
            out.append((a[keep], block.ids[at[keep]], s[keep]))
        trim()
    return pa.table({name: pa.array(np.concatenate(x), pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    scale: int = 256,
    query_block: int = 8192,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows.

    `is_query` is a condition on the column `id`.  Blocks hold 2,048 to 16,384
    distinct vectors, a 32nd of them where that lies between.
    """
    space = Workspace(vectors.sparkSession, "impact")
    raw = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"))
    whole = F.transform("vec", lambda v: F.least(F.greatest(F.floor(F.lit(float(scale)) * v), F.lit(-_LARGEST - 1)), F.lit(_LARGEST + 1)).cast("int"))
    rows = space.save(valid_vectors(raw.where("id is not null")).select("id", whole.alias("vec"), F.size("vec").alias("dim")), "rows")
    query_blocks = math.ceil(rows.where(is_query).select("id").distinct().count() / query_block) or 1
    queries = rows.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("id", "v.*")
    queries = queries.select("id", "dim", "vec", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("qb"))
    packed = space.save(queries.groupBy("dim", "qb").applyInArrow(_packed, _QUERIES), "queries")
    # Equal vectors are one entry; the hash comes first so that sorting seldom compares vectors.
    entry = ["h", "dim", "vec"]
    counted = rows.withColumn("h", F.xxhash64("vec")).groupBy(*entry, "id").agg(F.count(F.lit(1)).alias("n"))
    smallest = counted.withColumn("nth", F.row_number().over(Window.partitionBy(*entry).orderBy("id"))).where(F.col("nth") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("id", F.least("n", F.lit(k)).cast("int").alias("n")))).alias("ids")
    entries = space.save(smallest.groupBy(*entry).agg(ids).select("h", "dim", "vec", "ids"), "entries")
    space.drop("rows")
    total = entries.count()
    candidate_blocks = math.ceil(total / min(16384, max(2048, total // 32))) or 1
    block = F.pmod(F.xxhash64("h"), F.lit(candidate_blocks)).cast("int")
    index = space.save(entries.select("dim", "vec", "ids", block.alias("cb")).groupBy("dim", "cb").applyInArrow(_index, _INDEX), "index")
    space.drop("entries")
    release(space.spark)
    queries = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("cb"))
    asked_for = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    grid = ["dim", "qb", "cb"]
    tasks = min(4096, 2 * candidate_blocks * query_blocks)  # tasks by work: the blocks are small in bytes
    dealt = [x.repartition(tasks, *grid).groupBy(*grid) for x in (asked_for, queries)]
    best = dealt[0].cogroup(dealt[1]).applyInArrow(lambda i, q: _search(i, q, k), _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = space.save(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "result")
    space.close("result")
    return out
