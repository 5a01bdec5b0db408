"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Centroids are fitted on a bounded sample; every vector has its nearest
centroid's cell as home.  A vector also visits each cell whose border is at most
r/2 away, where r = sqrt(2 - 2 * threshold) is the largest distance of two
linked unit vectors: of two linked vectors with different homes, one lies
within r/2 of the plane between them.  So a link is either between two rows of
a home or between a visitor and a row of the home, and none is lost (recall 1,
see tests).

Equal vectors of a label are one vector with a weight from the start (told apart
by two 64-bit hashes of their numbers), so a million copies are compared once.
Cells (within a label) are cut into blocks of vectors; each pair of blocks is
one group, compared by a matrix product.  A group returns per vector the
weight of its links and a spanning forest of them, never all pairs, so a cell
that holds a third of all vectors becomes many groups of bounded size.
Components of the forests are found by star contraction, and one representative
of each group (the smallest id) is kept.

Labels may be of any type and are compared as they are.  Vectors are divided by
their largest component before they are squared, so their magnitude does not
matter.

Results in odd cases: vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null label, link with nothing and are
kept as their own component; vectors of different lengths never link.  Rows
that repeat an id are rows of their own: they count as vectors linked with each
other, and share the component.  Null ids: such rows link with nothing, and
their component is null and kept is true.  An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FractionalType, MapType, StructType

from harfmill.llm.components import components
from harfmill.llm.shared import Workspace

_OUT = "kind int, a long, b long, n long"
_ROWS = 2048  # rows that meet all centroids at a time


def unit_rows(vectors: list[np.ndarray] | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # of any magnitude: squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[k : k + _ROWS] @ centre.T, axis=1) for k in range(0, len(x), _ROWS)])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; starts from a fixed random choice of rows."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = _nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(1))
        centre = np.where(norm[:, None] > 0, total / np.where(norm, norm, 1)[:, None], centre)
    return np.unique(centre, axis=0)


def _margins(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row, and its distance to the border of each other cell."""
    score = x @ centre.T
    home = np.argmax(score, axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (centre[home] @ centre.T), 1e-12))
    return home, (score[np.arange(len(x)), home][:, None] - score) / gap


def _cells(batches, centres: dict[int, np.ndarray], reach: float):
    """Each vector once for its home and once for each visited cell; `seen` lists them all."""
    for whole in batches:
        for lo in range(0, whole.num_rows, _ROWS):
            yield _placed(whole.slice(lo, _ROWS), centres, reach)


def _placed(batch: pa.RecordBatch, centres: dict[int, np.ndarray], reach: float) -> pa.RecordBatch:
    vec = batch.column("vec")
    offsets = vec.offsets.to_numpy()
    size, edge = np.diff(offsets), offsets - offsets[0]
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at, home_of, cell_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        centre = centres.get(int(d))
        home, near = np.zeros(len(rows), np.int64), np.ones((len(rows), 1), bool)
        if centre is not None:
            home, margin = _margins(unit_rows(flat[edge[rows][:, None] + np.arange(d)]), centre)
            near = margin <= reach + 1e-9
        r, c = np.nonzero(near)
        at.append(rows[r])
        home_of.append(home[r])
        cell_of.append(c)
    at, home, cell = (np.concatenate(v) for v in (at, home_of, cell_of))
    order = np.argsort(at, kind="stable")
    at, home, cell = at[order], home[order], cell[order]
    visits = np.bincount(at, minlength=batch.num_rows)
    seen = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(visits)]), pa.int32()), pa.array(cell, pa.int32()))
    index = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(index) for c in ("row", "weight", "label")), pa.array(size[at], pa.int32()), pa.array(home, pa.int32()), pa.array(cell, pa.int32()), seen.take(index), vec.take(index)],
        ["row", "weight", "label", "dim", "home", "cell", "seen", "vec"],
    )


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indexes of edges that make a spanning forest."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    picked = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            picked.append(k)
    return np.asarray(picked, np.int64)


def _thin(n: int, link: np.ndarray, offset: int) -> np.ndarray:
    """A spanning forest of a boolean matrix between rows 0.. and columns offset.. ."""
    a, b = np.nonzero(link)
    if len(a) > 4 * n:  # contract many links at once: every row points to the smallest row it reaches
        root = np.arange(n)
        while True:
            low = root.copy()
            np.minimum.at(low, root[a], root[b + offset])
            np.minimum.at(low, root[b + offset], root[a])
            new = low[root]
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        moved = np.flatnonzero(root != np.arange(n))
        return np.stack([moved, root[moved]])
    keep = _forest(n, a, b + offset)
    return np.stack([a[keep], b[keep] + offset])


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links between two blocks of a cell (or within one): their weight per row (kind 0) and a forest (kind 1)."""
    side = table.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    table, side = table.take(pa.array(order)), side[order]
    row, weight, home, cell = (table.column(c).to_numpy() for c in ("row", "weight", "home", "cell"))
    weight = weight.astype(np.float64)  # exact up to 2**53 vectors
    d = int(table.column("dim")[0].as_py())
    x = unit_rows(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
    one_block = bool(table.column("one")[0].as_py())
    split = len(row) if one_block else int((side == 0).sum())
    first = np.arange(split)
    second = np.arange(split) if one_block else np.arange(split, len(row))
    guests = len(second) and home[second[0]] != cell[second[0]]
    if guests:  # the cells that each row is in, as sorted pairs
        seen = table.column("seen").combine_chunks()
        visits = np.diff(seen.offsets.to_numpy())
        pairs = np.sort(np.repeat(np.arange(len(row)), visits) << 32 | seen.flatten().to_numpy().astype(np.int64))
    counts, edges = np.zeros(len(row)), [np.empty((2, 0), np.int64)]
    for lo in range(0, len(first), 512):
        part = first[lo : lo + 512]
        link = x[part] @ x[second].T >= threshold
        if one_block:
            link &= second[None] > part[:, None]
        if guests:  # two rows that visit each other's homes meet twice; the home with the smaller number counts
            a, b = np.nonzero(link)
            g = home[second[b]]
            wanted = part[a] << 32 | g.astype(np.int64)
            again = pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted
            drop = again & (home[part[a]] > g)
            link[a[drop], b[drop]] = False
        if link.any():
            counts[part] += link @ weight[second]
            counts[second] += weight[part] @ link
            both = np.concatenate([part, second])
            edges.append(row[both[_thin(len(both), link, len(part))]])
    hit, e = np.flatnonzero(counts), np.concatenate(edges, axis=1)
    return pa.table(
        {
            "kind": pa.array(np.concatenate([np.zeros(len(hit), np.int32), np.ones(e.shape[1], np.int32)])),
            "a": pa.array(np.concatenate([row[hit], e[0]]).astype(np.int64)),
            "b": pa.array(np.concatenate([row[hit], e[1]]).astype(np.int64)),
            "n": pa.array(np.concatenate([counts[hit].astype(np.int64), np.zeros(e.shape[1], np.int64)])),
        }
    )


def valid_vectors(frame: DataFrame) -> DataFrame:
    """Rows whose vec (array of double) is neither null nor empty and holds only finite numbers."""
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return frame.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.coalesce(good, F.lit(False)))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    block: int = 512,
    cell_rows: int = 2048,
    max_cells: int = 4096,
    fit_rows: int = 40_960,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each input row.

    `fit_rows` bounds the sample that the centroids are fitted on; there are as
    many cells as make `cell_rows` rows a cell and label, `max_cells` at most
    (a fixed bound: the centroids are sent to every task).
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "sphere")
    reach = math.sqrt(2 - 2 * threshold) / 2
    kind = vectors.schema[label_column].dataType
    label = F.col(label_column) + F.lit(0).cast(kind) if isinstance(kind, FractionalType) else F.col(label_column)  # -0.0 is 0.0
    raw = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        (F.to_json(F.struct(label.alias("l"))) if isinstance(kind, (ArrayType, MapType, StructType)) else label.cast("string")).alias("label"),
        F.col(vector_column).cast("array<double>").alias("vec"),
    )
    sums = [F.xxhash64(*seed, F.transform("vec", lambda v: v + F.lit(0.0))) for seed in ((), (F.lit(77),))]
    flat = space.save(raw.select("*", sums[0].alias("h"), sums[1].alias("h2")), "rows")
    usable = valid_vectors(flat.where("id is not null and label is not null")).where(F.exists("vec", lambda v: v != 0))
    same = ["label", "h", "h2"]
    live = space.save(usable.groupBy(*same).agg(F.min(F.struct("row", "vec")).alias("m"), F.count(F.lit(1)).alias("weight")).select(*same, "m.row", "weight", "m.vec"), "live")
    total, labels = live.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    centres: dict[int, np.ndarray] = {}
    cells = min(max_cells, math.ceil(total / (cell_rows * max(labels, 1))))
    if cells > 1:
        sample = live.select("vec", "row").orderBy(F.xxhash64("row")).limit(fit_rows).select("vec").toArrow().column("vec").combine_chunks()
        size, values = np.diff(sample.offsets.to_numpy()), sample.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        by_size = {int(d): values[start[size == d][:, None] + np.arange(d)] for d in np.unique(size)}
        centres = {d: spherical_kmeans(unit_rows(v), cells) for d, v in by_size.items() if len(v) >= 10 * cells}
    sent = spark.sparkContext.broadcast(centres)
    placed = live.select("row", "weight", "label", "vec").mapInArrow(lambda it: _cells(it, sent.value, reach), "row long, weight long, label string, dim int, home int, cell int, seen array<int>, vec array<double>")
    placed = space.save(placed, "placed")
    keys = ["label", "dim", "cell"]
    sizes = placed.where("home = cell").groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # A home row meets its own block and each later one, and is met by each earlier one; a visitor meets every block.
    dealt = placed.join(sizes, keys).withColumn("mine", F.when(F.col("home") == F.col("cell"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")))
    seq = F.sequence(F.lit(0), F.col("blocks") - 1)
    guest_block = F.pmod(F.xxhash64("row", F.lit(1)), F.col("guest_blocks")).cast("int")
    guests = placed.where("home <> cell").groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("guest_blocks"))
    homes = dealt.where("home = cell")
    fields = [*keys, "row", "weight", "home", "seen", "vec"]
    within = homes.select(*fields, F.explode(seq).alias("other"), "mine").select(
        *fields, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") == F.col("other")).alias("one")
    )
    visited = homes.join(guests, keys).select(*fields, F.col("mine").alias("x"), F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("g")).select(
        *fields, "x", (-1 - F.col("g")).alias("y"), F.lit(0).alias("side"), F.lit(False).alias("one")
    )
    visitors = dealt.where("home <> cell").join(guests, keys).select(*fields, F.explode(seq).alias("x"), guest_block.alias("g")).select(
        *fields, "x", (-1 - F.col("g")).alias("y"), F.lit(1).alias("side"), F.lit(False).alias("one")
    )
    groups = within.unionByName(visited).unionByName(visitors)
    found = space.save(groups.groupBy(*keys, "x", "y").applyInArrow(lambda t: _compare(t, threshold), _OUT), "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links"))
    parts = components(space, found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "row")
    # A row's vector, and of that what its copies share; saved, so that the joins below may split a vector with many copies.
    shared = live.select(*same, "row", "weight").join(parts, "row", "left").join(counts, "row", "left")
    shared = space.save(shared.select(*same, F.coalesce("component", "row").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "shared")
    rows = space.save(usable.select("row", "id", *same).join(shared, same).select("row", "id", "component", "n_links"), "linked")
    least = space.save(rows.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    placed_rows = rows.join(least, "component").select("row", "component_id", "n_links")
    out = flat.select("row", "id").join(placed_rows, "row", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    result = space.save(
        out.select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.col("component_id"),
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        ),
        "result",
    )
    space.close("result")
    return result
