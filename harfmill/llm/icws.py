"""MinHash near-duplicates: consistent weighted sampling over TF-IDF shingles.

Words are runs without ASCII white space, in lower case; shingles are five
words in a row.  A shingle's weight is its count in the document times
1 + ln(N / df) / (4 ln(N)), between 1 (in every document) and 1.25 (in one), with the
exact document frequency df over all N documents.  Documents are linked if
their weighted Jaccard similarity, sum of minima over sum of maxima, is 0.8 or
more; classes are the connected components of the links.

Steps, none of which collects anything or emits the pairs of a group:

1. Batches of documents send their distinct shingles with counts; buckets add
   them up and answer with the df of those that other batches have too.
2. Each document draws improved consistent weighted samples (Ioffe, 2010):
   `bands` x `rows` (8 x 3) samples; equal similarity-0.8 pairs share a band
   with probability above 0.996.  The variates come from a table of 2**18
   pre-drawn (r, c, beta) triples addressed by a multiplicative hash of the
   shingle, one multiplier per sample.
3. Documents with the same word sequence collapse into one member.  In each
   band bucket every member is verified against the smallest one; linked
   members join its component.  Where more than a block of them is left
   outside, the smallest of these is verified against all others.  Members
   that are then left in another component are verified against all members
   of the bucket outside their own, in blocks.  So every pair that shares a bucket is either in one
   component already or verified: there is no cap on bucket sizes.
4. Verification is exact: the shingle weights of the documents concerned are
   recomputed from the stored texts and dealt to the comparing groups.

Results in odd cases: null and empty texts, and texts without words, link with
nothing (each is a class of its own); a text of one to four words has one
shingle, all its words; rows with null ids take part, a class without any id
has a null class_id; of rows with one id each is a row of its own; an empty
table gives an empty table.  Texts are used whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfmill.llm.bytesops import CHUNK, POLY, U64, doc_chunks, expand, lower, mix, ragged, squeeze, string_bytes, trim, words
from harfmill.llm.components import components
from harfmill.llm.shared import TextBatches, Workspace, release

WIDTH = 5
TABLE_BITS = 18
#: How much rarity may add to a weight.  Small, as copies make the shingles that they share frequent: with plain TF-IDF the
#: members of a large group of near copies rate each other by what they do not share.  Of the pairs of different texts of sf0.1
#: whose plain Jaccard similarity is 0.8 or more (48), 46 are links with a share of 0.25, 34 with 1 and 32 by plain TF-IDF.
IDF_SHARE = 0.25
MESSAGE = "batch int, bucket int, n long, payload binary"


class _Shingles:
    """The distinct shingles of each document of a batch, as sorted 48-bit fingerprints with counts."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("row")
        self.row = table.column("row").to_numpy()
        data, off = string_bytes(table.column("text"))
        prints, sizes, same = [], [], [[], []]
        for lo, hi in doc_chunks(off, CHUNK):
            part, edge = lower(data[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo]
            start, end = words(part, edge)
            word = mix(POLY[0].span(POLY[0].prefix(part), start, end))
            edge = np.searchsorted(start, edge)
            count = np.diff(edge)
            prefix = [p.prefix(word) for p in POLY]
            for k in (0, 1):
                same[k].append(POLY[k].span(prefix[k], edge[:-1], edge[1:]))
            n = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
            first = ragged(edge[:-1], n)
            last = np.minimum(first + WIDTH, np.repeat(edge[1:], n))
            prints.append(mix(POLY[1].span(prefix[1], first, last)) >> U64(16))
            sizes.append(n)
        size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        prints = np.concatenate(prints) if prints else np.empty(0, U64)
        edge = np.concatenate([[0], np.cumsum(size)])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            prints[a:b].sort()
        first = np.ones(len(prints), bool)
        first[1:] = prints[1:] != prints[:-1]
        first[edge[:-1][size > 0]] = True
        heads = np.flatnonzero(first)
        self.prints = prints[heads]
        self.tf = np.diff(np.append(heads, len(prints)))
        self.edge = np.searchsorted(heads, edge)
        self.same = [mix(np.concatenate(s)).view(np.int64) if s else np.empty(0, np.int64) for s in same]
        #: Distinct shingles of the batch, the documents of each, and where each document's shingles are among them.
        order = np.argsort(self.prints)
        s = self.prints[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.unique = s[new]
        self.place = np.empty(len(s), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.df = np.diff(np.append(np.flatnonzero(new), len(s)))

    def slices(self, buckets: int):
        bucket = ((self.unique * U64(buckets)) >> U64(48)).astype(np.int64)
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            yield int(b), int(edge[b]), int(edge[b + 1])

    def weights(self, messages: dict[int, bytes], buckets: int, total: int) -> np.ndarray:
        """The weight of each shingle of each document."""
        df = self.df.astype(np.float64)
        for b, lo, hi in self.slices(buckets):
            raw = expand(messages[b])
            bits = (hi - lo + 7) // 8
            more = np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=hi - lo).astype(bool)
            df[lo:hi][more] = np.frombuffer(raw, np.uint32, offset=bits)
        return self.tf * (1 + IDF_SHARE * np.log(total / df) / math.log(max(total, 2)))[self.place]


def _messages(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table({"batch": pa.array(columns[0], pa.int32()), "bucket": pa.array(columns[1], pa.int32()), "n": pa.array(columns[2], pa.int64()), "payload": pa.array(columns[3], pa.binary())})


def _count(table: pa.Table, buckets: int) -> pa.Table:
    s, batch = _Shingles(table), table.column("batch")[0].as_py()
    out = []
    for b, lo, hi in s.slices(buckets):
        keys = s.unique[lo:hi]
        out.append((batch, b, hi - lo, squeeze((keys & U64(0xFFFFFFFF)).astype(np.uint32), s.df[lo:hi].astype(np.uint32), (keys >> U64(32)).astype(np.uint16))))
    return _messages(out)


def _add_up(table: pa.Table) -> pa.Table:
    """Per batch of a bucket: a bit for each shingle that other batches have too, and those shingles' df."""
    batch, n = table.column("batch").to_pylist(), table.column("n").to_pylist()
    keys, counts = [], []
    for size, payload in zip(n, table.column("payload").to_pylist(), strict=True):
        raw = expand(payload)
        keys.append(np.frombuffer(raw, np.uint32, size).astype(U64) | np.frombuffer(raw, np.uint16, size, 8 * size).astype(U64) << U64(32))
        counts.append(np.frombuffer(raw, np.uint32, size, 4 * size))
    key, own = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key)
    s = key[order]
    heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(np.add.reduceat(own[order], heads), np.diff(np.append(heads, len(s))))
    more, edge = total > own, np.concatenate([[0], np.cumsum(n)])
    out = []
    for k, b in enumerate(table.column("bucket").to_pylist()):
        part = slice(edge[k], edge[k + 1])
        out.append((batch[k], b, n[k], squeeze(np.packbits(more[part]), total[part][more[part]].astype(np.uint32))))
    return _messages(out)


def sample_table(seed: int = 11) -> np.ndarray:
    """Pre-drawn variates: r and c from Gamma(2, 1), beta uniform; rows are r, 1 / r, beta, ln c."""
    rng = np.random.default_rng(seed)
    size = 1 << TABLE_BITS
    r, c = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size)
    return np.stack([r, 1 / r, rng.random(size), np.log(c)], axis=1).astype(np.float32)


def multipliers(count: int, seed: int = 13) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * U64(2) + U64(1)


_VARIATES: list[np.ndarray] = []


def weighted_samples(prints: np.ndarray, weights: np.ndarray, edge: np.ndarray, count: int) -> np.ndarray:
    """`count` consistent weighted samples of each set (all sets non-empty): sets x count, 64-bit."""
    if not _VARIATES:
        _VARIATES.append(sample_table())
    variates = _VARIATES[0]
    size = np.diff(edge)
    log = np.log(weights).astype(np.float32)
    owner = np.repeat(np.arange(len(size)), size)
    out = np.empty((len(size), count), U64)
    for k, factor in enumerate(multipliers(count)):
        v = variates.take((prints * factor >> U64(64 - TABLE_BITS)).astype(np.int64), axis=0)
        step = np.floor(log * v[:, 1] + v[:, 2])
        rank = v[:, 3] - v[:, 0] * (step - v[:, 2] + 1)
        hit = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, edge[:-1]), size))
        of = owner[hit]
        hit = hit[np.concatenate([[True], of[1:] != of[:-1]])]
        out[:, k] = mix(prints[hit] * U64(0x9E3779B97F4A7C15) + step[hit].astype(np.int64).view(U64))
    return out


def _sign(table: pa.Table, messages: pa.Table, buckets: int, total: int, bands: int, rows: int) -> pa.Table:
    """row, two hashes of the word sequence, the number of distinct shingles, and the band keys (none without words)."""
    s = _Shingles(table) if table.num_rows else None
    if s is None:
        return pa.table({**{c: pa.array([], pa.int64()) for c in ("row", "same", "same2", "size")}, "bands": pa.array([], pa.list_(pa.int64()))})
    weight = s.weights(dict(zip(messages.column("bucket").to_pylist(), messages.column("payload").to_pylist(), strict=True)), buckets, total)
    keys = np.zeros((len(s.row), bands), np.int64)
    full = np.diff(s.edge) > 0
    where = np.flatnonzero(full)
    parts = np.concatenate([[0], np.cumsum(np.diff(s.edge)[full])])
    for lo, hi in doc_chunks(parts, CHUNK // 4):
        a, b = parts[lo], parts[hi]
        sample = weighted_samples(s.prints[a:b], weight[a:b], parts[lo : hi + 1] - a, bands * rows)
        for band in range(bands):
            h = np.full(hi - lo, band, U64)
            for k in range(rows):
                h = mix(h * U64(0xD6E8FEB86659FD93) + sample[:, band * rows + k])
            keys[where[lo:hi], band] = h.view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]), pa.int32()), pa.array(keys[full].ravel(), pa.int64()))
    columns = {"row": s.row, "same": s.same[0], "same2": s.same[1], "size": np.diff(s.edge)}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()} | {"bands": lists})


_VECTORS = "g1 long, g2 long, side int, row long, component long, n long, payload binary"


def _vectors(table: pa.Table, messages: pa.Table, buckets: int, total: int) -> pa.Table:
    """The shingle weights of the rows that groups ask for."""
    kind = messages.column("kind").to_numpy()
    asks = messages.filter(pa.array(kind == 1))
    out = []
    if asks.num_rows and table.num_rows:
        df = messages.filter(pa.array(kind == 0))
        s = _Shingles(table)
        weight = s.weights(dict(zip(df.column("bucket").to_pylist(), df.column("payload").to_pylist(), strict=True)), buckets, total)
        at = np.searchsorted(s.row, asks.column("row").to_numpy())
        ready: dict[int, tuple[int, bytes]] = {}
        for k, g1, g2, side, row, component in zip(at.tolist(), *(asks.column(c).to_pylist() for c in ("g1", "g2", "side", "row", "component")), strict=True):
            if k not in ready:
                a, b = s.edge[k], s.edge[k + 1]
                p = s.prints[a:b]
                ready[k] = int(b - a), squeeze(weight[a:b].astype(np.float64), (p & U64(0xFFFFFFFF)).astype(np.uint32), (p >> U64(32)).astype(np.uint16))
            out.append((g1, g2, side, row, component, *ready[k]))
    columns = list(zip(*out, strict=True)) if out else [[]] * 7
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("g1", "g2", "side", "row", "component", "n", "payload"), columns, types, strict=True)})


def _open(sizes: list[int], payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    prints, weights = [], []
    for n, payload in zip(sizes, payloads, strict=True):
        raw = expand(payload)
        weights.append(np.frombuffer(raw, np.float64, n))
        prints.append(np.frombuffer(raw, np.uint32, n, 8 * n).astype(U64) | np.frombuffer(raw, np.uint16, n, 12 * n).astype(U64) << U64(32))
    return np.concatenate(prints), np.concatenate(weights), np.concatenate([[0], np.cumsum(sizes)])


def similarities(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard of each left set with each right set (fingerprints sorted within a set, weights, edges).

    A shingle's weight is count times a factor that both sides share, so minima
    over columns where both counts agree come from a matrix product; the rest
    are added column by column.
    """
    (p, w, e), (q, v, f) = left, right
    n, m = len(e) - 1, len(f) - 1
    sums_l, sums_r = np.add.reduceat(np.append(w, 0), e[:-1]), np.add.reduceat(np.append(v, 0), f[:-1])
    low = np.zeros((n, m))
    keys = np.intersect1d(p, q)  # distinct shingles that both sides have
    i, j = np.searchsorted(keys, p), np.searchsorted(keys, q)
    i_ok, j_ok = i < len(keys), j < len(keys)
    i_ok[i_ok] = keys[i[i_ok]] == p[i_ok]
    j_ok[j_ok] = keys[j[j_ok]] == q[j_ok]
    i, a, x = i[i_ok], np.repeat(np.arange(n), np.diff(e))[i_ok], w[i_ok]
    j, b, y = j[j_ok], np.repeat(np.arange(m), np.diff(f))[j_ok], v[j_ok]
    top = np.zeros(len(keys))
    least = np.full(len(keys), np.inf)
    for k, z in ((i, x), (j, y)):
        np.maximum.at(top, k, z)
        np.minimum.at(least, k, z)
    plain = top - least <= 1e-9 * top
    width = max(1, (4 << 20) // max(n + m, 1))
    for columns, flat in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
        number = np.full(len(keys), -1, np.int64)
        number[columns] = np.arange(len(columns))
        step = width if flat else max(1, (4 << 20) // max(n * m, 1))
        ni, nj = number[i], number[j]
        for lo in range(0, len(columns), step):
            s, t = (ni >= lo) & (ni < lo + step), (nj >= lo) & (nj < lo + step)
            k = min(step, len(columns) - lo)
            one, two = np.zeros((n, k)), np.zeros((m, k))
            if flat:
                one[a[s], ni[s] - lo] = x[s]
                two[b[t], nj[t] - lo] = 1
                low += one @ two.T
            else:
                one[a[s], ni[s] - lo] = x[s]
                two[b[t], nj[t] - lo] = y[t]
                low += np.minimum(one[:, None], two[None]).sum(2)
    return low / np.maximum(sums_l[:, None] + sums_r[None] - low, 1e-300)


def _verify(table: pa.Table, threshold: float) -> pa.Table:
    """Links between the two sides of a group, apart from pairs within one component."""
    side = table.column("side").to_numpy()
    row, component = table.column("row").to_numpy(), table.column("component").to_numpy()
    n, payload = table.column("n").to_pylist(), table.column("payload").to_pylist()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(one) and len(two):
        left = _open([n[k] for k in one], [payload[k] for k in one])
        right = _open([n[k] for k in two], [payload[k] for k in two])
        for lo in range(0, len(two), 128):
            hi = min(lo + 128, len(two))
            f = right[2]
            part = right[0][f[lo] : f[hi]], right[1][f[lo] : f[hi]], f[lo : hi + 1] - f[lo]
            link = similarities(left, part) >= threshold - 1e-9
            link &= component[one][:, None] != component[two[lo:hi]][None]
            a, b = np.nonzero(link)
            a_all.append(row[one[a]])
            b_all.append(row[two[lo + b]])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    # A forest is enough: of the links to one side's row keep those that join something new.
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})


def _trimmed(f, *args) -> pa.Table:
    out = f(*args)
    trim()
    return out


class NearDuplicates:
    """Classes of near-duplicate documents; `classes` has row, class_row and what the store carries."""

    def __init__(
        self, documents: DataFrame, threshold: float = 0.8, bands: int = 8, rows: int = 3, batch_bytes: int = 8 << 20, block: int = 256, block_shingles: int = 1 << 20, carry: tuple[str, ...] = ()
    ) -> None:
        spark = documents.sparkSession
        self.space = space = Workspace(spark, "icws")
        self.store = store = TextBatches(space, documents, batch_bytes, carry)
        self.threshold, self.block, self.block_shingles = threshold, block, block_shingles
        self.total, self.buckets = max(store.rows, 1), min(2 * store.count, 65000)
        buckets, total = self.buckets, self.total
        self.texts = store.frame.select("batch", "row", "text")
        sent = self.texts.groupBy("batch").applyInArrow(lambda t: _trimmed(_count, t, buckets), MESSAGE)
        self.df = space.save(store.spread(sent, "bucket").groupBy("bucket").applyInArrow(_add_up, MESSAGE), "df")
        del sent
        release(spark)
        signed = self.texts.groupBy("batch").cogroup(self.df.groupBy("batch")).applyInArrow(
            lambda t, m: _trimmed(_sign, t, m, buckets, total, bands, rows), "row long, same long, same2 long, size long, bands array<long>"
        )
        signed = space.save(signed, "signed")
        worded = signed.where(F.size("bands") > 0)
        members = worded.groupBy("same", "same2").agg(F.min(F.struct("row", "size", "bands")).alias("m"))
        members = space.save(members.select("same", "same2", "m.row", "m.size", "m.bands"), "members")
        keyed = members.select("row", "size", F.posexplode("bands").alias("band", "key"))
        self.members = keyed
        links = self._first_links()
        parts = components(space, links, "first")
        links = links.unionByName(self._second_links(parts))
        parts = components(space, links, "second")
        links = links.unionByName(self._other_links(parts))
        parts = components(space, links, "all")
        release(spark)
        of_member = members.select("same", "same2", "row").join(parts.withColumnRenamed("node", "row"), "row", "left")
        # Saved, as are other sides of joins on keys that many rows may share: then adaptive execution can split such a key's rows.
        of_member = space.save(of_member.select("same", "same2", F.coalesce("component", "row").alias("class_row")), "of_member")
        alone = signed.where(F.size("bands") == 0).select("row", F.col("row").alias("class_row"))
        grouped = worded.select("row", "same", "same2").join(of_member, ["same", "same2"]).select("row", "class_row")
        self.classes = space.save(grouped.unionByName(alone), "classes")

    def _ask(self, asks: DataFrame, name: str) -> DataFrame:
        """Verified links of groups (g1, g2) of rows on two sides; asks has g1, g2, side, row, component."""
        df, buckets, total, threshold = self.df, self.buckets, self.total, self.threshold
        none = {"bucket": "int", "n": "long", "payload": "binary"}
        said = df.withColumns({c: F.lit(None).cast(t) for c, t in (("g1", "long"), ("g2", "long"), ("side", "int"), ("row", "long"), ("component", "long"))}).withColumn("kind", F.lit(0))
        asked = asks.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).withColumn("batch", self.store.batch_of(F.col("row"))).withColumn("kind", F.lit(1))
        some = asked.select("batch").distinct()
        said, texts = said.join(some, "batch", "left_semi"), self.texts.join(some, "batch", "left_semi")
        messages = said.unionByName(asked)
        sent = texts.groupBy("batch").cogroup(messages.groupBy("batch")).applyInArrow(lambda t, m: _trimmed(_vectors, t, m, buckets, total), _VECTORS)
        return self.space.save(sent.groupBy("g1", "g2").applyInArrow(lambda t: _trimmed(_verify, t, threshold), "a long, b long"), name)

    def _blocks(self, rows, shingles):
        """Into how many blocks a group is cut, so that none holds more than `block` rows or about `block_shingles` shingles."""
        return F.ceil(F.greatest(rows / self.block, shingles / self.block_shingles, F.lit(1))).cast("int")

    def _led(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links of rows to the lead that each is paired with; pairs: lead, own (the lead's component), row, size, component."""
        pairs = self.space.save(pairs.distinct(), f"pairs_{name}")
        salts = self.space.save(pairs.groupBy("lead", "own").agg(self._blocks(F.count(F.lit(1)), F.sum("size")).alias("salts")), f"salts_{name}")
        slot = F.pmod(F.xxhash64("row"), F.col("salts")).cast("long")
        followers = pairs.join(salts.drop("own"), "lead").select(F.col("lead").alias("g1"), slot.alias("g2"), F.lit(1).alias("side"), "row", "component")
        leads = salts.select(F.col("lead").alias("g1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("g2"), F.lit(0).alias("side"), F.col("lead").alias("row"), F.col("own").alias("component"))
        return self._ask(followers.unionByName(leads), f"links_{name}")

    def _first_links(self) -> DataFrame:
        """Each member of a band bucket against the bucket's smallest."""
        least = self.members.groupBy("band", "key").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "key", "lead")
        return self._led(self.members.join(least, ["band", "key"]).where("row <> lead").select("lead", F.col("lead").alias("own"), "row", "size", F.col("row").alias("component")), "first")

    def _placed(self, parts: DataFrame) -> DataFrame:
        return self.members.join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))

    def _second_links(self, parts: DataFrame) -> DataFrame:
        """In buckets with more than a block's members outside the smallest member's component: the smallest of these against all others."""
        placed = self.space.save(self._placed(parts), "placed")
        main = placed.groupBy("band", "key").agg(F.min(F.struct("row", "component")).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "key", F.col("m.component").alias("main"))
        outside = placed.join(self.space.save(main, "main"), ["band", "key"]).where("component <> main")
        second = outside.groupBy("band", "key").agg(F.min(F.struct("row", "component")).alias("s"), F.count(F.lit(1)).alias("c")).where(F.col("c") > self.block)
        second = self.space.save(second.select("band", "key", F.col("s.row").alias("lead"), F.col("s.component").alias("own")), "second_leads")
        if second.isEmpty():
            return self.space.spark.createDataFrame([], "a long, b long")
        return self._led(placed.join(second, ["band", "key"]).where("component <> own").select("lead", "own", "row", "size", "component"), "second")

    def _other_links(self, parts: DataFrame) -> DataFrame:
        """In buckets that still hold several components: the members outside the smallest member's component against all."""
        placed = self._placed(parts)
        # Buckets with the same components in the same order are compared once: a key over what they hold.
        held = placed.groupBy("band", "key").agg(
            F.min(F.struct("row", "component")).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("content")
        ).where("lo <> hi")
        once = held.groupBy("content", "c").agg(F.min(F.struct("band", "key")).alias("k"), F.first("lead").alias("lead")).select("k.*", F.col("lead.component").alias("main"))
        open_ = self.space.save(placed.join(once, ["band", "key"]).select(F.xxhash64("band", "key").alias("g1"), "row", "size", "component", (F.col("component") != F.col("main")).alias("out")), "open")
        out_size = F.sum(F.when(F.col("out"), F.col("size")).otherwise(0))
        sizes = self.space.save(open_.groupBy("g1").agg(self._blocks(F.count(F.lit(1)), F.sum("size")).alias("all_blocks"), self._blocks(F.count_if("out"), out_size).alias("out_blocks")), "sizes")
        dealt = open_.join(sizes, "g1")
        slot = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("long")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
        left = dealt.where("out").select("g1", slot("out_blocks").alias("x"), every("all_blocks").alias("y"), F.lit(0).alias("side"), "row", "component")
        right = dealt.select("g1", every("out_blocks").alias("x"), slot("all_blocks").alias("y"), F.lit(1).alias("side"), "row", "component")
        return self._ask(left.unionByName(right).select("g1", (F.col("x") * F.lit(1 << 31) + F.col("y")).alias("g2"), "side", "row", "component"), "links_other")

    def with_documents(self, *columns: str) -> DataFrame:
        """The stored documents (row, doc_id, given columns) with class_row."""
        return self.store.frame.select("row", "doc_id", *columns).join(self.classes, "row")

    def close(self) -> None:
        self.space.close("result")


def near_duplicates(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, kept): class_id is the smallest doc_id of the class, and one row of each class is kept.

    The kept row is the one with the smallest doc_id (null last), then the first stored.
    """
    found = NearDuplicates(documents, threshold)
    ids = found.with_documents()
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    first = found.space.save(ids.groupBy("class_row").agg(F.min(order).alias("first")), "first")
    out = ids.join(first, "class_row").select("doc_id", F.col("first.i").alias("class_id"), (F.col("row") == F.col("first.r")).alias("kept"))
    out = found.space.save(out, "result")
    found.close()
    return out


def one_of_each(documents: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """The documents, one of each near-duplicate class, with the given columns as they were."""
    carry = tuple(c for c in columns if c not in ("doc_id", "text"))
    # The stored text stands in for null by the empty text, so the text's nullness is carried along.
    marked = documents.select(*columns, F.col("text").isNull().alias("hm_no_text"))
    found = NearDuplicates(marked, threshold, carry=(*carry, "hm_no_text"))
    whole = found.with_documents("text", *[f"c_{c}" for c in carry], "c_hm_no_text")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    first = found.with_documents().groupBy("class_row").agg(F.min(order).alias("first")).select(F.col("first.r").alias("row"))
    kept = whole.join(first, "row", "left_semi")
    picked = {c: F.col(f"c_{c}") for c in carry} | {"doc_id": F.col("doc_id"), "text": F.when(~F.col("c_hm_no_text"), F.col("text"))}
    out = found.space.save(kept.select(*[picked[c].alias(c) for c in columns]), "result")
    found.close()
    return out
