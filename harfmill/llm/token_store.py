"""Token-id files: shards of context-mixed, range-coded blocks.

Documents are dealt by ranges of (doc_id, hash of the text, row), so file order
is doc_id order and a doc_id that many rows share is dealt like any other.  Each
task tokenizes its range and writes shards of about `SHARD_IDS` ids into the
shared folder, whatever its share of the bytes; a manifest table (one row a
shard) is committed by Spark's writer, so files of lost or repeated attempts are
never read, and a task for each folder deletes them.  Of the manifest only one
number for a thousand partitions reaches the driver.

A shard: magic, numbers of documents, ids and symbols, doc_ids with a null
mask, document lengths, block sizes and checksums (zstd-compressed number
arrays), then the blocks, which need none but the number of symbols
(see `mixcoder.py`).

Results in odd cases: a null or empty text is its end id alone; null doc_ids
come last; rows with one doc_id follow each other in order of their texts'
hashes; an empty table makes no shards and reads back as no rows.  A damaged
block raises, and so does an id that the files cannot hold (over 65,534).
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harfmill.llm import mixcoder
from harfmill.llm.bytesops import expand, squeeze, string_bytes, trim
from harfmill.llm.shared import NULL_ID, Workspace
from harfmill.llm.units import encoder, with_end

MAGIC = b"HMTOKEN3"
_HEAD = "<8sQQQ3Q"
#: Ids after which a shard ends, so that a task holds no more, however long its range is.
SHARD_IDS = 8 << 20


def pack_shard(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids: NULL_ID stands for null."""
    symbols = int(ids.max(initial=0)) + 1
    blocks, sums = mixcoder.encode(ids, symbols)
    parts = [squeeze(doc_ids.astype(np.int64)), squeeze(sizes.astype(np.int64)), squeeze(np.fromiter(map(len, blocks), np.uint32, len(blocks)), np.asarray(sums, np.uint32))]
    return b"".join([struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), symbols, *map(len, parts)), *parts, *blocks])


def unpack_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    magic, docs, n, symbols, *lengths = struct.unpack_from(_HEAD, raw)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, parts = struct.calcsize(_HEAD), []
    for length in lengths:
        parts.append(expand(raw[at : at + length]))
        at += length
    count = -(-n // mixcoder.BLOCK)
    size = np.frombuffer(parts[2], np.uint32, count).astype(np.int64)
    sums = np.frombuffer(parts[2], np.uint32, count, 4 * count).tolist()
    edge = at + np.concatenate([[0], np.cumsum(size)])
    blocks = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return np.frombuffer(parts[0], np.int64, docs), np.frombuffer(parts[1], np.int64, docs), mixcoder.decode(blocks, sums, n, symbols)


_MANIFEST = "part int, seq int, name string, documents long, n_tokens long"


def _folder_of(part: int) -> str:
    return f"part-{part:06d}"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    code, part, seq, held = encoder(path), TaskContext.get().partitionId(), 0, 0
    files, base = pafs.FileSystem.from_uri(f"{folder}/{_folder_of(part)}")
    docs, sizes, ids = [], [], []

    def shard() -> pa.RecordBatch:
        doc, size, flat = np.concatenate(docs), np.concatenate(sizes), np.concatenate(ids)
        for kept in (docs, sizes, ids):
            kept.clear()
        files.create_dir(base)
        name = f"{seq:06d}-{uuid.uuid4().hex}.hmtoken"
        with files.open_output_stream(f"{base}/{name}") as out:
            out.write(pack_shard(doc, size, flat))
        trim()
        values = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [name]}
        return pa.RecordBatch.from_pydict(values | {"documents": pa.array([len(doc)], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64())})

    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            piece = batch.slice(lo, 2000)
            i, n = with_end(*code.encode(*string_bytes(piece.column("text"))), end)
            docs.append(piece.column("doc_id").fill_null(NULL_ID).to_numpy())
            sizes.append(n)
            ids.append(mixcoder.check_ids(i).astype(np.uint16))
            held += len(i)
            if held >= SHARD_IDS:
                yield shard()
                seq, held = seq + 1, 0
    if docs:
        yield shard()


def _sweep(table: pa.Table, folder: str) -> pa.Table:
    """Delete the files of one partition's folder that the manifest does not name."""
    part = table.column("part")[0].as_py()
    files, base = pafs.FileSystem.from_uri(f"{folder}/{_folder_of(part)}")
    named, gone = set(table.column("name").to_pylist()), 0
    for x in files.get_file_info(pafs.FileSelector(base)):
        if x.base_name not in named:
            files.delete_file(x.path)
            gone += 1
    return pa.table({"gone": pa.array([gone], pa.int64())})


def _read(batches: Iterator[pa.RecordBatch], folder: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    files, base = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for part, name, before in zip(*(batch.column(c).to_pylist() for c in ("part", "name", "before")), strict=True):
            with files.open_input_file(f"{base}/{_folder_of(part)}/{name}") as source:
                doc, size, ids = unpack_shard(source.read())
            raw = memoryview(ids.astype("<u4")).cast("B")
            edge = np.concatenate([[0], np.cumsum(size)])
            parts = [raw[4 * a : 4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            columns = {
                "doc_id": pa.array(doc, pa.int64(), mask=doc == NULL_ID),
                "start": pa.array(before + edge[:-1], pa.int64()),
                "n_tokens": pa.array(size, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
    trim()


class TokenFiles:
    """Written shards: `folder`, and `manifest` (part, seq, name, documents, n_tokens); file order is by part and seq."""

    def __init__(self, documents: DataFrame, tokenizer_path: str, end_id: int, range_bytes: int = 16 << 20) -> None:
        self.space = space = Workspace(documents.sparkSession, "tokens")
        self.folder = folder = space.path("shards")
        flat = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        total = flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("r")]
        flat = flat.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r"))
        ranged = flat.repartitionByRange(max(1, math.ceil(total / range_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
        self.manifest = space.save(ranged.mapInArrow(lambda it: _write(it, folder, tokenizer_path, end_id), _MANIFEST), "manifest")

    def sweep(self) -> int:
        """Delete what lost or repeated attempts of tasks have left; the number of files deleted."""
        folder = self.folder
        return self.manifest.groupBy("part").applyInArrow(lambda t: _sweep(t, folder), "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]

    def read(self, keep_ids: bool = False) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; with `keep_ids` also the ids."""
        folder, spark = self.folder, self.space.spark
        shards = self.manifest.select("part", "seq", "name", "n_tokens", F.expr("part div 1000").alias("thousand"))
        sums = [tuple(r) for r in shards.groupBy("thousand").agg(F.sum("n_tokens"), F.count(F.lit(1))).orderBy("thousand").collect()]
        base = np.concatenate([[0], np.cumsum([n for _, n, _ in sums])]).astype(int).tolist()
        bases = spark.createDataFrame([(k, b) for (k, _, _), b in zip(sums, base, strict=False)], "thousand long, base long")
        earlier = Window.partitionBy("thousand").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("base") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
        placed = shards.join(F.broadcast(bases), "thousand").select("part", "seq", "name", before.alias("before"))
        dealt = placed.repartitionByRange(max(1, sum(k for _, _, k in sums)), "part", "seq").select("part", "name", "before")
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
        return dealt.mapInArrow(lambda it: _read(it, folder, keep_ids), schema)


def round_trip(documents: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write all documents' ids, read the files back, and delete them."""
    files = TokenFiles(documents, tokenizer_path, end_id)
    out = files.space.save(files.read(), "result")
    files.space.close("result")
    return out
