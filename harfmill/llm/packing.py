"""Packing by concatenation and cutting.

First pass: every input partition tokenizes its documents once, keeps a running
token count and writes (partition, tokens before the document within it, ids).
The partitions' totals, one number each, give by prefix sums the global offset
of every partition.  Second pass: a document's place in the endless
concatenation is partition offset plus its own; fixed windows of `window` ids
cut it into pieces, and each piece is a boundary record: document, where in the
document, which sequence, where in it.  Only the last sequence is not full, so
padding is below one window for the whole corpus.

The order of documents is that of the input partitions.

Results in odd cases: a null or empty text is its end id alone; null and
repeated doc_ids are carried as they are; a document of any length is cut as
often as needed; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfmill.llm.bytesops import ragged, string_bytes, trim
from harfmill.llm.shared import Workspace
from harfmill.llm.units import encoder, with_end

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    code, part, before = encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            piece = batch.slice(lo, 2000)
            ids, size = with_end(*code.encode(*string_bytes(piece.column("text"))), end)
            edge = np.concatenate([[0], np.cumsum(size)])
            offsets = pa.array(edge * 4, pa.int32()) if edge[-1] < 2**29 else None
            raw = ids.astype("<u4")
            payload = (
                pa.Array.from_buffers(pa.binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(raw)])
                if offsets is not None
                else pa.array([raw[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            )
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.full(len(size), part), pa.int32()), pa.array(before + edge[:-1], pa.int64()), pa.array(size, pa.int64()), payload],
                ["doc_id", "part", "before", "n", "ids"],
            )
            before += int(edge[-1])
    trim()


def _cut(batches: Iterator[pa.RecordBatch], window: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, n = batch.column("begin").to_numpy(), batch.column("n").to_numpy()
        first, last = begin // window, (begin + n - 1) // window
        pieces = last - first + 1
        doc = np.repeat(np.arange(len(n)), pieces)
        sequence = ragged(first, pieces)
        lo = np.maximum(sequence * window, begin[doc])
        hi = np.minimum((sequence + 1) * window, (begin + n)[doc])
        start = lo - begin[doc]
        views = [memoryview(b.as_buffer()) for b in batch.column("ids")]
        parts = [views[d][4 * a : 4 * b] for d, a, b in zip(doc.tolist(), start.tolist(), (hi - begin[doc]).tolist(), strict=True)]
        columns = [
            batch.column("doc_id").take(pa.array(doc)),
            pa.array(start, pa.int64()),
            pa.array(hi - lo, pa.int64()),
            pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            pa.array(n[doc], pa.int64()),
            pa.array(sequence, pa.int64()),
            pa.array(lo % window, pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if keep_ids:
            columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)
    trim()


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Boundary records of all pieces; with `keep_ids` also each piece's ids as little-endian unsigned 32-bit numbers."""
    spark = documents.sparkSession
    space = Workspace(spark, "packing")
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = space.save(slim.mapInArrow(lambda it: _tokenize(it, tokenizer_path, end_id), "doc_id long, part int, before long, n long, ids binary"), "tokens")
    # One total for each input partition: a few bytes for every split of the input.
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n")).collect())
    base = np.concatenate([[0], np.cumsum([t for _, t in totals])]).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, base, strict=False)], "part int, base long")
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "n", (F.col("base") + F.col("before")).alias("begin"), "ids")
    out = space.save(placed.mapInArrow(lambda it: _cut(it, window, keep_ids), _PIECES + (", ids binary" if keep_ids else "")), "result")
    space.close("result")
    return out
