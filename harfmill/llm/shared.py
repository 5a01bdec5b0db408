"""Shared storage, code shipping and text batches for the corpus operators."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sort key that stands for a null id: after every other id.
NULL_ID = 2**63 - 1
_OWN_ROOT: list[str] = []
#: Batches for Python are bounded by bytes, as texts differ in length; set where the session says nothing.
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per context."""
    context = spark.sparkContext
    for name, value in _ARROW.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    source = Path(__file__).resolve().parents[1]
    if getattr(context, "_harfmill_shipped", False) or not source.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="harfmill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "harfmill-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(source.rglob("*.py")):
            out.write(path, path.relative_to(source.parent))
    context.addPyFile(str(archive))
    context._harfmill_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where the session has none and is local, as in tests, a temporary folder of
    this process takes its place and goes when the process ends; on a cluster
    ValueError, as executors would write where no other machine can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="harfmill-shared-"))
        atexit.register(shutil.rmtree, _OWN_ROOT[0], ignore_errors=True)
    return f"file://{_OWN_ROOT[0]}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


class Workspace:
    """The tables of one operator run, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.tag = f"{name}_{uuid.uuid4().hex[:16]}"
        self.root = f"{shared_root(spark)}/harfmill/{self.tag}"
        self._tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a table and return a frame that reads it: lineage ends here."""
        frame.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def save_bucketed(self, frame: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
        """Write a table bucketed by a column, so that later grouping by it needs no shuffle."""
        limit = "spark.sql.sources.bucketing.maxBuckets"
        if buckets > int(self.spark.conf.get(limit)):
            self.spark.conf.set(limit, str(buckets))
        table = f"harfmill_{self.tag}_{name}"
        (
            frame.repartition(buckets, by)
            .write.mode("overwrite")
            .bucketBy(buckets, by)
            .option("compression", "zstd")
            .option("path", self.path(name))
            .format("parquet")
            .saveAsTable(table)
        )
        self._tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if table := self._tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            self.delete(self.path(name))

    def close(self, *keep: str) -> None:
        """Drop every table but those named."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        self.drop(*[n for n in names if n not in keep])
        release(self.spark)

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _murmur3_int(value: int, seed: int = 42) -> int:
    """The 32-bit hash by which Spark deals out one integer column."""
    full = 0xFFFFFFFF
    k = value * 0xCC9E2D51 & full
    k = (k << 15 | k >> 17) & full
    h = seed ^ (k * 0x1B873593 & full)
    h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & full
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def bucket_keys(buckets: int) -> list[int]:
    """For each bucket number an integer that Spark's hash puts there, so that batches fill buckets evenly."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < buckets:
        found.setdefault(_murmur3_int(value) % buckets, value)
        value += 1
    return [found[k] for k in range(buckets)]


class TextBatches:
    """Documents dealt into batches of about `batch_bytes` of text, stored once.

    Several passes over the same batches exchange small messages with tables
    that are dealt by key; each pass joins a batch with the messages for it.
    The table is bucketed by batch, so the texts are shuffled only here.

    `frame` has row (a unique number), batch, doc_id, text (null: empty) and
    the carried columns, prefixed by `c_`.
    """

    def __init__(self, space: Workspace, documents: DataFrame, batch_bytes: int, carry: tuple[str, ...] = ()) -> None:
        totals = documents.select(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
        self.rows = int(totals["n"])
        self.bytes = int(totals["b"] or 0)
        self.count = max(1, math.ceil(self.bytes / batch_bytes))
        keys = bucket_keys(self.count) if self.count <= 4096 else list(range(self.count))
        self.keys = keys
        flat = documents.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
            *[F.col(c).alias(f"c_{c}") for c in carry],
        )
        self.frame = space.save_bucketed(flat.withColumn("batch", self.batch_of(F.col("row"))), "texts", self.count, "batch")

    def spread(self, frame: DataFrame, key: str) -> DataFrame:
        """Messages dealt by a key into as many partitions as keep each near 64 MB of text, where the session has fewer."""
        count = math.ceil(self.bytes / (64 << 20))
        return frame.repartition(count, key) if count > int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) else frame

    def batch_of(self, row):
        """The batch of a row number, as a Column."""
        slot = F.pmod(F.xxhash64(row), F.lit(self.count)).cast("int")
        if self.count <= 4096:
            return F.element_at(F.array(*[F.lit(k) for k in self.keys]), slot + 1)
        return slot
