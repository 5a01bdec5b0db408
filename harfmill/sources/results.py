"""Sources and sinks: experiment results, failure tables, tokenizer artifacts, cached analyses."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """all_metrics.json files under a glob, one row each, with the path."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())


def write_json(frame: DataFrame, path: str) -> None:
    """JSON lines with null fields kept."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_configs(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """A directory partitioned by source_config, without the excluded ones: pruned before anything is read."""
    frame = spark.read.parquet(root)
    return frame.where(~F.col("source_config").isin(*excluded)) if excluded else frame


def write_failures(frame: DataFrame, path: str, fields: list[str]) -> int:
    """A small failure report as CSV with a byte-order mark; the header is always there.  Returns the number of rows."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.DictWriter(out, fields, extrasaction="ignore")
        writer.writeheader()
        for row in frame.toLocalIterator():
            writer.writerow(row.asDict())
            rows += 1
    return rows


def write_report(frame: DataFrame, path: str, title: str) -> None:
    """A small comparison table as text, and beside it as JSON."""
    rows, names = [r.asDict() for r in frame.collect()], frame.columns
    cells = [names] + [["—" if r[n] is None else f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]
    width = [max(len(line[k]) for line in cells) for k in range(len(names))]
    lines = [title, ""] + [" | ".join(c.ljust(w) for c, w in zip(line, width, strict=True)) for line in cells]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
    Path(path).with_suffix(".json").write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def save_vocab(vocab: DataFrame, path: str, **manifest: object) -> None:
    """A vocabulary table and its manifest row."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    vocab.sparkSession.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "manifest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vocab"), json.loads(spark.read.json(f"{path}/manifest").first()["manifest"])


def cached_analyses(spark: SparkSession, path: str, needed: DataFrame, analyse) -> DataFrame:
    """Analyses of the needed words: from the cache if it covers them all, else computed and written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    cache = spark.read.parquet(path) if there else None  # a cache that cannot be read raises, and stays
    if cache is not None and needed.join(cache.select("word"), "word", "left_anti").isEmpty():
        return cache.join(needed.select("word").distinct(), "word", "left_semi")
    fresh = analyse(needed.select("word").distinct())
    fresh.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
