"""Corpora and benchmarks from folders: splits, text column, preprocessing, caps; several configurations of one benchmark."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfmill.operators import corpora

log = logging.getLogger(__name__)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, or nothing if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return sorted(x.getPath().getName() for x in files.listStatus(where) if x.isDirectory() or x.getPath().getName().endswith(".parquet"))


def _splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """train, test, ... of a folder with one Parquet table each; a folder that is a table itself is `train`."""
    names = _folders(spark, path)
    found = {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/{n}") for n in names if not n.startswith(("_", ".", "part-"))}
    return found or {"train": spark.read.parquet(path)}


def load_corpus(
    spark: SparkSession,
    path: str,
    train: str = "train",
    evaluation: str | None = "test",
    max_train: int | None = None,
    max_eval: int | None = None,
    preprocessing: dict | None = None,
    key: str | None = None,
) -> dict[str, DataFrame]:
    """{"train", "eval"} with a column `text`.

    A missing evaluation split is `validation` if there is one, else a tenth of
    train by the hash of the key (a column; the text without one).  Caps take
    rows in the order of the key's hash.
    """
    splits = _splits(spark, path)
    if train not in splits:
        raise ValueError(f"{path} has no split {train!r}; it has {sorted(splits)}")
    column = corpora.text_column(splits[train].schema)
    named = {n: f.withColumnRenamed(column, "text") if column != "text" else f for n, f in splits.items()}
    by = key or "text"
    out = {"train": named[train]}
    if evaluation:
        held = evaluation if evaluation in named else "validation" if "validation" in named else None
        if held:
            out["eval"] = named[held]
        else:
            split = corpora.hash_split(F.coalesce(F.col(by).cast("string"), F.lit("")))
            out = {"train": named[train].where(split == "train"), "eval": named[train].where(split == "eval")}
    if preprocessing is not None:
        out = {n: corpora.preprocess(f, **preprocessing) for n, f in out.items()}
    for name, cap in (("train", max_train), ("eval", max_eval)):
        if cap and name in out:
            out[name] = corpora.sample(out[name], by, cap)
    return out


def load_benchmark(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], config: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Parsed rows of one configuration, or of all that a folder has but the excluded ones; all splits together.

    `parse` makes examples of raw rows with ex_id and source_config, and raises
    where it can't.  A configuration that fails is skipped with a warning;
    RuntimeError if none is left or no row could be parsed.
    """
    names = [n for n in _folders(spark, path) if not n.startswith(("_", ".")) and not n.endswith(".parquet")]
    if config is not None or not names:
        return _parsed(spark, f"{path}/{config}" if config else path, parse, config or "_default")
    chosen, out, skipped = [n for n in names if n not in excluded], None, []
    for name in chosen:
        try:
            part = _parsed(spark, f"{path}/{name}", parse, name)
        except Exception as error:  # one bad configuration does not cost the others
            log.warning("%s: configuration %s is skipped: %s", path, name, error)
            skipped.append(name)
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise RuntimeError(f"{path}: none of {len(chosen)} configurations has a row that could be parsed (skipped: {skipped})")
    return out


def _parsed(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], config: str) -> DataFrame:
    rows = None
    for _, part in sorted(_splits(spark, path).items()):
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    key = F.xxhash64(F.lit(config), F.to_json(F.struct("*"))) if "ex_id" not in rows.columns else F.col("ex_id")
    out = parse(rows.withColumn("ex_id", key).withColumn("source_config", F.lit(config)))
    if out.isEmpty():
        raise RuntimeError(f"{path}: no row could be parsed")
    return out
