"""Training data and its schedule: batches, label masks, early stopping, trainable parameters."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harfmill.functions.scoring import answer_labels, early_stop
from harfmill.operators.mcq import ANSWER, CONTEXT, QUESTION

log = logging.getLogger(__name__)


def batches(rows: DataFrame, size: int, pad: int = 0, max_length: int = 512, shard: str = "shard", order: str = "ex_id") -> DataFrame:
    """rows: shard, ex_id, ids, labels (null: the ids).  Right-padded ids, mask and labels, `size` rows a batch.

    Batches are counted within a shard, so no partition sees more than one shard's rows.
    """
    w = Window.partitionBy(shard).orderBy(order)
    cut = rows.select(shard, order, F.slice("ids", 1, max_length).alias("ids"), F.slice(F.coalesce("labels", "ids"), 1, max_length).alias("labels"))
    placed = cut.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    longest = F.max(F.size("ids")).over(Window.partitionBy(shard, "batch_id"))
    filler = lambda v: F.array_repeat(F.lit(v).cast("long"), F.col("width") - F.size("ids"))
    one = F.array_repeat(F.lit(1).cast("long"), F.size("ids"))
    return placed.withColumn("width", longest).select(
        shard, "batch_id", order, F.concat("ids", filler(pad)).alias("ids"), F.concat(one, filler(0)).alias("mask"), F.concat("labels", filler(-100)).alias("labels")
    )


# The longest sequences of batches by what the embedding is made of.
LONGEST = {"standard": 512, "character_cnn": 512, "characters": 2048, "bytes": 2048}


def tokenize_records(records: DataFrame, tokenizer, max_length: int, loss_target: str) -> DataFrame:
    """records: id, question, context, answer.  (id, ids, labels, and char_ids where the tokenizer has them).

    full_sequence: labels are null, so that batches take the ids.  answer_only:
    labels are -100 over what prompt and full text begin with alike; records
    whose answer is cut off go.
    """
    if loss_target not in ("full_sequence", "answer_only"):
        raise ValueError(f"unknown loss target {loss_target!r}")
    prompt, full = qa_prompt(F.col("question"), F.col("context")), qa_prompt(F.col("question"), F.col("context"), F.col("answer"))
    out = tokenizer.encode(records.select("id", prompt.alias("prompt"), full.alias("full")), "full", max_length, truncation=True)
    vectors = ["char_ids"] if "char_ids" in out.columns else []
    if loss_target == "full_sequence":
        return out.select("id", "ids", F.lit(None).cast("array<bigint>").alias("labels"), *vectors)
    out = tokenizer.encode(out.select("id", "prompt", *vectors, F.col("ids").alias("full_ids")), "prompt", max_length, truncation=True) if not vectors else _both(out, tokenizer, max_length)
    labels = answer_labels(F.col("ids"), F.col("full_ids")).cast("array<bigint>")
    return out.select("id", F.col("full_ids").alias("ids"), labels.alias("labels"), *vectors).where("labels is not null")


def _both(out: DataFrame, tokenizer, max_length: int) -> DataFrame:
    """Prompts beside full texts whose character vectors must stay."""
    kept = out.select("id", "prompt", F.col("char_ids").alias("kept"), F.col("ids").alias("full_ids"))
    return tokenizer.encode(kept, "prompt", max_length, truncation=True).drop("char_ids").withColumnRenamed("kept", "char_ids")


def record_stats(records: DataFrame, tokenized: DataFrame) -> DataFrame:
    """kept, dropped and the mean number of learnt ids: one row."""
    learnt = F.size(F.filter("labels", lambda x: x != -100))
    kept = tokenized.agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg(learnt), 4).alias("mean_completion"))
    return records.agg(F.count(F.lit(1)).alias("n")).crossJoin(kept).select("kept", (F.col("n") - F.col("kept")).alias("dropped"), "mean_completion")


def qa_prompt(question: Column, context: Column, answer: Column | None = None) -> Column:
    """Context, question and answer header, and the answer if there is one."""
    text = F.concat(F.lit(f"{CONTEXT} "), context, F.lit(f"\n{QUESTION} "), question, F.lit(f"\n{ANSWER}"))
    return text if answer is None else F.concat(text, F.lit(" "), answer)


def collate(rows: DataFrame, embedding_type: str, size: int, pad: int = 0, max_length: int | None = None, shard: str = "shard", order: str = "ex_id") -> DataFrame:
    """Batches as the embedding needs them; rows: shard, ex_id, ids, labels, and char_ids for character_cnn.

    standard: padded ids, mask and labels.  characters, bytes: the same, and
    labels are always the ids.  character_cnn: vectors of words, padded with
    words of zeros; labels are given ones, else the word ids.
    """
    if embedding_type not in LONGEST:
        raise ValueError(f"unknown embedding type {embedding_type!r}; known: {sorted(LONGEST)}")
    longest = max_length or LONGEST[embedding_type]
    if embedding_type in ("characters", "bytes"):
        rows = rows.withColumn("labels", F.lit(None).cast("array<bigint>"))
    out = batches(rows, size, pad, longest, shard, order)
    if embedding_type != "character_cnn":
        return out
    vectors = rows.select(shard, order, F.slice("char_ids", 1, longest).alias("char_ids"))
    empty = F.array_repeat(F.lit(0).cast("long"), F.size(F.get("char_ids", F.lit(0))))
    filled = F.concat("char_ids", F.array_repeat(empty, F.size("ids") - F.size("char_ids")))
    return out.join(vectors, [shard, order]).withColumn("char_ids", filled)


def data_loader(records: DataFrame, tokenizer, size: int, max_length: int, loss_target: str, shards: int = 8, seed: int | None = None) -> DataFrame:
    """Records to batches: tokenized, dealt into shards, and with a seed in an order that only the seed and the id decide."""
    rows = tokenize_records(records, tokenizer, max_length, loss_target)
    key = F.xxhash64(F.lit(seed), F.col("id").cast("string")) if seed is not None else F.col("id")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(shards))).withColumn("ex_id", F.struct(key.alias("k"), F.col("id").cast("string").alias("i")))
    out = collate(rows, tokenizer.embedding_type, size, tokenizer.pad_token_id, max_length)
    return out.withColumn("id", F.col("ex_id.i")).drop("ex_id")


def check_trainable(names: DataFrame, parts: list[str]) -> tuple[DataFrame, list[str]]:
    """names: name, n (values).  Parameters with `trains`, and the parts that none has; AssertionError if none trains at all."""
    out = names.withColumn("trains", trainable(F.col("name"), parts))
    if parts == ["*"]:
        return out, []
    row = out.agg(F.count_if("trains"), *[F.count_if(F.contains("name", F.lit(p))) for p in parts]).first()
    missed = [p for p, n in zip(parts, row[1:], strict=True) if not n]
    if not row[0]:
        raise AssertionError(f"no parameter's name holds any of {missed}")
    if missed:
        log.warning("no parameter's name holds any of %s", missed)
    return out, missed


def parameter_counts(names: DataFrame) -> DataFrame:
    """names: name, n, trains.  How many values there are, how many train, and their share in percent: one row."""
    total, learnt = F.sum("n"), F.coalesce(F.sum(F.when(F.col("trains"), F.col("n"))), F.lit(0))
    return names.agg(total.alias("total"), learnt.alias("trainable"), F.round(100.0 * learnt / F.greatest(total, F.lit(1)), 2).alias("pct"))


def phase_log(losses: DataFrame, patience: int, every: int, minimum: int, keep: int = 200) -> DataFrame:
    """losses: run, step, loss.  What a phase leaves behind: the early stop, and its last losses in order."""
    tail = loss_tail(losses, keep).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("tail"))
    return stop_table(losses, patience, every, minimum).join(tail, "run")


def stop_table(losses: DataFrame, patience: int = 3, every: int = 2, minimum: int = 2, delta: float = 0.0) -> DataFrame:
    """losses: run, step, loss.  The early-stopping fold of each run; state is per run, never global."""
    series = losses.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("series"))
    return series.select("run", early_stop(F.col("series"), patience, every, minimum, delta).alias("s")).select("run", "s.best", "s.best_step", "s.evals", "s.stopped")


def loss_tail(losses: DataFrame, n: int = 200) -> DataFrame:
    """The last n losses of each run."""
    w = Window.partitionBy("run").orderBy(F.desc("step"))
    return losses.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def trainable(names: Column, parts: list[str]) -> Column:
    """Whether a parameter trains: its name holds one of the parts; "*" alone means all."""
    if parts == ["*"]:
        return F.lit(True)
    if "*" in parts or not parts:
        raise ValueError('"*" stands alone, and the list is not empty')
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(names, F.lit(part))
    return out
