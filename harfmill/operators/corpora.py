"""Corpus preparation: splits, samples, filters, text columns, question-answer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harfmill.functions.arabic import arabize, nfkc, normalize, words
from harfmill.functions.morphology import segment

# The columns looked for, in this order.
TEXT_COLUMNS = ["text", "content", "sentence", "document", "passage"]


def text_column(schema: T.StructType) -> str:
    """The text column of a schema: a usual name, else the first string column."""
    for name in TEXT_COLUMNS:
        if name in schema.names:
            return name
    for field in schema.fields:
        if isinstance(field.dataType, T.StringType):
            return field.name
    raise ValueError(f"no text column among {schema.names}")


def hash_split(key: Column, parts: int = 10) -> Column:
    """eval for about one key in `parts`, else train; decided by the key alone, so it never changes."""
    return F.when(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % parts == 0, "eval").otherwise("train")


def sample(frame: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of the key's hash, all if there are fewer; no global sort, n rows a task at most."""
    return frame.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def preprocess(frame: DataFrame, column: str = "text", min_length: int = 10, compose: bool = True, marks: bool = False) -> DataFrame:
    """Normalised texts (null: empty) of at least min_length signs."""
    text = F.coalesce(F.col(column), F.lit(""))
    out = frame.withColumn(column, normalize(nfkc(text) if compose else text, marks=marks))
    return out.where(F.length(column) >= min_length) if min_length > 0 else out


def arabized(documents: DataFrame) -> DataFrame:
    """Documents in the stand-in alphabet."""
    return documents.select("doc_id", "lang", "source", arabize(F.col("text")).alias("text"))


def segmented(frame: DataFrame, column: str = "text") -> DataFrame:
    """Texts with a space between the morphemes of each word."""
    parts = F.flatten(F.transform(words(F.col(column)), lambda w: F.coalesce(segment(w), F.array(w))))
    return frame.withColumn(column, F.array_join(parts, " "))


def occurrence(doc: str = "doc_id", pos: str = "pos") -> Column:
    """Where a word stands, as one number that orders like (document, position): unlike a struct, its minimum is hash-aggregated."""
    return F.col(doc).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(pos).cast("decimal(10,0)")


def word_rows(frame: DataFrame, *keep: str, column: str = "text") -> DataFrame:
    """(kept columns, pos, word), a row for each word."""
    return frame.select(*keep, F.posexplode(words(F.col(column))).alias("pos", "word"))


def word_sample(frame: DataFrame, n: int = 500) -> DataFrame:
    """The sample that morphological metrics share: n distinct words of three signs or more, in hash order."""
    distinct = frame.select(F.explode(words(F.col("text"))).alias("word")).distinct().where(F.length("word") >= 3)
    return sample(distinct, "word", n)


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Question-answer records: a user turn, the assistant turn after it, the turn before as context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"), F.lag("text").over(w).alias("before"))
    pairs = turns.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return pairs.select("conv_id", "turn", F.col("text").alias("question"), "answer", F.coalesce("before", F.lit("")).alias("context"))


def union_corpora(corpora: dict[str, dict[str, DataFrame]], names: list[str], splits: str | dict[str, str]) -> DataFrame:
    """Corpora in order, each with the split that is asked for."""
    out = None
    for name in names:
        if name not in corpora:
            raise KeyError(f"unknown corpus {name!r}; known: {sorted(corpora)}")
        split = splits if isinstance(splits, str) else splits[name]
        part = corpora[name][split].withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no corpora")
    return out


def squad_records(rows: DataFrame) -> DataFrame:
    """index, question, context, text: records without empty fields."""
    return _full(rows.select(F.col("index").cast("string").alias("id"), "question", "context", F.col("text").alias("answer")))


def span_records(rows: DataFrame, prefix: str | None = None) -> DataFrame:
    """Rows with answers.text, of ids with a prefix: the first answer, without empty fields."""
    if prefix:
        rows = rows.where(F.col("id").startswith(prefix))
    return _full(rows.select("id", "question", "context", F.try_element_at(F.col("answers.text"), F.lit(1)).alias("answer")))


def _full(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("question", F.lit("")) != "") & (F.coalesce("context", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""))
