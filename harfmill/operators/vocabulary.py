"""Vocabularies as tables (token, id): counts by hash aggregation, ids by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harfmill.operators.corpora import occurrence, word_rows


def ranked(counts: DataFrame, order: list, cap: int, first_id: int) -> DataFrame:
    """The first `cap` rows in an order, with ids from first_id: top-k first, so that the ranking window sees at most `cap` rows."""
    top = counts.orderBy(*order).limit(cap)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(*order)) + (first_id - 1)).cast("long"))


def characters(frame: DataFrame, column: str = "text") -> DataFrame:
    """Distinct characters."""
    return frame.select(F.explode(F.array_distinct(F.split(column, ""))).alias("token")).where("token <> ''").distinct()


def char_vocab(frame: DataFrame, column: str = "text") -> DataFrame:
    """Ids after the reserved ones: 4 is the space, then the characters by code point."""
    found = characters(frame, column).where("token <> ' '")
    return ranked(found, [F.col("token")], 1_114_112, 5)


def word_counts(frame: DataFrame) -> DataFrame:
    """word, cnt, and where it first occurs."""
    rows = word_rows(frame, "doc_id")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"), F.min(occurrence()).alias("first"))


def top_words(counts: DataFrame, cap: int) -> DataFrame:
    """counts: word, cnt, first.  Words by falling count, ties by first occurrence, from id 4."""
    return ranked(counts, [F.desc("cnt"), F.col("first")], cap, 4).select(F.col("word").alias("token"), "cnt", "id")


def word_vocab(frame: DataFrame, cap: int = 50_000) -> DataFrame:
    """The vocabulary of a frame's words."""
    return top_words(word_counts(frame), cap)


def counted(tokens: DataFrame, cap: int, min_count: int, first_id: int = 0) -> DataFrame:
    """Tokens (column token) by falling count, then by token; at least min_count."""
    counts = tokens.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)
    return ranked(counts, [F.desc("cnt"), F.col("token")], cap, first_id)


def reconstruction(entries: DataFrame) -> DataFrame:
    """The most frequent surface of each (root, pattern), ties by first occurrence; entries: root, pattern, surface, pos."""
    counts = entries.groupBy("root", "pattern", "surface").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first"))
    return counts.groupBy("root", "pattern").agg(F.max_by("surface", F.struct("cnt", (-F.col("first")).alias("f"), "surface")).alias("surface"))


def examples(entries: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The first n distinct words of each key in order of pos."""
    first = entries.groupBy(by, "word").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy(by).orderBy("pos", "word")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
