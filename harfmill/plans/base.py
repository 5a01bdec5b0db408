"""The catalogue's registry, table access, and SQL fragments that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harfmill.functions.arabic import ARABIZE_FROM, ARABIZE_TO, LETTERS, MARKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a directory by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def values(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query (a function of Tables) and its DuckDB SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def joined_md5(ids: Column) -> Column:
    return F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").cast("binary"))


def values_sql(columns: str, rows: list[tuple]) -> str:
    """(VALUES ...) AS v(columns)."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns})"


ARAB = rf"SELECT doc_id, lang, source, regexp_replace(translate(lower(text), '{ARABIZE_FROM}', '{ARABIZE_TO}'), '[^{LETTERS}\s]', '', 'g') AS text FROM documents"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


def words_sql(text: str = "text") -> str:
    return WORDS.format(text)


def skeleton_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[^{LETTERS}]', '', 'g'), '[اوي]', '', 'g')"


def root_sql(c: str) -> str:
    s = skeleton_sql(c)
    return f"(CASE WHEN length({s}) > 4 THEN substr({s}, 1, 3) WHEN length({s}) >= 3 THEN {s} END)"


def span_sql(text: str, root: str) -> str:
    """The stem span's pattern, by capture groups."""
    r = [f"substr({root}, {k}, 1)" for k in range(1, 5)]
    three = f"'(?s)' || {r[0]} || '(.*?)' || {r[1]} || '(.*?)' || {r[2]}"
    four = f"{three} || '(.*?)' || {r[3]}"
    g = lambda p, k: f"regexp_extract({text}, {p}, {k})"
    return (
        f"(CASE WHEN length({root}) = 4 AND regexp_matches({text}, {four}) THEN 'ف' || {g(four, 1)} || 'ع' || {g(four, 2)} || 'ل' || {g(four, 3)} || 'ل'"
        f" WHEN length({root}) = 3 AND regexp_matches({text}, {three}) THEN 'ف' || {g(three, 1)} || 'ع' || {g(three, 2)} || 'ل' END)"
    )


def pattern_sql(text: str, root: str) -> str:
    """The whole text's pattern, by capture groups."""
    r = [f"substr({root}, {k}, 1)" for k in range(1, 5)]
    three = f"'(?s)^(.*?)' || {r[0]} || '(.*?)' || {r[1]} || '(.*?)' || {r[2]} || '(.*)$'"
    four = f"'(?s)^(.*?)' || {r[0]} || '(.*?)' || {r[1]} || '(.*?)' || {r[2]} || '(.*?)' || {r[3]} || '(.*)$'"
    g = lambda p, k: f"regexp_extract({text}, {p}, {k})"
    return (
        f"(CASE WHEN length({root}) = 4 AND regexp_matches({text}, {four}) THEN {g(four, 1)} || 'ف' || {g(four, 2)} || 'ع' || {g(four, 3)} || 'ل' || {g(four, 4)} || 'ل' || {g(four, 5)}"
        f" WHEN length({root}) = 3 AND regexp_matches({text}, {three}) THEN {g(three, 1)} || 'ف' || {g(three, 2)} || 'ع' || {g(three, 3)} || 'ل' || {g(three, 4)} END)"
    )


def subsequence_sql(text: str, root: str) -> str:
    return f"regexp_matches({text}, '(?s)' || array_to_string(string_split({root}, ''), '.*'))"


def segment_sql(word: str) -> str:
    from harfmill.functions.morphology import SEGMENTS

    parts = ", ".join(f"regexp_extract({word}, '{SEGMENTS}', {k})" for k in range(1, 6))
    return f"(CASE WHEN regexp_matches({word}, '{SEGMENTS}') THEN list_filter([{parts}], lambda p: p <> '') WHEN {word} <> '' THEN [{word}] END)"


MARKS_SQL = MARKS
WORD_ROWS = f"SELECT doc_id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, lang, {words_sql()} AS ws FROM documents)"
ARAB_WORDS = f"SELECT doc_id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, lang, {words_sql()} AS ws FROM arab)"
#: 500 distinct words of three signs or more, in hash order.
SAMPLE = f"arab AS ({ARAB}), arab_words AS ({ARAB_WORDS}), sample AS (SELECT word FROM (SELECT DISTINCT word FROM arab_words WHERE length(word) >= 3) ORDER BY md5(word), word LIMIT 500)"
