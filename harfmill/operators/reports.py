"""Comparison tables over many runs: flattening, pivots, rankings, trends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(frame: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(schema: T.StructType, path: str = "") -> list[str]:
        out = []
        for f in schema.fields:
            name = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            out += leaves(f.dataType, name) if isinstance(f.dataType, T.StructType) else [name]
        return out

    return frame.select(*[F.col(n).alias(n.replace("`", "")) for n in leaves(frame.schema)])


def comparison(long: DataFrame, row: str, column: str, value: str, keys: list[str]) -> DataFrame:
    """A row for each metric and a column for each run; what a run lacks is a dash."""
    wide = long.groupBy(row).pivot(column, keys).agg(F.first(F.format_string("%.4f", F.col(value))))
    return wide.select(row, *[F.coalesce(F.col(k), F.lit("—")).alias(k) for k in keys])


def top_per(frame: DataFrame, by: str, score: str, tie: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return frame.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_gap(frame: DataFrame, task: str, family: str, score: str, rival: str) -> DataFrame:
    """Per task the best score of other families and what the rival lacks to it."""
    best = frame.where(F.col(family) != rival).groupBy(task).agg(F.max(score).alias("best"))
    own = frame.where(F.col(family) == rival).groupBy(task).agg(F.max(score).alias("own"))
    return own.join(best, task).select(task, "own", "best", F.round(F.col("best") - F.col("own"), 6).alias("gap"))


#: Tokenizers whose root conservation is extreme by their nature.
MECHANICAL = {"word": "RPS ceiling: the word is a token", "root_pattern": "RPS ceiling: roots are tokens", "char": "RPS floor: a letter holds no root", "byte": "RPS floor: a byte holds no letter"}
#: Tasks whose labels are known to be noisy.
NOISY = {"acva": "generated questions: some labels are wrong, and some rows occur with both labels"}


def summary(frame: DataFrame, by: str, columns: dict[str, str], first_by: str, rank_by: str) -> DataFrame:
    """Per configuration the first value or the mean of each column, and its rank by one of them, best first."""
    take = {"first": lambda c: F.min_by(c, first_by), "mean": lambda c: F.round(F.avg(c), 4)}
    out = frame.groupBy(by).agg(*[take[how](c).alias(c) for c, how in columns.items()])
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(rank_by), by)).cast("long"))  # a row a configuration


def first_per(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the first by an order: a deterministic dropDuplicates."""
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def place(column: str, order: list[str]) -> Column:
    """A value's place in a fixed order, 0 if it is not there: what categories are sorted by."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)).cast("long")


def grid(kinds: DataFrame, sizes: DataFrame) -> DataFrame:
    """The cells of a sweep: every kind with every size.  Both are a configuration's few rows."""
    return kinds.crossJoin(F.broadcast(sizes))


def resume(cells: DataFrame, done: DataFrame, key: str = "cell") -> DataFrame:
    """Cells of a sweep that have no result yet."""
    return cells.join(done.select(key), key, "left_anti")


def sweep(cells: list[dict], run: Callable[[dict], dict], done: dict[str, dict]) -> dict[str, dict]:
    """Each cell's results; a failing cell becomes an error entry, and the others go on."""
    out = dict(done)
    for cell in cells:
        name = cell_name(cell["type"], cell.get("vocab_size"))
        if name not in out:
            try:
                out[name] = run(cell)
            except Exception as error:  # a sweep survives any cell
                out[name] = {"error": str(error)}
    return out


def cell_name(kind: str, vocab_size: int | None) -> str:
    return f"{kind}_{vocab_size // 1000}k" if vocab_size else kind
