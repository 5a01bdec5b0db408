"""Character, word-character and byte tokenizers: Columns and joins; word look-up by Arrow's hash table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfmill.functions.arabic import words

# Reserved ids.
PAD, BOS, EOS, UNK, SPACE = 0, 1, 2, 3, 4
CHAR_RESERVED = {"pad": 0, "bow": 1, "eow": 2, "unk": 3, "bos": 4, "eos": 5, "unk_word": 6}
BYTE_VOCAB = 260


def truncate_pad(ids: Column, max_length: int | None, padding: bool, truncation: bool, pad: int = PAD) -> Column:
    """Cut and padded ids; each only if asked for and a length is given."""
    if max_length and truncation:
        ids = F.slice(ids, 1, max_length)
    if max_length and padding:
        ids = F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))))
    return ids


def code_table(vocab: DataFrame) -> DataFrame:
    """One row with an array that holds each code point's id at its place: a lookup in constant time.

    Its size is bounded by the code points there are, so it may be broadcast.
    """
    entries = vocab.select(F.ascii("token").alias("code"), "id").agg(F.map_from_entries(F.collect_list(F.struct("code", "id"))).alias("m"), F.max("code").alias("top"))
    return entries.select(F.transform(F.sequence(F.lit(0), F.coalesce("top", F.lit(0))), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(UNK).cast("long"))).alias("codes"))


def encode_char(frame: DataFrame, vocab: DataFrame, column: str = "text") -> DataFrame:
    """ids: bos, a character each (space 4, unknown 3), eos."""
    codes = code_table(vocab)
    one = lambda ch: F.when(ch == " ", F.lit(SPACE).cast("long")).otherwise(F.coalesce(F.try_element_at(F.col("codes"), F.ascii(ch) + 1), F.lit(UNK).cast("long")))
    body = F.transform(F.filter(F.split(F.coalesce(column, F.lit("")), ""), lambda ch: ch != ""), one)
    return frame.crossJoin(F.broadcast(codes)).withColumn("ids", F.concat(F.array(F.lit(BOS).cast("long")), body, F.array(F.lit(EOS).cast("long")))).drop("codes")


def decode_char(ids: Column, tokens: Column) -> Column:
    """tokens: array with the token of id k at place k + 1."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i > UNK), lambda i: F.when(i == SPACE, " ").otherwise(F.element_at(tokens, i.cast("int") + 1))), "")


def encode_bytes(c: Column) -> Column:
    """bos, byte + 4 each, eos."""
    hexes = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"))
    body = F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("long") + 4)
    return F.concat(F.array(F.lit(BOS).cast("long")), body, F.array(F.lit(EOS).cast("long")))


def decode_bytes(ids: Column) -> Column:
    """The text of byte ids; specials go, invalid UTF-8 becomes U+FFFD."""
    hexes = F.transform(F.filter(ids, lambda i: i > UNK), lambda i: F.lpad(F.hex(i - 4), 2, "0"))
    return F.make_valid_utf8(F.unhex(F.array_join(hexes, "")).cast("string"))


def encode_words(frame: DataFrame, vocab: DataFrame, column: str = "text", limit: int = 1_000_000) -> DataFrame:
    """frame with ids: bos, a word each (unknown 3), eos.  A narrow map: no word leaves its row.

    Words are split by Spark and looked up by Arrow's hash table, all words of a
    batch at once.  The vocabulary is capped where it is made; one of more than
    `limit` words is refused, as every worker holds it.
    """
    table = vocab.select("token", "id").limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise ValueError(f"a vocabulary of more than {limit} words")
    known = frame.sparkSession.sparkContext.broadcast((table.column("token").combine_chunks(), table.column("id").to_numpy().astype(np.int64)))

    @F.arrow_udf("array<bigint>")
    def look_up(lists: pa.Array) -> pa.Array:
        tokens, ids = known.value
        flat, edge = flattened(lists)
        at = pc.index_in(flat, value_set=tokens).fill_null(len(ids)).to_numpy(zero_copy_only=False)
        return framed(np.append(ids, UNK)[at], edge)

    return frame.withColumn("ids", look_up(words(F.col(column))))


def flattened(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column, and the bounds of its rows (null: empty)."""
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def framed(ids: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Lists of ids with bos before and eos behind each."""
    size = np.diff(edge) + 2
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, EOS, np.int64)
    inside = np.ones(len(out), bool)
    inside[ends - size] = inside[ends - 1] = False
    out[ends - size] = BOS
    out[inside] = ids
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out, pa.int64()))


def word_char_ids(word: Column, codes: Column, max_chars: int) -> Column:
    """A word as a fixed-length character vector: bow, up to max_chars - 2 characters, eow, padding."""
    one = lambda ch: F.coalesce(F.try_element_at(codes, F.ascii(ch) + 1), F.lit(UNK).cast("long"))
    body = F.transform(F.slice(F.filter(F.split(word, ""), lambda ch: ch != ""), 1, max_chars - 2), one)
    lone = lambda k: F.array(F.lit(k).cast("long"))
    return truncate_pad(F.concat(lone(CHAR_RESERVED["bow"]), body, lone(CHAR_RESERVED["eow"])), max_chars, True, True)
