"""One interface for all tokenizers: train, encode, token strings, decode, artifacts.

A tokenizer encodes a frame (a column `ids` is added, and `char_ids` where the
embedding is made of characters), gives the token strings of single words, which
is what morphological metrics look at, and is stored as Parquet tables beside a
manifest, never as pickled objects.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harfmill.functions.arabic import words
from harfmill.operators import corpora, rootpattern, subword, vocabulary
from harfmill.operators import tokenizers as plain
from harfmill.operators.registry import tokenizers as registry
from harfmill.sources.results import load_vocab, save_vocab

#: What the embedding layer of a model needs.
STANDARD, CHARACTER_CNN, CHARACTERS, BYTES = "standard", "character_cnn", "characters", "bytes"


class Tokenizer(ABC):
    """`params` are what it was made with; they go into the manifest."""

    name = ""
    embedding_type = STANDARD
    special_tokens = {"pad_token": 0, "bos_token": 1, "eos_token": 2, "unk_token": 3}

    def __init__(self, **params: Any) -> None:
        self.params = params

    @abstractmethod
    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        """Learn from a frame's texts; returns itself."""

    @abstractmethod
    def ids(self, frame: DataFrame, column: str) -> DataFrame:
        """The frame with `ids` of whole texts."""

    @abstractmethod
    def tokens(self, sample: DataFrame) -> DataFrame:
        """sample: word.  (word, tokens): each word's token strings, without bos and eos."""

    @abstractmethod
    def decode(self, ids: Column) -> Column:
        """The text of ids."""

    @abstractmethod
    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """What is stored; `vocab` has token and id."""

    @abstractmethod
    def restore(self, spark: SparkSession, path: str, vocab: DataFrame) -> None:
        """Back from what is stored."""

    @property
    @abstractmethod
    def vocab_size(self) -> int: ...

    @property
    def pad_token_id(self) -> int:
        return self.special_tokens["pad_token"]

    def embedding_config(self) -> dict[str, Any]:
        """What the embedding layer needs beside the vocabulary's size."""
        return {}

    def encode(self, frame: DataFrame, column: str = "text", max_length: int | None = None, padding: bool = False, truncation: bool = False) -> DataFrame:
        out = self.ids(frame, column)
        return out.withColumn("ids", plain.truncate_pad(F.col("ids").cast("array<bigint>"), max_length, padding, truncation, self.pad_token_id))

    def save(self, spark: SparkSession, path: str) -> None:
        tables = self.tables(spark)
        save_vocab(tables.pop("vocab"), path, name=self.name, vocab_size=self.vocab_size, special_tokens=self.special_tokens, params=self.params)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tokenizer:
        """The stored tokenizer of whatever kind; ValueError where manifest and tables disagree."""
        vocab, manifest = load_vocab(spark, path)
        out = registry.get(manifest["name"])(**manifest["params"])
        out.restore(spark, path, vocab)
        if out.vocab_size != manifest["vocab_size"]:
            raise ValueError(f"{path}: the manifest says {manifest['vocab_size']} entries, the table has {out.vocab_size}")
        return out


def _pairs(spark: SparkSession, vocab: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(vocab.items(), key=lambda x: x[1]), "token string, id long")


class _Subword(Tokenizer):
    kind = ""

    def _texts(self, frame: DataFrame, column: str) -> DataFrame:
        return frame

    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        self.model = subword.Subword.train(self._texts(frame, column), self.kind, vocab_size or 32_000, column=column)
        return self

    def ids(self, frame: DataFrame, column: str) -> DataFrame:
        """Texts in other columns stay as they are, also where this one is segmented first."""
        seen = self._texts(frame.select("*", F.col(column).alias("hm_text")), "hm_text")
        return seen.withColumn("ids", self.model.encode_column(F.col("hm_text"))).drop("hm_text")

    def tokens(self, sample: DataFrame) -> DataFrame:
        seen = self._texts(sample.select("word", F.col("word").alias("hm_text")), "hm_text")
        return seen.select("word", self.model.pieces_column(F.col("hm_text")).alias("tokens"))

    def decode(self, ids: Column) -> Column:
        model = self.model

        @F.pandas_udf("string")
        def run(lists: pd.Series) -> pd.Series:
            return pd.Series([model.decode([int(i) for i in x]) for x in lists], dtype=object)

        return run(ids)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        merges = [(k, a, b) for k, (a, b) in enumerate(self.model.merges)]
        return {"vocab": _pairs(spark, self.model.vocab), "merges": spark.createDataFrame(merges, "rank long, left string, right string")}

    def restore(self, spark: SparkSession, path: str, vocab: DataFrame) -> None:
        entries = {r.token: r.id for r in vocab.orderBy("id").collect()}
        merges = [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        if sorted(entries.values()) != list(range(len(entries))):
            raise ValueError(f"{path}: ids are not 0, 1, 2, ...")
        if any(a not in entries or b not in entries for a, b in merges):
            raise ValueError(f"{path}: a merge joins tokens that the vocabulary lacks")
        self.model = subword.Subword(self.kind, entries, merges)

    @property
    def vocab_size(self) -> int:
        return len(self.model.vocab)


@registry.register("bpe")
class Bpe(_Subword):
    name, kind = "bpe", "bpe"


@registry.register("wordpiece")
class WordPiece(_Subword):
    name, kind = "wordpiece", "wordpiece"


@registry.register("morpho_bpe")
class MorphoBpe(_Subword):
    """BPE over the morphemes of segmented texts."""

    name, kind = "morpho_bpe", "plain_bpe"

    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        self.model = subword.Subword.learn(subword.count_segmented(frame, column), self.kind, vocab_size or 32_000)
        return self

    def _texts(self, frame: DataFrame, column: str) -> DataFrame:
        return corpora.segmented(frame, column)


class _Vocabulary(Tokenizer):
    """Tokenizers whose vocabulary is a table; it stays a DataFrame."""

    def restore(self, spark: SparkSession, path: str, vocab: DataFrame) -> None:
        self.vocab = vocab

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"vocab": self.vocab.select("token", F.col("id").cast("long").alias("id"))}


@registry.register("char")
class Char(_Vocabulary):
    name, embedding_type = "char", CHARACTERS

    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        self.vocab = vocabulary.char_vocab(frame, column)
        return self

    def ids(self, frame: DataFrame, column: str) -> DataFrame:
        return plain.encode_char(frame, self.vocab, column)

    def tokens(self, sample: DataFrame) -> DataFrame:
        known = {r.token for r in self.vocab.collect()} | {" "}  # as many as there are signs
        every = F.filter(F.split("word", ""), lambda ch: ch != "")
        return sample.select("word", F.transform(every, lambda ch: F.when(ch.isin(*known), ch).otherwise("<unk>")).alias("tokens"))

    def decode(self, ids: Column) -> Column:
        names = {r.id: r.token for r in self.vocab.collect()}
        return plain.decode_char(ids, F.array(*[F.lit(names.get(k, "")) for k in range(max(names, default=4) + 1)]))

    @property
    def vocab_size(self) -> int:
        return self.vocab.count() + 5

    def embedding_config(self) -> dict[str, Any]:
        return {"char_vocab_size": self.vocab_size, "downsample_factor": self.params.get("downsample_factor", 4)}


@registry.register("byte")
class Byte(Tokenizer):
    name, embedding_type = "byte", BYTES

    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        return self

    def ids(self, frame: DataFrame, column: str) -> DataFrame:
        return frame.withColumn("ids", plain.encode_bytes(F.coalesce(column, F.lit(""))))

    def tokens(self, sample: DataFrame) -> DataFrame:
        digits = F.regexp_extract_all(F.lower(F.hex(F.encode("word", "UTF-8"))), F.lit("(..)"))
        return sample.select("word", F.transform(digits, lambda h: F.concat(F.lit("0x"), h)).alias("tokens"))

    def decode(self, ids: Column) -> Column:
        return plain.decode_bytes(ids)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"vocab": spark.range(256).select(F.format_string("0x%02x", "id").alias("token"), (F.col("id") + 4).alias("id"))}

    def restore(self, spark: SparkSession, path: str, vocab: DataFrame) -> None:
        if vocab.count() + 4 != plain.BYTE_VOCAB:
            raise ValueError(f"{path}: a byte vocabulary has {plain.BYTE_VOCAB} entries")

    @property
    def vocab_size(self) -> int:
        return plain.BYTE_VOCAB

    def embedding_config(self) -> dict[str, Any]:
        # The defaults of the gradient-based block embedding.
        defaults = {"max_block_size": 4, "downsample_rate": 2, "conv_kernel_size": 5, "block_attention": False}
        return {"vocab_size": self.vocab_size} | {k: self.params.get(k, v) for k, v in defaults.items()}


@registry.register("word_char")
class WordChar(_Vocabulary):
    """Word ids for the output, and each word's characters for the embedding."""

    name, embedding_type = "word_char", CHARACTER_CNN
    max_chars = 50

    def _texts(self, frame: DataFrame, column: str) -> DataFrame:
        return frame

    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        seen = self._texts(frame, column).select(F.monotonically_increasing_id().alias("doc_id"), F.col(column).alias("text"))
        self.vocab = vocabulary.word_vocab(seen, vocab_size or 50_000)
        self.characters = vocabulary.ranked(vocabulary.characters(seen), [F.col("token")], 1_114_112, len(plain.CHAR_RESERVED))
        return self

    def ids(self, frame: DataFrame, column: str) -> DataFrame:
        """ids, and char_ids: a vector of `max_chars` for bos, each word, and eos."""
        seen = self._texts(frame.select("*", F.col(column).alias("hm_text")), "hm_text")
        codes, longest = plain.code_table(self.characters), self.params.get("max_char_len", self.max_chars)
        seen = plain.encode_words(seen, self.vocab, "hm_text").crossJoin(F.broadcast(codes))  # one row, bounded by the signs there are
        lone = lambda k: F.array(plain.truncate_pad(F.array(F.lit(k).cast("long")), longest, True, True))
        body = F.transform(F.coalesce(words(F.col("hm_text")), F.array().cast("array<string>")), lambda w: plain.word_char_ids(w, F.col("codes"), longest))
        vectors = F.concat(lone(plain.CHAR_RESERVED["bos"]), body, lone(plain.CHAR_RESERVED["eos"]))
        return seen.withColumn("char_ids", vectors).drop("codes", "hm_text")

    def encode(self, frame: DataFrame, column: str = "text", max_length: int | None = None, padding: bool = False, truncation: bool = False) -> DataFrame:
        out = super().encode(frame, column, max_length, padding, truncation)
        if max_length and truncation:
            out = out.withColumn("char_ids", F.slice("char_ids", 1, max_length))
        if max_length and padding:
            empty = F.array_repeat(F.lit(0).cast("long"), self.params.get("max_char_len", self.max_chars))
            out = out.withColumn("char_ids", F.concat("char_ids", F.array_repeat(empty, F.greatest(F.lit(max_length) - F.size("char_ids"), F.lit(0)))))
        return out

    def tokens(self, sample: DataFrame) -> DataFrame:
        seen = self._texts(sample.select("word", F.col("word").alias("hm_text")), "hm_text")
        return seen.select("word", words(F.col("hm_text")).alias("tokens"))

    def decode(self, ids: Column) -> Column:
        names = [r.token for r in self.vocab.orderBy("id").collect()]  # capped

        @F.pandas_udf("string")
        def run(lists: pd.Series) -> pd.Series:
            return pd.Series([" ".join(names[i - 4] if i > 3 else "<unk>" for i in x if i == 3 or i > 3) for x in lists], dtype=object)

        return run(ids)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return super().tables(spark) | {"characters": self.characters}

    def restore(self, spark: SparkSession, path: str, vocab: DataFrame) -> None:
        self.vocab, self.characters = vocab, spark.read.parquet(f"{path}/characters")

    @property
    def vocab_size(self) -> int:
        return self.vocab.count() + 4

    def embedding_config(self) -> dict[str, Any]:
        # Widths and numbers of the character filters.
        filters = [[1, 32], [2, 32], [3, 64], [4, 128], [5, 256], [6, 512], [7, 1024]]
        return {
            "char_vocab_size": self.characters.count() + len(plain.CHAR_RESERVED), "char_embed_dim": 16, "max_char_len": self.params.get("max_char_len", self.max_chars),
            "cnn_filters": filters, "num_highway_layers": 2, "output_vocab_size": self.vocab_size,
        }


@registry.register("segmented_word_char")
class SegmentedWordChar(WordChar):
    """The same over morphemes, which are shorter."""

    name, max_chars = "segmented_word_char", 25

    def _texts(self, frame: DataFrame, column: str) -> DataFrame:
        return corpora.segmented(frame, column)


@registry.register("root_pattern")
class RootPatternTokenizer(Tokenizer):
    name = "root_pattern"

    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        seen = frame.select(F.monotonically_increasing_id().alias("doc_id"), F.col(column).alias("text"))
        self.analyses = rootpattern.analysis_table(seen)
        p = self.params
        self.model = rootpattern.RootPattern.train(self.analyses, p.get("max_roots", 10_000), p.get("max_patterns", 500), p.get("min_count", 2))
        return self

    def ids(self, frame: DataFrame, column: str) -> DataFrame:
        return self.model.encode_frame(frame, column)

    def tokens(self, sample: DataFrame) -> DataFrame:
        return self.model.encode_frame(sample.select("word"), "word", as_tokens=True).select("word", "tokens")

    def decode(self, ids: Column) -> Column:
        return self.model.decode_column(ids)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """vocab, reconstruction (root, pattern, surface), and where roots come from: five words of each."""
        surfaces = [(r, p, s) for (r, p), s in sorted(self.model.surfaces.items())]
        out = {"vocab": _pairs(spark, self.model.vocab), "reconstruction": spark.createDataFrame(surfaces, "root string, pattern string, surface string")}
        if getattr(self, "analyses", None) is not None:
            entries = self.analyses.where("root is not null and pattern is not null").select("root", "word", F.col("first").alias("pos"))
            out["examples"] = vocabulary.examples(entries, "root").select("root", "word", "rank")
        return out

    def restore(self, spark: SparkSession, path: str, vocab: DataFrame) -> None:
        tokens = [r.token for r in vocab.orderBy("id").collect()]
        kind = lambda k: [t[len(k) + 2 : -1] for t in tokens if t.startswith(f"[{k}_")]
        surfaces = {(r.root, r.pattern): r.surface for r in spark.read.parquet(f"{path}/reconstruction").collect()}
        self.model, self.analyses = rootpattern.RootPattern(kind("ROOT"), kind("PAT"), surfaces), None
        if self.model.tokens != tokens:
            raise ValueError(f"{path}: the tokens are not those of this alphabet")

    @property
    def vocab_size(self) -> int:
        return len(self.model.tokens)


@registry.register("pretrained")
class Pretrained(Tokenizer):
    """A tokenizer file of the public library, used as it is; params: path, bos, eos, unk (ids).  Texts get bos only."""

    name = "pretrained"

    @property
    def special_tokens(self) -> dict[str, int]:  # type: ignore[override]
        p = self.params
        return {"pad_token": p["eos"], "bos_token": p["bos"], "eos_token": p["eos"], "unk_token": p["unk"]}

    def train(self, frame: DataFrame, column: str = "text", vocab_size: int | None = None) -> Tokenizer:
        return self

    def _library(self):
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.params["path"])

    def _run(self, c: Column, kind: str) -> Column:
        load, bos = self._library, self.params["bos"]

        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            found = load().encode_batch([t or "" for t in texts], add_special_tokens=False)
            return pd.Series([e.tokens if kind == "array<string>" else [bos, *e.ids] for e in found])

        return run(c)

    def ids(self, frame: DataFrame, column: str) -> DataFrame:
        return frame.withColumn("ids", self._run(F.col(column), "array<bigint>"))

    def tokens(self, sample: DataFrame) -> DataFrame:
        return sample.select("word", self._run(F.col("word"), "array<string>").alias("tokens"))

    def decode(self, ids: Column) -> Column:
        load, bos = self._library, self.params["bos"]

        @F.pandas_udf("string")
        def run(lists: pd.Series) -> pd.Series:
            return pd.Series(load().decode_batch([[int(i) for i in x if i != bos] for x in lists]), dtype=object)

        return run(ids)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"vocab": _pairs(spark, self._library().get_vocab(with_added_tokens=True))}

    def restore(self, spark: SparkSession, path: str, vocab: DataFrame) -> None:
        """The file itself is not copied: the manifest names its place."""

    @property
    def vocab_size(self) -> int:
        return self._library().get_vocab_size()


def token_table(sample: DataFrame, chosen: dict[str, Tokenizer]) -> DataFrame:
    """(word, family, tokens) of a sample's words by several tokenizers.  A word without tokens has an empty list."""
    out = None
    for name, tokenizer in chosen.items():
        rows = tokenizer.tokens(sample).select("word", F.lit(name).alias("family"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no tokenizers")
    return out


def manifest_of(spark: SparkSession, path: str) -> dict[str, Any]:
    """A stored tokenizer's manifest."""
    return json.loads(spark.read.json(f"{path}/manifest").first()["manifest"])


