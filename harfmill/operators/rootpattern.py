"""The root-and-pattern tokenizer: clitics, a root token and a pattern token a word, literal characters otherwise.

Words are analysed once each, by rule (morphology.segment and the consonant
root of the stem) unless an analysis table is given.  The vocabulary is ranked
by Spark; encoding and decoding are Arrow UDFs with it in their closure.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfmill.functions.arabic import LETTERS, LONG_VOWELS, MARKS, PUNCTUATION, alpha_chunks, root_of_skeleton, strip_marks
from harfmill.functions.morphology import ENCLITICS, PROCLITICS, SEGMENTS, stem_span
from harfmill.functions.scoring import let
from harfmill.operators.corpora import occurrence
from harfmill.operators.vocabulary import counted, reconstruction

SPECIALS = ["<pad>", "<s>", "</s>", "<unk>", "[LIT_BEGIN]", "[LIT_END]"]
PAD, BOS, EOS, UNK, LIT_BEGIN, LIT_END = range(6)
_ALPHA = re.compile(f"[{LETTERS}{MARKS}]+|[0-9٠-٩]+|[{re.escape(PUNCTUATION)}]+|[^{LETTERS}{MARKS}0-9٠-٩{re.escape(PUNCTUATION)}]+")


_LETTER, _CHUNK = re.compile(f"[{LETTERS}{MARKS}]"), re.compile(f"[{LETTERS}{MARKS}]+")
_SEGMENTS, _NO_MARKS = re.compile(SEGMENTS), str.maketrans("", "", MARKS)
_CONSONANTS = re.compile(f"[^{LETTERS}]|[{LONG_VOWELS}]")

_CUT = "\u0001"


def analyse(chunks: DataFrame, *keep: str) -> DataFrame:
    """chunks: word, distinct.  word, root, pattern (of the stem, null where not analysable), proclitics, stem, enclitic.

    A column that is kept ties the analysis to the grouping that made the words
    distinct, so that a filter on a root is not moved below it, to every
    occurrence of every word.
    """
    word = F.when(F.col(keep[0]).isNotNull(), F.col("word")) if keep else F.col("word")
    cut = let(strip_marks(word), lambda v: F.struct(v.alias("bare"), F.split(F.regexp_replace(v, SEGMENTS, _CUT.join(f"${k}" for k in range(1, 6))), _CUT, -1).alias("p")))

    def rooted(v: Column) -> Column:
        whole = F.size(v["p"]) != 5  # no stem of three signs
        stem = F.when(whole, v["bare"]).otherwise(F.get(v["p"], F.lit(3)))
        proclitics = F.when(whole, F.array().cast("array<string>")).otherwise(F.filter(F.slice(v["p"], 1, 3), lambda p: p != ""))
        enclitic = F.nullif(F.get(v["p"], F.lit(4)), F.lit(""))
        return let(stem, lambda s: F.struct(s.alias("stem"), root_of_skeleton(s).alias("root"), proclitics.alias("proclitics"), enclitic.alias("enclitic")))

    out = chunks.withColumn("a", let(cut, rooted)).select("word", *keep, "a.*")
    pattern = F.when(F.col("root").isNotNull(), stem_span(F.col("stem"), F.col("root")))
    return out.select("word", "root", pattern.alias("pattern"), "proclitics", "stem", "enclitic", *keep)


def analysis_of(chunk: str) -> tuple[str, str, list[str], str | None] | None:
    """Root, pattern, proclitics and enclitic of a chunk of letters and marks as `analyse` gives them; None where it has no root or pattern."""
    bare = chunk.translate(_NO_MARKS)
    cut = _SEGMENTS.match(bare)
    stem = cut[4] if cut else bare
    root = _CONSONANTS.sub("", stem)
    if len(root) > 4:
        root = root[:3]
    if len(root) < 3:
        return None
    pattern, at = "", -1
    for seat, letter in zip("فعلل", root):
        to = stem.find(letter, at + 1)
        if to < 0:
            return None
        pattern += (stem[at + 1 : to] if at >= 0 else "") + seat
        at = to
    return root, pattern, [c for c in cut.groups()[:3] if c] if cut else [], cut[5] if cut else None


def analysis_table(frame: DataFrame, column: str = "text") -> DataFrame:
    """Analyses of all distinct alpha chunks of a corpus, with where each first occurs."""
    chunks = frame.select("doc_id", F.posexplode(alpha_chunks(F.col(column))).alias("pos", "word"))
    firsts = chunks.groupBy("word").agg(F.min(occurrence()).alias("first"))
    return analyse(firsts, "first")


class RootPattern:
    def __init__(self, roots: list[str], patterns: list[str], surfaces: dict[tuple[str, str], str]) -> None:
        letters = sorted(ch for a, b in re.findall("(.)-(.)", LETTERS) for ch in map(chr, range(ord(a), ord(b) + 1))) + ["ي"]
        tokens = [f"[P_{c}]" for c in PROCLITICS] + [f"[E_{c}]" for c in ENCLITICS]
        tokens += [f"[C_{c}]" for c in letters + sorted(MARKS)] + [f"[D_{c}]" for c in "0123456789٠١٢٣٤٥٦٧٨٩"] + [f"[X_{c}]" for c in PUNCTUATION]
        self.tokens = SPECIALS + tokens + [f"[ROOT_{r}]" for r in roots] + [f"[PAT_{p}]" for p in patterns]
        self.vocab = {t: k for k, t in enumerate(self.tokens)}
        self.surfaces = surfaces
        self._seen: dict[str, list[int]] = {}

    @classmethod
    def train(cls, analyses: DataFrame, max_roots: int = 10_000, max_patterns: int = 500, min_count: int = 2) -> RootPattern:
        """Collects the capped vocabulary and the surfaces of pairs within it; the analyses are made once and kept meanwhile."""
        analyses = analyses.select("root", "pattern", "stem", "first").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return cls._trained(analyses, max_roots, max_patterns, min_count)
        finally:
            analyses.unpersist()

    @classmethod
    def _trained(cls, analyses: DataFrame, max_roots: int, max_patterns: int, min_count: int) -> RootPattern:
        roots = [r[0] for r in counted(analyses.select(F.col("root").alias("token")), max_roots, min_count).orderBy("id").select("token").collect()]
        patterns = [r[0] for r in counted(analyses.select(F.col("pattern").alias("token")), max_patterns, min_count).orderBy("id").select("token").collect()]
        entries = analyses.where("root is not null and pattern is not null").select("root", "pattern", F.col("stem").alias("surface"), F.col("first").alias("pos"))
        known = entries.where(F.col("root").isin(roots) & F.col("pattern").isin(patterns)) if len(roots) + len(patterns) < 2000 else entries.join(
            F.broadcast(entries.sparkSession.createDataFrame([(r,) for r in roots], "root string")), "root", "left_semi"
        ).where(F.col("pattern").isin(patterns))
        return cls(roots, patterns, {(r.root, r.pattern): r.surface for r in reconstruction(known).collect()})

    def _alpha(self, chunk: str, analysis: tuple | None) -> list[int]:
        if analysis:
            root, pattern, proclitics, enclitic = analysis
            r, p = self.vocab.get(f"[ROOT_{root}]"), self.vocab.get(f"[PAT_{pattern}]")
            if r is not None and p is not None:
                return [*(self.vocab[f"[P_{c}]"] for c in proclitics), r, p, *([self.vocab[f"[E_{enclitic}]"]] if enclitic else [])]
        return [LIT_BEGIN, *(self.vocab.get(f"[C_{ch}]", UNK) for ch in chunk), LIT_END]

    def _word(self, word: str, analyses: dict[str, tuple]) -> list[int]:
        out = []
        for run in _ALPHA.findall(word):
            if _LETTER.match(run):
                out += self._alpha(run, analyses.get(run))
            elif run[0].isdecimal() or run[0] in PUNCTUATION:
                kind = "D" if run[0].isdecimal() else "X"
                out += [self.vocab.get(f"[{kind}_{ch}]", UNK) for ch in run]
            else:
                out.append(UNK)
        return out

    def encode(self, text: str, analyses: dict[str, tuple]) -> list[int]:
        return [BOS, *(k for word in unicodedata.normalize("NFKC", text).split() for k in self._word(word, analyses)), EOS]

    def encode_by_rule(self, text: str) -> list[int]:
        """`encode` with the rule's analyses of the chunks of the text as it stands; a word is analysed once and remembered."""
        if not unicodedata.is_normalized("NFKC", text):
            return self.encode(text, {c: a for c in _CHUNK.findall(text) if (a := analysis_of(c))})
        out = [BOS]
        for word in text.split():
            ids = self._seen.get(word)
            if ids is None:
                if len(self._seen) > 500_000:
                    self._seen.clear()
                ids = self._seen[word] = self._word(word, {c: a for c in _CHUNK.findall(word) if (a := analysis_of(c))})
            out += ids
        return [*out, EOS]

    def decode(self, ids: list[int]) -> str:
        """Words joined by a space: proclitics wait for their word, an enclitic joins the word before, digits join digits."""
        words: list[str] = []
        waiting, root, literal, digits = "", None, None, False
        for k in ids:
            token = self.tokens[k]
            kind, _, value = token[1:-1].partition("_")
            was_digit, digits = digits, kind == "D"
            if root is not None and kind != "PAT":
                words.append(waiting + root)
                waiting, root = "", None
            if k == LIT_BEGIN:
                literal = ""
            elif k == LIT_END:
                words.append(waiting + (literal or ""))
                waiting, literal = "", None
            elif literal is not None:
                literal += value if kind == "C" else "?"
            elif kind == "P" and k >= len(SPECIALS):
                waiting += value
            elif kind == "ROOT":
                root = value
            elif kind == "PAT":
                surface = self.surfaces.get((root or "", value)) or (self._fill(value, root) if root else value)
                words.append(waiting + surface)
                waiting, root = "", None
            elif kind == "E":
                if words:
                    words[-1] += value
                else:
                    words.append(value)
            elif kind == "D":
                if was_digit:
                    words[-1] += value
                else:
                    words.append(value)
            elif kind in ("X", "C"):
                words.append(value)
            elif k == UNK:
                words.append("?")
        if root is not None:
            words.append(waiting + root)
        return " ".join(words)

    @staticmethod
    def _fill(pattern: str, root: str) -> str:
        """The root's letters in the pattern's seats."""
        seats, out, k = "فعلل" if len(root) == 4 else "فعل", "", 0
        for ch in pattern:
            if k < len(root) and ch == seats[k]:
                out, k = out + root[k], k + 1
            else:
                out += ch
        return out

    def encode_frame(self, frame: DataFrame, column: str = "text", as_tokens: bool = False) -> DataFrame:
        """frame with ids (or the token strings of what lies between bos and eos): a narrow map, each distinct word of a worker analysed once."""
        model = RootPattern.__new__(RootPattern)  # without what earlier calls have remembered
        model.tokens, model.vocab, model.surfaces, model._seen = self.tokens, self.vocab, {}, {}

        @F.arrow_udf("array<string>" if as_tokens else "array<int>")
        def run(texts: pa.Array) -> pa.Array:
            flat, size = [], []
            for text in texts.to_pylist():
                ids = model.encode_by_rule(text or "")
                flat += ids[1:-1] if as_tokens else ids
                size.append(len(ids) - 2 if as_tokens else len(ids))
            values = pa.array(flat, pa.int32())
            edge = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            return pa.ListArray.from_arrays(edge, pc.take(pa.array(model.tokens, pa.string()), values) if as_tokens else values)

        return frame.withColumn("tokens" if as_tokens else "ids", run(F.col(column)))

    def decode_column(self, ids: Column) -> Column:
        model = self

        @F.pandas_udf("string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                yield s.map(lambda x: model.decode([int(i) for i in x]))

        return run(ids)
