"""Intrinsic and morphological metrics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfmill.functions.arabic import SPECIAL_TOKENS, content_tokens, normalize_answer, root_of_skeleton, words
from harfmill.functions.morphology import has_subsequence, segment, stem_span, word_record
from harfmill.functions.scoring import safe_rate, size_rate


def size_metrics(rows: DataFrame, by: list[str], unk: int | None = 3) -> DataFrame:
    """rows: text, n_tokens, n_unk.  Fertility, compression, unknown rate and mean tokens; tokens include specials."""
    tokens, texts = F.sum("n_tokens"), F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        texts.alias("n_texts"),
        size_rate(tokens, F.sum(F.size(words(F.col("text"))))).alias("fertility"),
        size_rate(F.sum(F.length("text")), tokens).alias("compression_ratio"),
        (size_rate(F.sum("n_unk"), tokens, 6) if unk is not None else F.lit(0.0)).alias("unk_rate"),
        size_rate(tokens, texts, 2).alias("avg_token_count"),
    )


def size_rates(tokens: Column, unknown: Column) -> list[Column]:
    """n_texts, fertility, compression, unknown rate and mean tokens, from sums n_texts, n_words, n_chars and given ones."""
    texts = F.col("n_texts")
    return [texts, size_rate(tokens, F.col("n_words")), size_rate(F.col("n_chars"), tokens), size_rate(unknown, tokens, 6), size_rate(tokens, texts, 2)]


def size_metrics_of_sums(sums: DataFrame, by: list[str], tokens: Column, unknown: Column) -> DataFrame:
    """The size metrics of one tokenizer from sums that are there already."""
    names = ["n_texts", "fertility", "compression_ratio", "unk_rate", "avg_token_count"]
    return sums.select(*by, *[c.alias(n) for c, n in zip(size_rates(tokens, unknown), names, strict=True)])


def vocab_coverage(distinct_words: DataFrame, by: list[str]) -> DataFrame:
    """distinct_words: unk (whether a word alone has an unknown id), one row a distinct word."""
    return distinct_words.groupBy(*by).agg((1 - size_rate(F.sum(F.col("unk").cast("long")), F.count(F.lit(1)), 12)).alias("v")).select(*by, F.round("v", 4).alias("vocab_coverage"))


FAMILIES = ["char", "word", "morpheme", "byte", "triple"]


def families(word: Column) -> Column:
    """Token strings of a word by tokenizer family: characters, the word itself, morphemes, bytes, and runs of three."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    tokens = [chars, F.array(word), F.coalesce(segment(word), F.array(word)), F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)")), F.regexp_extract_all(word, F.lit("(.{1,3})"))]
    return F.array(*[F.struct(F.lit(name).alias("family"), t.alias("tokens")) for name, t in zip(FAMILIES, tokens, strict=True)])


def word_table(sample: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """sample: word.  Per word and family: root, tokens, cleaned tokens, and the morpheme record.

    tokens: word, family, tokens of the sample's words by any tokenizers; without them, the built-in families.
    """
    t = sample.withColumn("root", root_of_skeleton(F.col("word"))).where("root is not null")
    t = t.withColumn("morphemes", segment(F.col("word"))).withColumn("span", stem_span(F.col("word"), F.col("root")))
    if tokens is None:
        t = t.select("word", "root", "span", "morphemes", F.inline(families(F.col("word"))))
    else:
        t = t.join(tokens.select("word", "family", "tokens"), "word").select("word", "root", "span", "morphemes", "family", "tokens")
    return t.withColumn("content", content_tokens(F.col("tokens"))).withColumn("r", word_record(F.col("word"), F.col("tokens"), F.col("morphemes")))


def _every(measured: DataFrame, names: list[str] | None) -> DataFrame:
    """A row for each family that is asked for, also where nothing could be measured: nulls, and a sample of 0."""
    if not names:
        return measured
    wanted = measured.sparkSession.createDataFrame([(n,) for n in names], "family string")
    return wanted.join(measured, "family", "left")


def morphological_metrics(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The metrics that need one pass over words: by family; with `names` a row for each of these, whatever the sample."""
    span, root = F.col("span"), F.col("root")
    kept = F.exists("content", lambda t: has_subsequence(t, root))
    pattern_kept = F.exists("content", lambda t: F.coalesce(stem_span(t, root) == span, F.lit(False)))
    measured = table.groupBy("family").agg(
        F.round(F.avg(kept.cast("double")), 4).alias("root_conservation_rate"),
        F.round(F.avg(F.when(span.isNotNull(), pattern_kept.cast("double"))), 4).alias("pattern_conservation_rate"),
        F.round(F.avg("r.integrity"), 4).alias("morpheme_integrity_rate"),
        safe_rate(F.sum("r.csa_respected"), F.sum("r.csa_total")).alias("clitic_separation_accuracy"),
        safe_rate(F.sum("r.raw_token_count"), F.sum("r.morpheme_count")).alias("semantic_fragmentation_ratio"),
        F.count("root").alias("morph_sample_size"),
    )
    return _every(measured, names).fillna(0, ["morph_sample_size"])


def bearing_tokens(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Share of content tokens that bear any sampled root, and any sampled root's pattern: identical tokens are tested once.

    A family whose tokens all clean to nothing has 0, not null: single bytes bear no root.
    """
    bound = table.agg(F.array_sort(F.collect_set("root")).alias("roots"), F.array_sort(F.collect_set("span")).alias("patterns"))
    raw = table.groupBy("family").agg(F.sum(F.size(F.filter("tokens", lambda t: ~t.isin(SPECIAL_TOKENS)))).alias("raw"))
    tokens = table.select("family", F.explode("content").alias("token")).groupBy("family", "token").agg(F.count(F.lit(1)).alias("cnt"))
    # The sample bounds the roots, so one row of arrays is broadcast.
    t = tokens.crossJoin(F.broadcast(bound))
    t = t.withColumn("bears", F.exists("roots", lambda r: has_subsequence(F.col("token"), r)))
    t = t.withColumn("patterned", F.exists("roots", lambda r: F.coalesce(F.array_contains("patterns", stem_span(F.col("token"), r)), F.lit(False))))
    share = lambda c: F.round(100 * F.sum(F.when(F.col(c), F.col("cnt")).otherwise(0)) / F.sum("cnt"), 2)
    shares = t.groupBy("family").agg(share("bears").alias("root_bearing_token_pct"), share("patterned").alias("pattern_bearing_token_pct"))
    filled = lambda c: F.coalesce(c, F.when(F.col("raw") > 0, 0.0)).alias(c)
    measured = raw.join(shares, "family", "left").select("family", filled("root_bearing_token_pct"), filled("pattern_bearing_token_pct"))
    return _every(measured, names)


def token_f1(prediction: Column, reference: Column) -> Column:
    """Token F1 by multiset overlap; both empty 1, one empty 0."""
    p, r = words(normalize_answer(prediction)), words(normalize_answer(reference))
    times = lambda v, w: F.size(v) - F.size(F.array_remove(v, w))
    common = F.aggregate(F.array_intersect(p, r), F.lit(0), lambda a, w: a + F.least(times(p, w), times(r, w)))  # only words that both have
    return (
        F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0)
        .when((F.size(p) == 0) | (F.size(r) == 0) | (common == 0), 0.0)
        .otherwise(2.0 * common / (F.size(p) + F.size(r)))
    )


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")
