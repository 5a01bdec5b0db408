"""Queries on set operations, character vectors, likelihood spans, analyses and pooling."""

from pyspark.sql import functions as F

from harfmill.functions import morphology, scoring
from harfmill.functions.arabic import MARKS
from harfmill.operators import corpora, tokenizers, vocabulary
from harfmill.plans.base import WORD_ROWS, joined_md5, query
from harfmill.plans.morphology import _PAIRS, _rooted, _words


@query(
    "set_operations",
    f"""WITH rows AS ({WORD_ROWS}), e AS (SELECT word, count(*) AS n FROM rows WHERE lang = 'en' GROUP BY word), f AS (SELECT word, count(*) AS n FROM rows WHERE lang = 'fr' GROUP BY word)
    SELECT (SELECT count(*) FROM e JOIN f USING (word)) AS n_intersect, (SELECT count(*) FROM e ANTI JOIN f USING (word)) AS n_except, (SELECT count(*) FROM (SELECT word FROM e UNION SELECT word FROM f)) AS n_union,
    (SELECT CAST(coalesce(sum(least(e.n, f.n)), 0) AS BIGINT) FROM e JOIN f USING (word)) AS n_multiset""",
)
def _(t):
    rows = corpora.word_rows(t.documents, "lang").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    both = rows.groupBy("word").agg(F.sum(F.when(F.col("lang") == "en", F.col("n"))).alias("e"), F.sum(F.when(F.col("lang") == "fr", F.col("n"))).alias("f"))
    e, f = F.col("e").isNotNull(), F.col("f").isNotNull()
    return both.agg(F.count_if(e & f).alias("n_intersect"), F.count_if(e & ~f).alias("n_except"), F.count_if(e | f).alias("n_union"), F.coalesce(F.sum(F.when(e & f, F.least("e", "f"))), F.lit(0)).alias("n_multiset"))


_CHARS = "SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''"


def _vectors_sql(max_chars):
    return f"""WITH rows AS ({WORD_ROWS}), v AS (SELECT map(list(ch), list(id)) AS m FROM (SELECT ch, row_number() OVER (ORDER BY ch) + 6 AS id FROM ({_CHARS}))),
    w AS (SELECT DISTINCT word FROM rows), x AS (SELECT word, list_concat(list_concat([1], list_transform(list_slice(string_split(word, ''), 1, {max_chars - 2}), lambda c: coalesce(m[c], 3))), [2]) AS ids FROM w, v)
    SELECT word, md5(array_to_string(list_concat(ids, list_transform(range(0, {max_chars} - len(ids)), lambda k: CAST(0 AS BIGINT))), ',')) AS ids_md5 FROM x"""


def _vectors(t, max_chars):
    vocab = vocabulary.ranked(vocabulary.characters(t.documents), [F.col("token")], 1_114_112, 7)
    words = corpora.word_rows(t.documents).select("word").distinct().crossJoin(F.broadcast(tokenizers.code_table(vocab)))  # one bounded row
    return words.select("word", joined_md5(tokenizers.word_char_ids(F.col("word"), F.col("codes"), max_chars)).alias("ids_md5"))


@query("word_char_vectors", _vectors_sql(12))
def _(t):
    return _vectors(t, 12)


@query("word_char_vectors_50", _vectors_sql(50))
def _(t):
    """The reference's length of a word."""
    return _vectors(t, 50)


@query("block_means", "SELECT vec_id, round(list_avg(list_slice(CAST(embedding AS DOUBLE[]), 1, 4)), 6) AS first_block, round(list_avg(list_slice(CAST(embedding AS DOUBLE[]), 61, 64)), 6) AS last_block, CAST(ceil(len(embedding) / 4.0) AS INTEGER) AS blocks FROM embeddings")
def _(t):
    x = F.col("embedding").cast("array<double>")
    mean = lambda k: scoring.rounded(scoring.mean(F.slice(x, F.lit(1) + 4 * k, F.lit(4))), 6)
    return t.embeddings.select("vec_id", mean(0).alias("first_block"), mean(15).alias("last_block"), F.ceil(F.size("embedding") / 4).cast("int").alias("blocks"))


@query("block_means_all", "SELECT vec_id, list_transform(range(0, CAST(ceil(len(embedding) / 4.0) AS BIGINT)), lambda k: round(list_avg(list_slice(CAST(embedding AS DOUBLE[]), 4 * k + 1, 4 * k + 4)), 6)) AS means FROM embeddings")
def _(t):
    """The mean of every block of 4; the last one can be shorter."""
    x = F.col("embedding").cast("array<double>")
    mean = lambda k: scoring.rounded(scoring.mean(F.slice(x, 4 * k + 1, F.lit(4))), 6)
    blocks = F.filter(F.sequence(F.lit(0), F.ceil(F.size(x) / 4).cast("int")), lambda k: 4 * k < F.size(x))
    return t.embeddings.select("vec_id", F.transform(blocks, mean).alias("means"))


# Analyses as a backend writes them, from all distinct words: separators in roots, loanword marks, missing patterns, clitics with marks.
_ROOT = "CASE length(word) % 5 WHEN 0 THEN 'NTWS' WHEN 1 THEN substr(root, 1, 1) || '.' || substr(root, 2, 1) || '_' || substr(root, 3, 1) WHEN 2 THEN substr(root, 1, 2) || '#' ELSE root END"
_PATTERN = "CASE length(word) % 7 WHEN 0 THEN '' WHEN 2 THEN 'NTWS' WHEN 3 THEN NULL ELSE '1ا2ي3' END"
_CLITIC = "CASE length(word) % 3 WHEN 0 THEN 'وَ' WHEN 1 THEN 'و' ELSE '' END || CASE length(word) % 2 WHEN 0 THEN 'اَل' ELSE '' END || '1ا2' || CASE length(word) % 5 WHEN 0 THEN 'هَا' WHEN 1 THEN 'ها' ELSE '' END"
_ANALYSED = f"{_PAIRS}, an AS (SELECT word, {_ROOT} AS raw, {_PATTERN} AS pat, {_CLITIC} AS whole FROM r WHERE root IS NOT NULL)"
_GOOD = "CASE WHEN coalesce(pat, '') <> '' AND NOT contains(pat, 'NTWS') AND length(regexp_replace(raw, '[_.#]', '', 'g')) >= 3 AND raw <> 'NTWS' THEN regexp_replace(raw, '[_.#]', '', 'g') END"


def _analysed(t):
    return _rooted(t).where("root is not null").selectExpr("word", f"{_ROOT} AS raw", f"{_PATTERN} AS pat", f"{_CLITIC} AS whole")


@query("accepted_root", f"WITH {_ANALYSED} SELECT word, {_GOOD} AS root FROM an")
def _(t):
    return _analysed(t).select("word", morphology.accepted(F.col("raw"), F.col("pat")).alias("root"))


@query("pattern_without_clitics", f"WITH {_ANALYSED} SELECT word, regexp_replace(regexp_replace(regexp_replace(whole, '^[{MARKS}]*و[{MARKS}]*', ''), '^[{MARKS}]*ا[{MARKS}]*ل[{MARKS}]*', ''), '[{MARKS}]*ه[{MARKS}]*ا[{MARKS}]*$', '') AS pattern FROM an")
def _(t):
    return _analysed(t).select("word", morphology.normalize_pattern(F.col("whole"), ["و", "ال"], "ها").alias("pattern"))


@query("analysis_record", f"WITH {_ANALYSED}, g AS (SELECT word, {_GOOD} AS root, regexp_replace(regexp_replace(whole, '^[{MARKS}]*و[{MARKS}]*', ''), '[{MARKS}]*ه[{MARKS}]*ا[{MARKS}]*$', '') AS pattern FROM an) SELECT word, root, pattern, replace(replace(replace(replace(pattern, '1', substr(root, 1, 1)), '2', substr(root, 2, 1)), '3', substr(root, 3, 1)), '4', substr(root, 4, 1)) AS stem FROM g WHERE root IS NOT NULL")
def _(t):
    """Accepted analyses: the pattern without its clitics, and where the backend names no stem, the filled pattern."""
    tags = [F.lit("wa_conj"), F.lit("0"), F.lit("na"), F.lit(None).cast("string"), F.lit("3fs_poss")]
    pat = F.coalesce("pat", F.lit(""))
    usable = F.when((pat != "") & ~F.contains(pat, F.lit("NTWS")), F.col("whole"))
    found = morphology.accepted_analysis(F.col("raw"), usable, tags, F.lit(None).cast("string"))
    return _analysed(t).select("word", found.alias("f")).where("f is not null").select("word", "f.root", "f.pattern", "f.stem")


@query("strip_all_clitics", f"WITH {_PAIRS} SELECT word, regexp_replace(regexp_replace(regexp_replace(word, '^و', ''), '^ال', ''), 'ها$', '') AS bare FROM w")
def _(t):
    return _words(t).select("word", morphology.strip_clitics(F.col("word"), ["و", "ال"], ["ها"]).alias("bare"))


@query("downsampled_mask", "SELECT vec_id, list_transform(range(0, CAST(ceil(len(embedding) / 3.0) AS BIGINT)), lambda k: CAST(len(list_filter(list_slice(embedding, 3 * k + 1, 3 * k + 3), lambda x: x > 0)) > 0 AS BIGINT)) AS mask FROM embeddings WHERE embedding IS NOT NULL")
def _(t):
    """The mask of a sequence that is pooled by threes: a place counts if any in its window does."""
    return t.embeddings.where("embedding is not null").select("vec_id", scoring.pooled_mask(F.transform("embedding", lambda x: (x > 0).cast("long")), 3).alias("mask"))


@query("block_mix", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
    b AS (SELECT vec_id, x, list_transform(range(0, len(x)), lambda k: list_transform([1, 2, 3], lambda b: list_sum(list_slice(x, k - k % b + 1, least(k - k % b + b, len(x)))) / b)) AS c FROM e),
    m AS (SELECT vec_id, list_transform(c, lambda v: list_sum(list_transform(v, lambda w: w * exp(w))) / list_sum(list_transform(v, lambda w: exp(w)))) AS y FROM b)
    SELECT vec_id, round(list_sum(y), 5) AS total, round(y[1], 6) AS first, round(y[len(y)], 6) AS last FROM m""")
def _(t):
    """Blocks of one to three places, averaged (the last one filled up with zeros) and mixed by the softmax of their own values."""
    y = scoring.block_mix(F.col("embedding").cast("array<double>"), 3)
    mixed = t.embeddings.where("embedding is not null").select("vec_id", y.alias("y"))
    return mixed.select("vec_id", scoring.rounded(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 5).alias("total"), scoring.rounded(F.get("y", F.lit(0)), 6).alias("first"), scoring.rounded(F.element_at("y", -1), 6).alias("last"))


@query("subconfig_section", "SELECT source AS config, printf('%.4f (n=%d)', avg(CAST(lang = 'en' AS DOUBLE)), count(*)) AS cell FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy(F.col("source").alias("config")).agg(F.format_string("%.4f (n=%d)", F.avg((F.col("lang") == "en").cast("double")), F.count(F.lit(1))).alias("cell"))
