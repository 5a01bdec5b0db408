"""Queries on text: cleaning, predicates, splits, samples."""

from pyspark.sql import functions as F

from harfmill.functions import arabic
from harfmill.functions.arabic import ARABIZE_FROM, ARABIZE_TO
from harfmill.operators import corpora
from harfmill.plans.base import ARAB, ARAB_WORDS, MARKS_SQL, WORD_ROWS, query

_NORMAL = r"trim(regexp_replace(replace(translate({}, 'آأإٱ', 'اااا'), 'ـ', ''), '\s+', ' ', 'g'))"
_WORDS = f"arab AS ({ARAB}), arab_words AS ({ARAB_WORDS}), w AS (SELECT DISTINCT word FROM arab_words)"
_RAW_WORDS = f"rows AS ({WORD_ROWS}), w AS (SELECT DISTINCT word FROM rows)"


def _words(t, arab=True):
    docs = corpora.arabized(t.documents) if arab else t.documents
    return docs.select(F.explode(arabic.words(F.col("text"))).alias("word")).distinct()


@query("normalize_arabic_sql", f"WITH arab AS ({ARAB}) SELECT doc_id, CAST(length({_NORMAL.format('text')}) AS BIGINT) AS n_chars, md5({_NORMAL.format('text')}) AS text_md5 FROM arab")
def _(t):
    c = arabic.normalize(F.col("text"))
    return corpora.arabized(t.documents).select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c.cast("binary")).alias("text_md5"))


@query("normalize_arabic_nfkc")
def _(t):
    c = arabic.normalize(arabic.nfkc(F.col("text")), marks=True)
    return t.documents.select("doc_id", F.length(c).alias("n_chars"))


@query("strip_diacritics", f"WITH {_WORDS}, s AS (SELECT word, regexp_replace(word, '(.)', '\\1َ' || substr('{MARKS_SQL}', CAST(1 + length(word) % 12 AS INTEGER), 1), 'g') AS marked FROM w) SELECT word, translate(marked, '{MARKS_SQL}', '') AS bare FROM s")
def _(t):
    """Every letter gets two marks, and loses them."""
    marked = F.regexp_replace("word", F.lit("(.)"), F.concat(F.lit("$1َ"), F.substring(F.lit(arabic.MARKS), (1 + F.length("word") % 12).cast("int"), F.lit(1))))
    return _words(t).select("word", arabic.strip_marks(marked).alias("bare"))


@query("min_length_filter", rf"SELECT lang, count(*) AS n FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) >= 200 GROUP BY lang")
def _(t):
    return corpora.preprocess(t.documents, min_length=200, compose=False).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("latin_predicate", f"WITH {_RAW_WORDS}, s AS (SELECT word, translate(word, '{ARABIZE_FROM}', '{ARABIZE_TO}') AS s FROM w) SELECT word, coalesce(regexp_matches(s, '{arabic.LATIN}'), FALSE) AS latin FROM s")
def _(t):
    """Words without their small letters of a to z: what is left is Latin by its capitals and accents."""
    return _words(t, False).select("word", arabic.has_latin(F.translate("word", ARABIZE_FROM, ARABIZE_TO)).alias("latin"))


@query(
    "latin_row_filter",
    f"WITH arab AS ({ARAB}) SELECT lang, count(*) AS kept FROM arab WHERE NOT (coalesce(regexp_matches(text, '{arabic.LATIN}'), FALSE) OR coalesce(regexp_matches(CASE WHEN doc_id % 3 = 0 THEN source END, '{arabic.LATIN}'), FALSE)) GROUP BY lang",
)
def _(t):
    from harfmill.operators.mcq import row_has_latin

    rows = corpora.arabized(t.documents)
    bad = row_has_latin(F.col("text"), F.array(F.when(F.col("doc_id") % 3 == 0, F.col("source"))), F.lit(None).cast("string"))
    return rows.where(~bad).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


_SPLIT = "CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 THEN 'eval' ELSE 'train' END"


@query("hash_split_90_10", f"SELECT lang, {_SPLIT} AS split, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    return t.documents.groupBy("lang", corpora.hash_split(F.col("doc_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("sample_top_md5", "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def _(t):
    return corpora.sample(t.documents.select("doc_id", "lang"), "doc_id", 100)


@query("union_all_configs", f"SELECT lang AS source_config, {_SPLIT} AS split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def _(t):
    docs = t.documents.select("doc_id", "text", F.col("lang").alias("source_config")).withColumn("split", corpora.hash_split(F.col("doc_id")))
    both = docs.where("split = 'train'").unionByName(docs.where("split = 'eval'"))
    return both.groupBy("source_config", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("exclude_all_config", "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src3') GROUP BY source")
def _(t):
    return t.documents.where(~F.col("source").isin("src0", "src3")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("clean_token_string", f"WITH {_WORDS} SELECT word, CASE WHEN length(word) % 7 = 6 THEN '' ELSE word END AS cleaned FROM w")
def _(t):
    """Words as tokens of many kinds, down to byte-level signs: each cleans to the word, a token without Arabic letters to nothing."""
    kinds = [F.concat(F.lit("##"), "word"), F.concat(F.lit("▁"), "word"), F.concat(F.lit("Ġ"), "word"), arabic.encode_byte_level(F.col("word")), arabic.encode_byte_level(F.concat(F.lit(" "), "word")), F.concat("word", F.lit("َ</w>"))]
    token = F.lit("<unk>")
    for k, made in enumerate(kinds):
        token = F.when(F.length("word") % 7 == k, made).otherwise(token)
    return _words(t).select("word", arabic.clean_token(token).alias("cleaned"))


@query("bytelevel_decode", f"WITH {_RAW_WORDS} SELECT word, md5(word) AS text_md5 FROM w")
def _(t):
    """There and back through the byte-level alphabet."""
    return _words(t, False).select("word", F.md5(arabic.decode_byte_level(arabic.encode_byte_level(F.col("word"))).cast("binary")).alias("text_md5"))


@query("arabic_letters_and_marks", f"WITH {_RAW_WORDS}, s AS (SELECT word, 'كَ' || word || '1ً،' || translate(word, '{ARABIZE_FROM}', '{ARABIZE_TO}') AS s FROM w) SELECT word, regexp_replace(s, '[^{arabic.LETTERS}{MARKS_SQL}]', '', 'g') AS kept FROM s")
def _(t):
    mixed = F.concat(F.lit("كَ"), "word", F.lit("1ً،"), F.translate("word", ARABIZE_FROM, ARABIZE_TO))
    return _words(t, False).select("word", arabic.arabic_only(mixed).alias("kept"))


@query("alpha_chunks", f"WITH arab AS ({ARAB}) SELECT lang, CAST(sum(len(c)) AS BIGINT) AS chunks, CAST(max(len(c)) AS BIGINT) AS most FROM (SELECT lang, regexp_extract_all(text, '[{arabic.LETTERS}{MARKS_SQL}]+') AS c FROM arab) GROUP BY lang")
def _(t):
    n = F.size(arabic.alpha_chunks(F.col("text"))).cast("long")
    return corpora.arabized(t.documents).groupBy("lang").agg(F.sum(n).alias("chunks"), F.max(n).alias("most"))


_PUNCT = "".join("\\" + p if p in "[]\\^-" else p for p in arabic.PUNCTUATION).replace("'", "''")


@query(
    "char_classes",
    f"""WITH c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents), g AS (SELECT lang, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL)
    SELECT lang, CASE WHEN regexp_full_match(ch, '[{arabic.LETTERS}{MARKS_SQL}]') THEN 'alpha' WHEN regexp_full_match(ch, '[{arabic.DIGITS}]') THEN 'digit'
    WHEN regexp_full_match(ch, '[{_PUNCT}]') THEN 'punct' WHEN regexp_full_match(ch, '\\s') THEN 'space' ELSE 'other' END AS class, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL""",
)
def _(t):
    chars = t.documents.select("lang", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.groupBy("lang", arabic.character_class(F.col("ch")).alias("class")).agg(F.sum("n").alias("n"))


@query("answer_normalize", r"SELECT item_id, md5(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[ؗ-ًؚ-ْٰ]', '', 'g')) AS answer_md5 FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.md5(arabic.normalize_answer(F.col("text")).cast("binary")).alias("answer_md5"))


@query("text_column_scan", "SELECT 'documents' AS name, count(text) AS texts FROM documents UNION ALL SELECT 'pages', count(url) FROM pages UNION ALL SELECT 'benchmark', count(text) FROM benchmark")
def _(t):
    out = None
    for name in ("documents", "pages", "benchmark"):
        frame = getattr(t, name)
        row = frame.agg(F.count(corpora.text_column(frame.schema)).alias("texts")).select(F.lit(name).alias("name"), "texts")
        out = row if out is None else out.unionByName(row)
    return out
