"""Queries on vocabularies, tokenizers and intrinsic metrics."""

from pyspark.sql import functions as F

from harfmill.functions.arabic import words
from harfmill.functions.morphology import ENCLITICS, PROCLITICS
from harfmill.operators import corpora, metrics, rootpattern, subword, tokenization, tokenizers, vocabulary
from harfmill.plans.base import ARAB, ARAB_WORDS, WORD_ROWS, joined_md5, query, root_sql, span_sql, words_sql

_CHARS = "SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' AND ch <> ' '"
_CHAR_VOCAB = f"char_vocab AS (SELECT ch, row_number() OVER (ORDER BY ch) + 4 AS id FROM ({_CHARS}))"
_WORD_VOCAB = f"rows AS ({WORD_ROWS}), vocab AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, f.d, f.p) + 3 AS id FROM (SELECT word, count(*) AS cnt, min({{'d': doc_id, 'p': pos}}) AS f FROM rows GROUP BY word) QUALIFY id < 50004)"


@query("char_vocab", f"WITH {_CHAR_VOCAB} SELECT ch AS token, id FROM char_vocab")
def _(t):
    return vocabulary.char_vocab(t.documents)


@query("word_vocab_topk", f"WITH {_WORD_VOCAB} SELECT word AS token, cnt, id FROM vocab")
def _(t):
    return vocabulary.word_vocab(t.documents)


@query("char_set_by_lang", "SELECT lang, count(DISTINCT ch) AS n, md5(string_agg(DISTINCT ch, '' ORDER BY ch)) AS chars_md5 FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY lang")
def _(t):
    chars = t.documents.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    return chars.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_set("ch")), "").cast("binary")).alias("chars_md5"))


_ANALYSES = f"""arab AS ({ARAB}), arab_words AS ({ARAB_WORDS}), firsts AS (SELECT word, min({{'d': doc_id, 'p': pos}}) AS f FROM arab_words GROUP BY word),
stems AS (SELECT word, f, CASE WHEN regexp_extract(word, '{{S}}', 4) = '' THEN word ELSE regexp_extract(word, '{{S}}', 4) END AS stem, regexp_extract(word, '{{S}}', 1) AS c1, regexp_extract(word, '{{S}}', 2) AS c2, regexp_extract(word, '{{S}}', 3) AS c3, regexp_extract(word, '{{S}}', 5) AS enc FROM firsts),
rooted AS (SELECT *, {root_sql("stem")} AS root FROM stems), entries AS (SELECT *, {span_sql("stem", "root")} AS pattern FROM rooted)""".replace("{S}", __import__("harfmill.functions.morphology", fromlist=["SEGMENTS"]).SEGMENTS)


def _analyses(t):
    """Alpha chunks of the stand-in text are its words, as it holds letters only."""
    return rootpattern.analysis_table(corpora.arabized(t.documents))


@query("root_vocab", f"WITH {_ANALYSES} SELECT root AS token, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS id FROM entries WHERE root IS NOT NULL GROUP BY root HAVING count(*) >= 2 QUALIFY id < 10000")
def _(t):
    return vocabulary.counted(_analyses(t).select(F.col("root").alias("token")), 10_000, 2)


@query("pattern_vocab", f"WITH {_ANALYSES} SELECT pattern AS token, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, pattern) - 1 AS id FROM entries WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 2 QUALIFY id < 500")
def _(t):
    return vocabulary.counted(_analyses(t).select(F.col("pattern").alias("token")), 500, 2)


@query("clitic_counts", f"WITH {_ANALYSES}, c AS (SELECT 'pro' AS kind, unnest([c1, c2, c3]) AS clitic FROM entries UNION ALL SELECT 'enc', enc FROM entries) SELECT kind, clitic, count(*) AS cnt FROM c WHERE clitic <> '' GROUP BY ALL")
def _(t):
    a = _analyses(t)
    pro = a.select(F.lit("pro").alias("kind"), F.explode("proclitics").alias("clitic"))
    return pro.unionByName(a.select(F.lit("enc").alias("kind"), F.col("enclitic").alias("clitic")).where("clitic is not null")).groupBy("kind", "clitic").agg(F.count(F.lit(1)).alias("cnt"))


def _entries(t):
    return _analyses(t).where("root is not null and pattern is not null").select("word", "root", "pattern", F.col("stem").alias("surface"), F.col("first").alias("pos"))


@query(
    "reconstruction_mode",
    f"WITH {_ANALYSES} SELECT root, pattern, stem AS surface FROM (SELECT root, pattern, stem, count(*) AS cnt, min(f.d * 1000000 + f.p) AS first FROM entries WHERE root IS NOT NULL AND pattern IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY root, pattern ORDER BY cnt DESC, first, stem DESC) = 1",
)
def _(t):
    return vocabulary.reconstruction(_entries(t))


@query("root_examples_top5", f"WITH {_ANALYSES} SELECT root, word, row_number() OVER (PARTITION BY root ORDER BY f.d * 1000000 + f.p, word) AS rank FROM entries WHERE root IS NOT NULL AND pattern IS NOT NULL QUALIFY rank <= 5")
def _(t):
    return vocabulary.examples(_entries(t), "root").select("root", "word", F.col("rank").cast("long").alias("rank"))


@query(
    "vocab_composition",
    f"WITH {_ANALYSES} SELECT 'ROOT' AS kind, least(count(*), 10000) AS n FROM (SELECT root FROM entries WHERE root IS NOT NULL GROUP BY root HAVING count(*) >= 2) UNION ALL SELECT 'PAT', least(count(*), 500) FROM (SELECT pattern FROM entries WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 2) UNION ALL SELECT 'P', {len(PROCLITICS)} UNION ALL SELECT 'E', {len(ENCLITICS)}",
)
def _(t):
    a = _analyses(t)
    tokens = vocabulary.counted(a.select(F.col("root").alias("token")), 10_000, 2).select(F.concat(F.lit("[ROOT_"), "token").alias("token"))
    tokens = tokens.unionByName(vocabulary.counted(a.select(F.col("pattern").alias("token")), 500, 2).select(F.concat(F.lit("[PAT_"), "token").alias("token")))
    tokens = tokens.unionByName(t.values("token string", [(f"[P_{c}",) for c in PROCLITICS] + [(f"[E_{c}",) for c in ENCLITICS]))
    return tokens.groupBy(F.regexp_extract("token", r"^\[([A-Z]+)_", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _encoded_char(t):
    return tokenizers.encode_char(t.documents, vocabulary.char_vocab(t.documents))


_CHAR_IDS = f"""{_CHAR_VOCAB}, cmap AS (SELECT map(list(ch), list(id)) AS m FROM char_vocab),
char_ids AS (SELECT doc_id, lang, text, list_concat(list_concat([1], list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: CASE WHEN c = ' ' THEN 4 ELSE coalesce(m[c], 3) END)), [2]) AS ids FROM documents, cmap)"""


@query("encode_char", f"WITH {_CHAR_IDS} SELECT doc_id, len(ids) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM char_ids")
def _(t):
    return _encoded_char(t).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined_md5(F.col("ids")).alias("ids_md5"))


@query(
    "encode_word_char",
    f"""WITH {_WORD_VOCAB}, d AS (SELECT row_number() OVER () AS n, doc_id, {words_sql()} AS ws FROM documents), w AS (SELECT n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
    e AS (SELECT n, count(*) AS k, string_agg(CAST(coalesce(id, 3) AS VARCHAR) || ',', '' ORDER BY pos) AS ids FROM w LEFT JOIN vocab USING (word) GROUP BY n)
    SELECT doc_id, coalesce(k, 0) + 2 AS n_tokens, md5('1,' || coalesce(ids, '') || '2') AS ids_md5 FROM d LEFT JOIN e USING (n)""",
)
def _(t):
    docs = tokenizers.encode_words(t.documents.select("doc_id", "text"), vocabulary.word_vocab(t.documents))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined_md5(F.col("ids")).alias("ids_md5"))


_BYTE_IDS = "list_concat(list_concat([1], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT) + 4)), [2])"


@query("encode_byte", f"SELECT doc_id, len(ids) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM (SELECT doc_id, {_BYTE_IDS} AS ids FROM documents)")
def _(t):
    return t.documents.withColumn("ids", tokenizers.encode_bytes(F.col("text"))).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined_md5(F.col("ids")).alias("ids_md5"))


@query("decode_roundtrip", "SELECT doc_id, md5(text) AS char_md5, md5(text) AS byte_md5 FROM documents")
def _(t):
    vocab = vocabulary.char_vocab(t.documents)
    lookup = vocab.agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("v")).select(F.concat(F.array_repeat(F.lit(""), 5), F.transform("v", lambda x: x["token"])).alias("tokens"))
    rows = _encoded_char(t).crossJoin(F.broadcast(lookup))  # the character table is one bounded row
    back = tokenizers.decode_char(F.col("ids"), F.col("tokens"))
    return rows.select("doc_id", F.md5(back.cast("binary")).alias("char_md5"), F.md5(tokenizers.decode_bytes(tokenizers.encode_bytes(F.col("text"))).cast("binary")).alias("byte_md5"))


@query(
    "pad_truncate",
    f"SELECT doc_id, md5(array_to_string(list_concat(c, list_transform(range(0, greatest(512 - len(c), 0)), lambda k: CAST(0 AS BIGINT))), ',')) AS ids_md5 FROM (SELECT doc_id, list_slice(ids, 1, 512) AS c FROM (SELECT doc_id, {_BYTE_IDS} AS ids FROM documents))",
)
def _(t):
    ids = tokenizers.truncate_pad(tokenizers.encode_bytes(F.col("text")), 512, True, True)
    return t.documents.select("doc_id", joined_md5(ids).alias("ids_md5"))


_SPLIT = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10"


@query("oov_lookup", f"WITH rows AS ({WORD_ROWS}), known AS (SELECT DISTINCT word FROM rows WHERE {_SPLIT} <> 0) SELECT lang, count(*) AS n_words, count(*) FILTER (k.word IS NULL) AS n_oov FROM rows r LEFT JOIN known k ON r.word = k.word WHERE {_SPLIT} = 0 GROUP BY lang")
def _(t):
    rows = corpora.word_rows(t.documents, "doc_id", "lang").withColumn("split", corpora.hash_split(F.col("doc_id")))
    known = rows.where("split = 'train'").select("word").distinct().withColumn("known", F.lit(True))
    counted = rows.where("split = 'eval'").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(known, "word", "left").groupBy("lang").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_oov"))


def _hashed(frame):
    return frame.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined_md5(F.col("ids")).alias("ids_md5"))


@query("encode_bpe")
def _(t):
    model = subword.Subword.train(t.documents, "bpe", 2000)
    return _hashed(t.documents.select("doc_id", model.encode_column(F.col("text")).alias("ids")))


@query("encode_wordpiece")
def _(t):
    model = subword.Subword.train(t.documents, "wordpiece", 2000)
    return _hashed(t.documents.select("doc_id", model.encode_column(F.col("text")).alias("ids")))


@query("encode_morpho_bpe")
def _(t):
    rows = corpora.segmented(corpora.arabized(t.documents))
    model = subword.Subword.train(rows, "plain_bpe", 1000)
    return _hashed(rows.select("doc_id", model.encode_column(F.col("text")).alias("ids")))


@query("encode_root_pattern")
def _(t):
    docs = corpora.arabized(t.documents)
    model = rootpattern.RootPattern.train(rootpattern.analysis_table(docs))
    return _hashed(model.encode_frame(docs))


def _sums(t, cap=5000):
    """Per language what the size metrics of all families need: one pass over the texts, one over their words."""
    docs = t.documents
    sums = docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum(F.size(words(F.col("text")))), F.lit(0)).alias("n_words"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"),
    )
    counts = corpora.word_rows(docs, "lang", "doc_id").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt"), F.min(corpora.occurrence()).alias("first"))
    totals = counts.groupBy("word").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
    known = vocabulary.top_words(totals, cap).select(F.col("token").alias("word"), F.lit(True).alias("known"))
    unknown = counts.join(known, "word", "left").where("known is null").groupBy(F.col("lang").alias("l")).agg(F.sum("cnt").alias("u"))
    return sums.join(unknown, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("n_unknown", F.coalesce("u", F.lit(0))).drop("l", "u")


def _family_metrics(sums, family, by):
    """A text's bos and eos are tokens.  The characters' vocabulary is the corpus's, and bytes are all known."""
    tokens = {"char": F.col("n_chars"), "byte": F.col("n_bytes"), "word": F.col("n_words")}[family] + 2 * F.col("n_texts")
    return metrics.size_metrics_of_sums(sums, by, tokens, F.col("n_unknown") if family == "word" else F.lit(0))


def _sized(t, family, cap=5000):
    totals = _sums(t, cap).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_texts", "n_words", "n_chars", "n_bytes", "n_unknown")])
    return _family_metrics(totals, family, [])


_RATES = """count(*) AS n_texts, round(sum(n_tokens) / greatest(sum(n_words), 1), 4) AS fertility, round(sum(length(text)) / greatest(sum(n_tokens), 1), 4) AS compression_ratio,
round(sum(n_unk) / greatest(sum(n_tokens), 1), 6) AS unk_rate, round(sum(n_tokens) / greatest(count(*), 1), 2) AS avg_token_count"""
_TOP_ALL = f"rows AS ({WORD_ROWS}), top AS (SELECT word FROM (SELECT word, count(*) AS cnt, min({{'d': doc_id, 'p': pos}}) AS f FROM rows GROUP BY word) ORDER BY cnt DESC, f.d, f.p LIMIT 50000)"
_TOP = _TOP_ALL.replace("LIMIT 50000", "LIMIT 5000")
_BASE = f"{_TOP}, unknown AS (SELECT doc_id, count(*) FILTER (t.word IS NULL) AS u FROM rows r LEFT JOIN top t ON r.word = t.word GROUP BY doc_id), base AS (SELECT d.doc_id, lang, text, len({words_sql()}) AS n_words, coalesce(u, 0) AS u FROM documents d LEFT JOIN unknown USING (doc_id))"
_BASE_50K = _BASE.replace(_TOP, _TOP_ALL)
_FAMILY = {"char": "length(text) + 2 AS n_tokens, 0 AS n_unk", "byte": "octet_length(encode(text)) + 2 AS n_tokens, 0 AS n_unk", "word": "n_words + 2 AS n_tokens, u AS n_unk"}


def _family_sql(family, by):
    return f"SELECT {by}{_RATES} FROM (SELECT lang, text, n_words, {_FAMILY[family]} FROM base)"


for _name in _FAMILY:

    @query(f"size_metrics_{_name}", f"WITH {_BASE} {_family_sql(_name, '')}")
    def _(t, family=_name):
        return _sized(t, family)


@query("size_metrics_word_50k", f"WITH {_BASE_50K} {_family_sql('word', '')}")
def _(t):
    return _sized(t, "word", 50_000)


_BY_LANG = " UNION ALL ".join(f"{_family_sql(f, f'{chr(39)}{f}{chr(39)} AS tokenizer, lang, ')} GROUP BY lang" for f in ("char", "byte", "word"))


@query("size_metrics_by_lang", f"WITH {_BASE} {_BY_LANG}")
def size_metrics_by_lang(t, cap=5000):
    """The flagship: what each tokenizer family costs per language."""
    names = ["n_texts", "fertility", "compression_ratio", "unk_rate", "avg_token_count"]
    sums = _sums(t, cap)
    # The three families' rows come from one row of sums, so nothing is read again.
    cells = []
    for family in ("char", "byte", "word"):
        tokens = {"char": F.col("n_chars"), "byte": F.col("n_bytes"), "word": F.col("n_words")}[family] + 2 * F.col("n_texts")
        unknown = F.col("n_unknown") if family == "word" else F.lit(0)
        cells.append(F.struct(F.lit(family).alias("tokenizer"), *[c.alias(n) for c, n in zip(metrics.size_rates(tokens, unknown), names, strict=True)]))
    return sums.select("lang", F.inline(F.array(*cells))).select("tokenizer", "lang", *names)


@query("size_metrics_by_lang_50k", f"WITH {_BASE_50K} {_BY_LANG}")
def _(t):
    """The flagship with the word vocabulary that word_vocab_topk builds."""
    return size_metrics_by_lang(t, 50_000)


_COVERAGE = "SELECT lang, round(1 - count(*) FILTER (t.word IS NULL) / greatest(count(*), 1), 4) AS vocab_coverage FROM (SELECT DISTINCT lang, word FROM rows) r LEFT JOIN top t ON r.word = t.word GROUP BY lang"


def _coverage(t, cap):
    known = vocabulary.word_vocab(t.documents, cap).select(F.col("token").alias("word"), F.lit(False).alias("k"))
    distinct = corpora.word_rows(t.documents, "lang").select("lang", "word").distinct().join(known, "word", "left").withColumn("unk", F.col("k").isNull())
    return metrics.vocab_coverage(distinct, ["lang"])


@query("vocab_coverage", f"WITH {_TOP} {_COVERAGE}")
def _(t):
    return _coverage(t, 5000)


@query("vocab_coverage_50k", f"WITH {_TOP_ALL} {_COVERAGE}")
def _(t):
    return _coverage(t, 50_000)


_UNK_RATE = "SELECT lang, round(sum(u) / greatest(sum(n_words + 2), 1), 6) AS unk_rate FROM base GROUP BY lang"


@query("unk_rate", f"WITH {_BASE} {_UNK_RATE}")
def _(t):
    return _family_metrics(_sums(t), "word", ["lang"]).select("lang", "unk_rate")


@query("unk_rate_50k", f"WITH {_BASE_50K} {_UNK_RATE}")
def _(t):
    return _family_metrics(_sums(t, 50_000), "word", ["lang"]).select("lang", "unk_rate")


@query("morph_metrics_tokenizers")
def _(t):
    """The morphological metrics of trained tokenizers, on the sample that the built-in families are measured on."""
    docs = corpora.arabized(t.documents)
    sizes = {"bpe": 1000, "wordpiece": 1000, "morpho_bpe": 500, "word_char": 5000, "segmented_word_char": 5000, "root_pattern": None}
    chosen = {kind: tokenization.registry.get(kind)().train(docs, vocab_size=size) for kind, size in sizes.items()}
    sample = corpora.word_sample(docs)
    table = metrics.word_table(sample, tokenization.token_table(sample, chosen))
    return metrics.morphological_metrics(table, list(chosen)).join(metrics.bearing_tokens(table, list(chosen)), "family")
