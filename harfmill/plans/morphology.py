"""Queries on roots, patterns, clitics and morphological metrics."""

from pyspark.sql import functions as F

from harfmill.functions import arabic, morphology
from harfmill.operators import corpora, metrics
from harfmill.plans.base import ARAB, ARAB_WORDS, MARKS_SQL, SAMPLE, pattern_sql, query, root_sql, segment_sql, skeleton_sql, span_sql, subsequence_sql, values_sql

_PAIRS = f"arab AS ({ARAB}), arab_words AS ({ARAB_WORDS}), w AS (SELECT DISTINCT word FROM arab_words), r AS (SELECT word, {root_sql('word')} AS root FROM w)"


def _words(t):
    return corpora.arabized(t.documents).select(F.explode(arabic.words(F.col("text"))).alias("word")).distinct()


def _rooted(t):
    return _words(t).withColumn("root", arabic.root_of_skeleton(F.col("word")))


@query("skeleton_root", f"WITH {_PAIRS} SELECT word, {skeleton_sql('word')} AS skeleton, root FROM r")
def _(t):
    return _rooted(t).select("word", arabic.skeleton(F.col("word")).alias("skeleton"), "root")


@query("subsequence", f"WITH {_PAIRS} SELECT word, {subsequence_sql('reverse(word)', 'root')} AS back FROM r WHERE root IS NOT NULL")
def _(t):
    return _rooted(t).where("root is not null").select("word", morphology.has_subsequence(F.reverse("word"), F.col("root")).alias("back"))


@query("derive_pattern", f"WITH {_PAIRS} SELECT word, {pattern_sql('word', 'root')} AS pattern FROM r WHERE root IS NOT NULL")
def _(t):
    return _rooted(t).where("root is not null").select("word", morphology.pattern(F.col("word"), F.col("root")).alias("pattern"))


@query("stem_span", f"WITH {_PAIRS} SELECT word, {span_sql('word', 'root')} AS span FROM r WHERE root IS NOT NULL")
def _(t):
    return _rooted(t).where("root is not null").select("word", morphology.stem_span(F.col("word"), F.col("root")).alias("span"))


_ENDS = "list_transform(range(1, greatest(len({0}), 1)), lambda k: CAST(list_sum(list_transform(list_slice({0}, 1, k), lambda x: length(x))) AS BIGINT))"


_ALIGNED = f"SELECT word, array_to_string({_ENDS.format('p')}, ',') AS ends FROM (SELECT word, regexp_extract_all(word, '.{{1,3}}') AS p FROM "


def _aligned(words):
    pieces = F.regexp_extract_all("word", F.lit("(.{1,3})"))
    ends = morphology.token_boundaries(pieces, F.col("word"))
    return words.select("word", F.array_join(F.transform(ends, lambda x: x.cast("string")), ",").alias("ends"))


@query("align_offsets", f"WITH {SAMPLE} {_ALIGNED}sample)")
def _(t):
    return _aligned(corpora.word_sample(corpora.arabized(t.documents)))


@query("align_offsets_all", f"WITH {_PAIRS} {_ALIGNED}w)")
def _(t):
    """Over all distinct words."""
    return _aligned(_words(t))


_PRO, _ENC = ", ".join(f"'{c}'" for c in morphology.PROCLITICS), ", ".join(f"'{c}'" for c in morphology.ENCLITICS)
_LEFT = f"coalesce(nullif(list_position(list_transform(list_slice(m, 1, len(m) - 1), lambda x: x IN ({_PRO})), FALSE), 0) - 1, len(m) - 1)"
_RIGHT = f"coalesce(nullif(list_position(list_transform(list_reverse(list_slice(m, 2, len(m))), lambda x: x IN ({_ENC})), FALSE), 0) - 1, len(m) - 1)"
_OFFSET = "CAST(list_sum(list_transform(list_slice(m, 1, k), lambda x: length(x))) AS BIGINT)"
_CLITICS = f"list_sort(list_distinct(list_concat(list_transform(range(1, {_LEFT} + 1), lambda k: {_OFFSET}), list_transform(range(len(m) - {_RIGHT}, len(m)), lambda k: {_OFFSET}))))"
_SEGMENTED = f"{_PAIRS}, sg AS (SELECT word, {segment_sql('word')} AS m FROM w)"


@query("clitic_boundaries", f"WITH {_SEGMENTED} SELECT word, array_to_string(CASE WHEN len(m) >= 2 THEN {_CLITICS} ELSE [] END, ',') AS bounds FROM sg WHERE m IS NOT NULL")
def _(t):
    b = morphology.clitic_boundaries(F.col("m"))
    return _words(t).withColumn("m", morphology.segment(F.col("word"))).where("m is not null").select("word", F.array_join(F.transform(b, lambda x: x.cast("string")), ",").alias("bounds"))


_FAMILIES = f"""{SAMPLE}, s AS (SELECT word, {root_sql('word')} AS root, coalesce({segment_sql('word')}, [word]) AS m FROM sample), f AS (SELECT * FROM s WHERE root IS NOT NULL),
tok AS (SELECT word, root, m, 'char' AS family, string_split(word, '') AS tokens FROM f UNION ALL SELECT word, root, m, 'word', [word] FROM f UNION ALL SELECT word, root, m, 'morpheme', m FROM f
UNION ALL SELECT word, root, m, 'byte', regexp_extract_all(hex(encode(word)), '..') FROM f UNION ALL SELECT word, root, m, 'triple', regexp_extract_all(word, '.{{1,3}}') FROM f),
tab AS (SELECT *, list_filter(list_transform(tokens, lambda x: regexp_replace(x, '[^{arabic.LETTERS}]', '', 'g')), lambda x: x <> '') AS content FROM tok),
rec AS (SELECT *, CASE WHEN family <> 'byte' THEN {_ENDS.format('tokens')} END AS te, {_ENDS.format('m')} AS mb, CASE WHEN len(m) >= 2 THEN {_CLITICS} ELSE [] END AS cb FROM tab)"""
_RESPECTED = "len(list_filter({}, lambda x: list_contains(te, x)))"


def _table(t):
    return metrics.word_table(corpora.word_sample(corpora.arabized(t.documents)))


@query("word_morph_record", f"WITH {_FAMILIES} SELECT family, word, CASE WHEN te IS NOT NULL AND len(mb) > 0 THEN round({_RESPECTED.format('mb')} / len(mb), 6) END AS integrity, CASE WHEN te IS NOT NULL AND len(cb) > 0 THEN {_RESPECTED.format('cb')} END AS csa_respected, CASE WHEN te IS NOT NULL AND len(cb) > 0 THEN len(cb) END AS csa_total, len(m) AS morpheme_count, len(tokens) AS raw_token_count FROM rec")
def _(t):
    return _table(t).select("family", "word", F.round("r.integrity", 6).alias("integrity"), "r.csa_respected", "r.csa_total", "r.morpheme_count", "r.raw_token_count")


@query("root_conservation", f"WITH {_FAMILIES} SELECT family, round(avg(CASE WHEN len(list_filter(content, lambda x: {subsequence_sql('x', 'root')})) > 0 THEN 1.0 ELSE 0.0 END), 4) AS root_conservation_rate, count(root) AS morph_sample_size FROM tab GROUP BY family")
def _(t):
    return metrics.morphological_metrics(_table(t), metrics.FAMILIES).select("family", "root_conservation_rate", "morph_sample_size")


@query("pattern_conservation", f"WITH {_FAMILIES} SELECT family, round(avg(CASE WHEN {span_sql('word', 'root')} IS NOT NULL THEN CASE WHEN len(list_filter(content, lambda x: coalesce({span_sql('x', 'root')} = {span_sql('word', 'root')}, FALSE))) > 0 THEN 1.0 ELSE 0.0 END END), 4) AS pattern_conservation_rate FROM tab GROUP BY family")
def _(t):
    return metrics.morphological_metrics(_table(t), metrics.FAMILIES).select("family", "pattern_conservation_rate")


@query(
    "integrity_csa_sfr",
    f"""WITH {_FAMILIES} SELECT family, round(avg(CASE WHEN te IS NOT NULL AND len(mb) > 0 THEN {_RESPECTED.format('mb')} / len(mb) END), 4) AS morpheme_integrity_rate,
    round(sum(CASE WHEN te IS NOT NULL THEN {_RESPECTED.format('cb')} END) / nullif(sum(CASE WHEN te IS NOT NULL THEN len(cb) END), 0), 4) AS clitic_separation_accuracy, round(sum(len(tokens)) / nullif(sum(len(m)), 0), 4) AS semantic_fragmentation_ratio FROM rec GROUP BY family""",
)
def _(t):
    return metrics.morphological_metrics(_table(t), metrics.FAMILIES).select("family", "morpheme_integrity_rate", "clitic_separation_accuracy", "semantic_fragmentation_ratio")


_BEARING = f"{_FAMILIES}, roots AS (SELECT DISTINCT root FROM f), pats AS (SELECT DISTINCT {span_sql('word', 'root')} AS p FROM f), ct AS (SELECT family, token, count(*) AS n FROM (SELECT family, unnest(content) AS token FROM tab) GROUP BY ALL)"


@query("root_bearing_pct", f"WITH {_BEARING}, b AS (SELECT family, round(100 * sum(CASE WHEN EXISTS (SELECT 1 FROM roots WHERE {subsequence_sql('token', 'roots.root')}) THEN n ELSE 0 END) / sum(n), 2) AS root_bearing_token_pct FROM ct GROUP BY family) SELECT family, coalesce(root_bearing_token_pct, 0.0) AS root_bearing_token_pct FROM (SELECT DISTINCT family FROM tab) LEFT JOIN b USING (family)")
def _(t):
    return metrics.bearing_tokens(_table(t), metrics.FAMILIES).select("family", "root_bearing_token_pct")


@query("pattern_bearing_pct", f"WITH {_BEARING}, b AS (SELECT family, round(100 * sum(CASE WHEN EXISTS (SELECT 1 FROM roots, pats WHERE {span_sql('token', 'roots.root')} = pats.p) THEN n ELSE 0 END) / sum(n), 2) AS pattern_bearing_token_pct FROM ct GROUP BY family) SELECT family, coalesce(pattern_bearing_token_pct, 0.0) AS pattern_bearing_token_pct FROM (SELECT DISTINCT family FROM tab) LEFT JOIN b USING (family)")
def _(t):
    return metrics.bearing_tokens(_table(t), metrics.FAMILIES).select("family", "pattern_bearing_token_pct")


_FILL = "CASE length(word) % 4 WHEN 0 THEN '1ا2ي3' WHEN 1 THEN 'م12و34' WHEN 2 THEN '' END"


@query("pattern_fill", f"WITH {_PAIRS}, p AS (SELECT word, root, {_FILL} AS p FROM r WHERE root IS NOT NULL) SELECT word, coalesce(replace(replace(replace(replace(p, '1', substr(root, 1, 1)), '2', substr(root, 2, 1)), '3', substr(root, 3, 1)), '4', substr(root, 4, 1)), '') AS surface FROM p")
def _(t):
    return _rooted(t).where("root is not null").selectExpr("word", "root", f"{_FILL} AS p").select("word", morphology.fill_pattern(F.col("p"), F.col("root")).alias("surface"))


_STRIPPED = "SELECT word, regexp_replace(word, '^و', '') AS bare, regexp_replace(word, 'ها$', '') AS bare_end FROM "


def _stripped(words):
    return words.select("word", morphology.strip_proclitic(F.col("word"), "و").alias("bare"), morphology.strip_enclitic(F.col("word"), "ها").alias("bare_end"))


@query("strip_clitic", f"WITH {SAMPLE} {_STRIPPED}sample")
def _(t):
    return _stripped(corpora.word_sample(corpora.arabized(t.documents)))


@query("strip_clitic_all", f"WITH {_PAIRS} {_STRIPPED}w")
def _(t):
    """Over all distinct words."""
    return _stripped(_words(t))


_TABLE = list(morphology.clitic_surfaces().items())
_TAG_LIST = [tag for tag, _ in _TABLE] + ["xx_new", "0", "na", ""]
_TAG = "element_at(array({}), CAST(pmod(length(word) * 31 + ascii(word), {}) AS INT) + 1)".format(", ".join(f"'{x}'" for x in _TAG_LIST), len(_TAG_LIST))


@query("clitic_tags", f"WITH {_PAIRS}, s AS (SELECT word, [{', '.join(repr(x) for x in _TAG_LIST)}][(length(word) * 31 + unicode(word)) % {len(_TAG_LIST)} + 1] AS tag FROM w) SELECT word, s.tag, CASE WHEN s.tag IN ('', '0', 'na') THEN NULL ELSE coalesce(v.surface, s.tag) END AS surface FROM s LEFT JOIN {values_sql('tag, surface', _TABLE)} ON s.tag = v.tag")
def _(t):
    return _words(t).selectExpr("word", f"{_TAG} AS tag").select("word", "tag", morphology.clitic_surface(F.col("tag")).alias("surface"))


@query("reconstruction_chain", f"WITH {_PAIRS}, p AS (SELECT word, root, {_FILL} AS p, CASE length(word) % 3 WHEN 0 THEN word WHEN 1 THEN '' END AS seen, CASE length(word) % 5 WHEN 0 THEN 'مَ' || root WHEN 1 THEN '' END AS made FROM r WHERE root IS NOT NULL) SELECT word, coalesce(nullif(seen, ''), nullif(translate(made, '{MARKS_SQL}', ''), ''), nullif(coalesce(replace(replace(replace(replace(p, '1', substr(root, 1, 1)), '2', substr(root, 2, 1)), '3', substr(root, 3, 1)), '4', substr(root, 4, 1)), ''), ''), root) AS surface FROM p")
def _(t):
    """The surface of a root and pattern: seen in the corpus, generated, filled in, or the root."""
    rows = _rooted(t).where("root is not null").selectExpr("word", "root", f"{_FILL} AS p", "CASE length(word) % 3 WHEN 0 THEN word WHEN 1 THEN '' END AS seen", "CASE length(word) % 5 WHEN 0 THEN 'مَ' || root WHEN 1 THEN '' END AS made")
    return rows.select("word", morphology.reconstruct(F.col("seen"), F.col("made"), F.col("p"), F.col("root")).alias("surface"))
