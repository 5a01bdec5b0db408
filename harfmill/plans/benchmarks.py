"""Queries on multiple-choice benchmarks, training data, metrics and reports."""

import math

from pyspark.sql import functions as F

from harfmill.functions import scoring
from harfmill.operators import corpora, mcq, metrics, reports, training
from harfmill.plans.base import joined_md5, query
from harfmill.plans.tokens import _BASE, _BASE_50K, _FAMILY, _family_sql, size_metrics_by_lang

# Parsers, on rows that every turn of a conversation gives: columns that both dialects compute in the same words.
_TURN = "conv_id * 100 + turn AS n"
_GENERIC = {
    "q": "CASE WHEN (conv_id * 100 + turn) % 11 = 0 THEN ' ' ELSE substr(text, 1, 40) END", "A": "substr(text, 1, 4)", "B": "CASE WHEN turn % 5 = 0 THEN '' ELSE substr(text, 5, 6) END",
    "C": "CASE WHEN conv_id % 3 <> 0 THEN substr(text, 11, 5) END", "D": "CASE WHEN conv_id % 4 = 1 THEN ' ' ELSE substr(text, 16, 5) END", "E": "CASE WHEN conv_id % 6 = 0 THEN substr(text, 2, 3) END",
    "ans": "CASE (conv_id * 100 + turn) % 8 WHEN 0 THEN 'B' WHEN 1 THEN ' c ' WHEN 2 THEN '1' WHEN 3 THEN 'e' WHEN 5 THEN 'x' WHEN 6 THEN '9' WHEN 7 THEN 'A' END",
}
_ACVA = {"q": _GENERIC["q"], "ans": "CASE (conv_id * 100 + turn) % 5 WHEN 0 THEN 'صح' WHEN 1 THEN 'خطأ' WHEN 2 THEN ' صح ' WHEN 3 THEN 'maybe' END"}
_ALGHAFA = {"q": _GENERIC["q"]} | {f"s{k}": _GENERIC[c] for k, c in enumerate("ABCDE", 1)} | {"label": "CASE (conv_id * 100 + turn) % 7 WHEN 0 THEN '0' WHEN 1 THEN ' 3' WHEN 2 THEN '4' WHEN 3 THEN 'abc' WHEN 4 THEN '2' WHEN 5 THEN '-1' END"}
_EXAM = {"q": _GENERIC["q"], "ctx": "CASE conv_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN substr(text, 1, 9) WHEN 2 THEN '' END"} | {f"o{k}": f"CASE WHEN (conv_id + {k}) % 6 = 0 THEN 'nan' ELSE {_GENERIC[c]} END" for k, c in enumerate("ABCDE", 1)}
_EXAM |= {"k": "CASE (conv_id * 100 + turn) % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'a' WHEN 2 THEN 'E' WHEN 3 THEN 'Z' WHEN 4 THEN ' c ' END", "few": "CASE conv_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END"}


def _raw(columns):
    return [_TURN, *[f"{e} AS {c}" for c, e in columns.items()]]


def _raw_sql(columns):
    return f"(SELECT {', '.join(_raw(columns))} FROM conversations)"


_FULL = "nullif(trim({}), '')"


def _example_sql(question, choices, index, source, context="NULL", where="TRUE"):
    return f"""WITH p AS (SELECT n, {question} AS question, {choices} AS ch, {index} AS answer, {context} AS context FROM {source} WHERE {where})
    SELECT n, question, array_to_string(ch, '/') AS choices, CAST(answer AS INTEGER) AS answer, context FROM p WHERE question IS NOT NULL AND len(ch) > 0 AND answer >= 0 AND answer < len(ch)"""


def _example(frame, parsed, context=False):
    out = frame.withColumn("e", parsed).where("e is not null")
    return out.select("n", "e.question", F.array_join("e.choices", "/").alias("choices"), "e.answer", F.col("e.context") if context else F.lit(None).cast("string").alias("context"))


def _list(*columns):
    return "list_filter([" + ", ".join(columns) + "], lambda x: x IS NOT NULL)"


_LETTER = "nullif(instr('ABCDE', upper(trim({}))), 0) - 1"


@query("parse_generic", _example_sql(_FULL.format("q"), _list(*[_FULL.format(c) for c in "ABCDE"]), f"CASE WHEN regexp_full_match(upper(trim(ans)), '[A-E]') THEN {_LETTER.format('ans')} ELSE TRY_CAST(trim(ans) AS INTEGER) END", _raw_sql(_GENERIC), "CAST(NULL AS VARCHAR)"))
def _(t):
    frame = t.conversations.selectExpr(*_raw(_GENERIC))
    return _example(frame, mcq.parse_generic(["q"], ["ans"]))


@query("parse_acva", _example_sql(_FULL.format("q"), "['صح', 'خطأ']", "CASE trim(ans) WHEN 'صح' THEN 0 WHEN 'خطأ' THEN 1 END", _raw_sql(_ACVA), "CAST(NULL AS VARCHAR)"))
def _(t):
    return _example(t.conversations.selectExpr(*_raw(_ACVA)), mcq.parse_true_false(F.col("q"), F.col("ans")))


@query("parse_alghafa", _example_sql(_FULL.format("q"), _list(*[_FULL.format(f"s{k}") for k in range(1, 6)]), "TRY_CAST(trim(label) AS INTEGER)", _raw_sql(_ALGHAFA), "CAST(NULL AS VARCHAR)"))
def _(t):
    frame = t.conversations.selectExpr(*_raw(_ALGHAFA))
    return _example(frame, mcq.parse_solutions(F.col("q"), [F.col(f"s{k}") for k in range(1, 6)], F.col("label")))


_REAL = "CASE WHEN lower(trim({0})) <> 'nan' THEN nullif(trim({0}), '') END"


@query("parse_exam", _example_sql(_FULL.format("q"), _list(*[_REAL.format(f"o{k}") for k in range(1, 6)]), _LETTER.format("k"), _raw_sql(_EXAM), f"coalesce({_REAL.format('ctx')}, '')", "coalesce(few, 0) = 0"))
def _(t):
    frame = t.conversations.selectExpr(*_raw(_EXAM))
    return _example(frame, mcq.parse_exam(F.col("q"), [F.col(f"o{k}") for k in range(1, 6)], F.col("k"), F.col("ctx"), F.col("few")), True)


_LINES = "array_to_string(list_transform(range(1, len(ch) + 1), lambda k: ['أ', 'ب', 'ج', 'د', 'هـ'][k] || '. ' || ch[k]), chr(10))"
_ITEMS = "SELECT item_id, text AS question, [substr(text, 1, 5), substr(text, 6, 7), 'c'] AS ch, CAST(item_id % 3 AS INTEGER) AS answer FROM benchmark"


def _items(t):
    return t.benchmark.select("item_id", F.col("text").alias("question"), F.array(F.substring("text", 1, 5), F.substring("text", 6, 7), F.lit("c")).alias("ch"), (F.col("item_id") % 3).cast("int").alias("answer"))


@query("mcq_prompt", f"WITH i AS ({_ITEMS}), p AS (SELECT *, '{mcq.QUESTION}' || chr(10) || question || chr(10) || chr(10) || '{mcq.CHOICES}' || chr(10) || {_LINES} || chr(10) || chr(10) || '{mcq.ANSWER}' AS prompt FROM i) SELECT item_id, md5(prompt) AS prompt_md5, md5(prompt || ' ' || ['أ', 'ب', 'ج'][answer + 1]) AS full_md5 FROM p")
def _(t):
    i = _items(t)
    full = mcq.letter_full(F.col("question"), F.col("ch"), F.col("answer"))
    return i.select("item_id", F.md5(mcq.letter_prompt(F.col("question"), F.col("ch")).cast("binary")).alias("prompt_md5"), F.md5(full.cast("binary")).alias("full_md5"))


@query("continuations", f"WITH i AS ({_ITEMS}) SELECT item_id, array_to_string(list_transform(range(1, len(ch) + 1), lambda k: ' ' || CASE WHEN item_id % 2 = 0 THEN ch[k] ELSE ['أ', 'ب', 'ج'][k] END), '|') AS conts FROM i")
def _(t):
    return _items(t).select("item_id", F.array_join(mcq.continuations(F.col("ch"), F.col("item_id") % 2 == 0), "|").alias("conts"))


# Scoring: embeddings as logits, dimensions 0 to 9 as choices.
_LOGITS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
ls AS (SELECT vec_id, label, list_transform(v, lambda x: x - list_max(v) - ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))) AS lp FROM e),
rq AS (SELECT vec_id AS ex_id, label AS gold, label % 3 AS source_config, unnest(range(0, 10)) AS choice_idx, unnest(list_slice(lp, 1, 10)) AS ll FROM ls),
un AS (SELECT choice_idx, avg(ll) AS u FROM rq GROUP BY choice_idx),
sc AS (SELECT rq.*, u, ll / greatest(1 + choice_idx % 3, 1) AS s, ll - u AS p FROM rq JOIN un USING (choice_idx)),
ex AS (SELECT ex_id, gold, source_config, list(ll ORDER BY choice_idx) AS lls, list(s ORDER BY choice_idx) AS ss, list(p ORDER BY choice_idx) AS ps FROM sc GROUP BY ALL),
pr AS (SELECT *, CAST(list_position(ss, list_max(ss)) - 1 AS INTEGER) AS pred_char, CAST(list_position(ps, list_max(ps)) - 1 AS INTEGER) AS pred_pmi FROM ex)"""


def _logits(t):
    return t.embeddings.where("embedding is not null and label is not null").select("vec_id", "label", scoring.log_softmax(F.col("embedding").cast("array<double>")).alias("lp"))


def _requests(t):
    """(ex_id, choice_idx, continuation, ll, unconditioned, gold, source_config); the prior of a continuation is computed once."""
    rows = _logits(t).select(F.col("vec_id").alias("ex_id"), F.col("label").alias("gold"), (F.col("label") % 3).alias("source_config"), F.posexplode(F.slice("lp", 1, 10)).alias("choice_idx", "ll"))
    rows = rows.withColumn("continuation", F.concat(F.lit(" "), F.repeat(F.lit("c"), 1 + F.col("choice_idx") % 3)))
    prior = rows.groupBy("choice_idx").agg(F.avg("ll").alias("unconditioned"))  # one row a distinct request
    return rows.join(F.broadcast(prior), "choice_idx")


@query("log_softmax", f"WITH {_LOGITS} SELECT vec_id, round(lp[label + 1], 6) AS gold_ll, round(list_sum(list_transform(lp, lambda x: exp(x))), 6) AS total FROM ls")
def _(t):
    total = F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x))
    return _logits(t).select("vec_id", F.round(F.get("lp", F.col("label")), 6).alias("gold_ll"), F.round(total, 6).alias("total"))


@query("mcq_char", f"WITH {_LOGITS} SELECT source_config, count(*) AS num_samples, round(avg(CAST(pred_char = gold AS DOUBLE)), 4) AS accuracy FROM pr GROUP BY source_config")
def _(t):
    return mcq.accuracy(mcq.score(_requests(t), "char")).where("source_config is not null").select("source_config", "num_samples", F.col("accuracy_char").alias("accuracy"))


@query("mcq_pmi", f"WITH {_LOGITS} SELECT source_config, count(*) AS num_samples, round(avg(CAST(pred_pmi = gold AS DOUBLE)), 4) AS accuracy FROM pr GROUP BY source_config")
def _(t):
    return mcq.accuracy(mcq.score(_requests(t), "pmi")).where("source_config is not null").select("source_config", "num_samples", F.col("accuracy_pmi").alias("accuracy"))


@query("mcq_char_pmi_grouping_sets", f"WITH {_LOGITS} SELECT source_config, count(*) AS num_samples, round(avg(CAST(pred_char = gold AS DOUBLE)), 4) AS accuracy_char, round(avg(CAST(pred_pmi = gold AS DOUBLE)), 4) AS accuracy_pmi FROM pr GROUP BY GROUPING SETS ((source_config), ())")
def _(t):
    return mcq.accuracy(mcq.score(_requests(t), "char+pmi")).select("source_config", "num_samples", "accuracy_char", "accuracy_pmi")


@query("uncond_cache_distinct", f"WITH {_LOGITS} SELECT choice_idx, round(u, 6) AS prior, (SELECT count(*) FROM rq) AS requests FROM un")
def _(t):
    rows = _requests(t)
    total = rows.agg(F.count(F.lit(1)).alias("requests"))  # one row
    priors = rows.groupBy("choice_idx").agg(F.round(F.first("unconditioned"), 6).alias("prior"))
    return priors.crossJoin(F.broadcast(total)).select(F.col("choice_idx").cast("long").alias("choice_idx"), "prior", "requests")


@query("mcq_failures", f"WITH {_LOGITS} SELECT ex_id, gold, pred_pmi AS pred, round(lls[pred_pmi + 1] - lls[gold + 1], 6) AS margin_ll, round(ss[pred_pmi + 1] - ss[gold + 1], 6) AS margin_char, round(ps[pred_pmi + 1] - ps[gold + 1], 6) AS margin_pmi FROM pr WHERE pred_pmi <> gold")
def _(t):
    return mcq.failures(mcq.score(_requests(t), "char+pmi")).select("ex_id", "gold", "pred", "margin_ll", "margin_char", "margin_pmi")


@query("choice_pivot", f"WITH {_LOGITS} SELECT ex_id, round(lls[1], 6) AS ll_0, round(lls[2], 6) AS ll_1, round(lls[3], 6) AS ll_2 FROM ex")
def _(t):
    rows = _requests(t).where("choice_idx < 3").groupBy("ex_id").pivot("choice_idx", [0, 1, 2]).agg(F.round(F.first("ll"), 6))
    return rows.select("ex_id", *[F.col(str(k)).alias(f"ll_{k}") for k in range(3)])


# Training data.
_PAIRS = """w AS (SELECT conv_id, turn, role, text, lead(text) OVER c AS answer, lead(role) OVER c AS next_role, lag(text) OVER c AS before FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT conv_id, turn, text AS question, answer, coalesce(before, '') AS context FROM w WHERE role = 'user' AND next_role = 'assistant')"""


@query("qa_pairs", f"WITH {_PAIRS} SELECT conv_id, turn, md5(question || '|' || answer || '|' || context) AS pair_md5 FROM qa")
def _(t):
    return corpora.conversation_pairs(t.conversations).select("conv_id", "turn", F.md5(F.concat_ws("|", "question", "answer", "context").cast("binary")).alias("pair_md5"))


_QA_TEXT = f"'{mcq.CONTEXT} ' || context || chr(10) || '{mcq.QUESTION} ' || question || chr(10) || '{mcq.ANSWER}'"


@query("qa_prompt", f"WITH {_PAIRS} SELECT conv_id, turn, md5({_QA_TEXT}) AS prompt_md5, md5({_QA_TEXT} || ' ' || answer) AS full_md5 FROM qa")
def _(t):
    q = corpora.conversation_pairs(t.conversations)
    prompt, full = training.qa_prompt(F.col("question"), F.col("context")), training.qa_prompt(F.col("question"), F.col("context"), F.col("answer"))
    return q.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt_md5"), F.md5(full.cast("binary")).alias("full_md5"))


# Byte ids of a question, and of question and answer cut to 256: where the answer does not fit, nothing is left to learn.
_IDS = "list_concat(list_concat([1], list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: CAST('0x' || h AS BIGINT) + 4)), [2])"
_ENCODED = f"{_PAIRS}, ids AS (SELECT conv_id, turn, {_IDS.format('question')} AS p, list_slice({_IDS.format(chr(39).join(['question || ', ' ', ' || answer']))}, 1, 256) AS f FROM qa)"
_LCP = "(coalesce(list_position(list_transform(range(1, least(len(p), len(f)) + 1), lambda k: p[k] = f[k]), FALSE), 0))"
_COMMON = f"(CASE WHEN {_LCP} = 0 THEN least(len(p), len(f)) ELSE {_LCP} - 1 END)"


def _encoded_pairs(t):
    from harfmill.operators.tokenizers import encode_bytes

    q = corpora.conversation_pairs(t.conversations)
    return q.select("conv_id", "turn", encode_bytes(F.col("question")).alias("p"), F.slice(encode_bytes(F.concat("question", F.lit(" "), "answer")), 1, 256).alias("f"))


@query("lcp_mask", f"WITH {_ENCODED}, c AS (SELECT *, {_COMMON} AS n FROM ids) SELECT conv_id, turn, CASE WHEN n < len(f) THEN md5(array_to_string(list_concat(list_transform(range(0, n), lambda k: CAST(-100 AS BIGINT)), list_slice(f, n + 1, len(f))), ',')) END AS labels_md5 FROM c")
def _(t):
    return _encoded_pairs(t).select("conv_id", "turn", joined_md5(scoring.answer_labels(F.col("p"), F.col("f"))).alias("labels_md5"))


@query("loglik_span", f"WITH {_ENCODED} SELECT conv_id, turn, CAST({_COMMON} AS INTEGER) AS lcp, CAST(len(p) AS INTEGER) AS plain FROM ids")
def _(t):
    p, f = F.col("p"), F.col("f")
    return _encoded_pairs(t).select("conv_id", "turn", scoring.continuation_start(p, f).alias("lcp"), scoring.continuation_start(p, f, "length").alias("plain"))


_BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: CAST('0x' || h AS BIGINT) + 4)"


def _batch_sql(max_length):
    return f"""WITH {_PAIRS}, r AS (SELECT conv_id % 8 AS shard, conv_id * 1000 + turn AS ex_id, list_slice({_BYTES.format('answer')}, 1, {max_length}) AS ids FROM qa),
    b AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY ex_id) - 1) // 4 AS batch_id FROM r), x AS (SELECT *, max(len(ids)) OVER (PARTITION BY shard, batch_id) AS width FROM b)
    SELECT shard, batch_id, ex_id, md5(array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda k: CAST(0 AS BIGINT))), ',')) AS ids_md5, len(ids) AS ones,
    md5(array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda k: CAST(-100 AS BIGINT))), ',')) AS labels_md5 FROM x"""


def _batches(t, max_length):
    from harfmill.operators.tokenizers import encode_bytes

    ids = encode_bytes(F.col("answer"))
    rows = corpora.conversation_pairs(t.conversations).select((F.col("conv_id") % 8).alias("shard"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ex_id"), F.slice(ids, F.lit(2), F.size(ids) - 2).alias("ids"), F.lit(None).cast("array<bigint>").alias("labels"))
    out = training.batches(rows, 4, max_length=max_length)
    return out.select("shard", "batch_id", "ex_id", joined_md5(F.col("ids")).alias("ids_md5"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"), joined_md5(F.col("labels")).alias("labels_md5"))


@query("batch_pad", _batch_sql(64))
def _(t):
    return _batches(t, 64)


@query("batch_pad_2048", _batch_sql(2048))
def _(t):
    """The reference's length for byte ids."""
    return _batches(t, 2048)


@query(
    "lr_schedule",
    f"SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s < 2 THEN s / 2.0 ELSE 0.5 * (1 + cos({math.pi!r} * least((s - 2) / 8.0, 1.0))) END, 6) AS cosine, round(CASE WHEN s < 2 THEN s / 2.0 ELSE greatest(0.0, 1 - least((s - 2) / 8.0, 1.0)) END, 6) AS linear FROM range(0, 15) AS r(s)",
)
def _(t):
    lr = lambda kind: F.round(scoring.learning_rate(F.col("id"), 2, 10, kind), 6)
    return t.spark.range(15).select(F.col("id").alias("step"), lr("cosine").alias("cosine"), lr("linear").alias("linear"))


_LOSSES = "losses AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss FROM events WHERE value IS NOT NULL)"


def _losses(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.where("value is not null").select(F.col("user_id").alias("run"), F.row_number().over(w).cast("long").alias("step"), F.col("value").alias("loss"))


_STATE = "{{'best': {}, 'best_step': CAST({} AS BIGINT), 'bad': CAST({} AS BIGINT), 'evals': CAST({} AS BIGINT), 'stopped': CAST({} AS BIGINT)}}"
_LIVE = "(acc.stopped IS NULL AND x.best_step >= 2 AND x.best_step % 2 = 0)"
_BETTER = f"({_LIVE} AND x.best < acc.best)"
_BAD = f"(CASE WHEN {_BETTER} THEN 0 WHEN {_LIVE} THEN acc.bad + 1 ELSE acc.bad END)"


@query(
    "early_stop_fold",
    f"""WITH {_LOSSES}, s AS (SELECT run, list({_STATE.format('CAST(loss AS DOUBLE)', 'step', 0, 0, 'NULL')} ORDER BY step) AS xs FROM losses GROUP BY run),
    f AS (SELECT run, list_reduce(xs, lambda acc, x: {_STATE.format(f'CASE WHEN {_BETTER} THEN x.best ELSE acc.best END', f'CASE WHEN {_BETTER} THEN x.best_step ELSE acc.best_step END', _BAD, f'CASE WHEN {_LIVE} THEN acc.evals + 1 ELSE acc.evals END', f'CASE WHEN {_LIVE} AND {_BAD} >= 3 THEN x.best_step ELSE acc.stopped END')}, {_STATE.format("CAST('inf' AS DOUBLE)", 'NULL', 0, 0, 'NULL')}) AS a FROM s)
    SELECT run, CASE WHEN a.best_step IS NOT NULL THEN round(a.best, 6) END AS best, a.best_step AS best_step, a.evals AS evals, a.stopped AS stopped FROM f""",
)
def _(t):
    s = training.stop_table(_losses(t), patience=3, every=2, minimum=2)
    return s.select("run", F.when(F.col("best_step").isNotNull(), F.round("best", 6)).alias("best"), "best_step", F.col("evals").cast("long").alias("evals"), "stopped")


@query("loss_tail", f"WITH {_LOSSES} SELECT run, step, loss FROM losses QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 5")
def _(t):
    return training.loss_tail(_losses(t), 5).select("run", "step", "loss")


@query("trainable_filter", "SELECT DISTINCT lang || '.' || source || '.weight' AS name, contains(lang || '.' || source || '.weight', 'en.') OR contains(lang || '.' || source || '.weight', 'src1') AS trains FROM documents")
def _(t):
    names = t.documents.select(F.concat("lang", F.lit("."), "source", F.lit(".weight")).alias("name")).distinct()
    return names.select("name", training.trainable(F.col("name"), ["en.", "src1"]).alias("trains"))


@query("answer_token_stats", f"WITH {_PAIRS} SELECT count(*) FILTER (length(trim(answer)) > 0) AS kept, count(*) FILTER (length(trim(answer)) = 0) AS dropped, round(avg(octet_length(encode(' ' || answer))) FILTER (length(trim(answer)) > 0), 4) AS mean_completion FROM qa")
def _(t):
    q = corpora.conversation_pairs(t.conversations).withColumn("full", F.length(F.trim("answer")) > 0)
    size = F.octet_length(F.concat(F.lit(" "), "answer"))
    return q.agg(F.count_if("full").alias("kept"), F.count_if(~F.col("full")).alias("dropped"), F.round(F.avg(F.when(F.col("full"), size)), 4).alias("mean_completion"))


# Metrics and reports.
@query(
    "qa_f1_em",
    f"""WITH {_PAIRS}, n AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(trim(question)), '\\s+', ' ', 'g'), '\\s+'), lambda w: w <> '') AS p, list_filter(string_split_regex(regexp_replace(lower(trim(answer)), '\\s+', ' ', 'g'), '\\s+'), lambda w: w <> '') AS r, regexp_replace(lower(trim(question)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(answer)), '\\s+', ' ', 'g') AS em FROM qa),
    c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda a: a = w)), len(list_filter(r, lambda b: b = w))))), 0) AS common FROM n)
    SELECT conv_id, turn, round(CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN len(p) = 0 OR len(r) = 0 OR common = 0 THEN 0.0 ELSE 2.0 * common / (len(p) + len(r)) END, 6) AS f1, CAST(em AS DOUBLE) AS em FROM c""",
)
def _(t):
    q = corpora.conversation_pairs(t.conversations)
    return q.select("conv_id", "turn", F.round(metrics.token_f1(F.col("question"), F.col("answer")), 6).alias("f1"), metrics.exact_match(F.col("question"), F.col("answer")).alias("em"))


@query("perplexity", f"WITH {_LOSSES} SELECT run, round(exp(least(avg(loss) / 100, 100)), 6) AS perplexity FROM losses GROUP BY run")
def _(t):
    return _losses(t).groupBy("run").agg(F.round(scoring.perplexity(F.avg("loss") / 100), 6).alias("perplexity"))


# A run's intrinsic figures (a row a user) meet its evaluations (a row an event): 1:N.
_INTRINSIC = "SELECT user_id, CASE WHEN user_id % 7 <> 3 THEN round(avg(value) / 100, 6) END AS r, CASE WHEN user_id % 11 <> 4 THEN round(max(value) / 10, 6) END AS c FROM events GROUP BY user_id"
_DOWN = {
    "k": "event_id", "user_id": "user_id", "mcq": "event_id % 13 <> 0", "a": "CASE WHEN event_id % 5 <> 1 THEN value / 100 END",
    "s": "CASE event_id % 9 WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 WHEN 2 THEN NULL ELSE value END", "n": "CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE event_id % 50 + 1 END",
}
_MEI_SQL = "CASE WHEN NOT mcq THEN 'task_not_mcq' WHEN a IS NULL THEN 'missing_accuracy' WHEN r IS NULL THEN 'missing_rps' WHEN c IS NULL THEN 'missing_compression' WHEN s IS NULL THEN 'missing_time' WHEN n IS NULL THEN 'missing_num_eval_rows' WHEN s <= 0 THEN 'zero_time' WHEN n <= 0 THEN 'zero_rows' ELSE 'ok' END"
_CELLS_SQL = f"i AS ({_INTRINSIC}), d AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _DOWN.items())} FROM events), m AS (SELECT d.*, r, c, {_MEI_SQL} AS status FROM d JOIN i USING (user_id))"


def _mei(t):
    i = t.events.groupBy("user_id").agg(F.round(F.avg("value") / 100, 6).alias("r"), F.round(F.max("value") / 10, 6).alias("c"))
    i = i.select("user_id", F.when(F.col("user_id") % 7 != 3, F.col("r")).alias("r"), F.when(F.col("user_id") % 11 != 4, F.col("c")).alias("c"))
    d = t.events.selectExpr(*[f"{e} AS {c}" for c, e in _DOWN.items()]).select("k", "user_id", "mcq", "a", F.col("s").cast("double").alias("s"), "n")
    args = [F.col(x) for x in ("mcq", "a", "r", "c", "s", "n")]
    return d.join(i, "user_id").select("k", scoring.efficiency_status(*args).alias("status"), scoring.efficiency_index(*args).alias("mei"))


@query("mei_status", f"WITH {_CELLS_SQL} SELECT k, status, CASE WHEN status = 'ok' THEN round(a * r * c / (s / n), 6) END AS mei FROM m")
def _(t):
    return _mei(t)


@query("status_tally", f"WITH {_CELLS_SQL} SELECT status, count(*) AS n FROM m GROUP BY status")
def _(t):
    return _mei(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_GRID = "grid AS (" + " UNION ALL ".join(f"{_family_sql(f, f'{chr(39)}{f}{chr(39)} AS tokenizer, lang, ')} GROUP BY lang" for f in _FAMILY) + ")"
_SWEEP = f"{_BASE}, {_GRID}"
_LONG = "long AS (UNPIVOT (SELECT tokenizer || '_' || lang AS run, fertility, compression_ratio, avg_token_count FROM grid) ON fertility, compression_ratio, avg_token_count INTO NAME metric VALUE v)"


def _long(t):
    g = size_metrics_by_lang(t).withColumn("run", F.concat_ws("_", "tokenizer", "lang"))
    return g.select("run", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("fertility", "compression_ratio", "avg_token_count")])))


@query("comparison_pivot", f"WITH {_SWEEP}, {_LONG} SELECT metric, coalesce(printf('%.4f', max(v) FILTER (run = 'char_en')), '—') AS char_en, coalesce(printf('%.4f', max(v) FILTER (run = 'byte_de')), '—') AS byte_de, coalesce(printf('%.4f', max(v) FILTER (run = 'word_xx')), '—') AS word_xx FROM long GROUP BY metric")
def _(t):
    return reports.comparison(_long(t), "metric", "run", "v", ["char_en", "byte_de", "word_xx"])


@query("comparison_all", f"WITH {_SWEEP}, {_LONG}, filled AS (SELECT metric, run, printf('%.4f', v) AS cell FROM long) SELECT * FROM (PIVOT filled ON run USING coalesce(max(cell), '—') GROUP BY metric)")
def _(t):
    """Every run of the grid: as many columns as tokenizers x languages."""
    langs = sorted(r[0] for r in t.documents.where("lang is not null").select("lang").distinct().collect())
    return reports.comparison(_long(t), "metric", "run", "v", [f"{f}_{lang}" for f in _FAMILY for lang in langs])


_FLAT = 'SELECT tokenizer, lang, fertility AS "size.fertility", unk_rate AS "size.more.unk_rate" FROM grid'


def _flat(t, cap):
    return reports.flatten(size_metrics_by_lang(t, cap).select("tokenizer", "lang", F.struct("fertility", F.struct("unk_rate").alias("more")).alias("size")))


@query("flatten_metrics", f"WITH {_SWEEP} {_FLAT}")
def _(t):
    return _flat(t, 5000)


@query("flatten_metrics_50k", f"WITH {_BASE_50K}, {_GRID} {_FLAT}")
def _(t):
    return _flat(t, 50_000)


@query("metric_corr_regr", f"WITH {_SWEEP} SELECT round(corr(fertility, compression_ratio), 6) AS r, round(regr_slope(compression_ratio, fertility), 6) AS slope, round(regr_intercept(compression_ratio, fertility), 6) AS intercept FROM grid")
def _(t):
    return size_metrics_by_lang(t).agg(F.round(F.corr("fertility", "compression_ratio"), 6).alias("r"), F.round(F.regr_slope("compression_ratio", "fertility"), 6).alias("slope"), F.round(F.regr_intercept("compression_ratio", "fertility"), 6).alias("intercept"))


@query("top3_per_task", f"WITH {_SWEEP} SELECT lang, tokenizer, row_number() OVER (PARTITION BY lang ORDER BY compression_ratio DESC, tokenizer) AS rank FROM grid QUALIFY rank <= 3")
def _(t):
    return reports.top_per(size_metrics_by_lang(t), "lang", "compression_ratio", "tokenizer").select("lang", "tokenizer", F.col("rank").cast("long").alias("rank"))


@query("best_subword_gap", f"WITH {_SWEEP} SELECT lang, max(compression_ratio) FILTER (tokenizer = 'char') AS own, max(compression_ratio) FILTER (tokenizer <> 'char') AS best, round(max(compression_ratio) FILTER (tokenizer <> 'char') - max(compression_ratio) FILTER (tokenizer = 'char'), 6) AS gap FROM grid GROUP BY lang")
def _(t):
    return reports.best_gap(size_metrics_by_lang(t), "lang", "tokenizer", "compression_ratio", "char")


@query("consistency_stats", f"WITH {_SWEEP} SELECT tokenizer, round(avg(fertility), 4) AS mean, round(stddev_samp(fertility), 4) AS std, min(fertility) AS lo, max(fertility) AS hi FROM grid GROUP BY tokenizer")
def _(t):
    return size_metrics_by_lang(t).groupBy("tokenizer").agg(F.round(F.avg("fertility"), 4).alias("mean"), F.round(F.stddev_samp("fertility"), 4).alias("std"), F.min("fertility").alias("lo"), F.max("fertility").alias("hi"))


@query("vocab_delta", f"WITH {_SWEEP} SELECT lang, max(fertility) FILTER (tokenizer = 'char') AS \"char\", max(fertility) FILTER (tokenizer = 'byte') AS byte, round(max(fertility) FILTER (tokenizer = 'byte') - max(fertility) FILTER (tokenizer = 'char'), 4) AS delta FROM grid GROUP BY lang")
def _(t):
    wide = size_metrics_by_lang(t).groupBy("lang").pivot("tokenizer", ["char", "byte"]).agg(F.max("fertility"))
    return wide.withColumn("delta", F.round(F.col("byte") - F.col("char"), 4))


@query("sweep_resume_anti", "WITH c AS (SELECT DISTINCT lang AS kind FROM documents), s AS (SELECT DISTINCT source AS size FROM documents) SELECT kind || '_' || size AS cell, kind, size FROM c, s WHERE kind || '_' || size NOT IN (SELECT lang || '_' || source FROM documents WHERE doc_id % 3 = 0 AND lang IS NOT NULL AND source IS NOT NULL)")
def _(t):
    """The grid of kinds and sizes (a few of each) without the cells that have results."""
    kinds, sizes = t.documents.select(F.col("lang").alias("kind")).distinct(), t.documents.select(F.col("source").alias("size")).distinct()
    cells = reports.grid(kinds, sizes).withColumn("cell", F.concat_ws("_", "kind", "size"))
    done = t.documents.where("doc_id % 3 = 0").select(F.concat_ws("_", "lang", "source").alias("cell")).distinct()
    return reports.resume(cells, done).select("cell", "kind", "size")


@query("mechanical_flags", f"WITH {_SWEEP} SELECT tokenizer, lang, CASE tokenizer WHEN 'char' THEN 'floor' WHEN 'byte' THEN 'floor' WHEN 'word' THEN 'ceiling' END AS flag FROM grid")
def _(t):
    flags = t.values("tokenizer string, flag string", [(k, v.split()[1].rstrip(":")) for k, v in reports.MECHANICAL.items()])
    return size_metrics_by_lang(t).select("tokenizer", "lang").join(F.broadcast(flags), "tokenizer", "left")


@query("config_summary", f"WITH {_SWEEP} SELECT tokenizer, first(n_texts ORDER BY lang) AS n_texts, round(avg(fertility), 4) AS fertility, round(avg(compression_ratio), 4) AS compression_ratio, row_number() OVER (ORDER BY round(avg(compression_ratio), 4) DESC, tokenizer) AS rank FROM grid GROUP BY tokenizer")
def _(t):
    return reports.summary(size_metrics_by_lang(t), "tokenizer", {"n_texts": "first", "fertility": "mean", "compression_ratio": "mean"}, "lang", "compression_ratio")


@query("efficiency_by_group", "SELECT event_type, round(avg(value), 4) AS mean_loss, round(avg(event_id % 97), 4) AS mean_time, round(avg(value / (event_id % 97 + 1)), 6) AS per_second FROM events GROUP BY event_type")
def _(t):
    e = t.events.select("event_type", "value", (F.col("event_id") % 97).alias("time"))
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_loss"), F.round(F.avg("time"), 4).alias("mean_time"), F.round(F.avg(F.col("value") / (F.col("time") + 1)), 6).alias("per_second"))


@query("first_per_config", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def _(t):
    """One row a (source, lang): the first by id, not whichever comes first."""
    return reports.first_per(t.documents, ["source", "lang"], "doc_id").select("source", "lang", "doc_id")


@query("ordered_runs", f"WITH {_SWEEP} SELECT tokenizer, lang, list_position(['word', 'byte', 'char'], tokenizer) AS place FROM grid")
def _(t):
    """The order of tokenizers in reports."""
    return size_metrics_by_lang(t).select("tokenizer", "lang", reports.place("tokenizer", ["word", "byte", "char"]).alias("place"))


@query("windowed_loss", "SELECT user_id AS run, time_bucket(INTERVAL 1 DAY, ts) AS start, round(avg(value), 4) AS mean_loss, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    from harfmill.streaming.monitor import windowed_loss

    rows = windowed_loss(t.events.select(F.col("user_id").alias("run"), "ts", F.col("value").alias("loss")), "1 day")
    return rows.select("run", "start", F.round("mean_loss", 4).alias("mean_loss"), "n")
