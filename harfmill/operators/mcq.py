"""Multiple-choice benchmarks: parsers, prompts, scoring, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfmill.functions.arabic import LATIN, has_latin
from harfmill.functions.scoring import char_score, first_argmax, pmi_score

# Prompt parts, answer letters and labels.
QUESTION, CHOICES, ANSWER, CONTEXT = "### السؤال:", "### الخيارات:", "### الإجابة:", "### السياق:"
LETTERS = ["أ", "ب", "ج", "د", "هـ"]
TRUE_FALSE = ["صح", "خطأ"]
WORD_SCORED = ["multiple_choice_facts_truefalse_balanced_task", "multiple_choice_rating_sentiment_no_neutral_task", "multiple_choice_rating_sentiment_task", "multiple_choice_sentiment_task"]


def _filled(c: Column) -> Column:
    """null for blank strings."""
    return F.nullif(F.trim(c), F.lit(""))


def _letter_index(c: Column) -> Column:
    return F.nullif(F.instr(F.lit("ABCDE"), F.upper(F.trim(c))), F.lit(0)) - 1


def _choices(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def _in_range(answer: Column, choices: Column) -> Column:
    return F.when((answer >= 0) & (answer < F.size(choices)), answer.cast("int"))


def _parsed(question: Column, choices: Column, answer: Column, context: Column | None = None) -> Column:
    """The example, or null if anything is missing."""
    fields = [question.alias("question"), choices.alias("choices"), answer.alias("answer")] + ([context.alias("context")] if context is not None else [])
    return F.when(question.isNotNull() & (F.size(choices) > 0) & answer.isNotNull(), F.struct(*fields))


def parse_generic(question: list[str], answer: list[str], letters: list[str] = ["A", "B", "C", "D", "E"]) -> Column:  # noqa: B006
    """First filled question column, choices from letter columns, answer a letter or a number."""
    q = F.coalesce(*[_filled(F.col(c)) for c in question])
    a = F.coalesce(*[_filled(F.col(c)) for c in answer])
    choices = _choices(*[_filled(F.col(c)) for c in letters])
    index = F.when(F.upper(a).rlike("^[A-E]$"), _letter_index(a)).otherwise(F.expr("try_cast(null as int)") if not answer else a.try_cast("int"))
    return _parsed(q, choices, _in_range(index, choices))


def parse_true_false(question: Column, answer: Column) -> Column:
    choices = F.array(*[F.lit(x) for x in TRUE_FALSE])
    return _parsed(_filled(question), choices, F.when(F.trim(answer) == TRUE_FALSE[0], 0).when(F.trim(answer) == TRUE_FALSE[1], 1))


def parse_solutions(query: Column, solutions: list[Column], label: Column) -> Column:
    """Solutions that are not blank, and a 0-based label."""
    choices = _choices(*[_filled(s) for s in solutions])
    return _parsed(_filled(query), choices, _in_range(F.trim(label).try_cast("int"), choices))


def parse_exam(question: Column, options: list[Column], key: Column, context: Column, few_shot: Column) -> Column:
    """Exam rows but the few-shot ones; blank and nan options go, as do such contexts."""
    real = lambda c: F.when(F.lower(F.trim(c)) != "nan", _filled(c))
    choices = _choices(*[real(o) for o in options])
    out = _parsed(_filled(question), choices, _in_range(_letter_index(_filled(key)), choices), F.coalesce(real(context), F.lit("")))
    return F.when(F.coalesce(few_shot, F.lit(0)) == 0, out)


def row_has_latin(question: Column, choices: Column, context: Column) -> Column:
    fields = F.concat(F.array(question), choices, F.array(context))
    return F.exists(fields, has_latin)


def letter_prompt(question: Column, choices: Column, context: Column | None = None) -> Column:
    """Question, lettered choices, answer header; with a context before all if it is not empty."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform(choices, lambda c, i: F.concat(F.coalesce(F.get(letters, i), i.cast("string")), F.lit(". "), c))
    body = F.concat(F.lit(f"{QUESTION}\n"), question, F.lit(f"\n\n{CHOICES}\n"), F.array_join(lines, "\n"), F.lit(f"\n\n{ANSWER}"))
    if context is None:
        return body
    return F.concat(F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(f"{CONTEXT}\n"), context, F.lit("\n\n"))).otherwise(""), body)


def letter_full(question: Column, choices: Column, answer: Column) -> Column:
    return F.concat(letter_prompt(question, choices), F.lit(" "), F.get(F.array(*[F.lit(x) for x in LETTERS]), answer))


def question_prompt(question: Column) -> Column:
    return F.concat(F.lit(f"{QUESTION}\n"), question, F.lit(f"\n\n{ANSWER}"))


def continuations(choices: Column, by_word: Column) -> Column:
    """A leading space and the choice where words are scored, else its letter."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.transform(choices, lambda c, i: F.concat(F.lit(" "), F.when(by_word, c).otherwise(F.coalesce(F.get(letters, i), i.cast("string")))))


def score(requests: DataFrame, mode: str = "char") -> DataFrame:
    """requests: ex_id, choice_idx, continuation, ll, unconditioned, gold, source_config.  Per example the scores, predictions and margins.

    mode: char, pmi, char+pmi (priors decide), or raw: log-likelihoods as they are.
    """
    by_length = F.col("ll") if mode == "raw" else char_score(F.col("ll"), F.col("continuation"))
    scored = requests.withColumn("s", by_length)
    scored = scored.withColumn("p", pmi_score(F.col("ll"), F.col("unconditioned")) if "pmi" in mode else F.lit(None).cast("double"))
    rows = scored.groupBy("ex_id", "source_config", "gold").agg(F.array_sort(F.collect_list(F.struct("choice_idx", "ll", "s", "p"))).alias("x"))
    pick = lambda f: F.transform("x", lambda v: v[f])
    out = rows.select("ex_id", "source_config", "gold", pick("ll").alias("ll"), pick("s").alias("char"), pick("p").alias("pmi"))
    out = out.withColumn("pred_char", first_argmax(F.col("char"))).withColumn("pred_pmi", first_argmax(F.col("pmi")) if "pmi" in mode else F.lit(None).cast("int"))
    return out.withColumn("pred", F.col("pred_pmi") if "pmi" in mode else F.col("pred_char"))


def accuracy(scored: DataFrame, totals: bool = False) -> DataFrame:
    """In total (source_config null) and by sub-config, in one pass; with `totals` a column says which row is the total."""
    hit = lambda c: F.round(F.avg((F.col(c) == F.col("gold")).cast("double")), 4)
    mark = [(F.grouping("source_config") == 1).alias("is_total")] if totals else []
    return scored.groupingSets([["source_config"], []], "source_config").agg(F.count(F.lit(1)).alias("num_samples"), hit("pred_char").alias("accuracy_char"), hit("pred_pmi").alias("accuracy_pmi"), *mark)


def failures(scored: DataFrame) -> DataFrame:
    """Wrong predictions with how far the gold choice was behind."""
    gap = lambda c: F.round(F.get(F.col(c), F.col("pred")) - F.get(F.col(c), F.col("gold")), 6)
    return scored.where("pred <> gold").select("ex_id", "source_config", "gold", "pred", gap("ll").alias("margin_ll"), gap("char").alias("margin_char"), gap("pmi").alias("margin_pmi"))
