"""Multiple-choice tasks as plug-ins: how rows are parsed, prompted, continued and scored.

Examples are a table (ex_id, question, choices, answer, context, source_config).
A scorer is a function of a table of distinct requests (context, continuation)
that adds `ll`, the log-likelihood: a model adapter, or anything else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfmill.operators import mcq
from harfmill.operators.registry import tasks as registry
from harfmill.sources.results import write_failures

DEFAULT = "_default"
MODES = ("char", "pmi", "char+pmi")
Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Task:
    """`parse` makes the example struct of a raw row (null: the row goes); the hooks are Columns over examples."""

    name: str
    parse: Callable[[DataFrame], Column]
    excluded: tuple[str, ...] = ()
    clean_latin: bool = False
    #: Whether the choices themselves are scored, not their letters.
    by_word: Callable[[], Column] = field(default=lambda: F.lit(False))
    #: Whether the prompt lists the choices.
    lists_choices: bool = True
    with_context: bool = False

    def prompt(self) -> Column:
        """What stands before the continuation."""
        question, choices, context = F.col("question"), F.col("choices"), F.col("context")
        listed = mcq.letter_prompt(question, choices, context if self.with_context else None)
        bare = mcq.question_prompt(question)
        return bare if not self.lists_choices else F.when(self.by_word(), bare).otherwise(listed)

    def continuations(self) -> Column:
        return mcq.continuations(F.col("choices"), self.by_word() if self.lists_choices else F.lit(True))

    def unconditioned(self) -> Column:
        """What stands before the continuation where only its prior is asked for."""
        return F.lit(mcq.ANSWER)

    def scores(self, requests: DataFrame, mode: str) -> DataFrame:
        """Per example the scores of its choices, and predictions."""
        return mcq.score(requests, mode)

    def text_fields(self) -> list[Column]:
        """Texts in which Latin letters are looked for."""
        return [F.array("question"), F.col("choices"), F.array("context")]

    def examples(self, rows: DataFrame) -> DataFrame:
        """rows: raw columns, ex_id and maybe source_config.  Parsed examples; RuntimeError if there are none."""
        config = F.coalesce("source_config", F.lit(DEFAULT)) if "source_config" in rows.columns else F.lit(DEFAULT)
        parsed = rows.withColumn("e", self.parse(rows)).where("e is not null")
        names = parsed.schema["e"].dataType.names
        context = F.col("e.context") if "context" in names else F.lit(None).cast("string")
        out = parsed.select("ex_id", "e.question", "e.choices", "e.answer", context.alias("context"), config.alias("source_config"))
        if self.excluded:
            out = out.where(~F.col("source_config").isin(*self.excluded))
        if out.isEmpty():
            raise RuntimeError(f"{self.name}: no row could be parsed")
        if self.clean_latin:
            out = out.where(~F.exists(F.concat(*self.text_fields()), lambda t: F.coalesce(t.rlike(mcq.LATIN), F.lit(False))))
            if out.isEmpty():
                raise RuntimeError(f"{self.name}: every row holds Latin letters")
        return out

    def requests(self, examples: DataFrame) -> DataFrame:
        """(ex_id, choice_idx, context, continuation, query, gold, source_config), a row a choice."""
        rows = examples.select("ex_id", "source_config", F.col("answer").alias("gold"), self.prompt().alias("context"), self.unconditioned().alias("query"), F.posexplode(self.continuations()).alias("choice_idx", "continuation"))
        return rows.select("ex_id", "choice_idx", "context", "continuation", "query", "gold", "source_config")

    def evaluate(self, rows: DataFrame, scorer: Scorer, mode: str = "char", max_samples: int | None = None, failures: str | None = None) -> dict[str, Any]:
        """Accuracy in total and by sub-config; with `failures` a folder where wrong answers are written as CSV."""
        if mode not in MODES:
            raise ValueError(f"unknown score normalization {mode!r}; one of {MODES}")
        examples = self.examples(rows)
        if max_samples:
            examples = examples.orderBy("ex_id").limit(max_samples)
        scored = self.scores(with_likelihoods(self.requests(examples), scorer, "pmi" in mode), mode).persist()
        try:
            out = metrics_of(scored, mode)
            if failures is not None:
                table = failure_table(examples, self, scored, mode)
                write_failures(table, f"{failures}/{self.name}_accuracy_failures.csv", table.columns)
        finally:
            scored.unpersist()
        return out | {"clean_latin_rows": self.clean_latin}


def with_likelihoods(requests: DataFrame, scorer: Scorer, priors: bool) -> DataFrame:
    """ll of each request, and with `priors` the unconditioned one: distinct requests are scored once each."""
    asked = requests.select("context", "continuation").distinct()
    out = requests.join(scorer(asked).select("context", "continuation", "ll"), ["context", "continuation"])
    if not priors:
        return out.withColumn("unconditioned", F.lit(None).cast("double"))
    prior = scorer(requests.select(F.col("query").alias("context"), "continuation").distinct())
    return out.join(prior.select(F.col("context").alias("query"), "continuation", F.col("ll").alias("unconditioned")), ["query", "continuation"])


def without_task(examples: DataFrame, scorer: Scorer) -> DataFrame:
    """Where there is no task: letter prompts, and the log-likelihoods as they are for scores."""
    plain = Task("none", lambda rows: F.lit(None))
    return mcq.score(with_likelihoods(plain.requests(examples), scorer, False), "raw")


def metrics_of(scored: DataFrame, mode: str) -> dict[str, Any]:
    """What a mode reports: `accuracy` is that of characters where they are scored, else that of priors."""

    def named(row: Any) -> dict[str, Any]:
        char, pmi = row["accuracy_char"] or 0.0, row["accuracy_pmi"] or 0.0
        extra = {"char": {"accuracy": char}, "pmi": {"accuracy": pmi, "accuracy_pmi": pmi}, "char+pmi": {"accuracy": char, "accuracy_char_norm": char, "accuracy_pmi": pmi}}
        return {"num_samples": row["num_samples"]} | extra[mode]

    rows = mcq.accuracy(scored, totals=True).collect()  # a row a sub-config
    total = next((r for r in rows if r["is_total"]), {"num_samples": 0, "accuracy_char": None, "accuracy_pmi": None})
    parts = sorted((r for r in rows if not r["is_total"]), key=lambda r: r["source_config"])
    return named(total) | {"per_subconfig_accuracy": {r["source_config"]: named(r) for r in parts}}


def failure_table(examples: DataFrame, task: Task, scored: DataFrame, mode: str) -> DataFrame:
    """Wrong answers: question, choices, answers as they were scored, scores a column a choice, and how far gold was behind."""
    wide = examples.agg(F.max(F.size("choices"))).first()[0] or 0
    texts = examples.select("ex_id", "question", "choices", task.continuations().alias("conts"))
    wrong = scored.where("pred <> gold").join(texts, "ex_id")
    shown = "char" if "char" in mode else "ll"
    gap = lambda c: F.round(F.get(F.col(c), F.col("pred")) - F.get(F.col(c), F.col("gold")), 6)
    token = lambda k: F.ltrim(F.get("conts", F.col(k)))
    each = lambda c, name: [F.round(F.get(c, F.lit(k)), 6).alias(f"{name}_{k}") for k in range(wide)]
    columns = [F.col("ex_id").alias("index"), F.col("question"), *[F.get("choices", F.lit(k)).alias(f"choice_{k}") for k in range(wide)]]
    columns += [F.col("gold").alias("gold_idx"), token("gold").alias("gold_letter"), F.col("pred").alias("pred_idx"), token("pred").alias("pred_letter")]
    columns += [*each("ll", "ll"), gap("ll").alias("ll_margin"), *each(shown, "score"), gap(shown).alias("score_margin")]
    if "pmi" in mode:
        columns += [*each("pmi", "score_pmi"), gap("pmi").alias("score_pmi_margin")]
    return wrong.orderBy("ex_id").select(*columns)


def _options(n: int) -> list[Column]:
    return [F.col(f"option{k}") for k in range(1, n + 1)]


registry.register("acva")(Task("acva", lambda rows: mcq.parse_true_false(F.col("question"), F.col("answer")), lists_choices=False))
registry.register("alghafa")(
    Task("alghafa", lambda rows: mcq.parse_solutions(F.col("query"), [F.col(c) for c in rows.columns if c.startswith("sol")], F.col("label")), by_word=lambda: F.col("source_config").isin(*mcq.WORD_SCORED))
)
registry.register("culture_arabic_mmlu")(Task("culture_arabic_mmlu", lambda rows: mcq.parse_generic(["question"], ["answer"], [c for c in "ABCDE" if c in rows.columns])))
registry.register("arabic_exam")(
    Task("arabic_exam", lambda rows: mcq.parse_exam(F.col("question"), _options(5), F.col("key"), F.col("context"), F.col("few_shot")), excluded=("All",), with_context=True)
)
