"""Scores, schedules and typed statuses as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, null where whole is 0: not measurable is not zero."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def size_rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole with whole at least 1: size metrics are 0 on empty input."""
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's body is evaluated anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half away from zero in binary, as C and SQL engines on it do: unlike F.round, a negative number stays below zero as -0.0."""
    scale = F.lit(10.0**digits)

    def over(x: Column) -> Column:
        whole = let(F.abs(x) * scale, lambda a: F.when(a - F.rint(a) == 0.5, F.rint(a) + 1).otherwise(F.rint(a)))
        return let(F.signum(x) * whole / scale, lambda r: F.when(F.abs(r) < float("inf"), r).otherwise(x))

    return let(value, over)


def mean(values: Column) -> Column:
    """The mean of an array of double without its nulls; null if nothing is left."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return let(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, v: a + v) / F.size(k)))


def log_softmax(logits: Column) -> Column:
    """Over an array of double."""

    def over(top: Column) -> Column:
        shift = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        return let(shift, lambda s: F.transform(logits, lambda x: x - s))

    return let(F.array_max(logits), over)


def char_score(ll: Column, continuation: Column) -> Column:
    """Log-likelihood by the continuation's length without leading space."""
    return ll / F.greatest(F.length(F.regexp_replace(continuation, r"^(?U)\s+", "")), F.lit(1))


def pmi_score(ll: Column, unconditioned: Column) -> Column:
    return F.when(unconditioned.isNull(), F.raise_error(F.lit("pmi needs unconditioned log-likelihoods"))).otherwise(ll - unconditioned)


def first_argmax(scores: Column) -> Column:
    """Index of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def answer_labels(prompt: Column, full: Column) -> Column:
    """Labels of a training example: -100 over the common prefix of prompt and full ids, then the ids; null if nothing is left."""
    pairs = F.zip_with(prompt, F.slice(full, F.lit(1), F.greatest(F.size(prompt), F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, e: F.struct(F.when(a["go"] & e, a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & e).alias("go")))["n"]
    common = F.least(common, F.size(full))
    rest = F.slice(full, common + 1, F.greatest(F.size(full) - common, F.lit(0)))
    return F.when(common < F.size(full), F.concat(F.array_repeat(F.lit(-100), common), rest))


def learning_rate(step: Column, warmup: int, total: int, kind: str) -> Column:
    """The schedule's multiplier at a step."""
    p = F.least((step - warmup) / max(total - warmup, 1), F.lit(1.0))
    after = {"cosine": 0.5 * (1 + F.cos(math.pi * p)), "linear": F.greatest(F.lit(0.0), 1 - p), "constant": F.lit(1.0)}[kind]
    return F.when(step < warmup, step / max(warmup, 1)).otherwise(after).cast("double")


def efficiency_status(is_mcq: Column, accuracy: Column, rps: Column, compression: Column, seconds: Column, rows: Column) -> Column:
    """Why an efficiency index has no value, or ok."""
    return (
        F.when(~is_mcq, "task_not_mcq")
        .when(accuracy.isNull(), "missing_accuracy")
        .when(rps.isNull(), "missing_rps")
        .when(compression.isNull(), "missing_compression")
        .when(seconds.isNull(), "missing_time")
        .when(rows.isNull(), "missing_num_eval_rows")
        .when(seconds <= 0, "zero_time")
        .when(rows <= 0, "zero_rows")
        .otherwise("ok")
    )


def efficiency_index(is_mcq: Column, accuracy: Column, rps: Column, compression: Column, seconds: Column, rows: Column) -> Column:
    """accuracy x root conservation x compression over the time per row."""
    ok = efficiency_status(is_mcq, accuracy, rps, compression, seconds, rows) == "ok"
    return F.when(ok, F.round(accuracy * rps * compression / (seconds / rows), 6))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(100.0)))


def early_stop(series: Column, patience: int, every: int, minimum: int, delta: float) -> Column:
    """Fold of an ordered array of (step, loss): best loss, its step, evaluations, and the step at which training stops (null: it doesn't)."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("best_step"), F.lit(0).alias("bad"), F.lit(0).alias("evals"), F.lit(None).cast("long").alias("stopped"))

    def step(a: Column, x: Column) -> Column:
        live = a["stopped"].isNull() & (x["step"] >= minimum) & (x["step"] % every == 0)
        better = live & (x["loss"] + delta < a["best"])
        bad = F.when(better, 0).when(live, a["bad"] + 1).otherwise(a["bad"])
        return F.struct(
            F.when(better, x["loss"]).otherwise(a["best"]).alias("best"),
            F.when(better, x["step"]).otherwise(a["best_step"]).alias("best_step"),
            bad.alias("bad"),
            F.when(live, a["evals"] + 1).otherwise(a["evals"]).alias("evals"),
            F.when(live & (bad >= patience), x["step"]).otherwise(a["stopped"]).alias("stopped"),
        )

    return F.aggregate(series, start, step)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of two arrays."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct(F.when(s["go"] & e, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["go"] & e).alias("go")))["n"]


def continuation_start(context: Column, full: Column, span: str = "lcp") -> Column:
    """Where the continuation's ids begin in the full sequence.

    `lcp`: behind the common prefix of both encodings (right also where the encoder appends an end id).
    `length`: behind as many ids as the context has; with such encoders this skips the first continuation id.
    """
    if span not in ("lcp", "length"):
        raise ValueError(f"span is lcp or length, not {span!r}")
    return common_prefix(context, full) if span == "lcp" else F.size(context)


def continuation_ll(log_probs: Column, full: Column, start: Column) -> Column:
    """Sum of log-probabilities of the ids from start on; log_probs[i] predicts id i + 1.  No ids: -1e9."""
    places = F.sequence(start, F.size(full) - 1)
    total = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get(F.get(log_probs, i - 1), F.get(full, i)))
    return F.when(start < F.size(full), total).otherwise(F.lit(-1e9))


def pooled_mask(mask: Column, rate: int) -> Column:
    """The mask of a sequence pooled by `rate`, ceil(length / rate) long: 1 where any place of a window is 1."""
    windows = F.filter(F.sequence(F.lit(0), F.ceil(F.size(mask) / rate).cast("int")), lambda k: k * rate < F.size(mask))
    return F.transform(windows, lambda k: F.array_max(F.slice(mask, k * rate + 1, F.lit(rate))).cast("long"))


def block_mix(x: Column, largest: int, score: float = 1.0) -> Column:
    """For each place the means of its blocks of 1 to `largest` places, mixed by the softmax of `score` times these means.

    Blocks begin at multiples of their size; the last one is filled up with zeros.
    """

    def at(k: Column) -> Column:
        means = F.array(*[F.aggregate(F.slice(x, k - k % b + 1, F.lit(b)), F.lit(0.0), lambda a, v: a + v) / b for b in range(1, largest + 1)])
        mixed = lambda m: F.aggregate(F.zip_with(m, F.transform(m, lambda v: F.exp(score * v)), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v) / F.aggregate(m, F.lit(0.0), lambda a, v: a + F.exp(score * v))
        return let(means, mixed)

    places = F.filter(F.sequence(F.lit(0), F.size(x)), lambda k: k < F.size(x))
    return F.transform(places, at)
