"""Experiments: a tokenizer, its metrics, tasks, the efficiency index, sweeps, reports, and recomputing them.

Work on tables is Spark's; what is held here are metrics, a few numbers each.
"""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfmill.functions import scoring
from harfmill.functions.arabic import words
from harfmill.operators import corpora, metrics, reports, tokenization
from harfmill.operators.registry import tasks as task_registry
from harfmill.operators.registry import tokenizers as tokenizer_registry
from harfmill.operators.tasks import Scorer
from harfmill.sources import loaders

log = logging.getLogger("harfmill")


def setup_logger(log_file: str | None = None, error_file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Console, a file, and a file of warnings and errors only; a logger that has handlers stays as it is."""
    log.setLevel(level)
    if log.handlers:
        return log
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    for path, least in ((log_file, level), (error_file, logging.WARNING)):
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(path, encoding="utf-8"))
            handlers[-1].setLevel(least)
    for h in handlers:
        h.setFormatter(form)
        log.addHandler(h)
    return log


def save_json(value: Any, path: str | Path) -> None:
    """Indented, readable in any script."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def load_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def intrinsic(tokenizer: tokenization.Tokenizer, texts: DataFrame, n: int | None = 5000, morphological: bool = True, morph_sample: int = 500, key: str = "text") -> dict[str, Any]:
    """Size and morphological metrics of one tokenizer over a column `text`; {} if there are no texts.

    `n` texts in the order of a hash, all with None.
    """
    chosen = corpora.sample(texts, key, n) if n is not None else texts
    unknown = tokenizer.special_tokens["unk_token"]
    rows = tokenizer.encode(chosen.select("text")).select("text", F.size("ids").alias("n_tokens"), F.size(F.filter("ids", lambda i: i == unknown)).alias("n_unk"))
    size = metrics.size_metrics(rows, []).first().asDict()
    if not size["n_texts"]:
        log.warning("no texts for intrinsic metrics")
        return {}
    distinct = chosen.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    per_word = tokenizer.encode(distinct, "word").select(F.exists("ids", lambda i: i == unknown).alias("unk"))
    size["vocab_coverage"] = metrics.vocab_coverage(per_word, []).first()["vocab_coverage"]
    size["vocab_size"] = tokenizer.vocab_size
    if not morphological:
        return size
    sample = corpora.word_sample(chosen, morph_sample)
    table = metrics.word_table(sample, tokenization.token_table(sample, {tokenizer.name: tokenizer})).persist()
    try:
        found = metrics.morphological_metrics(table, [tokenizer.name]).first().asDict()
        found |= metrics.bearing_tokens(table, [tokenizer.name]).first().asDict()
    finally:
        table.unpersist()
    found.pop("family")
    return size | found


def efficiency(accuracy: float | None, rps: float | None, compression: float | None, seconds: float | None, rows: int | None, is_mcq: bool = True, source: str = "accuracy") -> dict[str, Any]:
    """The efficiency index with why it has no value, and what it was made of."""
    status = (
        "task_not_mcq" if not is_mcq else "missing_accuracy" if accuracy is None else "missing_rps" if rps is None else "missing_compression" if compression is None
        else "missing_time" if seconds is None else "missing_num_eval_rows" if rows is None else "zero_time" if seconds <= 0 else "zero_rows" if rows <= 0 else "ok"
    )
    inputs = {"accuracy": accuracy, "rps": rps, "compression": compression, "inference_time_sec": seconds, "num_eval_rows": rows, "accuracy_source": source}
    return {"mei": round(accuracy * rps * compression / (seconds / rows), 6) if status == "ok" else None, "status": status, "inputs": inputs}


def efficiency_of(task: dict[str, Any], intrinsic_block: dict[str, Any], seconds: float | None) -> dict[str, Any]:
    """Accuracy by priors where there is one, else the other; the time is not rounded."""
    source = "accuracy_pmi" if "accuracy_pmi" in task else "accuracy"
    return efficiency(task.get(source), intrinsic_block.get("root_conservation_rate"), intrinsic_block.get("compression_ratio"), seconds, task.get("num_samples"), True, source)


def one_line(found: dict[str, Any]) -> str:
    """A task's metrics for the log."""
    keys = ("accuracy", "accuracy_char_norm", "accuracy_pmi", "f1", "exact_match", "perplexity")
    parts = [f"{k}={found[k]:.4f}" for k in keys if isinstance(found.get(k), (int, float))]
    return ", ".join(parts + ([f"n={found['num_samples']}"] if "num_samples" in found else [])) or str(found)


class Evaluator:
    """Intrinsic metrics and tasks of one tokenizer, each written as JSON below `output`."""

    def __init__(self, tokenizer: tokenization.Tokenizer, output: str, texts: DataFrame | None = None, scorer: Scorer | None = None, benchmarks: dict[str, DataFrame] | None = None) -> None:
        self.tokenizer, self.output, self.texts, self.scorer, self.benchmarks = tokenizer, output, texts, scorer, benchmarks or {}

    def run_intrinsic(self, n: int | None = 5000, morphological: bool = True, morph_sample: int = 500) -> dict[str, Any]:
        if self.texts is None:
            log.warning("no texts for intrinsic metrics")
            return {}
        found = intrinsic(self.tokenizer, self.texts, n, morphological, morph_sample)
        save_json(found, f"{self.output}/intrinsic_metrics.json")
        return found

    def run_downstream(self, mode: str = "char", max_samples: int | None = None, failures: bool = False) -> dict[str, dict[str, Any]]:
        """Each task's metrics with the seconds that it took."""
        if self.scorer is None:
            log.warning("no scorer for tasks")
            return {}
        out = {}
        for name, rows in self.benchmarks.items():
            start = time.perf_counter()
            found = task_registry.get(name).evaluate(rows, self.scorer, mode, max_samples, f"{self.output}/failure_reports" if failures else None)
            found["inference_time_sec"] = time.perf_counter() - start
            out[name] = found
            save_json(found, f"{self.output}/{name}_metrics.json")
            log.info("%s: %s", name, one_line(found))
        return out

    def run_all(self, **options: Any) -> dict[str, Any]:
        out = {"intrinsic": self.run_intrinsic(options.get("n", 5000)), "downstream": self.run_downstream(options.get("mode", "char"), options.get("max_samples"))}
        save_json(out, f"{self.output}/all_metrics.json")
        return out


def run_experiment(spark: SparkSession, config: dict[str, Any], scorer: Scorer | None = None) -> dict[str, Any]:
    """Corpus, tokenizer, intrinsic metrics, tasks and their efficiency; written below config["output_dir"].

    config: name, output_dir, data {path, max_train, max_eval, preprocessing},
    tokenizer {type, vocab_size, params, load_path, save_path}, tasks {name:
    {path, ...}}, evaluation {intrinsic, num_eval_samples, morphological,
    morph_sample_size, score_normalization, failure_reports}.
    """
    output, kind, ev = config["output_dir"], config["tokenizer"], config.get("evaluation", {})
    save_json(config, f"{output}/config.json")
    data = dict(config["data"])
    corpus = loaders.load_corpus(spark, data.pop("path"), **data)
    if kind.get("load_path"):
        tokenizer = tokenization.Tokenizer.load(spark, kind["load_path"])
    else:
        tokenizer = tokenizer_registry.get(kind["type"])(**kind.get("params", {})).train(corpus["train"], vocab_size=kind.get("vocab_size"))
        if kind.get("save_path"):
            tokenizer.save(spark, kind["save_path"])
    out: dict[str, Any] = {"config": {"tokenizer": kind["type"], "vocab_size": kind.get("vocab_size"), "tasks": sorted(config.get("tasks", {}))}}
    rows = {}
    for name, where in config.get("tasks", {}).items():
        task = task_registry.get(name)
        rows[name] = loaders.load_benchmark(spark, where["path"], lambda raw, task=task: raw.where(task.parse(raw).isNotNull()), where.get("config"), task.excluded)
    run = Evaluator(tokenizer, output, corpus.get("eval", corpus["train"]), scorer, rows)
    if ev.get("intrinsic", True):
        out["intrinsic"] = run.run_intrinsic(ev.get("num_eval_samples", 5000), ev.get("morphological", True), ev.get("morph_sample_size", 500))
    if scorer is not None and rows:
        tokenizer.encode(spark.createDataFrame([("warm up",)], "text string")).count()  # a cold start is not the tasks' time
        out["downstream"] = run.run_downstream(ev.get("score_normalization", "char"), ev.get("num_eval_samples"), ev.get("failure_reports", False))
        out["mei"] = {name: efficiency_of(found, out.get("intrinsic", {}), found["inference_time_sec"]) for name, found in out["downstream"].items()}
    save_json(out, f"{output}/all_metrics.json")
    return out


def cells_of(grid: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """[{type, vocab_sizes, params}] as one cell a type and size."""
    return [{"type": g["type"], "vocab_size": size, "params": g.get("params", {})} for g in grid for size in g.get("vocab_sizes") or [None]]


def run_sweep(spark: SparkSession, config: dict[str, Any], scorer: Scorer | None = None, run: Callable[..., dict] = run_experiment) -> dict[str, Any]:
    """Every cell of config["sweep"]; cells with results are read, failing ones become errors; a report at the end."""
    root = config["output_dir"]
    cells = cells_of(config["sweep"])
    done = {}
    for cell in cells:
        path = Path(root) / reports.cell_name(cell["type"], cell["vocab_size"]) / "all_metrics.json"
        if path.exists():
            done[path.parent.name] = load_json(path)

    def one(cell: dict) -> dict:
        name = reports.cell_name(cell["type"], cell["vocab_size"])
        inner = config | {"name": name, "output_dir": f"{root}/{name}", "tokenizer": cell | {"save_path": f"{root}/{name}/tokenizer"}}
        inner.pop("sweep")
        return run(spark, inner, scorer)

    out = reports.sweep(cells, one, done)
    write_report(out, f"{root}/comparison_report.txt")
    return out


# Reports.


def _flat(value: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in value.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def _cell(v: Any) -> str:
    return "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def _lines(rows: list[list[str]]) -> list[str]:
    width = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return [" | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows]


def comparison_lines(runs: dict[str, dict[str, Any]], keys: list[str] | None = None) -> list[str]:
    """A row a run, a column a metric; what a run lacks is a dash."""
    if not runs:
        return ["No experiments to compare."]
    flat = {n: _flat(r) for n, r in sorted(runs.items())}
    columns = sorted({k for f in flat.values() for k in f if keys is None or k in keys})
    return _lines([["Experiment", *columns], *[[n, *[_cell(f.get(k)) for k in columns]] for n, f in flat.items()]])


def subconfig_lines(task: str, runs: dict[str, dict[str, Any]]) -> list[str]:
    """Accuracy by sub-config; nothing where there is only the default one."""
    parts = {n: r.get("per_subconfig_accuracy") or {} for n, r in sorted(runs.items())}
    keys = sorted({k for p in parts.values() for k in p})
    if keys in ([], ["_default"]):
        return []
    cell = lambda e: f"{e['accuracy']:.4f} (n={e['num_samples']})" if e and isinstance(e.get("accuracy"), (int, float)) else "—"
    return [f"### Per-sub-config breakdown: {task}", "", *_lines([["Experiment", *keys], *[[n, *[cell(p.get(k)) for k in keys]] for n, p in parts.items()]]), ""]


def efficiency_lines(runs: dict[str, dict[str, Any]]) -> list[str]:
    """The efficiency index where it has a value, footnotes for mechanical extremes, and why others have none."""
    rows, notes, others = [], {}, []
    for name, r in sorted(runs.items()):
        kind = (r.get("config") or {}).get("tokenizer", "?")
        records = r.get("mei") or {}
        for task, record in sorted(({"": records} if "status" in records else records).items()):
            label = f"{name} {task}".strip()
            if record["status"] != "ok":
                others.append(f"  - {label} ({kind}): status={record['status']}")
                continue
            i = record.get("inputs") or {}
            if kind in reports.MECHANICAL:
                notes[kind] = reports.MECHANICAL[kind]
            rows.append([label, kind + "*" * (kind in notes), *map(_cell, (record["mei"], i.get("accuracy"), i.get("rps"), i.get("compression"), i.get("inference_time_sec"), i.get("num_eval_rows")))])
    if not rows and not others:
        return []
    out = ["## Efficiency index", "", "(accuracy x root conservation x compression) / (seconds / rows)", ""]
    if rows:
        out += [*_lines([["Experiment", "Tokenizer", "MEI", "Accuracy", "RPS", "Compression", "Time (s)", "Rows"], *rows]), ""]
    if notes:
        out += ["Mechanical extremes:", *[f"  * {k}: {v}" for k, v in sorted(notes.items())], ""]
    if others:
        out += ["Not computed:", *others, ""]
    return out


def report(runs: dict[str, dict[str, Any]]) -> str:
    """All sections of a comparison."""
    out = ["COMPARISON REPORT", ""]
    inner = {n: r["intrinsic"] for n, r in runs.items() if r.get("intrinsic")}
    if inner:
        out += ["## Intrinsic metrics", "", *comparison_lines(inner, ["fertility", "compression_ratio", "unk_rate", "vocab_coverage", "vocab_size"]), ""]
        moved = {n: {k: v for k, v in r.items() if k.startswith(("root_", "pattern_", "morph", "clitic", "semantic"))} for n, r in inner.items()}
        if any(moved.values()):
            out += ["## Morphological metrics", "", *comparison_lines(moved), ""]
    for task in sorted({t for r in runs.values() for t in r.get("downstream") or {}}):
        found = {n: r["downstream"][task] for n, r in runs.items() if task in (r.get("downstream") or {})}
        out += [f"## Task: {task}" + " †" * (task in reports.NOISY), ""]
        out += [*comparison_lines({n: {k: v for k, v in r.items() if k != "per_subconfig_accuracy"} for n, r in found.items()}), ""]
        out += [f"† {reports.NOISY[task]}", ""] if task in reports.NOISY else []
        out += subconfig_lines(task, found)
    out += efficiency_lines(runs)
    failed = {n: r["error"] for n, r in sorted(runs.items()) if "error" in r}
    out += ["## Failed", "", *[f"  - {n}: {e}" for n, e in failed.items()], ""] if failed else []
    return "\n".join(out)


def write_report(runs: dict[str, dict[str, Any]], path: str) -> str:
    """The report as text, and the runs as JSON beside it."""
    text = report(runs)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    save_json(runs, Path(path).with_suffix(".json"))
    return text


# Recomputing.


def recompute(root: str, dry_run: bool = False, with_reports: bool = True) -> dict[str, int]:
    """The efficiency records of all results below a folder anew; how many ended how.  Reports of sweeps are written again."""
    if not Path(root).exists():
        raise FileNotFoundError(root)
    tally: dict[str, int] = {}
    for path in sorted(Path(root).rglob("all_metrics.json")):
        for status in _recomputed(path, dry_run):
            tally[status] = tally.get(status, 0) + 1
    if with_reports and not dry_run:
        regenerate_reports(root)
    return tally


def _recomputed(path: Path, dry_run: bool) -> list[str]:
    data = load_json(path)
    block = data.get("mei")
    if block is None:
        return ["no_mei_block"]
    single = "status" in block or "inputs" in block
    records = {(data.get("config") or {}).get("task"): block} if single else block
    out, fresh = [], {}
    for task, record in records.items():
        inputs, rows = record.get("inputs") or {}, ((data.get("downstream") or {}).get(task) or {}).get("num_samples")
        if task not in task_registry.available():
            out.append("not_mcq")
        elif not inputs:
            out.append("no_inputs")
        elif rows is None:
            out.append("no_num_samples")
        elif dry_run:
            out.append("would_update")
        else:
            fresh[task] = efficiency(inputs.get("accuracy"), inputs.get("rps"), inputs.get("compression"), inputs.get("inference_time_sec"), rows, True, inputs.get("accuracy_source", "accuracy"))
            out.append("updated" if fresh[task]["status"] == "ok" else f"status_changed_to_{fresh[task]['status']}")
    if fresh:
        data["mei"] = next(iter(fresh.values())) if single else block | fresh
        save_json(data, path)
    return out


def regenerate_reports(root: str) -> list[str]:
    """The report of each sweep below a folder: a folder with a report and folders of results."""
    out = []
    for path in sorted(Path(root).rglob("comparison_report.txt")):
        runs = {p.parent.name: load_json(p) for p in sorted(path.parent.glob("*/all_metrics.json"))}
        if runs:
            write_report(runs, str(path))
            out.append(str(path))
    return out


def efficiency_table(cells: DataFrame, intrinsic_rows: DataFrame) -> DataFrame:
    """The same as a table: cells (cell, task, accuracy, seconds, rows) meet their tokenizer's figures (cell, rps, compression)."""
    args = [F.lit(True), *[F.col(c) for c in ("accuracy", "rps", "compression", "seconds", "rows")]]
    joined = cells.join(intrinsic_rows, "cell", "left")
    return joined.select("cell", "task", scoring.efficiency_status(*args).alias("status"), scoring.efficiency_index(*args).alias("mei"))
