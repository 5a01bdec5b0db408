"""Tokenizers by one interface, tasks, batches, loaders, experiments and reports."""

import json

import pytest
from pyspark.sql import functions as F

from harfmill import __main__ as cli
from harfmill.operators import experiment, mcq, metrics, reports, tokenization, training
from harfmill.operators.registry import tasks as task_registry
from harfmill.operators.registry import tokenizers as registry
from harfmill.sources import loaders, results

TEXTS = ["درس الطالب الدرس في المدرسة", "والدرس الذي درسه الطلاب", "ذهب الولد إلى البيت", "بيتهم قريب من المدرسة", "كتب المدرس رسالة", "قرأ الطالب الرسالة"]
KINDS = ["bpe", "wordpiece", "morpho_bpe", "char", "byte", "word_char", "segmented_word_char", "root_pattern"]


def docs(spark, n=2):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * n)], "doc_id long, text string")


@pytest.mark.parametrize("kind", KINDS)
def test_tokenizer_interface(spark, tmp_path, kind):
    made = registry.get(kind)(**({"min_count": 1} if kind == "root_pattern" else {})).train(docs(spark), vocab_size=200)
    odd = docs(spark, 1).unionByName(spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string"))
    whole = {(r.doc_id, r.text): r for r in made.encode(odd).collect()}
    assert len(whole) == len(TEXTS) + 2 and all(r.ids[0] == 1 and r.ids[-1] == 2 for r in whole.values())
    assert max(i for r in whole.values() for i in r.ids) < made.vocab_size
    cut = made.encode(odd, max_length=4, padding=True, truncation=True).collect()
    assert all(len(r.ids) == 4 for r in cut)
    if made.embedding_type == tokenization.CHARACTER_CNN:
        assert all(len(r.char_ids) == 4 and {len(v) for v in r.char_ids} == {made.max_chars} for r in cut)
        assert all(len(r.char_ids) == len(r.ids) for r in whole.values())
    words = spark.createDataFrame([("والمدرسة",), ("x",)], "word string")
    tokens = {r.word: r.tokens for r in made.tokens(words).collect()}
    assert set(tokens) == {"والمدرسة", "x"} and all(tokens.values())
    made.save(spark, f"{tmp_path}/t")
    back = tokenization.Tokenizer.load(spark, f"{tmp_path}/t")
    assert type(back) is type(made) and back.vocab_size == made.vocab_size and back.embedding_config() == made.embedding_config()
    assert {(r.doc_id, r.text): r.ids for r in back.encode(odd).collect()} == {k: r.ids for k, r in whole.items()}
    assert {r.word: r.tokens for r in back.tokens(words).collect()} == tokens
    if kind in ("bpe", "char", "byte", "word_char"):
        texts = {r.text: r.x for r in made.encode(docs(spark, 1)).select("text", made.decode(F.col("ids")).alias("x")).collect()}
        assert all(a == b for a, b in texts.items())


def test_artifacts_are_checked(spark, tmp_path):
    made = registry.get("byte")().train(docs(spark))
    made.save(spark, f"{tmp_path}/b")
    spark.range(9).select(F.col("id").cast("string").alias("token"), "id").write.mode("overwrite").parquet(f"{tmp_path}/b/vocab")
    with pytest.raises(ValueError, match="260"):
        tokenization.Tokenizer.load(spark, f"{tmp_path}/b")
    bpe = registry.get("bpe")().train(docs(spark), vocab_size=150)
    bpe.save(spark, f"{tmp_path}/p")
    spark.createDataFrame([(0, "zz", "y")], "rank long, left string, right string").write.mode("overwrite").parquet(f"{tmp_path}/p/merges")
    with pytest.raises(ValueError, match="lacks"):
        tokenization.Tokenizer.load(spark, f"{tmp_path}/p")


def test_pretrained(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    file = Tokenizer(models.WordLevel({"<unk>": 0, "a": 1, "b": 2, "<s>": 3}, unk_token="<unk>"))
    file.pre_tokenizer = pre_tokenizers.Whitespace()
    file.save(f"{tmp_path}/t.json")
    made = registry.get("pretrained")(path=f"{tmp_path}/t.json", bos=3, eos=3, unk=0)
    frame = spark.createDataFrame([("a b c",), (None,)], "text string")
    assert sorted(r.ids for r in made.encode(frame).collect()) == [[3], [3, 1, 2, 0]]
    made.save(spark, f"{tmp_path}/stored")
    assert tokenization.Tokenizer.load(spark, f"{tmp_path}/stored").pad_token_id == 3


def test_metrics_of_real_tokenizers(spark):
    """Known by construction: morphemes align with segmented tokenizers, characters hold no root, roots are tokens."""
    chosen = {k: registry.get(k)(**({"min_count": 1} if k == "root_pattern" else {})).train(docs(spark), vocab_size=500) for k in KINDS}
    sample = spark.createDataFrame([(w,) for w in ("والدرس", "المدرسة", "بيتهم", "الطالب", "رسالة")], "word string")
    table = metrics.word_table(sample, tokenization.token_table(sample, chosen)).persist()
    m = {r.family: r for r in metrics.morphological_metrics(table, KINDS).collect()}
    b = {r.family: r for r in metrics.bearing_tokens(table, KINDS).collect()}
    assert set(m) == set(b) == set(KINDS)
    assert m["segmented_word_char"].morpheme_integrity_rate == m["segmented_word_char"].clitic_separation_accuracy == 1.0
    assert m["morpho_bpe"].clitic_separation_accuracy == 1.0 and m["word_char"].root_conservation_rate == 1.0
    assert m["char"].root_conservation_rate == 0.0 and m["root_pattern"].root_conservation_rate > 0
    assert m["byte"].morpheme_integrity_rate is None and b["byte"].root_bearing_token_pct == 0.0
    # Byte-level strings are read back, so BPE's tokens are compared as Arabic letters.
    assert m["bpe"].morpheme_integrity_rate is not None and m["bpe"].root_conservation_rate > 0


def by_length(requests):
    """A scorer without a model: the shorter the better, and half as sure without a question."""
    alone = F.col("context") == mcq.ANSWER
    return requests.withColumn("ll", -F.length("continuation").cast("double") * F.when(alone, 0.5).otherwise(1.0))


def rows_of(spark, kind):
    if kind == "acva":
        return spark.createDataFrame([(k, f"سؤال {k}", ["صح", "خطأ"][k % 2]) for k in range(6)] + [(9, "", "صح")], "ex_id long, question string, answer string")
    if kind == "alghafa":
        config = [mcq.WORD_SCORED[0], "other"]
        return spark.createDataFrame([(k, f"س {k}", "طويل جدا", "قصير", str(k % 2), config[k % 2]) for k in range(6)], "ex_id long, query string, sol1 string, sol2 string, label string, source_config string")
    if kind == "culture_arabic_mmlu":
        return spark.createDataFrame([(k, f"س {k}", "أول", "ثان", "A") for k in range(4)], "ex_id long, question string, A string, B string, answer string")
    return spark.createDataFrame([(k, f"س {k}", "أ", "ب", None, None, None, "B", ["", "نص"][k % 2], 0, ["x", "All"][k % 2]) for k in range(4)], "ex_id long, question string, option1 string, option2 string, option3 string, option4 string, option5 string, key string, context string, few_shot int, source_config string")


@pytest.mark.parametrize("kind", ["acva", "alghafa", "culture_arabic_mmlu", "arabic_exam"])
def test_tasks(spark, tmp_path, kind):
    task = task_registry.get(kind)
    examples = task.examples(rows_of(spark, kind))
    requests = task.requests(examples).collect()
    assert all(r.continuation.startswith(" ") and r.context.endswith(mcq.ANSWER) for r in requests)
    if kind == "acva":
        assert {r.continuation for r in requests} == {" صح", " خطأ"} and not any(mcq.CHOICES in r.context for r in requests)
    if kind == "alghafa":
        assert {(mcq.CHOICES in r.context, len(r.continuation) == 2) for r in requests} == {(True, True), (False, False)}
    if kind == "arabic_exam":
        assert {r.source_config for r in requests} == {"x"}
    for mode in ("char", "pmi", "char+pmi"):
        found = task.evaluate(rows_of(spark, kind), by_length, mode, failures=f"{tmp_path}/{mode}")
        assert ("accuracy_pmi" in found) == ("pmi" in mode) and ("accuracy_char_norm" in found) == (mode == "char+pmi")
        parts = found["per_subconfig_accuracy"]
        assert sum(p["num_samples"] for p in parts.values()) == found["num_samples"] == examples.count() and found["clean_latin_rows"] is False
        lines = (tmp_path / mode / f"{kind}_accuracy_failures.csv").read_text(encoding="utf-8-sig").splitlines()
        assert lines[0].startswith("index,question,choice_0,choice_1") and ("score_pmi_margin" in lines[0]) == ("pmi" in mode)
        assert len(lines) - 1 == round((1 - (found["accuracy_pmi"] if "pmi" in mode else found["accuracy"])) * found["num_samples"])
    assert task.evaluate(rows_of(spark, kind), by_length, max_samples=1)["num_samples"] == 1
    with pytest.raises(ValueError, match="normalization"):
        task.evaluate(rows_of(spark, kind), by_length, "words")


def test_task_refusals(spark):
    from dataclasses import replace

    from harfmill.operators.tasks import without_task

    task = task_registry.get("acva")
    with pytest.raises(RuntimeError, match="parsed"):
        task.examples(rows_of(spark, "acva").where("question = ''"))
    clean = replace(task, clean_latin=True)
    latin = rows_of(spark, "acva").withColumn("question", F.concat("question", F.lit(" x")))
    with pytest.raises(RuntimeError, match="Latin"):
        clean.examples(latin)
    assert clean.examples(rows_of(spark, "acva")).count() == 6
    got = without_task(task.examples(rows_of(spark, "acva")), by_length).first()
    assert got["char"] == got["ll"]  # raw likelihoods


def test_batches_by_embedding(spark):
    records = spark.createDataFrame([(k, "ما هذا؟", "نص", "درس " * (k + 1)) for k in range(9)] + [(20, "س" * 400, "نص", "درس")], "id long, question string, context string, answer string")
    kinds = {k: registry.get(k)().train(docs(spark), vocab_size=200) for k in ("char", "byte", "word_char", "bpe")}
    for kind, made in kinds.items():
        for target in ("full_sequence", "answer_only"):
            rows = training.data_loader(records, made, 4, 300, target, shards=2, seed=1).collect()
            assert len(rows) == (10 if target == "full_sequence" or kind == "word_char" else 9)
            for r in rows:
                assert len(r.ids) == len(r.mask) == len(r.labels) == r.width if "width" in r else len(r.ids) == len(r.mask) == len(r.labels)
                own = kind in ("char", "byte") or target == "full_sequence"
                want = [i if m else -100 for i, m in zip(r.ids, r.mask)]
                assert r.labels == want if own else r.labels != want and r.labels[0] == -100
                if kind == "word_char":
                    assert len(r.char_ids) == len(r.ids) and {len(v) for v in r.char_ids} == {50}
    stats = training.record_stats(records, training.tokenize_records(records, kinds["char"], 300, "answer_only")).first()
    assert (stats.kept, stats.dropped) == (9, 1) and stats.mean_completion > 4
    again = [training.data_loader(records, kinds["bpe"], 4, 300, "full_sequence", 1, seed=s).select("id", "batch_id").collect() for s in (1, 1, 2)]
    assert sorted(map(str, again[0])) == sorted(map(str, again[1])) != sorted(map(str, again[2]))
    for bad in (lambda: training.collate(records, "x", 4), lambda: training.tokenize_records(records, kinds["char"], 9, "x")):
        with pytest.raises(ValueError, match="unknown"):
            bad()


def test_parameters(spark):
    names = spark.createDataFrame([("a.embed", 10), ("b.norm", 30)], "name string, n long")
    rows, missed = training.check_trainable(names, ["embed", "head"])
    assert missed == ["head"] and tuple(training.parameter_counts(rows).first()) == (40, 10, 25.0)
    with pytest.raises(AssertionError, match="head"):
        training.check_trainable(names, ["head"])
    assert training.check_trainable(names, ["*"])[0].where("trains").count() == 2
    losses = spark.createDataFrame([(1, k, float(9 - k)) for k in range(1, 9)], "run int, step long, loss double")
    assert [x.step for x in training.phase_log(losses, 3, 2, 2, keep=3).first().tail] == [6, 7, 8]


def test_loaders(spark, tmp_path):
    docs(spark, 20).withColumnRenamed("text", "content").write.parquet(f"{tmp_path}/one/train.parquet")
    got = loaders.load_corpus(spark, f"{tmp_path}/one", key="doc_id", max_eval=3, preprocessing={"min_length": 2, "compose": False})
    assert got["eval"].count() <= 3 and "text" in got["train"].columns and got["train"].count() < 120
    docs(spark, 1).write.parquet(f"{tmp_path}/one/validation.parquet")
    assert loaders.load_corpus(spark, f"{tmp_path}/one")["eval"].count() == 6
    with pytest.raises(ValueError, match="no split"):
        loaders.load_corpus(spark, f"{tmp_path}/one", train="other")
    raw = spark.createDataFrame([("س", "صح"), ("", "صح")], "question string, answer string")
    for config in ("a", "b", "All"):
        raw.write.parquet(f"{tmp_path}/many/{config}/train.parquet")
        raw.write.parquet(f"{tmp_path}/many/{config}/test.parquet")
    raw.drop("answer").write.parquet(f"{tmp_path}/many/broken/train.parquet")
    parse = lambda rows: task_registry.get("acva").examples(rows)
    found = loaders.load_benchmark(spark, f"{tmp_path}/many", parse, excluded=("All",))
    assert {r.source_config: r["count"] for r in found.groupBy("source_config").count().collect()} == {"a": 2, "b": 2}
    assert loaders.load_benchmark(spark, f"{tmp_path}/many", parse, config="All").count() == 2
    for config, text in (("broken", "answer"), (None, "none of")):
        with pytest.raises(Exception, match=text):
            loaders.load_benchmark(spark, f"{tmp_path}/many", parse, config, ("a", "b", "All"))


def test_experiment_and_sweep(spark, tmp_path, capsys):
    docs(spark, 12).write.parquet(f"{tmp_path}/corpus/train.parquet")
    rows_of(spark, "acva").write.parquet(f"{tmp_path}/acva/test.parquet")
    config = {
        "name": "n", "output_dir": f"{tmp_path}/out", "data": {"path": f"{tmp_path}/corpus", "key": "doc_id"}, "tasks": {"acva": {"path": f"{tmp_path}/acva"}},
        "evaluation": {"score_normalization": "char+pmi", "failure_reports": True}, "sweep": [{"type": "char"}, {"type": "bpe", "vocab_sizes": [1000]}, {"type": "nosuch"}],
    }
    out = experiment.run_sweep(spark, config, by_length)
    assert set(out) == {"char", "bpe_1k", "nosuch"} and "unknown tokenizer" in out["nosuch"]["error"]
    found = out["bpe_1k"]
    assert found["intrinsic"]["fertility"] > 1 and found["intrinsic"]["vocab_coverage"] == 1.0 and found["intrinsic"]["morph_sample_size"] > 3
    assert found["mei"]["acva"]["status"] in ("ok", "zero_rows") and found["mei"]["acva"]["inputs"]["accuracy_source"] == "accuracy_pmi"
    text = (tmp_path / "out" / "comparison_report.txt").read_text()
    assert "## Task: acva †" in text and "bpe_1k" in text and "char*" in text and "## Failed" in text and "Per-sub-config" not in text
    calls = []
    again = experiment.run_sweep(spark, config, by_length, run=lambda *a: calls.append(1) or {})
    assert len(calls) == 1 and again["char"]["config"]["tokenizer"] == "char"  # only the failed cell runs again
    stored = tokenization.Tokenizer.load(spark, f"{tmp_path}/out/bpe_1k/tokenizer")
    assert stored.vocab_size == found["intrinsic"]["vocab_size"]
    path = tmp_path / "out" / "char" / "all_metrics.json"
    data = json.loads(path.read_text())
    data["mei"]["acva"]["mei"] = -1
    path.write_text(json.dumps(data))
    assert experiment.recompute(str(tmp_path / "out"), dry_run=True) == {"would_update": 2}
    assert sum(experiment.recompute(str(tmp_path / "out")).values()) == 2 and json.loads(path.read_text())["mei"]["acva"]["mei"] != -1
    assert cli.main(["compare", f"{tmp_path}/r/report.txt", f"{tmp_path}/out/char", f"{tmp_path}/out/bpe_1k"]) == 0 and (tmp_path / "r" / "report.json").exists()
    assert cli.main(["recompute", str(tmp_path / "out"), "--dry-run"]) == 0 and "would_update: 2" in capsys.readouterr().out
    assert cli.main(["list"]) == 0 and cli.main([]) == 2 and cli.main(["run", "x"]) == 2


def test_recompute_statuses(tmp_path):
    ok = {"accuracy": 0.4, "rps": 0.7, "compression": 2.0, "inference_time_sec": 5.0}
    cases = {
        "none": {}, "other": {"config": {"task": "x"}, "mei": {"inputs": ok}}, "empty": {"config": {"task": "acva"}, "mei": {"status": "ok"}},
        "rows": {"config": {"task": "acva"}, "mei": {"inputs": ok}}, "good": {"config": {"task": "acva"}, "mei": {"inputs": ok}, "downstream": {"acva": {"num_samples": 10}}},
        "zero": {"config": {"task": "acva"}, "mei": {"inputs": ok}, "downstream": {"acva": {"num_samples": 0}}},
    }
    for name, value in cases.items():
        experiment.save_json(value, tmp_path / name / "all_metrics.json")
    assert experiment.recompute(str(tmp_path)) == {"no_mei_block": 1, "not_mcq": 1, "no_inputs": 1, "no_num_samples": 1, "updated": 1, "status_changed_to_zero_rows": 1}
    assert experiment.load_json(tmp_path / "good" / "all_metrics.json")["mei"]["mei"] == pytest.approx(0.4 * 0.7 * 2 / 0.5)
    with pytest.raises(FileNotFoundError):
        experiment.recompute(str(tmp_path / "nowhere"))


def test_report_sections():
    part = {"accuracy": 0.5, "num_samples": 4}
    runs = {"a": {"per_subconfig_accuracy": {"x": part, "y": part}}, "b": {"per_subconfig_accuracy": {"x": part}}}
    lines = experiment.subconfig_lines("t", runs)
    assert any("0.5000 (n=4)" in x for x in lines) and any("—" in x for x in lines)
    assert experiment.subconfig_lines("t", {"a": {"per_subconfig_accuracy": {"_default": part}}}) == []
    assert experiment.one_line({"accuracy": 0.25, "num_samples": 3}) == "accuracy=0.2500, n=3"
    assert experiment.comparison_lines({}) == ["No experiments to compare."] and experiment.efficiency_lines({"a": {}}) == []


def test_tables_of_reports(spark):
    frame = spark.createDataFrame([("a", "x", 1, 0.5), ("a", "y", 2, 0.7), ("b", "x", 3, 0.1)], "k string, t string, n int, v double")
    got = {r.k: tuple(r)[1:] for r in reports.summary(frame, "k", {"n": "first", "v": "mean"}, "t", "v").collect()}
    assert got == {"a": (1, 0.6, 1), "b": (3, 0.1, 2)}
    assert reports.first_per(frame, ["k"], "n").count() == 2 and [r.p for r in frame.select(reports.place("k", ["b", "a"]).alias("p")).collect()] == [2, 2, 1]
    cells = spark.createDataFrame([("a", "t", 0.5, 2.0, 4), ("b", "t", 0.5, 2.0, 0)], "cell string, task string, accuracy double, seconds double, rows int")
    inner = spark.createDataFrame([("a", 0.5, 2.0), ("b", 0.5, 2.0)], "cell string, rps double, compression double")
    assert {r.cell: (r.status, r.mei) for r in experiment.efficiency_table(cells, inner).collect()} == {"a": ("ok", 1.0), "b": ("zero_rows", None)}


def test_log_files(tmp_path, monkeypatch):
    monkeypatch.setattr(experiment.log, "handlers", [])
    out = experiment.setup_logger(f"{tmp_path}/l/all.log", f"{tmp_path}/l/bad.log")
    out.info("quiet")
    out.warning("loud")
    assert "quiet" in (tmp_path / "l" / "all.log").read_text() and (tmp_path / "l" / "bad.log").read_text().count("\n") == 1
    assert experiment.setup_logger() is out and len(out.handlers) == 3


def test_cache_that_cannot_be_read_stays(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part-0.parquet").write_bytes(b"nonsense")
    with pytest.raises(Exception):
        results.cached_analyses(spark, f"{tmp_path}/c", spark.createDataFrame([("x",)], "word string"), lambda w: w)
    assert (tmp_path / "c" / "part-0.parquet").read_bytes() == b"nonsense"
