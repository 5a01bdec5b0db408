"""Sources, sinks, configuration and the streaming extensions."""

import json

import pytest
from pyspark.sql import functions as F

from harfmill.sources import config, results
from harfmill.streaming.monitor import stop_monitor, windowed_loss


def test_results_and_reports(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"run{k}").mkdir()
        (tmp_path / f"run{k}" / "all_metrics.json").write_text(json.dumps({"intrinsic": {"fertility": 1.5 + k}, "status": "ok"}, indent=2))
    frame = results.read_results(spark, f"{tmp_path}/*/all_metrics.json")
    assert frame.count() == 3 and frame.select("intrinsic.fertility").agg(F.max("fertility")).first()[0] == 3.5
    results.write_report(frame.select("status", "intrinsic.fertility").orderBy("fertility"), f"{tmp_path}/report.txt", "Runs")
    assert "1.5000" in (tmp_path / "report.txt").read_text() and len(json.loads((tmp_path / "report.json").read_text())) == 3
    results.write_json(frame.withColumn("x", F.lit(None).cast("int")), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").where("value like '%\"x\":null%'").count() == 3


def test_failures_csv(spark, tmp_path):
    frame = spark.createDataFrame([(1, "سؤال", 2)], "index int, question string, extra int")
    assert results.write_failures(frame, f"{tmp_path}/a/f.csv", ["index", "question", "missing"]) == 1
    raw = (tmp_path / "a" / "f.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfindex,question,missing") and "سؤال".encode() in raw
    assert results.write_failures(frame.limit(0), f"{tmp_path}/f2.csv", ["index"]) == 0 and (tmp_path / "f2.csv").read_bytes().strip() == b"\xef\xbb\xbfindex"


def test_vocab_and_cache(spark, tmp_path):
    vocab = spark.createDataFrame([("a", 1)], "token string, id long")
    results.save_vocab(vocab, f"{tmp_path}/v", kind="char", size=260)
    back, manifest = results.load_vocab(spark, f"{tmp_path}/v")
    assert back.collect() == vocab.collect() and manifest == {"kind": "char", "size": 260}
    calls = []

    def analyse(words):
        calls.append(1)
        return words.withColumn("root", F.upper("word"))

    need = spark.createDataFrame([("x",), ("y",)], "word string")
    for frame in (need, need.where("word = 'x'")):
        got = results.cached_analyses(spark, f"{tmp_path}/cache", frame, analyse)
    assert len(calls) == 1 and [r.root for r in got.collect()] == ["X"]


def test_configs(spark, tmp_path):
    frame = spark.createDataFrame([("a", "All"), ("b", "x"), ("c", "y")], "q string, source_config string")
    frame.write.partitionBy("source_config").parquet(f"{tmp_path}/c")
    assert results.read_configs(spark, f"{tmp_path}/c", ("All",)).count() == 2
    (tmp_path / "base.json").write_text('{"a": {"b": 1, "c": 2}, "experiment": {"name": "n"}}')
    (tmp_path / "exp.json").write_text('{"a": {"b": 3}}')
    got = config.load_config(f"{tmp_path}/base.json", f"{tmp_path}/exp.json", {"a": {"d": 4}})
    assert got["a"] == {"b": 3, "c": 2, "d": 4} and got["name"] == "n"
    for bad in ({"p": {"steps": 0}}, {"p": {"trainable_parameters": ["*", "x"]}}, {"sft": {"steps": 1}}):
        with pytest.raises(ValueError):
            config.check_phases(bad)


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 0{k}:00:00", k, 5.0 - k if k < 3 else 9.0) for k in range(8)]
    frame = spark.createDataFrame(rows, "run long, ts string, step long, loss double").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    for name, query, mode in (("w", windowed_loss(stream, "2 hours"), "complete"), ("m", stop_monitor(stream.select("run", "step", "loss"), 3), "update")):
        query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("w").count() == 4
    assert [tuple(r) for r in spark.table("m").collect()] == [(1, 3.0, 5)]
