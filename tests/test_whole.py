"""Queries that cover all rows, whole texts and the reference's sizes."""

import duckdb
from pyspark.sql import functions as F

from harfmill import plans
from harfmill.plans import base


def run(spark, monkeypatch, name, **tables):
    monkeypatch.setattr(base.Tables, "__getattr__", lambda self, table: tables[table])
    return plans.QUERIES[name](spark, "").collect()


def documents(spark, *texts):
    return spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_long_answers_stay_whole(spark, monkeypatch):
    rows = [(1, 0, "user", "question"), (1, 1, "assistant", "a" * 1500), (2, 0, "user", "question"), (2, 1, "assistant", "b" * 3000)]
    got = run(spark, monkeypatch, "batch_pad_2048", conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert sorted(r.ones for r in got) == [1500, 2048]


def test_long_words_differ(spark, monkeypatch):
    got = run(spark, monkeypatch, "word_char_vectors_50", documents=documents(spark, "abcdefghijkl abcdefghijkm"))
    assert len({r.ids_md5 for r in got}) == 2


def test_clitics_of_all_words(spark, monkeypatch):
    letters = "bcdfghjklm"
    docs = documents(spark, " ".join(f"{a}{b}{c}" for a in letters for b in letters for c in letters))
    n = docs.select(F.explode(F.split("text", " ")).alias("w")).distinct().count()
    for name in ("strip_clitic_all", "align_offsets_all"):
        got = run(spark, monkeypatch, name, documents=docs)
        assert len(got) == len({r.word for r in got}) > 500 and n >= len(got)


def test_word_vocabulary_of_50000(spark, monkeypatch):
    docs = documents(spark, " ".join(f"w{k}" for k in range(6000)))
    for name in ("size_metrics_word_50k", "size_metrics_by_lang_50k", "unk_rate_50k"):
        assert all(r.unk_rate == 0 for r in run(spark, monkeypatch, name, documents=docs))
    assert [r.vocab_coverage for r in run(spark, monkeypatch, "vocab_coverage_50k", documents=docs)] == [1.0]
    assert all(r["size.more.unk_rate"] == 0 for r in run(spark, monkeypatch, "flatten_metrics_50k", documents=docs))


def test_every_block_and_run(spark, monkeypatch):
    vectors = spark.createDataFrame([(1, [float(k) for k in range(70)]), (2, [])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.means for r in run(spark, monkeypatch, "block_means_all", embeddings=vectors)}
    assert got == {1: [4 * k + 1.5 for k in range(17)] + [68.5], 2: []}
    docs = documents(spark, "a b").unionByName(documents(spark, "c").withColumn("lang", F.lit("fr")))
    got = run(spark, monkeypatch, "comparison_all", documents=docs)
    assert sorted(got[0].asDict()) == sorted(["metric", *[f"{f}_{lang}" for f in ("char", "byte", "word") for lang in ("en", "fr")]]) and len(got) == 3


def test_block_means_like_sql(spark, monkeypatch, tmp_path):
    rows = [(1, [-1e-7] * 4 + [1e-7] * 4), (2, [1.0, None, 3.0, None, None]), (3, [float("nan")] * 4 + [float("inf"), 1.0]), (4, None), (5, []), (6, [2.5e-6, 0.0, 0.0, 0.0, -0.5]), (7, [-2e-7] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "v"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    for name in ("block_means_all", "block_means"):
        want = {r[0]: repr(r[1:]) for r in con.execute(base.ORACLES[name]).fetchall()}
        got = {r[0]: repr(tuple(r)[1:]) for r in run(spark, monkeypatch, name, embeddings=vectors)}
        assert got == want
    assert "-0.0" in want[7]
