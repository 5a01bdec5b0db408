"""Golden vectors of the operators' definitions."""

import math

import pytest
from pyspark.sql import functions as F

from harfmill.functions import arabic, morphology, scoring
from harfmill.operators import corpora, mcq, metrics, reports, training
from harfmill.operators.registry import Registry


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("morphemes", "want"),
    [
        ([], []), (["قلم"], []), (["ف", "قلم"], [1]), (["ف", "ال", "بيت"], [1, 3]), (["بيت", "هما"], [3]), (["س", "يلعب", "ون"], [1]),
        (["ب", "بيت", "نا"], [1, 4]), (["فَ", "بَيْت"], [1]), (["لا", "عب"], [2]), (["قلم", "هم", "نا"], [3, 5]), (["بيت", "ال", "كن"], [5]),
    ],
)
def test_clitic_boundaries(spark, morphemes, want):
    assert one(spark, "m array<string>", (morphemes,), morphology.clitic_boundaries(F.col("m"))) == want


def shown(text):
    return "".join({b: c for c, b in arabic.byte_alphabet().items()}[b] for b in text.encode())


@pytest.mark.parametrize(
    ("word", "morphemes", "tokens", "want"),
    [
        ("قلم", None, ["قلم"], None),
        ("قلم", ["قلم"], ["ق", "لم"], (None, None, None, 1, 2)),
        ("فالبيت", ["ف", "ال", "بيت"], ["فال", "بيت"], (0.5, 1, 2, 3, 2)),
        ("بيتنا", ["بيت", "نا"], ["<s>", "بيت", "##نا"], (1.0, 1, 1, 2, 2)),
        ("بيتنا", ["بيت", "نا"], ["صخر"], (None, None, None, 2, 1)),
        ("بيتنا", ["بيت", "نا"], [shown("بيت"), shown("نا")], (1.0, 1, 1, 2, 2)),
        ("يلعبون", ["يلعب", "ون"], ["يل", "عبون"], (0.0, None, None, 2, 2)),
        ("فَبيت", ["ف", "بيت"], ["فَب", "يت"], (0.0, 0, 1, 2, 2)),
    ],
)
def test_word_record(spark, word, morphemes, tokens, want):
    got = one(spark, "w string, m array<string>, t array<string>", (word, morphemes, tokens), morphology.word_record(F.col("w"), F.col("t"), F.col("m")))
    assert (tuple(got) if got else got) == want


def test_patterns(spark):
    p = lambda f, t, r: one(spark, "t string, r string", (t, r), f(F.col("t"), F.col("r")))
    assert p(morphology.pattern, "دَارس", "درس") == "فاعل" and p(morphology.pattern, "زلزال", "زلزل") == "فعلال"
    assert p(morphology.stem_span, "بالدروس", "درس") == "فعول" and p(morphology.stem_span, "متزلزلة", "زلزل") == "فعلل"
    assert p(morphology.pattern, "دار", "درس") is None and p(morphology.stem_span, "دار", "درس") is None
    assert p(morphology.pattern, "", "درس") is None and p(morphology.pattern, "درس", "") is None
    assert p(morphology.pattern, "سفرجلي", "سفرجل") == "فعلي" and p(morphology.stem_span, "xدر", "در") == "فع"
    assert p(morphology.has_subsequence, "مدروس", "درس") and not p(morphology.has_subsequence, "سرد", "درس") and p(morphology.has_subsequence, "x", "")
    assert p(morphology.fill_pattern, "م12و3", "درس") == "مدروس" and p(morphology.fill_pattern, "1234", "درس") == "درس"
    assert one(spark, "w string", ("فَالدرس",), morphology.strip_proclitic(F.col("w"), "ف")) == "الدرس"
    assert one(spark, "w string", ("درس",), morphology.strip_clitics(F.col("w"), ["ف", "ال"], ["هم"])) == "درس"
    assert one(spark, "w string", ("فَالْدرسهم",), morphology.strip_clitics(F.col("w"), ["ف", "ال"], ["هم"])) == "درس"


def test_patterns_by_fold(spark):
    """One match and the fold agree wherever both apply."""
    letters = "ابدرسمل"
    rows = [("".join(letters[(k * 7 + j * j * (k % 5 + 1)) % 7] for j in range(k % 9 + 1)), "".join(letters[(k * 3 + j * 2) % 7] for j in range(3 + k % 2))) for k in range(300)]
    frame = spark.createDataFrame(rows, "t string, r string")
    t, r = F.col("t"), F.col("r")
    three = F.length("r") == 3  # the fold knows the seats of three letters
    got = frame.where(three).select(*[f(t, r, w).alias(f"{n}{w}") for w in (True, False) for n, f in (("a", morphology._seated), ("b", morphology._seated_fold))]).collect()
    assert all(x.aTrue == x.bTrue and x.aFalse == x.bFalse for x in got) and sum(x.aTrue is not None for x in got) > 5


def test_latin(spark):
    no = ["قرأت الكتاب", "صَبَاحُ الخَيْرِ", "Москва", "Ελλάδα", "東京", "7 ؛ !", "٩٨", "", None]
    yes = ["لغة C", "Paris", "naïve", "Łódź"]
    got = [r.x for r in spark.createDataFrame([(k, s) for k, s in enumerate(no + yes)], "k int, s string").orderBy("k").select(arabic.has_latin(F.col("s")).alias("x")).collect()]
    assert got == [False] * len(no) + [True] * len(yes)


def test_cleaning(spark):
    assert one(spark, "s string", ("  آدم  أَحْمَد\n إلى ـــ ",), arabic.normalize(F.col("s"), marks=True)) == "ادم احمد الى"
    assert one(spark, "s string", ("ﬁ ２",), arabic.nfkc(F.col("s"))) == "fi 2"
    for text in ("قلم", " قلم", "a\x00b", "é\n"):
        assert one(spark, "s string", (shown(text),), arabic.decode_byte_level(F.col("s"))) == text
        assert one(spark, "s string", (text,), arabic.encode_byte_level(F.col("s"))) == shown(text)
    for text in ("قلم", "Ø", ""):  # no byte-level form: as it is
        assert one(spark, "s string", (text,), arabic.decode_byte_level(F.col("s"))) == text
    assert one(spark, "s string", (shown(" قَلم"),), arabic.clean_token(F.col("s"))) == "قلم"
    assert one(spark, "s string", ("aقَلx١",), arabic.arabic_only(F.col("s"))) == "قَل"
    assert len(arabic.byte_alphabet()) == 256


def test_scores(spark):
    assert one(spark, "l double, c string", (-4.0, " صح"), scoring.char_score(F.col("l"), F.col("c"))) == -2
    assert one(spark, "l double, c string", (-12.0, " ايجابي"), scoring.char_score(F.col("l"), F.col("c"))) == -2
    with pytest.raises(Exception, match="pmi"):
        one(spark, "l double, u double", (-1.0, None), scoring.pmi_score(F.col("l"), F.col("u")))
    assert one(spark, "s array<double>", ([-1.0, 2.0, 2.0],), scoring.first_argmax(F.col("s"))) == 1
    got = one(spark, "s array<double>", ([1.0, 2.0, 3.0],), scoring.log_softmax(F.col("s")))
    want = [x - math.log(sum(math.exp(y) for y in (1, 2, 3))) for x in (1, 2, 3)]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("p", "f", "want"), [([7, 8], [7, 8, 30, 31], [-100, -100, 30, 31]), ([7, 9], [7, 8, 30], [-100, 8, 30]), ([4, 4, 4], [4, 4], None), ([6], [6], None), ([], [2, 3], [2, 3])])
def test_answer_labels(spark, p, f, want):
    assert one(spark, "p array<int>, f array<int>", (p, f), scoring.answer_labels(F.col("p"), F.col("f"))) == want


def test_grouped_accuracy(spark):
    rows = [(e, c, " x", -1.0 - c, -1.0, 0 if e % 2 else 1, "a" if e < 2 else "b") for e in range(4) for c in range(2)]
    frame = spark.createDataFrame(rows, "ex_id int, choice_idx int, continuation string, ll double, unconditioned double, gold int, source_config string")
    got = {r.source_config: (r.num_samples, r.accuracy_char) for r in mcq.accuracy(mcq.score(frame)).collect()}
    assert got == {None: (4, 0.5), "a": (2, 0.5), "b": (2, 0.5)}
    assert mcq.failures(mcq.score(frame, "char+pmi")).count() == 2


def test_empty_sample_is_null_not_zero(spark):
    table = metrics.word_table(spark.createDataFrame([], "word string"))
    rows = metrics.morphological_metrics(table, ["bpe"]).collect() + metrics.bearing_tokens(table, ["bpe"]).collect()
    values = {k: v for r in rows for k, v in r.asDict().items()}
    assert len(rows) == 2 and values.pop("family") == "bpe" and values.pop("morph_sample_size") == 0
    assert set(values.values()) == {None} and len(values) == 7
    assert one(spark, "a int, b int", (0, 0), scoring.safe_rate(F.col("a"), F.col("b"))) is None
    assert one(spark, "a int, b int", (0, 0), scoring.size_rate(F.col("a"), F.col("b"))) == 0


def test_bytes_bear_no_root(spark):
    words = spark.createDataFrame([("مدرسة",), ("دارس",)], "word string")
    got = {r.family: r for r in metrics.bearing_tokens(metrics.word_table(words), metrics.FAMILIES).collect()}
    assert got["byte"].root_bearing_token_pct == 0.0 and got["byte"].pattern_bearing_token_pct == 0.0 and got["word"].root_bearing_token_pct == 100.0


def test_token_f1_by_definition(spark):
    from collections import Counter

    rows = [("a b b c", "b b b d a"), ("x", "x"), ("", ""), ("", "y"), ("q r", "s t"), ("a a a", "a"), ("B  b", "b")]
    for p, r in rows:
        x, y = p.lower().split(), r.lower().split()
        common = sum((Counter(x) & Counter(y)).values())
        want = 1.0 if not x and not y else 0.0 if not common else 2 * common / (len(x) + len(y))
        assert one(spark, "p string, r string", (p, r), metrics.token_f1(F.col("p"), F.col("r"))) == pytest.approx(want)


def test_pooling(spark):
    assert one(spark, "m array<long>", ([0, 0, 1, 0, 0, 0, 1],), scoring.pooled_mask(F.col("m"), 3)) == [1, 0, 1]
    assert one(spark, "m array<long>", ([],), scoring.pooled_mask(F.col("m"), 3)) == []
    x = [1.0, 3.0, -2.0]
    blocks = [[1.0, 2.0], [3.0, 2.0], [-2.0, -1.0]]
    want = [sum(v * math.exp(v) for v in b) / sum(math.exp(v) for v in b) for b in blocks]
    assert one(spark, "x array<double>", (x,), scoring.block_mix(F.col("x"), 2)) == pytest.approx(want)


def test_accepted_analysis(spark):
    tags = [F.lit("wa_conj"), F.lit("0"), F.lit(None).cast("string"), F.lit("Al_det"), F.lit("3fs_poss")]
    f = lambda root, pat, stem=None: one(spark, "r string, p string, s string", (root, pat, stem), morphology.accepted_analysis(F.col("r"), F.col("p"), tags, F.col("s")))
    got = f("د.ر#س", "وَال1َ2ْ3هَا")
    assert (got.root, got.pattern, got.proclitics, got.enclitic, got.stem) == ("درس", "1َ2ْ3", ["و", "ال"], "ها", "دَرْس")
    assert f("درس", "1ا23", "دارس").stem == "دارس"
    assert [f(*x) for x in (("NTWS", "123"), ("درس", ""), ("درس", None), ("در", "12"), ("درس", "NTWS"), (None, "123"))] == [None] * 6


def test_generated_surface(spark):
    kind = "f string, c array<struct<root: string, pattern: string, stem: string, wanted: boolean>>"
    g = lambda c: one(spark, kind, ("naive", c), morphology.generated_surface(F.col("f"), F.col("c")))
    assert g([("a", "p", "no", False), ("b", "q", "stem", True)]) == "stem" and g([("b", "q", "", True)]) == "naive" and g([]) == "naive"


def test_integrity_one_means_clitics_one(spark):
    words = spark.createDataFrame([(w,) for w in ("والكتاب", "كتابهم", "والكاتب", "كتاب", "مدرسة", "والمدرسة", "يدرس")], "word string")
    got = {r.family: r for r in metrics.morphological_metrics(metrics.word_table(words)).collect()}
    assert got["morpheme"].morpheme_integrity_rate == got["morpheme"].clitic_separation_accuracy == got["morpheme"].semantic_fragmentation_ratio == 1.0
    assert got["word"].morpheme_integrity_rate == 0 and got["word"].root_conservation_rate == 1
    assert got["char"].root_conservation_rate == 0 and got["byte"].morpheme_integrity_rate is None


def test_schedule_and_stop(spark):
    lr = [r.x for r in spark.range(11).select(scoring.learning_rate(F.col("id"), 2, 10, "cosine").alias("x")).orderBy("id").collect()]
    assert lr[:3] == [0, 0.5, 1.0] and lr[6] == pytest.approx(0.5) and lr[10] == pytest.approx(0)
    losses = spark.createDataFrame([(1, s, float(x)) for s, x in enumerate([9, 3, 9, 5, 9, 5, 9, 1], 1)] + [(2, s, float(9 - s)) for s in range(1, 9)], "run int, step long, loss double")
    got = {r.run: r for r in training.stop_table(losses, patience=2, every=2, minimum=2).collect()}
    assert got[1].stopped == 6 and got[1].best_step == 2 and got[1].evals == 3
    assert got[2].stopped is None and got[2].best_step == 8


def test_small_pieces(spark):
    assert corpora.text_column(spark.createDataFrame([], "id int, title string, content string").schema) == "content"
    with pytest.raises(ValueError, match="no text"):
        corpora.text_column(spark.createDataFrame([], "id int").schema)
    r = Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError, match="already"):
        r.register("a")
    with pytest.raises(KeyError, match="known"):
        r.get("b")
    assert reports.sweep([{"type": "bpe", "vocab_size": 16000}, {"type": "char"}], lambda c: {"v": 1 / (c["type"] != "char")}, {}) == {"bpe_16k": {"v": 1.0}, "char": {"error": "division by zero"}}
    with pytest.raises(ValueError, match="alone"):
        training.trainable(F.lit("x"), ["*", "y"])
    with pytest.raises(KeyError, match="unknown corpus"):
        corpora.union_corpora({}, ["x"], "train")


def test_corpus_adapters(spark):
    squad = spark.createDataFrame([(1, "q", "c", "a"), (2, "q", "", "a")], "index int, question string, context string, text string")
    spans = spark.createDataFrame([("arabic-1", "q", "c", (["x", "y"],)), ("english-1", "q", "c", (["x"],)), ("arabic-2", "q", "c", ([],))], "id string, question string, context string, answers struct<text: array<string>>")
    assert [tuple(r) for r in corpora.squad_records(squad).collect()] == [("1", "q", "c", "a")]
    assert [tuple(r) for r in corpora.span_records(spans, "arabic-").collect()] == [("arabic-1", "q", "c", "x")]
    both = corpora.union_corpora({"s": {"train": corpora.squad_records(squad)}, "t": {"dev": corpora.span_records(spans)}}, ["s", "t"], {"s": "train", "t": "dev"})
    assert both.groupBy("source").count().count() == 2


def test_continuation_likelihood(spark):
    lp = [[-1.0, -2.0, -3.0]] * 4
    got = one(spark, "l array<array<double>>, c array<int>, f array<int>", (lp, [0, 1], [0, 1, 2, 1]), scoring.continuation_ll(F.col("l"), F.col("f"), scoring.continuation_start(F.col("c"), F.col("f"))))
    assert got == -5.0
    assert one(spark, "l array<array<double>>, f array<int>", (lp, [0, 1]), scoring.continuation_ll(F.col("l"), F.col("f"), F.lit(2))) == -1e9
    with pytest.raises(ValueError, match="span"):
        scoring.continuation_start(F.lit(1), F.lit(1), "other")


def test_first_accepted(spark):
    rows = [("NTWS", "1"), ("ك.ت.ب", "1ا2"), ("درس", "1")]
    got = one(spark, "c array<struct<root: string, pattern: string>>", (rows,), morphology.first_accepted(F.col("c")))
    assert tuple(got) == ("كتب", "1ا2")


def test_bridge(spark):
    import io
    import sys

    from harfmill.sources import bridge

    words = spark.createDataFrame([("والكتاب",), ("في",), ("يدرسون",)], "word string").repartition(2)
    got = {r.word: r.root for r in bridge.analyse_words(words, [sys.executable, "-m", "harfmill.sources.bridge"]).collect()}
    assert got == {"والكتاب": "كتب", "في": None, "يدرسون": bridge.analyse("يدرسون")["root"]}
    out = io.StringIO()
    bridge.serve(io.StringIO('nonsense\n{"op": "x"}\n{"op": "generate", "root": "كتب", "pattern": "م12و3"}\n{"op": "shutdown"}\n{"op": "x"}\n'), out)
    lines = out.getvalue().splitlines()
    assert len(lines) == 3 and '"ok": false' in lines[0] and '"ok": false' in lines[1] and "مكتوب" in lines[2]
