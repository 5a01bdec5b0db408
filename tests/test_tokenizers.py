"""Tokenizers: ids, round trips, training."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harfmill.operators import corpora, rootpattern, subword, tokenizers, vocabulary

TEXTS = ["كتب الطالب الدرس", "والكتاب الذي قرأته", "قال الرجل للولد", "يدرس الطلاب", "في عام 2024", "السلام عليكم!", "كتب كاتب كتابا", "والكتاب كتابهم"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_char_ids(spark):
    vocab = vocabulary.char_vocab(docs(spark))
    ids = sorted(r.id for r in vocab.collect())
    assert ids == list(range(5, 5 + len(ids)))
    table = {r.token: r.id for r in vocab.collect()}
    for r in tokenizers.encode_char(docs(spark), vocab).collect():
        assert r.ids == [1, *[4 if ch == " " else table[ch] for ch in r.text], 2]
    unknown = spark.createDataFrame([(1, "Z 😀")], "doc_id long, text string")
    assert tokenizers.encode_char(unknown, vocab).first().ids == [1, 3, 4, 3, 2]


def test_byte_round_trip(spark):
    frame = docs(spark).unionByName(spark.createDataFrame([(99, "é😀\n"), (98, "")], "doc_id long, text string"))
    ids = tokenizers.encode_bytes(F.col("text"))
    for r in frame.select("text", ids.alias("ids"), tokenizers.decode_bytes(ids).alias("back")).collect():
        assert r.ids == [1, *[b + 4 for b in r.text.encode()], 2] and r.back == r.text
    bad = spark.createDataFrame([([1, 0xC3 + 4, 2],)], "ids array<long>").select(tokenizers.decode_bytes(F.col("ids")).alias("x")).first().x
    assert bad == "�"


def test_pad_truncate(spark):
    f = lambda *a: spark.createDataFrame([([5, 6, 7],)], "i array<long>").select(tokenizers.truncate_pad(F.col("i"), *a).alias("x")).first().x
    assert f(2, True, True) == [5, 6] and f(5, True, True) == [5, 6, 7, 0, 0] and f(2, True, False) == [5, 6, 7] and f(None, True, True) == [5, 6, 7]


def test_words_and_char_vectors(spark):
    vocab = vocabulary.word_vocab(docs(spark), 3)
    assert [r.id for r in vocab.orderBy("id").collect()] == [4, 5, 6] and vocab.orderBy("id").first().token in ("كتب", "والكتاب")
    ids = {r.doc_id: r.ids for r in tokenizers.encode_words(docs(spark), vocab).collect()}
    assert all(i[0] == 1 and i[-1] == 2 for i in ids.values()) and len(ids[0]) == 5
    odd = spark.createDataFrame([(7, "كتب x"), (7, "كتب"), (None, ""), (8, None)], "doc_id long, text string")
    table = {r.token: r.id for r in vocab.collect()}
    got = [(r.doc_id, r.ids) for r in tokenizers.encode_words(odd, vocab).collect()]
    assert sorted(got, key=str) == sorted([(7, [1, table.get("كتب", 3), 3, 2]), (7, [1, table.get("كتب", 3), 2]), (None, [1, 2]), (8, [1, 2])], key=str)
    with pytest.raises(ValueError, match="more than"):
        tokenizers.encode_words(odd, vocab, limit=2)
    codes = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda k: k.cast("long") + 7)
    v = spark.createDataFrame([("abcdef",)], "w string").select(tokenizers.word_char_ids(F.col("w"), codes, 6).alias("x")).first().x
    assert v == [1, 104, 105, 106, 107, 2]


def test_bpe_and_wordpiece(spark):
    frame = docs(spark).unionByName(docs(spark))
    bpe = subword.Subword.train(frame, "bpe", 200)
    for t in TEXTS:
        assert bpe.decode(bpe.encode(t)) == t
    got = frame.select("text", bpe.encode_column(F.col("text")).alias("ids")).collect()
    assert all(r.ids == bpe.encode(r.text) and r.ids[0] == 1 and r.ids[-1] == 2 for r in got)
    assert len(bpe.encode("والكتاب")) < len("والكتاب".encode()) + 2
    wp = subword.Subword.train(frame, "wordpiece", 150)
    assert wp.decode(wp.encode("كتب الطالب")) == "كتب الطالب" and wp.encode("zzz") == [1, 3, 2]
    assert [*wp.vocab.values()] == list(range(len(wp.vocab)))


def test_merges_by_definition():
    counts = {"abab": 5, "abc": 3, "bc": 4}
    vocab, merges = subword.learn_bpe(counts, 100, 2)
    words = {tuple(w): n for w, n in counts.items()}
    for pair in merges:
        seen: dict = {}
        for w, n in words.items():
            for p in zip(w, w[1:]):
                seen[p] = seen.get(p, 0) + n
        assert seen[pair] == max(seen.values()) and pair == min(p for p in seen if seen[p] == seen[pair])
        fresh: dict = {}
        for w, n in words.items():
            out, k = [], 0
            while k < len(w):
                if w[k : k + 2] == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(w[k])
                    k += 1
            fresh[tuple(out)] = fresh.get(tuple(out), 0) + n
        words = fresh


def test_training_counts_every_word(spark):
    rare = ["ذرزضظ", "غثخذ"]
    texts = TEXTS * 2 + ["aaaa aaa abab ababab baab abc bcabc", *rare, "x\x01y \x02\x01"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind in ("bpe", "wordpiece"):
        whole, few = subword.Subword.train(frame, kind, 150), subword.Subword.train(frame, kind, 150, max_words=3)
        assert few.vocab == whole.vocab and few.merges == whole.merges and whole.merges
        assert all(subword.UNK not in few.encode(w) for w in rare)


def test_plain_bpe_has_no_marker(spark):
    frame = spark.createDataFrame([("ab ab abab xb",), ("ab abc",)], "text string")
    model = subword.Subword.train(frame, "plain_bpe", 9)
    assert model.tokens == [*subword.SPECIALS, "a", "b", "c", "x"] and model.merges == []
    model = subword.Subword.train(frame, "plain_bpe", 10)
    assert model.merges == [("a", "b")] and model.tokens[9] == "ab"
    assert model.encode("abzab ba") == [1, 9, 3, 9, 6, 5, 2] and model.decode([1, 9, 6, 2]) == "ab b"


SIGNS = ["foo _bar", "a² 10½ Ⅷ①", "it's we'll  x\n\n y ", "كَتَبَ الطالبُ، 2024_v", "日本　x ", "a\u200db é\u0301", "", " ", "\t-\x1c?", "x" * 300]


def test_pre_tokens_equal_library(spark):
    from tokenizers import pre_tokenizers as library

    made = {True: library.ByteLevel(add_prefix_space=False), False: library.Whitespace()}
    frame = spark.createDataFrame([(t,) for t in SIGNS], "text string")
    for level, other in made.items():
        want = {t: [p for p, _ in other.pre_tokenize_str(t)] for t in SIGNS}
        assert all(subword.pre_tokens(t, level) == want[t] for t in SIGNS)
        assert all(r.p == want[r.text] for r in frame.select("text", subword.pre_token_column(F.col("text"), level).alias("p")).collect())


def test_ids_equal_library(spark):
    """The library's own encoding with our vocabulary and merges."""
    from tokenizers import Tokenizer, models
    from tokenizers import pre_tokenizers as library

    frame = docs(spark).unionByName(docs(spark)).unionByName(spark.createDataFrame([(k, t) for k, t in enumerate(SIGNS * 2)], "doc_id long, text string"))
    for kind in ("bpe", "wordpiece", "plain_bpe"):
        ours = subword.Subword.train(frame, kind, 260 if kind != "bpe" else 400)
        if kind == "wordpiece":
            theirs = Tokenizer(models.WordPiece(ours.vocab, unk_token="<unk>", max_input_chars_per_word=10_000))
        else:
            theirs = Tokenizer(models.BPE(ours.vocab, ours.merges, unk_token="<unk>"))
        theirs.pre_tokenizer = library.ByteLevel(add_prefix_space=False) if kind == "bpe" else library.Whitespace()
        for r in frame.select("text", ours.encode_column(F.col("text")).alias("ids"), ours.pieces_column(F.col("text")).alias("pieces")).collect():
            want = theirs.encode(r.text)
            assert r.ids == [1, *want.ids, 2] == ours.encode(r.text), (kind, r.text)
            assert r.pieces == [ours.tokens[i] for i in want.ids]


def test_morpho_bpe_segments_first(spark):
    frame = spark.createDataFrame([("والمدرسة درسهم في",)], "text string")
    assert corpora.segmented(frame).first().text == "و ال مدرسة درس هم في"


def test_root_pattern(spark):
    frame = docs(spark)
    model = rootpattern.RootPattern.train(rootpattern.analysis_table(frame), min_count=1)
    got = model.encode_frame(frame)
    rows = got.select("text", "ids", model.decode_column(F.col("ids")).alias("back")).collect()
    assert len(rows) == len(TEXTS)
    back = {r.text: r.back for r in rows}
    assert back["في عام 2024"] == "في عام 2024" and back["السلام عليكم!"] == "السلام عليكم !"
    assert all(r.ids[0] == 1 and r.ids[-1] == 2 and 3 not in r.ids for r in rows)
    strict = rootpattern.RootPattern.train(rootpattern.analysis_table(frame), min_count=99)
    literal = strict.encode_frame(frame).select("text", strict.decode_column(F.col("ids")).alias("back")).collect()
    assert all(r.back.replace(" ", "") == r.text.replace(" ", "") for r in literal)
    assert strict.decode(strict.encode("hello", {})) == "?"
    same = spark.createDataFrame([(None, TEXTS[0]), (3, TEXTS[1]), (3, TEXTS[0]), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.ids for r in model.encode_frame(same).collect()}
    assert len(got) == 4 and got[None, TEXTS[0]] == got[3, TEXTS[0]] != got[3, TEXTS[1]] and got[None, None] == [1, 2]


def test_analyses_are_made_once_a_word(spark):
    """No part of the analysis stands below the grouping into distinct words."""
    table = rootpattern.analysis_table(docs(spark)).where("root is not null and pattern is not null")
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Aggregate [word")
    assert "regexp_replace" in above and below and "regexp_replace" not in below and "regexp_like" not in below.lower()


def test_chunks_are_analysed_alike_and_texts_are_not_shuffled(spark):
    """A worker's analyses equal Spark's, and encoding is a narrow map."""
    r = random.Random(6)
    found = ["".join(r.choice("اويبكلسفهنمتعدَُّ") for _ in range(r.randint(1, 12))) for _ in range(3000)] + ["والكتابهما", "فبالبيتها", "ووو", "ّ"]
    table = rootpattern.analyse(spark.createDataFrame([(w,) for w in found], "word string"))
    for x in table.collect():
        want = (x.root, x.pattern, list(x.proclitics), x.enclitic) if x.root is not None and x.pattern is not None else None
        assert rootpattern.analysis_of(x.word) == want
    plan = rootpattern.RootPattern(["كتب"], ["فعل"], {}).encode_frame(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_packed_training_is_the_same(monkeypatch):
    """Merges in strings equal merges in lists, also where signs repeat and counts tie."""
    r = random.Random(9)
    for marker in ("", "##"):
        counts = {"".join(r.choice("abاب") for _ in range(r.randint(0, 9))): r.randint(1, 9) for _ in range(2500)}
        found = subword.learn_bpe_packed(list(counts), np.fromiter(counts.values(), np.int64), 150, 2, marker, part=300)
        assert found == subword.learn_bpe(counts, 150, 2, marker)


def test_segmented_counts_come_from_distinct_words(spark):
    frame = spark.createDataFrame([("والمدرسة درسهم في",), ("درسهم x² والمدرسة، درسهم",), (None,), ("",)], "text string")
    want = {r.word: r.cnt for r in subword.count_words(corpora.segmented(frame), "text", False).collect()}
    assert {r.word: r.cnt for r in subword.count_segmented(frame).collect()} == want
    below = subword.count_segmented(frame)._jdf.queryExecution().optimizedPlan().toString().rpartition("Aggregate [word")[2]
    assert "regexp_extract(" not in below
