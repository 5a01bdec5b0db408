"""Each corpus operator against a brute-force version on small inputs, with the odd cases its docstring names."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harfmill.llm import chains, html_density, icws, impact_topk, mixcoder, packing, pfp_dedup, piece_fst, quality, sphere_dedup, token_store
from harfmill.llm.bytesops import string_bytes
from harfmill.llm.components import components
from harfmill.llm.queries import vocabulary
from harfmill.llm.shared import Workspace
from harfmill.llm.units import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch int, row string"
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["été", "größe", "ñandú"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], DOCS)


ODD = [(900, None), (901, ""), (902, " \n"), (None, "a null id with some words in it"), (903, "x"), (904, "same id"), (904, "same id"), (904, "other text, same id")]


# op1


def test_main_text():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>'
        '<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">Cookies!</div><aside>side</aside>'
        "<article><h1>Title &amp; more</h1><p><b>First\n line.<br><p>Second &lt;b&gt; caf&eacute;.</p><p>Un<i>brok</i>en</p><form><input>f</form>"
        '<div class="comments"><p>a reader says</p></div></article><footer>&copy; me</footer></body></html>'
    )
    assert html_density.main_text(page) == "Title & more First line. Second <b> café. Unbroken"
    body = "".join(f"<p>{prose(40, k)}</p>" for k in range(5))
    links = "".join(f'<li><a href="/{k}">{prose(3, k)}</a></li>' for k in range(30))
    plain = f"<html><body><div><ul>{links}</ul></div><div><div>{body}</div></div><div><a href='x'>more</a></div></body></html>"
    assert html_density.main_text(plain) == " ".join(prose(40, k) for k in range(5))
    assert html_density.main_text(None) == html_density.main_text("  ") == ""
    assert html_density.main_text("just text &amp; no tags") == "just text & no tags"
    assert html_density.main_text("<p>open <b>never closed") == "open never closed"
    assert html_density.main_text("<!-- never ends <p>x</p>") == ""
    assert len(html_density.main_text(f"<body><article><p>{'long ' * 200000}</p></article></body>")) == 999999
    assert html_density.main_text("<body>" + "<div>" * 3000 + "deep") == "deep"


PARAGRAPH = "Rain fell on the old harbour for most of the day, and the boats stayed where they were until the evening."
BODY = "".join(f"<p>{k} {PARAGRAPH}</p>" for k in range(3))
PROSE = " ".join(f"{k} {PARAGRAPH}" for k in range(3))
MENU = "<nav><ul><li><a href=/a>Start</a></li><li><a href=/b>Team</a></li></ul></nav>"


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="layout has-sidebar">{}</div>', '<div class="content no-footer">{}</div>', '<section id="research-share">{}</section>', "<form id=f action=/go/>{}<input></form>", '<div class="widget">{}</div>', "<main>{}</main>", "<article>{}</article>", "<div>{}</div>", '<div id="sidebar-wrapper">{}</div>'],
)
def test_wrapped_prose_stays(wrapper):
    page = f"<html><body>{MENU}{wrapper.format(BODY)}<footer>all rights reserved</footer></body></html>"
    assert html_density.main_text(page) == PROSE


def test_parts_of_an_article():
    words = f'<article><h1>Title</h1>{BODY}<p class="comment-free">a block</p><ul class=more><li><a href=1>one more story</a><li><a href=2>and one more</a></ul><h2>Next</h2><p>short</p></article>'
    assert html_density.main_text(f"<body>{MENU}{words}</body>") == f"Title {PROSE} a block Next short"
    post = f'<div class=post><h1>Title</h1>{BODY}</div>'
    comments = '<div class="{}">' + "<p>what a reader says about it, at length</p>" * 40 + "</div>"
    for name in ("comments", "reader-comments", "post-comments comments-area", "acme-comments", "commentList"):
        assert html_density.main_text(f"<body>{post}{comments.format(name)}</body>") == f"Title {PROSE}", name
    assert html_density.main_text("<body><nav class=menu/><a href=x>HOME</a> ABOUT</nav><article><p>Text</p></article></body>") == "Text"
    short = "<body><article><p>Few words.</p></article><footer>a footer that says a great deal more than the article itself does</footer></body>"
    assert html_density.main_text(short) == "Few words."


@pytest.mark.parametrize("part", ["<div>", "<![CDATA[", "<a ", '<a href="', "<a b='c\" ", "<b>", "<p><b>", "<table><tr><td>", "<!--", "<", "<style>", "<a>", "</i>", "&amp", "<li></li>", "<title>", "<ul><li>"])
def test_long_hostile_pages(part):
    """Time grows with length only: a page of a megabyte takes seconds at most."""
    from time import process_time

    before = process_time()
    html_density.main_text("<ul><li><div>" + part * ((1 << 20) // len(part)) + "</x>" * 100)
    assert process_time() - before < 6


def test_densities_against_definition():
    """Composite density and sums on random trees, by recursion over the tree as it was made."""
    r = random.Random(8)

    def make(depth):
        kids = []
        for _ in range(r.randint(0, 4) if depth else 3):
            kind = r.choice(["text", "b", "node", "a"]) if depth < 5 else "text"
            word = "w" * r.randint(1, 30)
            kids.append(word if kind == "text" else ("b", [word]) if kind == "b" else ("a", [word]) if kind == "a" else (r.choice(["div", "section", "ul"]), make(depth + 1)))
        return kids

    def html(kids):
        return "".join(k if isinstance(k, str) else f"<{k[0]}>{html(k[1])}</{k[0]}>" for k in kids)

    def count(kids, link=False):
        c = lc = t = lt = 0
        for k in kids:
            if isinstance(k, str):
                c, lc = c + len(k), lc + len(k) * link
            else:
                x = count(k[1], link or k[0] == "a")
                c, lc, t, lt = c + x[0], lc + x[1], t + x[2] + 1, lt + x[3] + (k[0] == "a")
        return c, lc, t, lt

    def density(kids, share, link):
        c, lc, t, lt = count(kids, link)
        if not c:
            return 0.0
        t = max(t, 1)
        return max(0.0, c / t * math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(c / max(c - lc, 1) * lc + share * c + math.e))

    for _ in range(60):
        kids = make(0)
        tree = html_density._parse(f"<body>{html(kids)}</body>")
        c, lc, _, _ = count(kids)
        want, sums = [], []

        def walk(kids, link, share):
            place = len(want)
            want.append(density(kids, share, link))
            sums.append(0.0)
            for k in kids:
                if not isinstance(k, str) and k[0] != "b":
                    sums[place] += walk(k[1], link or k[0] == "a", share)
            return want[place]

        walk(kids, False, lc / max(c, 1))
        got, total, body, _ = html_density._densities(tree, [False] * len(tree.tag))
        assert body == 1 and len(got) == len(want) + 1
        assert np.allclose(got[1:], want) and np.allclose(total[1:], sums)


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", 1), (2, None, None, 2), (2, None, None, 2)], "page_id long, url string, html string, text int")
    got = html_density.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "a b", 3), (2, None, "", 0), (2, None, "", 0)]
    assert html_density.extract(pages.limit(0)).count() == 0


# op2


def remove_brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = 2**63 if i is None else i
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b, j = (t or "").encode(), 2**63 if i is None else i
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < j:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeats(seed=1):
    r, shared, rows = random.Random(seed), [prose(20, 50 + k) for k in range(4)], []
    for i in range(60):
        parts = [prose(r.randint(0, 40), 1000 + i)]
        if r.random() < 0.5:
            parts.insert(r.randint(0, 1), r.choice(shared)[r.randint(0, 30) :])
        rows.append((i * 3 % 61, " ".join(parts)))
    return rows + [(200, rows[3][1]), (201, rows[3][1] + " é"), (202, "ab" * 300), (203, "ab" * 100), (204, "a" * 49), (205, "a" * 49), (206, "é" * 40), (207, "xé" + "é" * 40)] + ODD + [(None, rows[5][1])]


def test_corpus_order():
    """Dictionary, parse and their suffix arrays put suffixes in the order of their bytes, and equal windows side by side."""
    r = random.Random(5)
    for trial in range(60):
        letters = r.choice([b"ab", b"abcdefgh ", bytes(range(256)), b"a"])
        pool = [bytes(r.choice(letters) for _ in range(r.randint(20, 90))) for _ in range(4)]
        strings = [b"".join(r.choice(pool) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 25))]
        text, edge = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, strings)))])
        start, end, left = pfp_dedup.parse(text, edge)
        assert set(edge[:-1]) <= set(start) and left[-1] == 1 and (end - start > 0).all()
        tails = {text[p:e].tobytes() for s, e, n in zip(start, end, left) for p in range(s, e - pfp_dedup.GRAM) if n > 1}
        assert not any(a != b and b.startswith(a) for a in tails for b in tails)  # prefix-free
        length = 20
        at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(edge[:-1], edge[1:])])
        order, key = pfp_dedup.corpus_order(text, edge, at)
        bound = edge[np.searchsorted(edge, at, "right")]
        suffixes = [text[p:e].tobytes() for p, e in zip(at[order], bound[order])]
        assert suffixes == sorted(suffixes)
        same = pfp_dedup.equal_neighbours(text, at[order], key, length)
        assert same.tolist() == [False] + [a[:length] == b[:length] for a, b in zip(suffixes, suffixes[1:])]


@pytest.mark.parametrize("hot", [{"hot_times": 0}, {"hot_batches": 2}, {"hot_times": 2}])
def test_remove_repeats_of_hot_anchors(spark, hot):
    """Anchors treated as hot, also such as repeat within a window."""
    rows = repeats() + [(3000 + k, prose(4, k) + " abab" * (15 + k) + " the common sixteen bytes " + prose(12, k % 5) + "z" * 70) for k in range(12)]
    got = pfp_dedup.remove_repeats(frame(spark, rows), batch_bytes=1500, **hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == remove_brute(rows)


def test_remove_repeats(spark):
    rows = repeats()
    for size in (1500, 12 << 20):
        got = pfp_dedup.remove_repeats(frame(spark, rows), batch_bytes=size).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == remove_brute(rows)
    assert pfp_dedup.remove_repeats(frame(spark, [])).count() == 0
    kept = pfp_dedup.documents_without_repeats(frame(spark, rows), ["doc_id", "text", "lang", "source", "n_chars"])
    assert kept.count() == len(rows) and kept.where("n_chars <> length(text)").count() == 0


# op3


def test_pieces_equal_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    ours, theirs = piece_fst.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [prose(60, k) for k in range(40)] + ["", " ", "  two  spaces ", "tabs\tand\nlines \n", "日本語 テキスト 😀", "▁ x ▁", "<s> </s> <unk> <0x41>", "ALL CAPS!! %%% ###", "naïve ﬁ ½ 𝔘", "a" * 300, "x  " * 9]
    for t in texts:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids, t
        assert ours.decode(ids) == theirs.decode(ids), t


def merged(model, text):
    """BPE by its definition: join the best-scored neighbours (leftmost of equals) until none is a piece."""
    signs = list(text)
    while True:
        best, where = -math.inf, -1
        for k in range(len(signs) - 1):
            i = model.ids.get(signs[k] + signs[k + 1])
            if i is not None and model.scores[i] > best:
                best, where = model.scores[i], k
        if where < 0:
            return signs
        signs[where : where + 2] = [signs[where] + signs[where + 1]]


def test_piece_pairs_fit_as_merges_say():
    model = piece_fst.PieceTransducer(vocabulary("piece_bpe_32k.model"))
    r = random.Random(6)
    common = [p for p in model.ids if 1 <= len(p) <= 5 and set(p) <= set("▁abcdeinorst")]
    pairs = [(r.choice(common), r.choice(common).replace("▁", "")) for _ in range(4000)]
    pairs = [(a, b) for a, b in pairs if b in model.ids]
    got = model._fits(np.array([model.ids[a] for a, _ in pairs]), np.array([model.ids[b] for _, b in pairs]))
    want = [merged(model, a + b) == [a, b] for a, b in pairs]
    assert got.tolist() == want and 100 < sum(want) < len(want) - 100
    for size in (40, 200, 3000):  # side by side and alone
        text = "".join(r.choice("aaabcdeinorsté日") for _ in range(size))
        ids = [model.ids[x] if x in model.ids else None for x in merged(model, "▁" + text)]
        want = [k for x, y in zip(ids, merged(model, "▁" + text)) for k in ([x] if x is not None else [model.bytes[b] for b in y.encode()])]
        assert model.encode(text) == want


def _proto(number, value):
    """A field of a protocol-buffer message."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, pieces, kind, character_map=b"", byte_pieces=False, **flags):
    """A model by hand: nothing is trained."""
    out = b"".join(_proto(1, _proto(1, p) + _proto(2, 0.0) + _proto(3, t)) for p, t in (("<unk>", 2), ("<s>", 3), ("</s>", 3)))
    if byte_pieces:
        out += b"".join(_proto(1, _proto(1, f"<0x{b:02X}>") + _proto(2, 0.0) + _proto(3, 6)) for b in range(256))
    out += b"".join(_proto(1, _proto(1, p) + _proto(2, float(s)) + _proto(3, 1)) for p, s in pieces.items())
    out += _proto(2, _proto(3, kind) + _proto(35, int(byte_pieces)))
    out += _proto(3, _proto(1, "own") + _proto(2, character_map) + _proto(3, flags.get("dummy", 1)) + _proto(4, flags.get("trim", 1)) + _proto(5, 1))
    Path(path).write_bytes(out)
    return str(path)


@pytest.mark.parametrize("bytes_", [False, True])
@pytest.mark.parametrize("spaced", [False, True])
def test_unigram_shortest_path_equals_library(tmp_path, bytes_, spaced):
    import sentencepiece

    r = random.Random(3)
    pieces = {ch: -8.0 - k / 4 for k, ch in enumerate("▁abcde")}
    while len(pieces) < 60:
        p = "".join(r.choice("▁aabbcde" if spaced else "aabbcde") for _ in range(r.randint(2, 5)))
        pieces.setdefault(("▁" if r.random() < 0.4 else "") + p, -r.randint(8, 120) / 8 - len(pieces) / 1024)
    if not spaced:
        pieces = {p: s for p, s in pieces.items() if "▁" not in p[1:]}
    path = model_file(tmp_path / "own.model", pieces, 1, byte_pieces=bytes_, trim=0)
    ours, theirs = piece_fst.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert ours.apart != spaced
    for _ in range(300):
        text = "".join(r.choice("aaabbcde  éx") for _ in range(r.choice([0, 1, 5, 30, 200])))
        assert ours.encode(text) == theirs.encode(text), text
        assert ours.decode(ours.encode(text)) == theirs.decode(theirs.encode(text))


def test_normaliser_equals_library(tmp_path):
    import sentencepiece

    named = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf")
    spec = dict(f for n, v in piece_fst._fields(named.serialized_model_proto()) if n == 3 for f in piece_fst._fields(v))
    path = model_file(tmp_path / "map.model", {"▁": -1.0, "a": -2.0}, 1, spec[2])
    ours, theirs = piece_fst.PieceTransducer(path).normalise, sentencepiece.SentencePieceNormalizer(model_file=path)
    assert len(ours.rules) > 1000
    r = random.Random(2)
    signs = "aB ﬁ½Éé\u0301Å\u030a①㌔\u3000\t\xa0ſß가각ｶﾞ日İ"
    for text in ["", " ", "Ｆｕｌｌ  width", *["".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(500)]]:
        assert ours(text) == theirs.normalize(text), repr(text)


def test_pieces_frame(spark):
    rows = ODD + [(1, prose(30, 1))]
    got = piece_fst.encode_documents(frame(spark, rows), vocabulary("piece_bpe_32k.model"), keep=True).collect()
    assert len(got) == len(rows) and all(r.decoded_equal for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in got)
    assert piece_fst.encode_documents(frame(spark, []), vocabulary("piece_bpe_32k.model")).count() == 0


# op4 and op7: ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    code = Encoder(vocabulary(name), limit=50)
    texts = [prose(80, k) for k in range(30)] + [
        "", " ", "a", " a", "a ", "a  b", "a \n b", "don't we'll  it's 'S", "x y z", "é o ́x", "tab\tb c", "line\nbreak here", "½ ² a1 1a 12 3", "<|endoftext|> a <|startoftext|>", "%%% &&& !!", "日本 語 😀 x", "Ñ É ß ς Σ", "a b c", "x\x1cy z", "word,. word.. ,word", "ÀÖ ×÷ ßa",
    ]
    ids, size = code.encode(*string_bytes(pa.array(texts)))
    edge = np.concatenate([[0], np.cumsum(size)])
    for k, t in enumerate(texts):
        assert ids[edge[k] : edge[k + 1]].tolist() == code.library.encode(t, add_special_tokens=False).ids, repr(t)
    r = random.Random(3)
    signs = "ab é\u0301 \n\t.,'1²日 ½  sS×—’\u3000\u2003\xa0Çß\x1c\r!"
    many = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    ids, size = code.encode(*string_bytes(pa.array(many)))
    edge = np.concatenate([[0], np.cumsum(size)])
    for k, t in enumerate(many):
        assert ids[edge[k] : edge[k + 1]].tolist() == code.library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n", [0, 1, 7, 1023, 1024, 1025, 30000])
def test_codec_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 65535, n), np.where(r.random(n) < 0.9, 5, r.integers(0, 400, n)), np.resize([3, 1, 4, 1, 5], n), r.zipf(1.3, n) % 50000):
        symbols = int(ids.max(initial=0)) + 1
        blocks, sums = mixcoder.encode(ids, symbols)
        assert (mixcoder.decode(blocks, sums, n, symbols) == ids).all()
        for k in range(0, len(blocks), 7):  # each block on its own, in another order
            part = ids[k * mixcoder.BLOCK : (k + 1) * mixcoder.BLOCK]
            assert (mixcoder.decode([blocks[k]], [sums[k]], len(part), symbols) == part).all()
    blocks, sums = mixcoder.encode(np.resize([3, 1, 4, 1, 5], n), 6)
    if n > 3000:
        assert len(blocks[0]) < 150  # a period of five ids is learnt
        for damaged in ([b[::-1] for b in blocks], [bytes(len(b)) for b in blocks], [b"\xff" * len(b) for b in blocks]):
            with pytest.raises(ValueError):
                mixcoder.decode(damaged, sums, n, 6)


def test_codec_learns_order_0():
    """Ids in no order at all: order 0 alone can tell the few from the many, in each block anew."""
    ids = np.random.default_rng(1).integers(0, 16, 8192) * 2999 + 7
    blocks, _ = mixcoder.encode(ids, 50000)
    assert sum(map(len, blocks)) < 0.75 * 8192  # 4 bits an id at best, 16 without learning


@pytest.mark.parametrize("bad", [70_000, 65_535, -1])
def test_ids_out_of_range(bad):
    with pytest.raises(ValueError):
        mixcoder.encode(np.array([1, bad]), 70_001)
    with pytest.raises(ValueError):
        mixcoder.check_ids(np.array([bad, 3]))


def _stored(files, rows, code):
    """The documents of the files, after a check that they follow each other, by id, without a gap."""
    got = sorted(files.read(keep_ids=True).collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        start += r.n_tokens
    order = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    want = Counter((i, tuple(code.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == want


def test_token_files(spark, monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    code = Encoder(path).library
    rows = [(k * 7 % 101, prose(k, k)) for k in range(101)] + ODD
    _stored(token_store.TokenFiles(frame(spark, rows), path, 2, range_bytes=4000), rows, code)
    hot = [(5, prose(30, k % 3)) for k in range(200)] + [(None, prose(9, 1))] * 60
    files = token_store.TokenFiles(frame(spark, hot), path, 2, range_bytes=2000)
    _stored(files, hot, code)
    sizes = [r.documents for r in files.manifest.collect()]
    assert len(sizes) > 5 and max(sizes) < 80  # one doc_id, many tasks
    names = {r.name for r in files.manifest.collect()}
    folder = Path(files.folder.removeprefix("file://"))
    (next(folder.iterdir()) / "stray.hmtoken").write_bytes(b"x")
    assert files.sweep() == 1 and {p.name for p in folder.rglob("*.hmtoken")} == names
    assert token_store.round_trip(frame(spark, []), path, 2).count() == 0


def test_token_files_of_a_long_range():
    """A task writes several shards where its range is long."""
    from tempfile import TemporaryDirectory

    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, None], pa.int64()), "text": ["one two", "", "three"]})

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 4

    with TemporaryDirectory() as d, pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_store, "TaskContext", Context)
        patch.setattr(token_store, "SHARD_IDS", 2)
        listed = [b.to_pydict() for b in token_store._write(iter([docs, docs]), f"file://{d}", vocabulary("word_bpe_49k.json"), 2)]
        assert [x["seq"][0] for x in listed] == list(range(len(listed))) and len(listed) == 2
        names = [x["name"][0] for x in listed]
        rows = pa.RecordBatch.from_pydict({"part": pa.array([4, 4], pa.int32()), "name": names, "before": pa.array([0, 7], pa.int64())})
        assert [x for b in token_store._read(iter([rows]), f"file://{d}", False) for x in b.column("doc_id").to_pylist()] == [1, 2, None] * 2


def test_packing(spark):
    rows = [(k, prose(k * 3 % 50, k)) for k in range(90)] + ODD + [(5000, prose(3000, 1))]
    path = vocabulary("byte_bpe_50k.json")
    code = Encoder(path).library
    got = packing.pack(frame(spark, rows).repartition(3), path, 0, 64, keep_ids=True).collect()
    pieces = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for p in pieces:
        assert p.sequence_id * 64 + p.offset == at and p.offset + p.length <= 64 and p.length > 0
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length
        at += p.length
    texts = Counter()
    docs, ids = [], []
    for p in pieces:
        if p.start == 0:
            ids = []
        assert len(ids) == p.start
        ids += np.frombuffer(bytes(p.ids), "<u4").tolist()
        if len(ids) == p.doc_tokens:
            docs.append((p.doc_id, tuple(ids)))
    for i, t in rows:
        texts[i, tuple(code.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    assert Counter(docs) == texts
    assert packing.pack(frame(spark, []), path).count() == 0


# op5


def test_top_k(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(700, 12)) / 3, 3)
    rows = [(k, [float(v) for v in x[k % 350]]) for k in range(700)] + [(1000, None), (1050, [1.0, None]), (1100, [math.nan] * 12), (1150, [math.inf] * 12), (1200, []), (None, [0.1] * 12), (1250, [9.0] * 12), (1300, [0.5, 0.5])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = impact_topk.top_k(vectors, F.col("id") % 50 == 0)
    live = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q, v in live:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in live if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert impact_topk.top_k(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def test_block_top_proof():
    r = np.random.default_rng(8)
    for scale in (3, 200, 100000):
        q, c = r.integers(-scale, scale, (20, 16)), r.integers(-scale, scale, (300, 16))
        c[50:] //= 7
        a, b, s = impact_topk.block_top(np.arange(20), q, np.arange(300), c, impact_topk.segments(c), 4)
        exact = q @ c.T
        exact[np.arange(20), np.arange(20)] = -(2**62)
        for k in range(20):
            want = sorted(zip(-exact[k], range(300)))[:4]
            assert [(-x, y) for x, y in zip(s[a == k], b[a == k])] == want


def test_segments_add_up():
    """Postings by falling impact: their sum and what is left make the rows again."""
    x = np.random.default_rng(4).integers(-5000, 5000, (90, 7))
    parts = impact_topk.segments(x)
    assert [p.impact for p in parts] == sorted((p.impact for p in parts), reverse=True)
    total = np.zeros(x.shape)
    for p in parts:
        np.add.at(total, (p.row, p.dim), p.sign * float(p.impact))
        assert np.allclose(p.norm, np.sqrt(((x - total) ** 2).sum(1)))


def test_top_k_ties_and_clashing_columns(spark):
    """Equal scores at rank k lie in several blocks; columns are named like the operator's own."""
    rows = [(k, [1.0, 0.5]) for k in range(3000)] + [(50, [1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "dim", "vec", "cb", "qb", "row", "score", "rank")})
    got = {}
    for r in impact_topk.top_k(vectors, F.col("id") % 50 == 0, query_block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(got) == 60
    for q, best in got.items():
        others = sorted([k for k in range(3000) if k != q][:5] + ([50, 50] if q != 50 else []))
        assert [v for _, v in sorted(best)] == others[:5]


def test_block_top_repeated_ids():
    """The stored index against all pairs: entries that the query's own id shares with others, repeated rows, zero vectors."""
    r = np.random.default_rng(5)
    c = r.integers(-40, 40, (1500, 8)).astype(np.int32)
    c[7] = 0
    ids = [[(int(i), int(n)) for i, n in zip(sorted(r.choice(60, 1 + k % 3, replace=False)), r.integers(1, 4, 3))] for k in range(1500)]
    table = pa.table({"dim": pa.array([8] * 1500, pa.int32()), "cb": pa.array([0] * 1500, pa.int32()), "vec": pa.array(c.tolist(), pa.list_(pa.int32())), "ids": pa.array([[{"id": i, "n": n} for i, n in x] for x in ids], pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int32())])))})
    q = r.integers(-40, 40, (60, 8)).astype(np.int32)
    asked = impact_topk._packed(pa.table({"dim": pa.array([8] * 60, pa.int32()), "qb": pa.array([0] * 60, pa.int32()), "id": pa.array(range(60), pa.int64()), "vec": pa.array(q.tolist(), pa.list_(pa.int32()))}))
    got = impact_topk._search(impact_topk._index(table), asked, 4).to_pylist()
    score = q.astype(np.int64) @ c.T
    for k in range(60):
        rows = sorted((-int(score[k, e]), i) for e, x in enumerate(ids) for i, n in x for _ in range(n) if i != k)[:4]
        assert [(-x["score"], x["vec_id"]) for x in got if x["query_id"] == k] == rows


def test_top_k_equal_vectors_are_one_entry(spark, monkeypatch):
    """Copies are indexed once: 20,000 rows with four vectors make one block of four entries."""
    seen = spark.sparkContext.accumulator(0)
    index = impact_topk._index
    monkeypatch.setattr(impact_topk, "_index", lambda t: (seen.add(t.num_rows), index(t))[1])
    vectors = spark.range(20000).selectExpr("id AS vec_id", "array(cast(id % 4 as float), 1.0f) AS embedding")
    got = impact_topk.top_k(vectors, F.col("id") % 5000 == 0).collect()
    want = [(q, k + 1, i) for q in range(0, 20000, 5000) for k, i in enumerate([i for i in range(6) if i != q][:5])]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == want
    assert seen.value == 4


# op6


def sphere_brute(rows, threshold=0.93):
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {k: np.float64(np.float32(rows[k][1])) / np.linalg.norm(np.float64(np.float32(rows[k][1]))) for k in good}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for n, a in enumerate(good):
        for b in good[:n]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = least.get(find(k))
        out.append((i, links[k], c, i is None or i == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_rows", [2048, 40])
def test_sphere(spark, cell_rows):
    r = np.random.default_rng(5)
    rows = []
    for k in range(120):
        base = r.normal(size=24)
        for j in range(r.integers(1, 6)):
            v = base / np.linalg.norm(base) + r.normal(size=24) * 0.055 * j
            rows.append((len(rows) * 17 % 4099, [float(x) for x in v], int(k % 2)))
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [math.nan] * 24, 0), (5003, [None] + [1.0] * 23, 0), (5004, rows[0][1], None), (None, rows[0][1], 0), (5005, [1.0, 2.0], 0), (5006, [1.0, 2.0], 0), (5006, [2.0, 4.0], 0), (5007, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sphere_dedup.near_duplicates(vectors, block=32, cell_rows=cell_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sphere_brute(rows)
    assert sphere_dedup.near_duplicates(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "double"])
def test_sphere_extremes(spark, kind):
    """Vectors of any magnitude, labels of any type, and a vector that most rows share."""
    name = {"string": ["a", "b"], "double": [1.2, 1.7]}[kind]
    rows = [(k, [1.0 + k % 3 / 1000, 2.0, 3.0], name[0]) for k in range(300)]
    rows += [(1000, [1e200, 2e200, 3e200], name[0]), (1001, [1e-170, 2e-170, 3e-170], name[0]), (1002, [5e-324, 1e-323, 1.5e-323], name[0]), (1003, [1e308, -1e308, 0.0], name[0])]
    rows += [(2000, [1.0, 2.0, 3.0], name[1]), (2001, [-0.0, 1.0, 0.0], name[1]), (2002, [0.0, 1.0, 0.0], name[1])]
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").withColumns({c: F.lit(1) for c in ("row", "h", "weight", "cell", "id", "dim")})
    got = {r.vec_id: r for r in sphere_dedup.near_duplicates(vectors, block=32).collect()}
    assert len(got) == len(rows)
    assert all((got[k].n_links, got[k].component_id) == (302, 0) for k in [*range(300), 1000, 1001, 1002])
    assert (got[1003].n_links, got[1003].component_id) == (0, 1003)
    assert [(got[k].n_links, got[k].component_id, got[k].kept) for k in (2000, 2001, 2002)] == [(0, 2000, True), (1, 2001, True), (1, 2001, False)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(1, 300)] + [(7, 7)]
    got = dict(map(tuple, components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()))
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    assert got == want


# op8, op9: held-out accuracy


def labelled(spark, n=900):
    r, rows, labels = random.Random(9), [], []
    for k in range(n):
        text, toxic, good = prose(r.randint(15, 90), k), r.random() < 0.25, r.random() < 0.7
        if toxic:
            words = text.split(" ")
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["vilexa", "VileXo,", "vilexum", "zgrubbed"]))
            text = " ".join(words)
        if not good:
            text = r.choice([" ".join(w + "%%%" for w in text.split()), text.replace(" ", " | "), text.upper().replace(" ", "!! ")])
        rows.append((k, text))
        labels.append((k, int(good), int(toxic)))
    extra = [(k, None, None) for k in (5, 6)] + [(None, 1, 1), (3, labels[3][1], labels[3][2])]
    return rows, {k: (q, t) for k, q, t in labels}, spark.createDataFrame(labels[:700] + extra, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    rows, truth, labels = labelled(spark)
    got = chains.predict_toxicity(frame(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [(r.toxic, truth[r.doc_id][1]) for r in got if r.doc_id in truth and r.doc_id >= 700]
    assert sum(a == bool(b) for a, b in held) / len(held) > 0.97
    assert all(0 <= r.p_dense <= 1 for r in got) and not any(r.toxic for r in got if r.doc_id is None or r.doc_id >= 900)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert chains.predict_toxicity(frame(spark, rows[:9]), some).where("toxic").count() == 0
    assert chains.predict_toxicity(frame(spark, []), labels).count() == 0


def test_quality(spark):
    rows, truth, labels = labelled(spark)
    got = quality.score_documents(frame(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [(r.predicted, truth[r.doc_id][0]) for r in got if r.doc_id in truth and r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.score for r in quality.score_documents(frame(spark, rows[:5]), labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(frame(spark, []), labels).count() == 0


def real(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")


def log_loss(p, y):
    p = np.clip(np.asarray(p), 1e-9, 1 - 1e-9)
    return -np.mean(np.where(np.asarray(y) > 0, np.log(p), np.log(1 - p)))


def test_toxicity_of_a_real_table(spark):
    """Labels of even ids teach, labels of odd ids judge; the chain does better than its last member alone."""
    docs, labels = real(spark, "documents").select("doc_id", "text").withColumn("p_toxic", F.lit("mine")), real(spark, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    loss = {}
    for chain in (True, False):
        model = chains.ToxicityModel(docs, labels.where("doc_id % 2 = 0"), chain=chain)
        got = [(r.p_toxic, truth[r.doc_id]) for r in model.score(docs).where("doc_id % 2 = 1").select("doc_id", "p_toxic").collect() if r.doc_id in truth]
        assert np.mean([(p >= 0.5) == bool(y) for p, y in got]) > 0.98
        loss[chain] = log_loss(*zip(*got))
    assert loss[True] < loss[False]


def test_quality_of_a_real_table(spark):
    """Accuracy on rows that are never learnt from, and what the word vectors and the other features do alone."""
    docs, labels = real(spark, "documents").select("doc_id", "text").withColumn("score", F.lit("mine")), real(spark, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    loss = {}
    for name, use in (("all", slice(None)), ("vectors", slice(0, quality.DIMENSIONS)), ("others", slice(quality.DIMENSIONS, None))):
        model = quality.QualityModel(docs, labels, use=use)
        got = [(r.score, truth[r.doc_id]) for r in model.score(docs).where(quality.held_out()).select("doc_id", "score").collect() if r.doc_id in truth]
        assert np.mean([(p >= 0.7) == bool(y) for p, y in got]) > 0.96
        loss[name] = log_loss(*zip(*got))
    assert loss["all"] < min(loss["vectors"], loss["others"])


# op10


def shingle_weights(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\t-\r ]+", (t or "").lower()) if x]
        s = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets.append(s)
    df = Counter(x for s in sets for x in s)
    n = len(rows)
    return [{x: c * (1 + 0.25 * math.log(n / df[x]) / math.log(n)) for x, c in s.items()} for s in sets]


def jaccard(a, b):
    low = sum(min(v, b[x]) for x, v in a.items() if x in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


def near_rows(seed=2):
    r, rows = random.Random(seed), []
    for k in range(50):
        base = prose(r.randint(30, 200), k).split(" ")
        for _ in range(r.choice([1, 1, 2, 4])):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((len(rows) * 13 % 997, " ".join(words)))
    return rows + [(2000, rows[0][1]), (2001, rows[0][1].upper()), (2002, "a b a b " * 40), (2003, "a b a b " * 41), (2004, "x y"), (2005, "X  y")] + ODD


@pytest.mark.parametrize("size", [3000, 12 << 20])
def test_near_duplicates(spark, size):
    rows = near_rows()
    weights = shingle_weights(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(weights[a], weights[b]) >= 0.8:
                root[find(a)] = find(b)
    found = icws.NearDuplicates(frame(spark, rows), batch_bytes=size, block=1 if size < 4000 else 4)
    by_text = {}
    got = found.with_documents("text").collect()
    for r in got:
        by_text.setdefault(r.class_row, []).append((r.doc_id, r.text))
    want = {}
    for k, (i, t) in enumerate(rows):
        want.setdefault(find(k), []).append((i, t or ""))
    key = lambda groups: sorted(sorted(map(str, g)) for g in groups.values())
    assert key(by_text) == key(want)


def test_near_duplicates_frame(spark):
    rows = near_rows()
    got = icws.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.class_id is None or r.doc_id is None or r.class_id <= r.doc_id for r in got)
    kept = icws.one_of_each(frame(spark, rows), ["doc_id", "text", "lang", "source", "n_chars"])
    assert kept.count() == sum(r.kept for r in got) and kept.where("text is null").count() == 1
    assert icws.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_a_real_table(spark):
    """Recall and precision against all pairs of different texts, compared by the formula itself."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    words = lambda t: tuple(x for x in re.split(r"[\t-\r ]+", (t or "").lower()) if x)
    distinct = {}
    for i, t in rows:
        distinct.setdefault(words(t), []).append(i)
    weights = dict(zip([r[0] for r in rows], shingle_weights(rows)))
    heads = [ids[0] for w, ids in distinct.items() if w]
    holders = {}
    for i in heads:
        for x in weights[i]:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for n, b in enumerate(ids) for a in ids[:n]}
    links = {p for p in pairs if jaccard(weights[p[0]], weights[p[1]]) >= 0.8}
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(docs).collect()}
    assert len(links) > 3 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(len({got[i] for i in ids}) == 1 for w, ids in distinct.items() if w)
    root = {i: i for i in heads}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    classes = {}
    for i in heads:
        classes.setdefault(got[i], set()).add(find(i))
    assert all(len(c) == 1 for c in classes.values())  # no class joins what the formula keeps apart


def test_groups_are_bounded_by_shingles(spark):
    """A hot group of long near copies: the same classes when a block holds one text's shingles only."""
    base = prose(400, 1).split(" ")
    rows = [(k, " ".join([*base[: 7 * k], "changed", *base[7 * k + 1 :]])) for k in range(40)] + [(100, prose(400, 2))]
    found = icws.NearDuplicates(frame(spark, rows), block_shingles=500)
    classes = Counter(r.class_row for r in found.classes.collect())
    assert sorted(classes.values()) == [1, 40]
    found.close()


def test_weighted_samples_follow_similarity():
    r = np.random.default_rng(3)
    prints = np.sort(r.integers(0, 2**48, 800).astype(np.uint64))
    weights = r.random(800) + 0.5
    other = np.where(r.random(800) < 0.2, weights * 2, weights)
    a = icws.weighted_samples(prints, weights, np.array([0, 800]), 600)
    b = icws.weighted_samples(prints, other, np.array([0, 800]), 600)
    want = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    assert abs((a == b).mean() - want) < 0.06


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "repeated_passages", "packing"]
    rows, truth, labels = labelled(spark, 400)
    rows += [(k + 5000, rows[k][1]) for k in range(20)]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, rows).drop("batch", "row").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        docs = Workspace(spark, "t").save(out, name)
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        if name == "toxicity":
            assert sum(truth[i % 5000][1] for i in after) <= 3 and len(after) > 0.6 * len(before)
        if name == "near_duplicates":
            assert not [i for i in after if i >= 5000]
    total = p.run(spark, str(tmp_path)).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total[1] == docs.count()
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts and repeated rows go through every stage."""
    import corpus_pipeline as p

    rows, _, labels = labelled(spark, 120)
    rows += ODD + [(None, None), (None, ""), (7, rows[7][1]), (7, "another text with the id of a labelled one")]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, rows).withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = p.run(spark, str(tmp_path)).collect()
    assert pieces and all(r.length > 0 for r in pieces)
    assert sum(r.start == 0 for r in pieces) == len({(r.doc_id, r.sequence_id, r.offset) for r in pieces if r.start == 0})


def test_nothing_else_imports_llm():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{top}/harfmill"):
        if not folder.startswith(f"{top}/harfmill/llm"):
            for name in names:
                if name.endswith(".py"):
                    assert "llm" not in open(f"{folder}/{name}").read(), name
