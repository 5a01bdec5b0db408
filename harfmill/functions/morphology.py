"""Roots, patterns, clitics and token alignment as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harfmill.functions.arabic import MARKS, SPECIAL_TOKENS, clean_token, strip_marks
from harfmill.functions.scoring import let

# Clitic surfaces, and the tags that stand for them.
PROCLITICS = ["أ", "و", "ف", "ب", "ك", "ل", "س", "ت", "ال", "لا", "ما"]
ENCLITICS = ["ي", "ك", "ه", "ها", "نا", "كم", "كن", "هم", "هن", "كما", "هما"]
PROCLITIC_TAGS = {
    "أ": "AAA_quest Aa_quest", "و": "wa_conj wa_part wa_prep wa_sub", "ف": "fa_conj fa_rc fa_conn fa_sub fa_part", "ب": "bi_prep bi_part", "ك": "ka_prep",
    "ل": "li_prep li_jus li_sub", "س": "sa_fut", "ت": "ta_prep", "ال": "Al_det", "لا": "lA_neg", "ما": "mA_neg mA_part mA_rel ma_rel",
}
ENCLITIC_PERSONS = dict(zip("1s 2ms 2fs 3ms 3fs 1p 2mp 2fp 3mp 3fp 2d 3d".split(), ["ي", "ك", "ك", "ه", "ها", "نا", "كم", "كن", "هم", "هن", "كما", "هما"], strict=True))
ENCLITIC_FORMS = ("dobj", "poss", "pron")

#: One conjunction, one preposition or future sign, the article, a stem of three signs or more, one enclitic.
SEGMENTS = "^(و|ف)?(ب|ك|ل|س)?(ال)?(.{3,}?)(كما|هما|ها|نا|كم|كن|هم|هن|ي|ك|ه)?$"


def clitic_surfaces() -> dict[str, str]:
    """Tag to surface."""
    table = {tag: surface for surface, tags in PROCLITIC_TAGS.items() for tag in tags.split()}
    return table | {f"{p}_{f}": s for p, s in ENCLITIC_PERSONS.items() for f in ENCLITIC_FORMS}


def clitic_surface(tag: Column) -> Column:
    """The surface of a tag; an unknown tag stays as it is, an empty marker becomes null."""
    known = F.create_map(*[F.lit(x) for pair in clitic_surfaces().items() for x in pair])
    tag = F.when(~tag.isin("", "0", "na"), tag)
    return F.coalesce(F.try_element_at(known, tag), tag)


def segment(word: Column) -> Column:
    """Morphemes by rule; a word without a stem of three signs is one morpheme."""
    bare = strip_marks(word)
    parts = F.filter(F.array(*[F.regexp_extract(bare, SEGMENTS, k) for k in range(1, 6)]), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).when(bare != "", F.array(bare))


def has_subsequence(text: Column, root: Column) -> Column:
    """Whether all letters of root occur in text in order; an empty root does."""
    letters = lambda r: F.aggregate(F.split(text, ""), F.lit(0), lambda k, ch: F.when((ch != "") & (ch == F.substring(r, k + 1, F.lit(1))), k + 1).otherwise(k)) == F.length(r)
    return let(root, letters)


_SEATS = {3: "فعل", 4: "فعلل"}


def _seated(text: Column, root: Column, whole: bool) -> Column:
    """By one match: the nearest letters of a root of three or four, in order, become the pattern's seats."""

    def over(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for n, seats in _SEATS.items():
            letter = [F.concat(F.lit("\\Q"), F.substring(v["r"], k, F.lit(1)), F.lit("\\E")) for k in range(1, n + 1)]
            parts = [F.lit("(?s)^(.*?)" if whole else "(?s)^.*?"), letter[0]]
            for one in letter[1:]:
                parts += [F.lit("(.*?)"), one]
            match = F.concat(*parts, F.lit("(.*)$" if whole else ".*$"))
            groups = iter(range(1, n + 2))
            kept = (f"${next(groups)}" if whole else "") + "".join(seat + (f"${next(groups)}" if k < n - 1 or whole else "") for k, seat in enumerate(seats))
            out = F.when((F.length(v["r"]) == n) & F.regexp_like(v["t"], match), F.regexp_replace(v["t"], match, F.lit(kept))).otherwise(out)
        return out

    return let(F.struct(strip_marks(text).alias("t"), root.alias("r")), over)


def _seated_fold(text: Column, root: Column, whole: bool) -> Column:
    """The same for a root of any length, letter by letter; seats beyond the third letter are empty."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def over(v: Column) -> Column:
        r = v["r"]

        def step(acc: Column, ch: Column) -> Column:
            hit = (ch != "") & (ch == F.substring(r, acc["k"] + 1, F.lit(1)))
            kept = F.lit(True) if whole else (acc["k"] > 0) & (acc["k"] < F.length(r))
            seat = F.concat(acc["out"], F.substring(F.lit(_SEATS[3]), acc["k"] + 1, F.lit(1)))
            return F.struct(F.when(hit, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.when(hit, seat).when(kept, F.concat(acc["out"], ch)).otherwise(acc["out"]).alias("out"))

        done = F.aggregate(F.split(strip_marks(v["t"]), ""), start, step)
        return let(done, lambda d: F.when((v["t"] != "") & (r != "") & (d["k"] == F.length(r)), d["out"]))

    return let(F.struct(text.alias("t"), root.alias("r")), over)


def pattern(text: Column, root: Column) -> Column:
    """text with the root's letters replaced, in order, by the pattern letters; null if they are not all there."""
    return F.when(F.length(root).isin(3, 4), _seated(text, root, True)).otherwise(_seated_fold(text, root, True))


def stem_span(text: Column, root: Column) -> Column:
    """The pattern of the shortest greedy stretch of text from the first to the last root letter."""
    return F.when(F.length(root).isin(3, 4), _seated(text, root, False)).otherwise(_seated_fold(text, root, False))


def fill_pattern(pat: Column, root: Column) -> Column:
    """Digits 1 to 4 of a pattern become the root's letters; digits beyond the root go."""
    seat = lambda k: F.substring(root, F.lit(k), F.lit(1))
    for k in range(1, 5):
        pat = F.replace(pat, F.lit(str(k)), seat(k))
    return F.coalesce(pat, F.lit(""))


def boundaries(pieces: Column) -> Column:
    """End offsets of pieces, but the last one's."""
    sizes = F.transform(pieces, F.length)
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, n: a + n))
    return F.when(F.size(pieces) > 1, F.slice(ends, F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))


def clitic_boundaries(morphemes: Column) -> Column:
    """Offsets at which clitics end or begin: proclitics from the left, enclitics from the right, up to the first other morpheme."""
    bare = F.transform(morphemes, strip_marks)
    n = F.size(bare)
    sizes = F.transform(bare, F.length)
    offset = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x)
    left = F.aggregate(F.slice(bare, F.lit(1), n - 1), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")), lambda a, m: F.struct(F.when(a["go"] & m.isin(PROCLITICS), a["k"] + 1).otherwise(a["k"]).alias("k"), (a["go"] & m.isin(PROCLITICS)).alias("go")))["k"]
    right = F.aggregate(F.reverse(F.slice(bare, F.lit(2), n - 1)), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")), lambda a, m: F.struct(F.when(a["go"] & m.isin(ENCLITICS), a["k"] + 1).otherwise(a["k"]).alias("k"), (a["go"] & m.isin(ENCLITICS)).alias("go")))["k"]
    none = F.array().cast("array<int>")
    first = F.when(left > 0, F.transform(F.sequence(F.lit(1), F.greatest(left, F.lit(1))), offset)).otherwise(none)
    last = F.when(right > 0, F.transform(F.sequence(n - F.greatest(right, F.lit(1)), n - 1), offset)).otherwise(none)
    return F.when(n >= 2, F.array_sort(F.array_union(first, last))).otherwise(none)


def token_boundaries(tokens: Column, word: Column) -> Column:
    """Ends of the cleaned tokens but the last; null unless they tile the word exactly."""
    clean = F.transform(F.filter(tokens, lambda t: ~t.isin(SPECIAL_TOKENS)), clean_token)
    return F.when((F.size(clean) > 0) & (F.array_join(clean, "") == strip_marks(word)), boundaries(clean))


def word_record(word: Column, tokens: Column, morphemes: Column) -> Column:
    """integrity, csa_respected, csa_total, morpheme_count, raw_token_count of a word; null without morphemes."""
    parts = F.struct(token_boundaries(tokens, word).alias("ends"), boundaries(F.transform(morphemes, strip_marks)).alias("inner"), clitic_boundaries(morphemes).alias("clitics"))

    def over(v: Column) -> Column:
        ends, inner, clitics = v["ends"], v["inner"], v["clitics"]
        respected = lambda b: F.size(F.filter(b, lambda x: F.array_contains(ends, x)))
        return F.struct(
            F.when((F.size(inner) > 0) & ends.isNotNull(), respected(inner).cast("double") / F.size(inner)).alias("integrity"),
            F.when((F.size(clitics) > 0) & ends.isNotNull(), respected(clitics)).cast("long").alias("csa_respected"),
            F.when((F.size(clitics) > 0) & ends.isNotNull(), F.size(clitics)).cast("long").alias("csa_total"),
            F.size(morphemes).cast("long").alias("morpheme_count"),
            F.size(F.filter(tokens, lambda t: ~t.isin(SPECIAL_TOKENS))).cast("long").alias("raw_token_count"),
        )

    return F.when(F.size(morphemes) > 0, let(parts, over))


def strip_proclitic(word: Column, clitic: str) -> Column:
    """A clitic taken off the start, through marks between its letters and around it; no match: unchanged."""
    marks = f"[{MARKS}]*"
    return F.regexp_replace(word, "^" + marks + marks.join(clitic) + marks, "")


def strip_enclitic(word: Column, clitic: str) -> Column:
    marks = f"[{MARKS}]*"
    return F.regexp_replace(word, marks + marks.join(clitic) + marks + "$", "")


def normalize_pattern(pat: Column, proclitics: list[str], enclitic: str | None) -> Column:
    """A pattern without its clitics: proclitics from the outermost in, then the enclitic."""
    for c in proclitics:
        pat = strip_proclitic(pat, c)
    return strip_enclitic(pat, enclitic) if enclitic else pat


def strip_clitics(word: Column, proclitics: list[str], enclitics: list[str]) -> Column:
    """A surface without its clitics: proclitics from the outermost in, then enclitics, each only if it is there."""
    for c in proclitics:
        word = strip_proclitic(word, c)
    for c in enclitics:
        word = strip_enclitic(word, c)
    return word


def accepted(root: Column, pat: Column) -> Column:
    """The root of an analysis that counts: without separators, three letters or more, not the no-root mark; else null."""
    bare = F.regexp_replace(root, "[_.#]", "")
    pat = F.coalesce(pat, F.lit(""))
    return F.when((pat != "") & ~F.contains(pat, F.lit("NTWS")) & (F.length(bare) >= 3) & (bare != "NTWS"), bare)


def first_accepted(candidates: Column) -> Column:
    """The first acceptable one of an array of (root, pattern) structs, with its root cleaned."""
    good = F.filter(candidates, lambda c: accepted(c["root"], c["pattern"]).isNotNull())
    return F.transform(F.slice(good, 1, 1), lambda c: F.struct(accepted(c["root"], c["pattern"]).alias("root"), c["pattern"].alias("pattern")))[0]


def accepted_analysis(root: Column, pat: Column, tags: list[Column], stem: Column) -> Column:
    """A backend's analysis as it counts, or null: root, pattern without clitics, clitic surfaces, and the stem.

    tags: four proclitic tags from the outermost in, and the enclitic's.  A
    missing stem is the pattern filled with the root's letters.
    """
    surfaces = [clitic_surface(t) for t in tags]
    bare = pat
    for c in surfaces[:-1]:
        bare = F.when(c.isNotNull(), _without(bare, c, True)).otherwise(bare)
    bare = F.when(surfaces[-1].isNotNull(), _without(bare, surfaces[-1], False)).otherwise(bare)
    good = accepted(root, pat)
    filled = F.coalesce(F.nullif(stem, F.lit("")), fill_pattern(bare, good))
    fields = [good.alias("root"), bare.alias("pattern"), F.filter(F.array(*surfaces[:-1]), lambda c: c.isNotNull()).alias("proclitics"), surfaces[-1].alias("enclitic"), filled.alias("stem")]
    return F.when(good.isNotNull(), F.struct(*fields))


def _without(text: Column, clitic: Column, start: bool) -> Column:
    """A clitic that is a column, taken off the start or end, through marks between its letters and around it."""
    marks = f"[{MARKS}]*"
    letters = F.array_join(F.filter(F.split(clitic, ""), lambda ch: ch != ""), marks)
    match = F.concat(F.lit(("^" if start else "") + marks), letters, F.lit(marks + ("" if start else "$")))
    return F.regexp_replace(text, match, F.lit(""))


def reconstruct(lookup: Column, generated: Column, pat: Column, root: Column) -> Column:
    """A stem's surface: the one seen in the corpus, else the generator's, else the pattern filled, else the root; marks go."""
    kept = lambda c: F.nullif(strip_marks(c), F.lit(""))
    return F.coalesce(F.nullif(lookup, F.lit("")), kept(generated), kept(fill_pattern(pat, root)), root)


def generated_surface(filled: Column, candidates: Column) -> Column:
    """A generator's answer: the stem of the analysis of the filled pattern that has its root and pattern, else the filled pattern.

    candidates: array of (root, pattern, stem, wanted), `wanted` whether root and pattern are those that were asked for.
    """
    hits = F.filter(candidates, lambda c: c["wanted"] & (F.coalesce(c["stem"], F.lit("")) != ""))
    return F.coalesce(F.try_element_at(F.transform(hits, lambda c: c["stem"]), F.lit(1)), filled)
