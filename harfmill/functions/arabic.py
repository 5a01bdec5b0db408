"""Arabic text as Column expressions: character classes, cleaning, words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from harfmill.functions.scoring import let

# The character classes.
#: Marks that token and word cleaning drops.
MARKS = "ًٌٍَُِّْٰٕٓٔ"
#: Marks that corpus normalisation and answer normalisation drop (another set).
NORMAL_MARKS = "[ؗ-ًؚ-ْٰ]"
ALEF_VARIANTS, ALEF = "آأإٱ", "ا"
TATWEEL = "ـ"
#: Letters as the inside of a regular-expression class; without U+0649 and tatweel.
LETTERS = "ء-غف-وي"
LONG_VOWELS = "اوي"
LATIN = "[A-Za-zÀ-ɏḀ-ỿⱠ-Ɀ꜠-ꟿꬰ-꭯]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~،؛؟«»…—–ـ"
DIGITS = "0-9٠-٩"
# The Latin letters that row filters look for, signs that count as punctuation, digits, and special tokens.
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>", "<mask>", "<bow>", "<eow>"]
#: The stand-in alphabet: Latin prose becomes Arabic-script text of the same shape.
ARABIZE_FROM, ARABIZE_TO = "abcdefghijklmnopqrstuvwxyz", "ابتجدهوزحطيكلمنسعفصقرشتثخذ"


def strip_marks(c: Column) -> Column:
    return F.translate(c, MARKS, "")


def normalize(c: Column, marks: bool = False, alef: bool = True, tatweel: bool = True) -> Column:
    """Corpus normalisation without NFKC, for which Spark has no built-in (see `nfkc`)."""
    if marks:
        c = F.regexp_replace(c, NORMAL_MARKS, "")
    if alef:
        c = F.translate(c, ALEF_VARIANTS, ALEF * 4)
    if tatweel:
        c = F.translate(c, TATWEEL, "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def nfkc(c: Column) -> Column:
    """Unicode NFKC; an Arrow batch at a time."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def has_latin(c: Column) -> Column:
    """Whether a string holds a Latin letter; null and empty: false."""
    return F.coalesce(c.rlike(LATIN), F.lit(False))


def words(c: Column) -> Column:
    """Split at Unicode white space, without empty pieces."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{LETTERS}]", "")


def skeleton(c: Column) -> Column:
    """Consonants: letters without long vowels."""
    return F.regexp_replace(F.regexp_replace(c, f"[^{LETTERS}]", ""), f"[{LONG_VOWELS}]", "")


def root_of_skeleton(c: Column) -> Column:
    """Three or four consonants are the root, of more the first three; fewer: null."""
    return let(skeleton(c), lambda s: F.when(F.length(s) > 4, F.substring(s, 1, 3)).when(F.length(s) >= 3, s))


def arabize(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), ARABIZE_FROM, ARABIZE_TO), rf"[^{LETTERS}\s]", "")


def arabic_only(c: Column) -> Column:
    """Arabic letters and their marks, without anything else."""
    return F.regexp_replace(c, f"[^{LETTERS}{MARKS}]", "")


def clean_token(c: Column) -> Column:
    """A token string as Arabic letters only: byte-level forms are read as text, word-piece markers and marks go."""
    c = decode_byte_level(c)
    c = F.regexp_replace(c, "^##", "")
    c = F.regexp_replace(c, "^▁", "")
    c = F.regexp_replace(c, "^Ġ", "")
    return letters_only(strip_marks(c))


def content_tokens(tokens: Column) -> Column:
    """Cleaned tokens without special and empty ones."""
    kept = F.filter(tokens, lambda t: ~t.isin(SPECIAL_TOKENS))
    return F.filter(F.transform(kept, clean_token), lambda t: t != "")


def character_class(ch: Column) -> Column:
    """alpha, digit, punct, space or other, in that order of precedence."""
    punct = "".join("\\" + p if p in "[]\\^-&" else p for p in PUNCTUATION)
    return (
        F.when(ch.rlike(f"^[{LETTERS}{MARKS}]$"), "alpha")
        .when(ch.rlike(f"^[{DIGITS}]$"), "digit")
        .when(ch.rlike(f"^[{punct}]$"), "punct")
        .when(ch.rlike(r"^(?U)\s$"), "space")
        .otherwise("other")
    )


def alpha_chunks(c: Column) -> Column:
    """Maximal runs of Arabic letters and marks."""
    return F.regexp_extract_all(c, F.lit(f"([{LETTERS}{MARKS}]+)"))


def normalize_answer(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(?U)\s+", " "), NORMAL_MARKS, "")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet's characters and their bytes: printable Latin-1 stands for itself, the rest moves above U+00FF."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    table = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            table[chr(256 + len(table) - len(shown))] = b
    return table


_SHOWN = {b: ch for ch, b in byte_alphabet().items()}
_MOVED = [b for b in range(256) if ord(_SHOWN[b]) != b]
_ALPHABET = "^[" + "".join("\\" + ch if ch in "[]\\^-&" else ch for ch in _SHOWN.values()) + "]+$"


def encode_byte_level(c: Column) -> Column:
    """A string with each of its UTF-8 bytes as its sign of the byte-level alphabet."""
    latin = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, _MOVED)), "".join(_SHOWN[b] for b in _MOVED))


def decode_byte_level(c: Column) -> Column:
    """A byte-level token as text; a token that holds other signs or no valid UTF-8 stays as it is."""
    held = F.when(c.rlike(_ALPHABET), c)
    # translate() takes a sign without a counterpart out, so byte 0 is put in as hexadecimal digits.
    latin = lambda part: F.translate(part, "".join(_SHOWN[b] for b in _MOVED if b), "".join(chr(b) for b in _MOVED if b))
    digits = F.array_join(F.transform(F.split(held, _SHOWN[0], -1), lambda part: F.hex(F.encode(latin(part), "ISO-8859-1"))), "00")
    return F.coalesce(F.try_validate_utf8(F.unhex(digits).cast("string")), c)
