"""Text forms, folds, keys and slugs, as functions from columns to columns.

One definition serves both stored tokens and query literals.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code-point ranges and letter tables.
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ]"
RECITATION = "[ؐ-ؚۖ-ۭ]"
MARKS_ONLY = "^[ۖ-ۭ٠-٩۰-۹]+$"
TATWEEL = "ـ"
ALEF_FORMS, ALEF = "آأإٱ", "ا"
#: Root letters and their slug codes.
SLUG_CODES = {
    "ا": "a", "أ": "e", "ؤ": "o", "ء": "c", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "hh", "خ": "kh",
    "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "sd", "ض": "dd", "ط": "tt", "ظ": "zh",
    "ع": "aa", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y",
}
#: Letters and their romanisation.
LATIN = {
    "ء": "ʾ", "ا": "ā", "ب": "b", "ت": "t", "ث": "ṯ", "ج": "ǧ", "ح": "ḥ", "خ": "ḫ", "د": "d", "ذ": "ḏ", "ر": "r",
    "ز": "z", "س": "s", "ش": "š", "ص": "ṣ", "ض": "ḍ", "ط": "ṭ", "ظ": "ẓ", "ع": "ʿ", "غ": "ġ", "ف": "f", "ق": "q",
    "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y",
}
HAMZA_SEATS = {"أ": "ʾ", "إ": "ʾ", "ؤ": "ʾ", "ئ": "ʾ", "ٱ": ""}
VOWELS = {"َ": "a", "ِ": "i", "ُ": "u", "ً": "an", "ٍ": "in", "ٌ": "un", "ٰ": "ā", "ى": "ā", "ة": "a", " ": " "}
SHADDA = "ّ"
#: Keys of transliterated lexica and the letters they stand for.
KEYBOARD = "'|>&<}AbptvjHxd*rzs$SDTZEgfqklmnhwyY{aiuo~FNK`_"
KEYBOARD_LETTERS = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهويىٱًٌٍَُِّْٰـ"
RADICALS = "[^ابتثجحخدذرزسشصضطظعغفقكلمنهويىءأؤإئآٱة]"
#: Function words that are left out before translations are compared.
STOP_WORDS = (
    "the a an and or of to in on for with is are am be been being was were as by that this these those it its his her their they them he she we you your yours "
    "ye thy thee thou thine hath doth hast art shall will would then than so if when who whom which what all any some more most such no nor not but from at "
    "into unto o our my me us him lo yea verily indeed there here where whose upon have has had do did done shall should may might can could out up down over "
    "about also very just only own same too now"
).split()
SUFFIXES = ["eth", "est", "ing", "edly", "ed", "es", "s"]


def strip_tashkeel(c: Column) -> Column:
    """Without vowel and recitation marks."""
    return F.regexp_replace(c, DIACRITICS, "")


def normalise(c: Column) -> Column:
    """Without marks and tatweel; alef variants, teh marbuta and alef maksura unified."""
    return F.translate(F.translate(strip_tashkeel(c), TATWEEL, ""), ALEF_FORMS + "ةى", ALEF * 4 + "هي")


def to_simple(c: Column) -> Column:
    """Without recitation marks and tatweel, alef wasla as alef; vowels stay."""
    return F.translate(F.regexp_replace(c, RECITATION, ""), "ٱ" + TATWEEL, ALEF)


def is_mark_run(c: Column) -> Column:
    """Whether a piece has nothing but marks and so is no token."""
    return c.rlike(MARKS_ONLY)


def fold(c: Column) -> Column:
    """For comparing editions: no marks, tatweel, spaces or hamza; eight letters unified."""
    return F.translate(strip_tashkeel(c), ALEF_FORMS + "ةىؤئ" + TATWEEL + " ء", ALEF * 4 + "هيوي")


def fold_further(c: Column) -> Column:
    """fold, after alef maksura and dagger alef are dropped."""
    return fold(F.translate(c, "ىٰ", ""))


def folds_of(text: str) -> tuple[str, str]:
    """fold and fold_further of one text, for rules that go through words in order."""
    plain = str.maketrans(ALEF_FORMS + "ةىؤئ", ALEF * 4 + "هيوي", TATWEEL + " ء")
    one, two = (re.sub(DIACRITICS, "", t).translate(plain) for t in (text, re.sub("[ىٰ]", "", text)))
    return one, two


def _by_value(c: Column, fn: Callable[[str], str | None]) -> Column:
    """A vectorised function of strings; null gives null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else fn(x))

    return F.pandas_udf(run, T.StringType(), F.PandasUDFType.SCALAR)(c)


def nfc(c: Column) -> Column:
    """Canonical composition; apply it to distinct forms."""
    return _by_value(c, lambda x: unicodedata.normalize("NFC", x))


def spaced_root(c: Column) -> Column:
    """A root's letters with a space between each two."""
    return F.array_join(F.filter(F.split(F.regexp_replace(c, r"\s", ""), ""), lambda x: x != ""), " ")


def root_slug(c: Column) -> Column:
    """Letters of a root as hyphen-joined codes; null if a letter has no code."""
    table = F.create_map(*[F.lit(x) for pair in SLUG_CODES.items() for x in pair])
    codes = F.transform(F.split(spaced_root(c), " "), lambda x: F.try_element_at(table, x))
    return F.when(~F.exists(codes, lambda x: x.isNull()), F.array_join(codes, "-"))


def root_from_slug(c: Column) -> Column:
    """The spaced root of a slug; null if a code is unknown."""
    table = F.create_map(*[F.lit(x) for k, v in SLUG_CODES.items() for x in (v, k)])
    letters = F.transform(F.split(c, "-"), lambda x: F.try_element_at(table, x))
    return F.when(~F.exists(letters, lambda x: x.isNull()), F.array_join(letters, " "))


def romanise_word(word: str | None) -> str | None:
    """Romanisation of a vowelled word; a shadda doubles the last consonant, marks go, other letters stay."""
    if word is None:
        return None
    out: list[str] = []
    doubled = -1
    for c in word:
        if c == SHADDA:
            if doubled >= 0:
                out.insert(doubled + 1, out[doubled])
        elif c in LATIN or HAMZA_SEATS.get(c):
            if c != ALEF:
                doubled = len(out)
            out.append(LATIN.get(c) or HAMZA_SEATS[c])
        elif c in VOWELS:
            out.append(VOWELS[c])
        elif c not in HAMZA_SEATS and c != TATWEEL and not ("ؐ" <= c <= "ؚ" or "ً" <= c <= "ٟ" or "ۖ" <= c <= "ۭ"):
            out.append(c)
    return "".join(out)


def romanise(c: Column) -> Column:
    """romanise_word; apply it to distinct forms."""
    return _by_value(c, romanise_word)


def decode_keys(c: Column) -> Column:
    """Letters of a transliterated lexicon key."""
    return F.translate(F.replace(F.replace(c, F.lit("A^"), F.lit("أ")), F.lit("^"), F.lit("ء")), KEYBOARD, KEYBOARD_LETTERS)


def radical_print(c: Column) -> Column:
    """Root letters only, hamza seats and alef as hamza, teh marbuta as teh, alef maksura as yeh."""
    return F.translate(F.regexp_replace(c, RADICALS, ""), "أإؤئآٱاةى", "ء" * 7 + "تي")


def gloss_key(c: Column) -> Column:
    """Lower case, one apostrophe, no brackets or punctuation, single spaces."""
    plain = F.regexp_replace(F.translate(F.lower(c), "‘’ʼ`", "''''"), r"[^\p{L}\p{N}\s'-]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def gloss_slug(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("-"))


def stem(c: Column) -> Column:
    """Without the first matching suffix that leaves two letters or more."""
    out = c
    for suffix in reversed(SUFFIXES):
        out = F.when(c.endswith(suffix) & (F.length(c) >= len(suffix) + 2), c.substr(F.lit(1), F.length(c) - len(suffix))).otherwise(out)
    return out


def latin_words(c: Column) -> Column:
    """Lower-case words of a-z, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z\s]", " "), r"\s+"), lambda w: w != "")


def significant_stems(c: Column) -> Column:
    """The set of stems of the words that aren't function words."""
    return F.array_distinct(F.transform(F.filter(latin_words(c), lambda w: ~w.isin(STOP_WORDS)), stem))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Shared share of two sets; ``empty`` is what two empty sets give."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a string's characters, as a long; characters count as their code points."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("bigint")) % F.lit(4294967296).cast("bigint"))


def seeded_pick(seed: Column, n: Column) -> Column:
    """An index below n from a seed, -1 if n is 0."""
    return F.when(n > 0, fnv1a(seed) % n).otherwise(F.lit(-1).cast("bigint"))


def segment_id(work: Column, scheme: Column, division: Column, slot: Column) -> Column:
    return F.concat_ws(":", work, scheme, division.cast("string"), slot.cast("string"))


def token_id(segment: Column, position: Column) -> Column:
    return F.concat_ws(":", segment, position.cast("string"))
