"""Tokens, stop words and stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP_WORDS = tuple("were with will from your that and the are for has was its you be he of an in on to or as is at it by a".split())


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column, stop_words: bool = False, shortest: int = 1, longest: int = 256) -> Column:
    """Runs of ASCII letters and digits, lower case; null text has none."""
    found = F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    if shortest > 1 or longest < (1 << 30):
        found = F.filter(found, lambda t: (F.length(t) >= shortest) & (F.length(t) <= longest))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if stop_words else found


def once(value: Column) -> Column:
    """A generator of one row: whatever reads the value above it doesn't compute it anew."""
    return F.explode(F.array(value))


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[ \t\r\n\f\x0B]+"), lambda t: t != "")


_VOWEL = "aeiou"
_SUFFIXES = {
    "de": ("ungen", "heiten", "keiten", "lichen", "ung", "heit", "keit", "lich", "isch", "ern", "em", "er", "en", "es", "e", "n", "s"),
    "fr": ("issements", "issement", "atrices", "ateurs", "ations", "ation", "ements", "ement", "euses", "euse", "ives", "ive", "eux", "ifs", "if", "es", "e", "s"),
    "es": ("amientos", "amiento", "aciones", "acion", "adoras", "adores", "mente", "idades", "idad", "ivas", "ivos", "iva", "ivo", "as", "os", "es", "a", "o", "e", "s"),
    "it": ("azioni", "azione", "amente", "mente", "ita", "iva", "ivo", "i", "e", "a", "o"),
    "pt": ("amentos", "amento", "acoes", "acao", "mente", "idades", "idade", "as", "os", "es", "a", "o", "e", "s"),
}


def _measure(stem: str) -> int:
    kinds = "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in _VOWEL or (w[i] == "y" and i > 0 and not _is_vowel(w, i - 1))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and not _is_vowel(w, len(w) - 1) and _is_vowel(w, len(w) - 2) and not _is_vowel(w, len(w) - 3) and w[-1] not in "wxy"


def _has_vowel(w: str) -> bool:
    return any(_is_vowel(w, i) for i in range(len(w)))


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def porter(w: str) -> str:
    """Porter's algorithm (1980), steps 1a to 5b."""
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                w = w[: -len(s)] + table[s] if _measure(w[: -len(s)]) > 0 else w
                break
    for s in _STEP4:
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stem(word: str, language: str = "en") -> str:
    if language == "en":
        return porter(word)
    for s in _SUFFIXES.get(language, ()):
        if word.endswith(s) and len(word) - len(s) >= 3:
            return word[: -len(s)]
    return word


def stem_all(language: str = "en"):
    """A pandas UDF over arrays of tokens: Spark SQL has no stemmer."""
    @F.pandas_udf(ArrayType(StringType()))
    def run(column: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def each(words):
            if words is None:
                return None
            for w in words:
                if w not in known:
                    known[w] = stem(w, language)
            return [known[w] for w in words]

        return column.map(each)

    return run
