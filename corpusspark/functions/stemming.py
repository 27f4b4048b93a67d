"""English suffix stripping after Porter (1980), written from the paper's rules, as a column function over word lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_VOWELS = "aeiou"
# The rules of steps 2 to 4 of the paper: suffix and what replaces it (fixed values).
_STEP_2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP_3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP_4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,ion,ou,ism,ate,iti,ous,ive,ize"


def _rules(text: str) -> list[tuple[str, str]]:
    pairs = [tuple((r + " ").split(" ")[:2]) for r in text.split(",")]
    return sorted(pairs, key=lambda p: -len(p[0]))


_TABLES = (_rules(_STEP_2), _rules(_STEP_3))
_LAST = _rules(_STEP_4)


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for c in word:
        out.append(c not in _VOWELS and not (c == "y" and out and out[-1]))
    return out


def _measure(stem: str) -> int:
    """The number of vowel runs that a consonant follows."""
    kinds = _consonants(stem)
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _short_end(word: str) -> bool:
    """Whether a word ends consonant, vowel, consonant other than w, x and y."""
    return len(word) > 2 and _consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other than ASCII letters, stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short_end(cut)):
            word = cut + "e"
        else:
            word = cut[:-1] if _double_end(cut) and cut[-1] not in "lsz" else cut
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    # derivations: in each step the longest suffix that fits is the only one that is tried
    for table in _TABLES:
        found = next(((s, r) for s, r in table if word.endswith(s)), None)
        if found and _measure(word[: -len(found[0])]) > 0:
            word = word[: -len(found[0])] + found[1]
    found = next((s for s, _ in _LAST if word.endswith(s)), None)
    if found:
        rest = word[: -len(found)]
        if _measure(rest) > 1 and (found != "ion" or rest.endswith(("s", "t"))):
            word = rest
    # a last e, and a double l
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """The stems of word lists, in Arrow batches; null stays null."""
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            known[w] = stem_word(w)
        return known[w]

    return pd.Series([None if x is None else [one(w) for w in x] for x in words])
