"""English stems by the two-region suffix algorithm (the published "English" or Porter2 rules).

A word's first region starts behind its first non-vowel that follows a vowel, the second region at the
same place of the first. A suffix goes, or is changed, only where it lies in the region its step asks
for; in each step the longest suffix decides.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

# The rules' suffixes and exceptions.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
AFTER_PLURAL = set("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
_LI = "cdeghkmnrt"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_PREFIX = re.compile("gener|commun|arsen")
_SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _suffix(word: str, table) -> str:
    return max((s for s in table if word.endswith(s)), key=len, default="")


def english_stem(word: str) -> str:
    """The stem of a lower-cased word. Words of two characters or fewer, and those without an English
    suffix, stay as they are; an empty word is its own stem."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("^'", "", word.replace("’", "'"))
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    start = _PREFIX.match(w) or _REGION.search(w)
    r1 = start.end() if start else len(w)
    again = _REGION.search(w, r1)
    r2 = again.end() if again else len(w)

    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURAL:
        return w

    end = _suffix(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.match(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"

    end = _suffix(w, STEP_2)
    at = len(w) - len(end)
    if end and at >= r1 and not (end == "ogi" and w[at - 1] != "l") and not (end == "li" and w[at - 1] not in _LI):
        w = w[:at] + STEP_2[end]
    end = _suffix(w, STEP_3)
    at = len(w) - len(end)
    if end and at >= (r2 if end == "ative" else r1):
        w = w[:at] + STEP_3[end]
    end = _suffix(w, STEP_4)
    at = len(w) - len(end)
    if end and at >= r2 and not (end == "ion" and w[at - 1] not in "st"):
        w = w[:at]
    if w.endswith("e"):
        if len(w) > r2 or (len(w) > r1 and not _SHORT.match(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def with_stems(words: DataFrame, word_col: str = "term", stem=english_stem) -> DataFrame:
    """(``word_col``, stem) for each distinct word of ``words``; null words are left out. An empty table
    has none."""

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({word_col: pdf[word_col], "stem": [stem(w) for w in pdf[word_col]]})

    return words.select(word_col).filter(f"{word_col} is not null").distinct().mapInPandas(run, f"{word_col} string, stem string")
