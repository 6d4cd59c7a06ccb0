"""The Porter2 ("Snowball English") stemmer, after its published description."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
#: Fixed values of the published algorithm.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def stem(word: str) -> str:
    """The stem of a lower-case word of letters and digits."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word[0] == "y":
        word = "Y" + word[1:]
    word = "".join("Y" if c == "y" and i and word[i - 1] in VOWELS else c for i, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _region(word, 0)
    r2 = _region(word, r1) if r1 < len(word) else len(word)

    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if suffix.startswith("ee"):
                word = base + "ee" if len(base) >= r1 else word
            elif any(c in VOWELS for c in base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_end(word):
                    word += "e"
            break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2
    for suffix, instead in STEP2:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) >= r1 and (suffix != "ogi" or base.endswith("l")) and (suffix != "li" or (base and base[-1] in LI_ENDINGS)):
                word = base + instead
            break
    # 3
    for suffix, instead in STEP3:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) >= (r2 if suffix == "ative" else r1):
                word = base + instead
            break
    # 4
    for suffix in STEP4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) >= r2 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    # 5
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _short_end(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stem_column(token: Column) -> Column:
    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        known: dict[str, str] = {w: stem(w) for w in words.dropna().unique()}
        return words.map(known)

    return stems(token)
