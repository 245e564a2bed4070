"""English stems by rules: suffixes go in steps, as far as what is left before them allows."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = frozenset("aeiouy")
# Fixed values of the public English stemming algorithm of the second kind: irregular words, beginnings behind which the
# first region starts, doubled letters, letters before -li, and endings by step with what replaces them.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = frozenset("cdeghkmnrt")
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate",
    "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, begin: int = 0) -> int:
    """Where the part behind the first consonant after a vowel begins."""
    for i in range(begin + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.removeprefix("'")
    # A y that is a consonant is written Y meanwhile.
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    first = next((len(b) for b in REGION_BEGINNINGS if word.startswith(b)), None) or _region(word)
    second = _region(word, first)
    if end := _longest(word, ("'", "'s", "'s'")):
        word = word[: -len(end)]
    # 1a: plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and VOWELS & set(word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_1A:
        return word
    # 1b: participles.
    if end := _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        before = word[: -len(end)]
        if end in ("eed", "eedly"):
            word = before + "ee" if len(before) >= first else word
        elif VOWELS & set(before):
            word = before
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif first >= len(word) and _ends_short(word):
                word += "e"
    # 1c: y behind a consonant.
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2 and 3: compound endings, in the first region.
    if (end := _longest(word, STEP_2)) and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if not (end == "ogi" and before[-1:] != "l") and not (end == "li" and before[-1:] not in BEFORE_LI):
            word = before + STEP_2[end]
    if (end := _longest(word, STEP_3)) and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + STEP_3[end]
    # 4: simple endings, in the second region.
    if (end := _longest(word, STEP_4)) and len(word) - len(end) >= second and not (end == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(end)]
    # 5: a last e or l.
    if word.endswith("e") and (len(word) > second or (len(word) > first and not _ends_short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.lower()


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words, null for null; a worker computes each distinct word once, in Arrow batches."""
    return F.udf(lambda found: None if found is None else [None if w is None else stem(w) for w in found], "array<string>", useArrow=True)(words)
