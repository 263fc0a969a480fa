"""Porter's stemmer (1980, with its author's later changes) for English words.

It is meant for the distinct terms of a dictionary, not for texts: an index keeps words as they
are written and finds the forms of a word by their common stem.
"""

from __future__ import annotations

# Endings of steps 2, 3 and 4 of the published algorithm, with what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Words of more letters than this are no words and stay as they are.
LONGEST = 64


def _shape(word: str) -> str:
    """``v`` for a vowel and ``c`` for a consonant; y is a vowel behind a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last of them not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = _longest(word, ("ed", "ing"))
    if end is None or not _has_vowel(word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _double(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short(word) else word


def _replace(word: str, endings: dict[str, str]) -> str:
    end = _longest(word, endings)
    if end is None or _measure(word[: -len(end)]) == 0:
        return word
    return word[: -len(end)] + endings[end]


def _cut(word: str) -> str:
    end = _longest(word, STEP_4)
    if end is None or _measure(word[: -len(end)]) < 2 or (end == "ion" and word[: -len(end)][-1] not in "st"):
        return word
    return word[: -len(end)]


def stem(word: str) -> str:
    """The stem of a lower-cased word; words with other letters than a to z, and short ones, are their own stems."""
    if not 2 < len(word) <= LONGEST or not (word.isascii() and word.isalpha()):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _cut(_replace(_replace(word, STEP_2), STEP_3))
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
