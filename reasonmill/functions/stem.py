"""Suffix stripping after Porter (1980), with the usual extensions for short words and a few irregular forms."""

from __future__ import annotations

from functools import lru_cache

# --- fixed values: irregular forms and the suffix tables of the published algorithm
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)
# --- end of fixed values


def _shape(word: str) -> str:
    """``c`` or ``v`` per letter; y counts as a vowel after a consonant."""
    marks: list[str] = []
    for n, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and n > 0 and marks[n - 1] == "c")
        marks.append("v" if vowel else "c")
    return "".join(marks)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_syllable(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; also a two-letter word of vowel and consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: -len(suffix)]
        if w.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_syllable(stem) else stem
    return w


def _final_y(w: str) -> str:
    ends = w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c"
    return w[:-1] + "i" if ends else w


def _swap(w: str, table: tuple[tuple[str, str], ...]) -> str:
    for suffix, ending in table:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + ending if _measure(stem) > 0 else w
    return w


def _derived(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _derived(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _swap(w, STEP_2)


def _long_suffix(w: str) -> str:
    for suffix in STEP_4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            keeps = suffix == "ion" and not stem.endswith(("s", "t"))
            return stem if _measure(stem) > 1 and not keeps else w
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        size = _measure(stem)
        if size > 1 or (size == 1 and not _short_syllable(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    return _final_e(_long_suffix(_swap(_derived(word), STEP_3)))
