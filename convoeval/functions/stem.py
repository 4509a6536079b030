"""Porter's suffix stripping as published in 1980, with the widely used
extensions of later implementations (irregular forms, -ied/-ies, -fulli ...)."""

from __future__ import annotations

# Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed", "sky": "sky",
}
# Suffix pairs of steps 2, 3 and the suffixes of step 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel)."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(part: str) -> int:
    return _shape(part).count("vc")


def _ends_cvc(part: str) -> bool:
    s = _shape(part)
    if len(part) >= 3 and s.endswith("cvc") and part[-1] not in "wxy":
        return True
    return len(part) == 2 and s == "vc"


def _double(part: str) -> bool:
    return len(part) > 1 and part[-1] == part[-2] and _shape(part)[-1] == "c"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + new if _measure(base) > 0 else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    if w.endswith(("sses", "ies")):
        return w[:-2]
    if w.endswith("s") and not w.endswith("ss"):
        return w[:-1]
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if "v" not in _shape(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double(base):
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if _measure(base) == 1 and _ends_cvc(base) else base
    return w


def _final_y(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        return w[:-1] + "i"
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _swap(w, STEP2)


def _step4(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            fits = _measure(base) > 1 and (suffix != "ion" or base[-1] in "st")
            return base if fits else w
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _step2):
        word = step(word)
    return _final_e(_step4(_swap(word, STEP3)))
