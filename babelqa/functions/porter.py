"""Porter stemmer (Porter 1980) with the extensions of the NLTK variant, which is the
one the ROUGE scorer stems with. A small per-word helper: Spark calls it on whole
token arrays through an Arrow UDF, or once per distinct word of a vocabulary.
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiou")

# FIXED VALUES: irregular forms answered directly by the NLTK variant (form -> stem).
IRREGULAR = {
    "skies": "sky", "sky": "sky",
    "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news",
    "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# FIXED VALUES: suffix rules (suffix, replacement) of steps 2, 3 and 4, in rule order.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("fulli", "ful"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of vowel-consonant sequences: [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        c = _cons(stem, i)
        if c and prev_vowel:
            m += 1
        prev_vowel = not c
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1):
        return w[-1] not in "wxy"
    return len(w) == 2 and not _cons(w, 0) and _cons(w, 1)


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    for suf, rep in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suf):
            return w[: len(w) - len(suf)] + rep
    return w


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return w[:-3] + "ee" if _m(w[:-3]) > 0 else w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[: len(w) - len(suf)]):
            s = w[: len(w) - len(suf)]
            break
    else:
        return w
    for suf, rep in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
        if s.endswith(suf):
            return s[: len(s) - len(suf)] + rep
    if _double_cons(s):
        return s[:-1] if s[-1] not in "lsz" else s
    if _m(s) == 1 and _cvc(s):
        return s + "e"
    return s


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _m(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    for suf, rep in STEP2:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            ok = _m(w[:-3]) > 0 if suf == "logi" else _m(stem) > 0
            return stem + rep if ok else w
    return w


def _step3(w: str) -> str:
    for suf, rep in STEP3:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if _m(stem) > 0 else w
    return w


def _step4(w: str) -> str:
    for suf in STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            ok = _m(stem) > 1 and (suf != "ion" or (stem[-1:] in ("s", "t")))
            return stem if ok else w
    return w


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        if _m(stem) > 1 or (_m(stem) == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5):
        w = step(w)
    return w
