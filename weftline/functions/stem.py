"""Porter's suffix stripping, written from the published algorithm.

M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980, with the author's two
later changes to step 2 (``bli`` -> ``ble`` and ``logi`` -> ``log``).
"""

from __future__ import annotations

from functools import lru_cache

# The rules of the published algorithm, longest suffix first where they overlap.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as v and c: y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, rules: tuple, key=lambda r: r[0]):
    found = [r for r in rules if word.endswith(key(r))]
    return max(found, key=lambda r: len(key(r)), default=None)


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a word. Words of one or two characters stay; upper-case letters count as consonants."""
    if len(word) <= 2:
        return word
    # Plurals.
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + by
            break
    # Past tense and gerund.
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if "v" in _shape(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double_end(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        rule = _longest(word, rules)
        if rule and _measure(word[: len(word) - len(rule[0])]) > 0:
            word = word[: len(word) - len(rule[0])] + rule[1]
    suffix = _longest(word, STEP_4, key=lambda r: r)
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


# The rules of the published English (Porter2) stemmer.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: after the first consonant that follows a vowel, and again."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)

    def after(at: int) -> int:
        for i in range(at + 1, len(word)):
            if word[i] not in "aeiouy" and word[i - 1] in "aeiouy":
                return i + 1
        return len(word)

    r1 = start if start is not None else after(0)
    return r1, after(r1)


def _short_syllable(word: str) -> bool:
    if len(word) == 2:
        return word[0] in "aeiouy" and word[1] not in "aeiouy"
    return len(word) > 2 and word[-3] not in "aeiouy" and word[-2] in "aeiouy" and word[-1] not in "aeiouywxY"


@lru_cache(maxsize=200_000)
def porter2(word: str) -> str:
    """The stem by the English stemmer that followed Porter's, for lower-case words."""
    if len(word) <= 2:
        return word
    word = word.lstrip("'") if word.startswith("'") else word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    # A y that acts as a consonant is written Y while the rules run.
    letters = list(word)
    for i, ch in enumerate(letters):
        if ch == "y" and (i == 0 or letters[i - 1] in "aeiouy"):
            letters[i] = "Y"
    word = "".join(letters)
    r1, r2 = _regions(word)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in "aeiouy" for c in word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    if word.endswith(("eed", "eedly")):
        suffix = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    else:
        suffix = next((s for s in ("ingly", "edly", "ing", "ed") if word.endswith(s)), None)
        if suffix and any(c in "aeiouy" for c in word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif _short_syllable(word) and r1 >= len(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    rule = next((r for r in SECOND if word.endswith(r[0])), None)
    if rule and len(word) - len(rule[0]) >= r1:
        stem = word[: len(word) - len(rule[0])]
        if (rule[0] != "ogi" or stem.endswith("l")) and (rule[0] != "li" or stem[-1:] in tuple("cdeghkmnrt")):
            word = stem + rule[1]
    rule = next((r for r in THIRD if word.endswith(r[0])), None)
    if rule and len(word) - len(rule[0]) >= (r2 if rule[0] == "ative" else r1):
        word = word[: len(word) - len(rule[0])] + rule[1]
    suffix = next((s for s in FOURTH if word.endswith(s)), None)
    if suffix and len(word) - len(suffix) >= r2:
        stem = word[: -len(suffix)]
        if suffix != "ion" or stem.endswith(("s", "t")):
            word = stem
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
