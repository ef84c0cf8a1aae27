"""English lexemes: stop words and the stems of the Snowball project's English (Porter2) stemmer."""

from __future__ import annotations

import re

# fixed values: the stop words and the tables of the published algorithm
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
SPECIAL = dict(pair.split(":") for pair in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LONG_PREFIX = ("gener", "commun", "arsen")
DOUBLES = tuple("bb dd ff gg mm nn pp rr tt".split())
LI_ENDING = "cdeghkmnrt"
STEP2 = dict(pair.split(":") for pair in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split())
STEP3 = dict(pair.split(":") for pair in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
STEP4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())

_AFTER_VOWEL = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    """Where the part behind the first consonant after a vowel begins, from ``start`` on."""
    found = _AFTER_VOWEL.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) <= 2:
        return word
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1 = next((len(p) for p in LONG_PREFIX if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)

    w = _plural(w)
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in LI_ENDING):
            w = before + STEP2[end]
    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _plural(w: str) -> str:
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    if end == "s" and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    if end in ("eedly", "eed"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if not end or not _VOWEL.search(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if len(w) <= r1 and _SHORT_END.search(w) else w


def lexeme(token: str) -> str | None:
    """None for a stop word."""
    return None if token in STOP_WORDS else stem(token)
