"""English stems and stop words, and the small query language of a search box."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the language (the published Snowball rules for English).
VOWELS, DOUBLES, BEFORE_LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
LONG_PREFIXES = ("gener", "commun", "arsen")
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: Fixed values of the language: words too common to search for.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _after(word: str, start: int) -> int:
    """Where the region begins after the first consonant that follows a vowel, from start on."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _step_1(word: str, r1: int) -> str:
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")) or (len(word) <= r1 and _SHORT_END.search(word)):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    return word


def _steps_2_to_5(word: str, r1: int, r2: int) -> str:
    end = _longest(word, STEP_2)
    at = len(word) - len(end)
    if end and at >= r1 and (end != "ogi" or word[at - 1] == "l") and (end != "li" or word[at - 1] in BEFORE_LI):
        word = word[:at] + STEP_2[end]
    end = _longest(word, STEP_3)
    at = len(word) - len(end)
    if end and at >= (r2 if end == "ative" else r1):
        word = word[:at] + STEP_3[end]
    end = _longest(word, STEP_4)
    at = len(word) - len(end)
    if end and at >= r2 and (end != "ion" or word[at - 1] in "st"):
        word = word[:at]
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT_END.search(word[:at]))):
        return word[:at]
    return word[:at] if word.endswith("ll") and at >= r2 else word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a small-letter English word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    word = word.removeprefix("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word.startswith("y") else word)
    prefix = next((p for p in LONG_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(word, 0)
    r2 = _after(word, r1)
    word = word.removesuffix(_longest(word, ("'", "'s", "'s'")))
    word = _step_1(word, r1)
    return (word if word in KEPT else _steps_2_to_5(word, r1, r2)).replace("Y", "y")


@lru_cache(maxsize=64)
def _heads(only: frozenset[str]) -> frozenset[str]:
    """How words of some stems begin: a stem keeps the first two letters, but for irregular words, or is shorter."""
    return frozenset(s[:2] for s in only)


def lexemes(words: list[str], start: int = 0, only: frozenset[str] | None = None) -> list[tuple[str, int]]:
    """(stem, position) of the words that aren't stop words; stop words take up positions. With only, of words with those stems; others aren't stemmed where their beginning rules them out."""
    if only is None:
        return [(stem(word), at) for at, word in enumerate(words, start + 1) if word not in STOP]
    heads, out = _heads(only), []
    for at, word in enumerate(words, start + 1):
        if (word[:2] in heads or word[:1] in heads or word in IRREGULAR) and word not in STOP and (lexeme := stem(word)) in only:
            out.append((lexeme, at))
    return out


_TOKEN = re.compile(r'(-?)"([^"]*)"?|(\S+)')
_WORD = re.compile("[a-z0-9]+")


def parse(query: str) -> list[tuple[int, int, bool, str, int, int]]:
    """(alternative, atom, negated, stem, offset, words of the atom) of a search box query; a word that is asked twice counts once.

    Words are all wanted; "quoted words" stand next to each other, as do words that
    other signs join; a minus before either rules it out; `or` parts alternatives. A
    stop word isn't asked for but keeps its place in quotes. An alternative of
    stop words or negations only finds nothing.
    """
    out, alternative, atom, seen = [], 0, 0, set()
    for minus, quoted, plain in _TOKEN.findall(query.lower()):
        if plain == "or":
            alternative += 1
            continue
        text = plain.removeprefix("-") if plain else quoted
        found, negated = lexemes(_WORD.findall(text)), bool(minus) or plain.startswith("-")
        whole = (alternative, negated, *((lexeme, at - found[0][1]) for lexeme, at in found))
        if found and whole not in seen:
            seen.add(whole)
            out += [(alternative, atom, negated, lexeme, at - found[0][1], len(found)) for lexeme, at in found]
            atom += 1
    asked = {r[0] for r in out if not r[2]}
    return [r for r in out if r[0] in asked]


def parsed(queries: DataFrame, fold: dict[int, str] | None = None) -> DataFrame:
    """queries (query_id, query) as rows (query_id, alt, atom, negated, term, offset, words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, *r) for q, text in zip(b["query_id"], b["query"], strict=True) for r in parse((text or "").translate(fold or {}))]
            yield pd.DataFrame(rows, columns=["query_id", "alt", "atom", "negated", "term", "offset", "words"])

    return queries.select("query_id", "query").mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, alt int, atom int, negated boolean, term string, offset int, words int")
