"""Full-text analysis, web-search queries and cover-density ranks.

Two analyzers: simple (runs of a-z and 0-9 after lower-casing, in the JVM) and english (the same tokens without stop words,
stemmed by the Snowball English rules). The english one follows a database's english dictionary for words and numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[a-z0-9]+"
# English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
    did doing a an the and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)


def simple_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def term_count(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


VOWELS = "aeiouy"
# The stemmer's irregular words, those that end after plurals are cut, beginnings whose rest is a region, and its suffixes with what takes their place.
_IRREGULAR = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl",
    sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes",
)
_WHOLE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_BEGINNINGS = ("gener", "commun", "arsen")
_DOUBLES, _BEFORE_LI = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
_STEP2 = dict(
    tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al",
    fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="",
)
_STEP3 = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _longest(word: str, suffixes) -> str:
    """The longest of some suffixes that a word has; empty if none."""
    return max((x for x in suffixes if word.endswith(x)), key=len, default="")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _vowel_in(part: str) -> bool:
    return any(ch in VOWELS for ch in part)


def _short_end(part: str) -> bool:
    """Whether a part ends in a short syllable: consonant, vowel, consonant but w, x and Y; or is a vowel and a consonant."""
    if len(part) == 2:
        return part[0] in VOWELS and part[1] not in VOWELS
    return len(part) > 2 and part[-1] not in VOWELS + "wxY" and part[-2] in VOWELS and part[-3] not in VOWELS


def _without_plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _vowel_in(word[:-2]):
        return word[:-1]
    return word


def _without_tense(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    rest = word[: len(word) - len(suffix)]
    if suffix in ("eed", "eedly"):
        return rest + "ee" if len(rest) >= r1 else word
    if not suffix or not _vowel_in(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(_DOUBLES):
        return rest[:-1]
    return rest + "e" if _short_end(rest) and r1 >= len(rest) else rest


def _replaced(word: str, table: dict[str, str], r1: int, r2: int) -> str:
    suffix = _longest(word, table)
    rest = word[: len(word) - len(suffix)]
    if not suffix or len(rest) < r1:
        return word
    if (suffix == "li" and not rest.endswith(tuple(_BEFORE_LI))) or (suffix == "ogi" and not rest.endswith("l")) or (suffix == "ative" and len(rest) < r2):
        return word
    return rest + table[suffix]


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case English word, by the Snowball rules: suffixes go where they lie in the regions behind the first and second syllable."""
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = re.sub("^y|[aeiouy]y", lambda m: m[0][:-1] + "Y", word)  # a y that is no vowel
    r1 = next((len(b) for b in _BEGINNINGS if word.startswith(b)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)
    word = _without_plural(word)
    if word in _WHOLE:
        return word
    word = _without_tense(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2, r1, r2), _STEP3, r1, r2)
    suffix = _longest(word, _STEP4)
    rest = word[: len(word) - len(suffix)]
    if suffix and len(rest) >= r2 and (suffix != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


def english_lexemes(text: str) -> list[tuple[str, int]]:
    """Stems with their places; stop words take a place but are left out."""
    return [(stem(t), i) for i, t in enumerate(re.findall(TOKEN, text.lower()), 1) if t not in STOP_WORDS]


@dataclass
class Clause:
    """One alternative of a query: phrases that must and must not occur; a term is a phrase of one word."""

    must: list[tuple[str, ...]] = field(default_factory=list)
    never: list[tuple[str, ...]] = field(default_factory=list)


def parse_query(text: str, english: bool = True) -> list[Clause]:
    """Web-search syntax: words are joined by and, "quotes" make phrases, or parts alternatives, - negates."""
    clauses = [Clause()]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', text):
        quoted, word = m[2], m[3]
        if word is not None and word.lower() == "or":
            clauses.append(Clause())
            continue
        negated = m[1] == "-" if quoted is not None else word.startswith("-")
        found = re.findall(TOKEN, (quoted if quoted is not None else word).lower())
        lexemes = tuple(stem(t) for t in found if t not in STOP_WORDS) if english else tuple(found)
        if lexemes:
            (clauses[-1].never if negated else clauses[-1].must).append(lexemes)
    return [c for c in clauses if c.must or c.never]


def _places(where: dict[str, list[int]], phrase: tuple[str, ...]) -> list[int]:
    starts = where.get(phrase[0], [])
    return [p for p in starts if all(p + k in where.get(x, ()) for k, x in enumerate(phrase))]


def cover_rank(where: dict[str, list[int]], clauses: list[Clause]) -> float | None:
    """The rank of a text by its lexemes' places, None if it does not match: a tenth over one plus the noise words, summed over minimal covers."""
    matched, places = False, {}
    for c in clauses:
        if all(_places(where, p) for p in c.must) and not any(_places(where, p) for p in c.never):
            matched = True
        places.update({p: _places(where, p) for p in c.must})
    if not matched:
        return None
    best = 0.0
    for c in clauses:
        if not c.must or not all(places[p] for p in c.must):
            continue
        events = sorted((place, k) for k, p in enumerate(c.must) for place in places[p])
        last, total = {}, 0.0
        previous = -1
        for place, k in events:
            last[k] = place
            if len(last) == len(c.must):
                start = min(last.values())
                if start > previous:
                    total += 0.1 / (1 + max(0, place - start + 1 - sum(map(len, c.must))))
                    previous = start
        best = max(best, total)
    return float(np.float32(best))


def cover_density(text: str, clauses: list[Clause]) -> float | None:
    """cover_rank of a text."""
    where: dict[str, list[int]] = {}
    for lexeme, place in english_lexemes(text):
        where.setdefault(lexeme, []).append(place)
    return cover_rank(where, clauses)


def lexemes_of(clauses: list[Clause]) -> list[str]:
    """All lexemes that a query asks for or forbids."""
    return sorted({x for c in clauses for phrase in (*c.must, *c.never) for x in phrase})


def rank_of_places(clauses: list[Clause]):
    """A column function: cover_rank by an array of (lexeme, places), null where it does not match, all of it in the JVM.

    Minimal covers are found by a fold over the places of a clause's terms in order: it carries the last place of each term, and a cover
    ends at a place where the least of those has moved on.
    """
    none = F.array().cast("array<int>")

    def rank(found: Column | str) -> Column:
        where = F.map_from_entries(F.col(found) if isinstance(found, str) else found)
        places = {p: _phrase_places(where, p, none) for c in clauses for p in (*c.must, *c.never)}
        matched, best = F.lit(False), [F.lit(0.0)]
        for c in clauses:
            there = F.lit(True)
            for p in c.must:
                there = there & (F.size(places[p]) > 0)
            free = there
            for p in c.never:
                free = free & (F.size(places[p]) == 0)
            matched = matched | free
            if c.must:
                best.append(F.when(there, _covers([places[p] for p in c.must], sum(map(len, c.must)))).otherwise(0.0))
        top = F.greatest(*best) if len(best) > 1 else best[0]
        return F.when(matched, top.cast("float").cast("double"))

    return rank


def _phrase_places(where: Column, phrase: tuple[str, ...], none: Column) -> Column:
    """Where a phrase begins, in order."""
    of = lambda lexeme: F.coalesce(F.try_element_at(where, F.lit(lexeme)), none)
    first = F.array_sort(of(phrase[0]))
    for k, lexeme in enumerate(phrase[1:], 1):
        first = F.array_intersect(first, F.transform(of(lexeme), lambda p: p - F.lit(k)))
    return first


def _covers(terms: list[Column], words: int) -> Column:
    """A tenth over one plus the noise words, summed over the minimal covers of all terms, whose phrases have so many words."""
    events = F.array_sort(F.concat(*[F.transform(t, lambda p: F.struct(p.alias("place"), F.lit(k).alias("k"))) for k, t in enumerate(terms)]))
    start = F.struct(*[F.lit(-1).alias(f"last{k}") for k in range(len(terms))], F.lit(-1).alias("begun"), F.lit(0.0).alias("total"))

    def step(s: Column, e: Column) -> Column:
        last = [F.when(e["k"] == k, e["place"]).otherwise(s[f"last{k}"]) for k in range(len(terms))]
        begin = F.least(*last) if len(last) > 1 else last[0]
        ends, noise = begin > s["begun"], e["place"] - begin + (1 - words)
        gain = F.when(ends, F.lit(0.1) / (F.greatest(noise, F.lit(0)) + 1)).otherwise(0.0)
        return F.struct(*[x.alias(f"last{k}") for k, x in enumerate(last)], F.when(ends, begin).otherwise(s["begun"]).alias("begun"), (s["total"] + gain).alias("total"))

    return F.aggregate(events, start, step, lambda s: s["total"])


@F.pandas_udf(StringType())
def _english_lexeme(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t in STOP_WORDS else stem(t))


#: The stem of each token, null for stop words; meant for a vocabulary, a row for each distinct token. A filter on it does not run it again.
english_lexeme = _english_lexeme.asNondeterministic()
