"""Text analysis for ranking: lower-cased words without stop words, reduced to stems by English suffix rules.

The rules are the first steps of the usual English stemmer: plurals, ``-ed`` and ``-ing`` with the repairs after them, and a
final ``y``. "lifted", "lifts" and "lifting" all become "lift".
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the analyser, in its order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Each step is a list of (pattern, part to replace, replacement); the first pattern that matches decides.
PLURALS = [
    ("sses$", "sses$", "ss"),
    ("^..+ie[sd]$", "ie[sd]$", "i"),
    ("^.ie[sd]$", "ie[sd]$", "ie"),
    ("(us|ss)$", "^$", ""),
    ("[aeiouy].+s$", "s$", ""),
]
PAST = [
    ("^[^aeiouy]*[aeiouy]+[^aeiouy].*eed(ly)?$", "eed(ly)?$", "ee"),
    ("eed(ly)?$", "^$", ""),
    # A sign that a repair may be due; it is taken off again in the next step.
    ("[aeiouy].*(ed|edly|ing|ingly)$", "(ed|edly|ing|ingly)$", "+"),
]
REPAIRS = [
    (r"(at|bl|iz)\+$", r"\+$", "e"),
    (r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\+$", r".\+$", ""),
    (r"^[^aeiouy]*[aeiouy][^aeiouywx]\+$", r"\+$", "e"),
    (r"\+$", r"\+$", ""),
]
LAST = [("^.+[^aeiouy]y$", "y$", "i")]
STEPS = (PLURALS, PAST, REPAIRS, LAST)


def _step(word: Column, rules: list[tuple[str, str, str]]) -> Column:
    out = None
    for pattern, part, new in rules:
        changed = F.regexp_replace(word, part, new)
        hit = word.rlike(pattern)
        out = F.when(hit, changed) if out is None else out.when(hit, changed)
    return out.otherwise(word)


def stems(found: Column) -> Column:
    """Stems of an array of words. Each step is an array of its own, so no step is computed more than once."""
    for rules in STEPS:
        found = _mapped(found, rules)
    return found


def _mapped(found: Column, rules: list[tuple[str, str, str]]) -> Column:
    return F.transform(found, lambda w: _step(w, rules))


def words(text: Column) -> Column:
    """Lower-cased words of the whole text, in order and with repeats, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def analyse(text: Column) -> Column:
    """Array of terms of the whole text, in order and with repeats."""
    return stems(without_stop_words(words(text)))


def without_stop_words(found: Column) -> Column:
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def stem_prefix(term: str) -> str:
    """What every word begins with that has this stem: the last letter of a stem may be a repair."""
    return term[:-1] if len(term) > 1 and term[-1] in "ei" else term


def stem(word: str) -> str:
    """The same for one word on the driver."""
    for rules in STEPS:
        for pattern, part, new in rules:
            if re.search(pattern, word):
                word = re.sub(part, new, word, count=1)
                break
    return word


def analyse_words(text: str) -> list[str]:
    """The same for a short query text on the driver."""
    return [stem(w) for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS]
