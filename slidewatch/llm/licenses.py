"""License notices in texts, exact and with a few typing errors.

Words are runs of letters and digits, A-Z lowered, joined by one blank. Base phrases are looked for exactly, at word
starts. The method finds short notices with up to ``edits`` insertions, deletions or substitutions: a notice is cut into
``edits + 1`` seeds, of which at least one must occur unchanged (pigeonhole), and only around such a place the ``regex``
library's bounded-error matching decides, and reports the span and its edits.

Defined results: null and empty texts have no words, no labels and score 0; null doc_id stays; repeated rows give repeated
results; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame

from slidewatch.llm.common import folded_words, map_rows, pick

#: Base phrases and their labels. Fixed values.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


class Notice(NamedTuple):
    text: str
    label: str
    edits: int


NOTICES = (
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("released under the mit license", "mit", 2),
    Notice("licensed under the mit license", "mit", 2),
    Notice("licensed under the apache license version 2", "apache-2", 3),
    Notice("licensed under cc by nc", "cc-by-nc", 1),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3),
    Notice("licensed under the gnu general public license", "gpl", 3),
    Notice("redistribution and use in source and binary forms", "bsd", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("all rights reserved", "all-rights-reserved", 1),
)


class Match(NamedTuple):
    label: str
    start: int
    stop: int
    edits: int
    score: float


def base_places(words: list[bytes], phrases=BASE) -> list[tuple[int, str]]:
    """(first word, label) of every exact occurrence, overlapping ones included."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        wanted, at = b" " + phrase.encode() + b" ", -1
        while (at := line.find(wanted, at + 1)) >= 0:
            found.append((line.count(b" ", 0, at), label))
    return found


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = []
        for n in notices:
            size, k = len(n.text), n.edits + 1
            cuts = [round(j * size / k) for j in range(k + 1)]
            seeds = [(n.text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]
            pattern = regex.compile(rb"(?b)(?:%b){e<=%d}" % (regex.escape(n.text).encode(), n.edits))
            self.notices.append((n, seeds, pattern))

    def matches(self, words: list[bytes]) -> list[Match]:
        """Spans (in words) of notices within their edits. Of spans that overlap the one with the fewest edits stays.

        A seed shows where a notice may begin, give or take its edits. Every stretch of whole words from there that is as long
        as the notice, give or take, is matched as a whole, for which the library finds the fewest edits.
        """
        line = b" ".join(words)
        found = []
        for notice, seeds, pattern in self.notices:
            size, slack = len(notice.text), notice.edits
            places = set()
            for seed, offset in seeds:
                at = line.find(seed)
                while at >= 0:
                    places.add(at - offset)
                    at = line.find(seed, at + 1)
            spans = {
                (start, stop) for place in places for start in self._edges(line, place - slack, place + slack, 1)
                for stop in self._edges(line, start + size - slack, start + size + slack, 0) if stop > start
            }
            fits = []
            for start, stop in spans:
                m = pattern.fullmatch(line, start, stop)
                if m:
                    fits.append((sum(m.fuzzy_counts), start, stop))
            taken: list[tuple[int, int]] = []
            for edits, start, stop in sorted(fits):
                k = bisect_left(taken, (start, stop))
                if (not k or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= stop):
                    taken.insert(k, (start, stop))
                    first = line.count(b" ", 0, start)
                    found.append(Match(notice.label, first, first + line.count(b" ", start, stop) + 1, edits, 1 - edits / size))
        return sorted(set(found))

    @staticmethod
    def _edges(line: bytes, low: int, high: int, after: int) -> list[int]:
        """Places from ``low`` to ``high`` where a word ends, or begins where ``after`` is 1."""
        low, high = max(0, low), min(len(line), high)
        end = 0 if after else len(line)
        edges = [end] if low <= end <= high else []
        at = line.find(b" ", max(0, low - after), high + 1 - after)
        while at >= 0:
            edges.append(at + after)
            at = line.find(b" ", at + 1, high + 1 - after)
        return edges


@lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan(
    docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: base counts and labels, all labels, score, and the spans of the fuzzy matches.

    The score is 1 for an exact base phrase, else one less the share of edits of the best match, else 0.
    """

    def scanned(batches):
        scanner = _scanner(notices)
        for ids, texts in batches:
            rows = []
            for doc, text in zip(ids, texts):
                words = folded_words(text)
                base = base_places(words)
                fuzzy = scanner.matches(words)
                starts = [p for p, _ in base]
                own = {label for _, label in base}
                labels = own | {m.label for m in fuzzy}
                score = 1.0 if base else max((m.score for m in fuzzy), default=0.0)
                spans = [{"label": m.label, "start": m.start, "stop": m.stop, "edits": m.edits} for m in fuzzy]
                rows.append((
                    doc, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(own)), ",".join(sorted(labels)), score, spans,
                ))
            yield tuple(zip(*rows)) if rows else ((),) * 9

    rows = pick(docs, _id=id_col, _text=text_col).selectExpr("cast(_id as long)", "_text")
    return map_rows(
        rows,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,start:long,stop:long,edits:long>>",
        scanned,
    )
