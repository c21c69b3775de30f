"""Quality rules as a short-circuit cascade.

Each rule rejects a document on one reading of it. A task first tries all rules on its first documents, measures what each
rule costs and how many it rejects, and then runs them by rejections per second: a document stops at the first rule that
rejects it. A rule with no rejection in the sample goes last, cheapest first. The order changes the cost only: a document
is kept when no rule rejects it, in any order, so results do not depend on the sample or the clock.

Readings that several rules share (words, lines) are taken once per document.

Defined results: null and empty texts have no words and fail ``few_words``; null doc_id stays; repeated rows give
repeated results; other columns are not looked at.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from slidewatch.llm.common import WORD_RE, let_go, map_rows, pick

#: ASCII characters that ``str.split`` takes as blanks and the contract does not.
_SEPARATOR = re.compile("[\x1c-\x1f]")

SYMBOLS = "#*$%&|<>"
#: Documents on which a task measures its rules.
SAMPLE = 200


class Reading:
    """What rules read of one text, each reading taken at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        if self.text.isascii() and not _SEPARATOR.search(self.text):
            return self.text.split()
        return WORD_RE.findall(self.text)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if WORD_RE.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        total, free = 0, 0
        for at, window in enumerate(windows):
            if found[window] > 1:
                total += at + 3 - max(at, free)
                free = at + 3
        return total

    @cached_property
    def top_share(self) -> float:
        return Counter(self.words).most_common(1)[0][1] / len(self.words) if self.words else 0.0


def few_words(r: Reading) -> bool:
    return len(r.words) < 50


def repeated_windows(r: Reading) -> bool:
    return 100 * r.n_repeat_words > 50 * len(r.words)


def symbols(r: Reading) -> bool:
    return 100 * r.n_symbols > 5 * r.word_chars


def shouting(r: Reading) -> bool:
    return 10 * sum(len(w) > 1 and w.isupper() for w in r.words) > 3 * len(r.words)


def repeated_lines(r: Reading) -> bool:
    return 2 * r.n_dup_lines > len(r.lines)


def one_word(r: Reading) -> bool:
    return r.top_share > 0.3


def word_length(r: Reading) -> bool:
    return not 2 * len(r.words) <= r.word_chars <= 25 * len(r.words)


def few_letters(r: Reading) -> bool:
    return 10 * sum(not any(map(str.isalpha, w)) for w in r.words) > 4 * len(r.words)


Rule = Callable[[Reading], bool]
BASE: tuple[Rule, ...] = (few_words, repeated_windows)
RULES: tuple[Rule, ...] = (symbols, shouting, repeated_lines, one_word, word_length, few_letters)


class Cascade:
    """Rules in an order that is measured on the first ``sample`` documents."""

    def __init__(self, rules: tuple[Rule, ...], sample: int = SAMPLE):
        self.rules, self.left = list(rules), sample
        self.seconds = dict.fromkeys(rules, 0.0)
        self.rejected = dict.fromkeys(rules, 0)

    def kept(self, reading: Reading) -> bool:
        if self.left <= 0:
            return not any(rule(reading) for rule in self.rules)
        self.left -= 1
        verdict = True
        for rule in self.rules:
            # A fresh reading: a rule that comes first pays for what it reads.
            began = time.perf_counter()
            if rule(Reading(reading.text)):
                self.rejected[rule] += 1
                verdict = False
            self.seconds[rule] += time.perf_counter() - began
        if not self.left:
            self.rules.sort(key=lambda r: (-self.rejected[r] / max(self.seconds[r], 1e-9), self.seconds[r]))
        return verdict


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: its counts, base_failed, and kept (false if base_failed, else the cascade's verdict)."""

    def judged(batches):
        cascade = Cascade(rules, sample)
        for ids, texts in batches:
            rows = []
            for doc, text in zip(ids, texts):
                r = Reading(text)
                failed = any([rule(r) for rule in base])
                kept = not failed and cascade.kept(r)
                rows.append((doc, len(r.words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, failed, kept))
            yield tuple(zip(*rows)) if rows else ((),) * 8

    rows = pick(docs, _id=id_col, _text=text_col).selectExpr("cast(_id as long)", "_text")
    return map_rows(
        rows,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean",
        judged,
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; nothing is counted that no rule asks for."""
    place = docs.columns.index(text_col)

    def filtered(batches):
        let_go()
        cascade = Cascade(rules, sample)
        for batch in batches:
            keep = [cascade.kept(Reading(t)) for t in batch.column(place).to_pylist()]
            yield batch.filter(_mask(keep))

    return docs.mapInArrow(filtered, docs.schema)


def _mask(keep: list[bool]):
    import pyarrow as pa

    return pa.array(keep, pa.bool_())
