"""Token counts at every prefix of a text, by dynamic programming over prefixes.

Byte-pair merging has one property that makes prefixes cheap: the tokens of a prefix that ends at byte i are the tokens of
the prefix that ends where its last token starts, and that last token. A candidate for the last token is right when it and
the last token of the shorter prefix stay apart if merged alone. So ``tokens[i] = tokens[i - len(last[i])] + 1``, and one
pass over a word piece gives the exact count at each of its prefixes.

A table row keeps, for each character, how much the count changes there (one signed byte). ``count_at`` answers how many
tokens a prefix has and ``longest_within`` how much of a text fits a budget, both without encoding again.

The pre-tokenizer cuts a text into pieces first. Cutting the text in two changes pieces only in three places, which are
treated apart: after the first characters of a contraction, in a run of blanks before a word, and in a special token.
Pieces are cached per unit (blanks and the word after them), because a unit's pieces do not depend on its neighbours.

Defined results: null text counts as empty (0 tokens, not over the limit); null doc_id stays; repeated rows give repeated
results; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import accumulate, chain
from os.path import commonprefix

import numpy as np
import regex
from pyspark.sql import DataFrame

from slidewatch.llm.common import Recent, map_rows, pick

#: The published pre-tokenizer pattern of this vocabulary. Fixed value.
PIECES = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: The pieces of it that another cut may split. Fixed value.
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))

UNITS_KEPT = 350_000
RUNS_KEPT = 350_000
PAIRS_KEPT = 1_000_000
_UNIT = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_RUN = re.compile(r"[\t-\r ]{2}")
#: Units whose pieces are a line end, a run of Latin letters, with the blank before it, and the marks after it.
_PLAIN = re.compile(r"(\n(?! ))?( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?$%&*#]*)")
_SPACE = regex.compile(r"\s+")
#: Blanks beyond ASCII, which belong to runs of blanks as well, and separators on which libraries differ.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_letters() -> dict[str, int]:
    """The vocabulary file writes bytes as letters: printable ones as themselves, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ends(text: str) -> list[int]:
    """Bytes before each character and at the end."""
    return [0, *accumulate(len(c.encode("utf-8")) for c in text)]


class PrefixCounter:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special)
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if special else None
        as_bytes = lambda word: bytes(letters[c] for c in word)
        self.vocabulary = {as_bytes(w): k for w, k in spec["model"]["vocab"].items() if w not in special}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[as_bytes(left), as_bytes(right)] = rank
        self.longest = max(map(len, self.vocabulary))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.units = Recent(UNITS_KEPT)
        self.runs = Recent(RUNS_KEPT)
        self.marks: dict[str, bytes] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Tokens of a short string, merged rank by rank."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay apart when their bytes are merged together (left may be empty)."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        known = self.pairs[left, right] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def _prefixes(self, data: bytes, counts: list[int] | None = None, last: list[bytes] | None = None) -> list[int]:
        """Token count of each byte prefix of a piece, the empty one included.

        ``counts`` and ``last`` hold what is known of its first prefixes and are added to. One last token alone is right, so
        starts may be tried in any order: mostly the token before has grown by a byte, or a token begins.
        """
        counts, last = ([0], [b""]) if counts is None or last is None else (counts, last)
        vocabulary, pairs, longest = self.vocabulary, self.pairs, self.longest
        for end in range(len(counts), len(data) + 1):
            grown = end - 1 - len(last[end - 1])
            token = data[grown:end]
            if token in vocabulary:
                apart = pairs.get((last[grown], token))
                if apart is None:
                    apart = self._apart(last[grown], token)
                if apart:
                    counts.append(counts[grown] + 1)
                    last.append(token)
                    continue
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = data[start:end]
                if token in vocabulary and start != grown:
                    apart = pairs.get((last[start], token))
                    if apart is None:
                        apart = self._apart(last[start], token)
                    if apart:
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
        return counts

    def _learn_runs(self, runs: set[str]) -> None:
        """Adds ``runs`` to the cache. In order, each goes on from the prefix that it shares with the one before."""
        counts, last, before = [0], [b""], b""
        for data, run in sorted((r.encode("utf-8"), r) for r in runs):
            same = len(commonprefix((before, data)))
            del counts[same + 1 :], last[same + 1 :]
            self._prefixes(data, counts, last)
            before = data
            ends = counts if len(run) == len(data) else [counts[e] for e in _ends(run)]
            self.runs[run] = bytes([(b - a) & 255 for a, b in zip(ends, ends[1:])])

    def _piece(self, piece: str) -> list[int]:
        """Token count of each character prefix of a piece."""
        counts = self._prefixes(piece.encode("utf-8"))
        if piece.isascii():
            return counts
        return [counts[e] for e in _ends(piece)]

    def _total(self, text: str) -> int:
        return sum(self._prefixes(p.encode("utf-8"))[-1] for p in PIECES.findall(text))

    def _changes(self, text: str) -> bytes:
        """Changes of the count, a byte per character, from the pieces of ``text``."""
        counts, base, pieces = [0], 0, PIECES.findall(text)
        k = 0
        while k < len(pieces):
            blanks = []
            while k < len(pieces) and _SPACE.fullmatch(pieces[k]):
                blanks.append(pieces[k])
                k += 1
            piece = pieces[k] if k < len(pieces) else ""
            k += 1
            shared = 0
            if blanks:  # a prefix that ends in a run of blanks has them as one piece
                shared = int(piece[:1] == " ")
                counts += [base + c for c in self._piece("".join(blanks) + " " * shared)[1:]]
                base += sum(self._total(b) for b in blanks)
            own = [0, *(self._total(piece[:c]) for c in range(1, len(piece) + 1))] if piece in CONTRACTIONS else self._piece(piece)
            counts += [base + c for c in own[shared + 1 :]]
            base += own[-1]
        return np.diff(np.array(counts, np.int64)).astype(np.int8).tobytes()

    def _learn(self, units: set[str]) -> None:
        """Adds ``units`` to the cache; a run of letters and closing marks is put together from its two pieces."""
        plain, runs = [], set()
        for unit in units:
            found = _PLAIN.fullmatch(unit)
            if found:
                line, run, marks = found.groups()
                plain.append((unit, line, run, marks))
                runs.add(run)
            else:
                self.units[unit] = self._changes(unit)
        self._learn_runs(self.runs.absent(runs))
        known, ends = self.runs, self.marks
        begins = self._changes("\n")
        for unit, line, run, marks in plain:
            changes = begins + known[run] if line else known[run]
            if marks:
                if marks not in ends:
                    if len(ends) >= UNITS_KEPT:
                        ends.clear()
                    ends[marks] = self._changes(marks)
                changes += ends[marks]
            self.units[unit] = changes

    def _units_of(self, text: str) -> list[str] | None:
        """A text in units that do not depend on each other; None where other blanks than ASCII ones may join them."""
        if _OTHER_BLANK.search(text):
            return None
        if "\n" in text or _RUN.search(text):
            return _UNIT.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Changes of the count, a byte per character, of texts without special tokens."""
        split = [self._units_of(t) if t else [] for t in texts]
        missing = self.units.absent(chain.from_iterable(u for u in split if u))
        if missing:
            self._learn(missing)
        known = self.units.__getitem__
        return [self._changes(t) if units is None else b"".join(map(known, units)) for t, units in zip(texts, split)]

    def tables(self, texts: list[str]) -> list[bytes]:
        """Changes of the token count at each character of each of ``texts``."""
        special = [bool(self.special_re and self.special_re.search(t)) for t in texts]
        plain = iter(self._plain([t for t, odd in zip(texts, special) if not odd]))
        return [self._with_special(t) if odd else next(plain) for t, odd in zip(texts, special)]

    def table(self, text: str) -> bytes:
        return self.tables([text])[0]

    def _with_special(self, text: str) -> bytes:
        out, at = [], 0
        for found in self.special_re.finditer(text):
            head, name = text[at : found.start()], found.group()
            cut, whole = self._plain([head + name[:-1], head])
            end = int(np.frombuffer(whole, np.int8).sum()) + 1
            out += [cut, (end - int(np.frombuffer(cut, np.int8).sum())).to_bytes(1, "little", signed=True)]
            at = found.end()
        out += self._plain([text[at:]])
        return b"".join(out)


@lru_cache(maxsize=2)
def _counter(file: str) -> PrefixCounter:
    return PrefixCounter(file)


def count_at(prefixes: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    return int(np.frombuffer(prefixes, np.int8, min(n_chars, len(prefixes))).sum())


def longest_within(prefixes: bytes, budget: int) -> int:
    """The most characters whose prefix has at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(prefixes, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_prefixes: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, cut_at and, where wanted, the table ``prefixes``.

    ``cut_at`` is the most characters that stay within ``limit`` tokens.
    """

    def counted(batches):
        counter = _counter(vocabulary)
        for ids, texts in batches:
            texts = [t or "" for t in texts]
            tables = counter.tables(texts)
            counts = [int(np.frombuffer(x, np.int8).sum()) for x in tables]
            cuts = [len(x) if n <= limit else longest_within(x, limit) for x, n in zip(tables, counts)]
            out = ids, [len(t.encode("utf-8")) for t in texts], counts, [n > limit for n in counts], cuts
            yield (*out, tables) if keep_prefixes else out

    rows = pick(docs, _id=id_col, _text=text_col).selectExpr("cast(_id as long)", "_text")
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_at long"
    return map_rows(rows, f"{schema}, prefixes binary" if keep_prefixes else schema, counted)
