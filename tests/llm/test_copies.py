"""Substring dedup, SimHash and decontamination against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from slidewatch.llm import fm_index, simhash, super_kmers
from tests.llm.conftest import SCHEMA, order

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_dedup(rows):
    import zlib

    places = sorted(
        {(i is None, i or 0, super_kmers.text_key((t or "").encode()), t or "") for i, t, *_ in rows}
    )
    assert places == sorted(places, key=lambda p: (p[:2], zlib.crc32(p[3].encode()), p[2]))
    seen, out = set(), {}
    for missing, i, _, t in places:
        words = BLANK_WORD.findall(t)
        stay = [True] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                stay[k : k + 20] = [False] * 20
            seen.add(window)
        left = [w for w, s in zip(words, stay) if s]
        out[None if missing else i, t] = (len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return [(i, *out[i, t or ""]) for i, t, *_ in rows]


@pytest.mark.parametrize("buckets", [3, 64])
def test_substring_dedup(docs, rows, buckets):
    found = super_kmers.dedup(docs, buckets=buckets, slots=1024).collect()
    assert order((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found) == order(brute_dedup(rows))


def test_substring_dedup_of_a_hot_passage(spark):
    r = random.Random(8)
    hot = " ".join(f"h{k}" for k in range(30))
    rows = [(k, f"{' '.join(str(r.random()) for _ in range(25))} {hot} {r.random()}", "", "", 0, 0, "") for k in range(300)]
    found = super_kmers.dedup(spark.createDataFrame(rows, SCHEMA), buckets=16, slots=256).collect()
    assert order((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found) == order(brute_dedup(rows))


def test_texts_without_an_id_are_told_apart_when_checksums_collide(spark):
    """Two texts with one CRC-32 and no id: each keeps its own words, and what both share is found."""
    import zlib

    passage = " ".join(f"p{k}" for k in range(25))
    seen, pair = {}, None
    for k in range(400_000):
        text = f"only{k} {passage} " + " ".join(f"q{k}x{j}" for j in range(3))
        crc = zlib.crc32(text.encode())
        if crc in seen:
            pair = (seen[crc], text)
            break
        seen[crc] = text
    assert pair
    rows = [(None, pair[0] + " tail of the first"), (None, pair[1] + " tail of the first"), (None, pair[0]), (None, pair[1]), (7, "x " * 30)]
    assert zlib.crc32(pair[0].encode()) == zlib.crc32(pair[1].encode())
    found = super_kmers.dedup(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3, slots=64).collect()
    assert order((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found) == order(brute_dedup(rows))


def test_substring_dedup_of_nothing(no_docs):
    assert super_kmers.dedup(no_docs).count() == 0


def test_windows_are_compared_by_words_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(super_kmers, "spread_bits", lambda x: x & np.uint64(1))
    lines = [" ".join(f"{c}{k}" for k in range(25)).encode() for c in "aba"]
    held = [d for _, d in super_kmers.packs([1, 2, 3], [0, 0, 0], lines, np.zeros(16, bool), 1)]
    doc, _, start, stop = super_kmers.repeats(held)
    removed = Counter()
    for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist()):
        removed.update((d, k) for k in range(a, b))
    assert set(removed) == {(3, k) for k in range(25)}


def test_word_hashes_are_those_of_the_words(monkeypatch):
    monkeypatch.setattr(super_kmers, "BLOCK", 16)
    words = [b"a", b"b", b"ab", b"ba", b"a", b"x" * 50, b"\xc3\xa9", b"aa", b"x" * 50]
    starts, ends, found = super_kmers.word_hashes(b" ".join(words))
    line = b" ".join(words)
    assert [line[a:b] for a, b in zip(starts, ends)] == words
    assert all((found[i] == found[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def brute_fingerprint(text):
    words = BLANK_WORD.findall(lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=2):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(prints))]


@pytest.mark.parametrize("tree_limit", [4096, 1])
def test_simhash_components(docs, rows, tree_limit):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    want = brute_components(prints, [x[0] for x in rows])
    found = simhash.components(docs, tree_limit=tree_limit).withColumn("hex", simhash.fingerprint_text()).collect()
    assert order((x["doc_id"], x["hex"], x["component_id"]) for x in found) == order(
        (x[0], f"{p:016x}", c) for x, p, c in zip(rows, prints, want)
    )


@pytest.mark.parametrize(("radius", "tree_limit"), [(1, 3), (1, 4096), (2, 3), (2, 4096)])
def test_links_have_the_components_of_all_pairs(spark, radius, tree_limit):
    r = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(14):
            value = centre
            for _ in range(r.randint(0, 4)):
                value ^= 1 << r.randrange(64)
            prints.add(value)
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.connected(simhash.links(frame, radius, tree_limit)).collect()}
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    want = brute_components(prints, list(range(len(prints))), radius)
    groups = lambda labels: {frozenset(k for k, x in enumerate(labels) if x == y) for y in labels}
    assert groups(got) == groups(want)


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(2)
    values = [r.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v, 3)) == sorted({w for w in values if (v ^ w).bit_count() <= 3})


def test_cuts_bound_what_a_bucket_can_hold():
    for radius, left in ((2, 16), (1, 1)):
        masks = simhash.cuts(radius)
        assert all(sum(blocks) == 2**64 - 1 and len(blocks) == radius + 1 for blocks in masks)
        agreed = [0]
        for blocks in masks:
            agreed = [a | m for a in agreed for m in blocks]
        assert max((~a & (2**64 - 1)).bit_count() for a in agreed) <= left


@pytest.mark.parametrize("tree_limit", [4096, 2])
def test_one_of_each_group_stays(docs, no_docs, rows, tree_limit):
    """One row of each component, the one with the least id, whatever the order of ids; equal rows once."""
    kept = simhash.one_of_each(docs, tree_limit=tree_limit)
    assert kept.columns == docs.columns
    left = [(x["doc_id"], x["text"]) for x in kept.collect()]
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    groups = brute_components(prints, list(range(len(rows))))
    want = {}
    for (i, t, *_), group in zip(rows, groups):
        want.setdefault(group, []).append((i is None, i or 0, t))
    assert len(left) == len(want)
    assert order(i for i, _ in left) == order(None if least[0] else least[1] for least in map(min_id, want.values()))
    assert {i for i, _ in left if i} <= {x[0] for x in rows}
    assert simhash.one_of_each(no_docs).count() == 0 and simhash.components(no_docs).count() == 0


def min_id(members):
    return min(x[:2] for x in members)


def test_a_hot_group_of_near_copies_leaves_one(spark):
    """A third of all rows are copies of one text with a changed word; more rows share an id or have none."""
    r = random.Random(11)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    data = []
    for k in range(150):
        own = list(base)
        own[r.randrange(400)] = f"x{k}"
        data.append((500 - k, " ".join(own)))
    data += [(1000 + k, " ".join(f"v{r.randrange(5000)}" for _ in range(60))) for k in range(280)] + [(None, " ".join(base))] * 20
    groups = brute_components([brute_fingerprint(t) for _, t in data], list(range(len(data))))
    kept = simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string").repartition(5), tree_limit=8).collect()
    least = {}
    for (i, _), group in zip(data, groups):
        least[group] = min(least.get(group, (True, 0)), (i is None, i or 0))
    assert order(x["doc_id"] for x in kept) == order(None if none else i for none, i in least.values())


def brute_hits(rows, items, window=10):
    words_of = lambda t: LETTERS.findall(lower(t or ""))
    phrases = []
    for name, text in items:
        words = words_of(text)
        phrases += [(name, words[k : k + window]) for k in range(max(1, len(words) - window + 1)) if words]
    out = []
    for i, t, *_ in rows:
        words = words_of(t)
        hit, names = set(), set()
        for name, phrase in phrases:
            for k in range(len(words) - len(phrase) + 1):
                if words[k : k + len(phrase)] == phrase:
                    hit.update(range(k, k + len(phrase)))
                    names.add("null" if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(names), digest, bool(hit)))
    return out


@pytest.mark.parametrize(("shard_words", "block_words"), [(1 << 18, 1 << 20), (64, 20)])
def test_decontamination(spark, docs, rows, shard_words, block_words):
    passage = LETTERS.findall(lower(next(t for i, t, *_ in rows if i == 3000)))
    items = [(7, " ".join(passage[35:60])), (10, " ".join(passage[50:58])), (9, "Same SAME same"), (8, None), (6, ""), (None, "no id here"), (70, " ".join(passage[35:60]))]
    benchmark = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, count string")
    found = fm_index.hits(docs, benchmark, shard_words=shard_words, block_words=block_words).collect()
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_hits(rows, items)
    assert sum(x[5] for x in want) > 10
    assert order(tuple(x[c] for c in columns) for x in found) == order(want)
    clean = fm_index.without_hits(docs, benchmark, shard_words=shard_words)
    assert clean.columns == docs.columns
    assert order(x["doc_id"] for x in clean.collect()) == order(x[0] for x in want if not x[5])
    assert all(sum(s["stop"] - s["start"] for s in x["spans"]) == x["n_hit"] for x in found)


def test_decontamination_of_nothing(spark, docs, no_docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.hits(docs, benchmark).where("contaminated").count() == 0
    assert fm_index.hits(no_docs, benchmark).count() == 0


def test_suffix_order_and_search():
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (40, 2), (300, 3), (500, 90)):
        symbols = np.concatenate([r.integers(1, kinds + 1, n), [0]])
        want = sorted(range(len(symbols)), key=lambda k: symbols[k:].tolist())
        assert fm_index.suffix_order(symbols).tolist() == want
        index = fm_index.FMIndex(symbols, kinds + 1)
        for _ in range(30):
            at, length = r.integers(0, n), int(r.integers(1, 6))
            pattern = symbols[at : min(n, at + length)]
            low, high = index.search(pattern[None, :], np.array([len(pattern)]))
            places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert places == [k for k in range(n) if symbols[k : k + len(pattern)].tolist() == pattern.tolist()]


def test_spans_are_cut_from_texts():
    text = "One, two; three (four) five."
    assert fm_index.cut_words(text, [(1, 3)]) == "One,  (four) five."
    assert fm_index.merged([(5, 6), (1, 3), (2, 4), (4, 5)]) == [(1, 6)]


def test_decontamination_of_a_document_longer_than_an_index(monkeypatch):
    item = [f"q{k}" for k in range(12)]
    phrases = fm_index.Phrases([("x", " ".join(item))], 10)
    words = [b"w%d" % (k % 700) for k in range(3000)]
    starts = (0, 245, 500, 1018, 2988)
    for at in starts:
        words[at : at + 12] = [w.encode() for w in item]
    monkeypatch.setattr(fm_index, "_INDEX", 10)
    for shard_words in (100, 256, 1 << 20):
        found = fm_index.search_shard([words[:40], words, [], words[40:240]], phrases, shard_words)
        assert found == [([(0, 12)], ["x"]), ([(at, at + 12) for at in starts], ["x"]), ([], []), ([], [])]


def test_one_block_of_the_benchmark_is_held_at_a_time(spark, docs, rows, monkeypatch):
    passage = LETTERS.findall(lower(next(t for i, t, *_ in rows if i == 3000)))
    items = [(k, " ".join(passage[30 + k : 45 + k])) for k in range(8)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    held, most = set(), []
    context = type(spark.sparkContext)
    true = context.broadcast

    def broadcast(self, value):
        sent = true(self, value)
        if isinstance(value, fm_index.Phrases):
            held.add(sent.unpersist)
            most.append(len(held))
            gone = sent.unpersist
            sent.unpersist = lambda *a: (held.discard(gone), gone(*a))
        return sent

    monkeypatch.setattr(context, "broadcast", broadcast)
    clean = fm_index.without_hits(docs, benchmark, block_words=10)
    want = brute_hits(rows, items)
    assert sum(x[5] for x in want) > 5
    assert order(x["doc_id"] for x in clean.collect()) == order(x[0] for x in want if not x[5])
    assert len(most) > 2 and max(most) == 1
