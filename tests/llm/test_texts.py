"""Quality rules, licenses, main texts and the classifier."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from slidewatch.llm import blocks, licenses, nbsvm, quality_rules
from tests.llm.conftest import order

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeat = set()
    for k, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeat.update((k, k + 1, k + 2))
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    same = sum(line in lines[:k] for k, line in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, same, len(repeat), failed


def test_quality_counts_and_verdicts(docs, no_docs, rows):
    found = quality_rules.judge(docs, sample=5).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for i, t, *_ in rows:
        counts = brute_counts(t)
        kept = not counts[-1] and not any(rule(quality_rules.Reading(t)) for rule in quality_rules.RULES)
        want.append((i, *counts, kept))
    assert order(tuple(x[n] for n in names) for x in found) == order(want)
    left = quality_rules.keep_good(docs, sample=5)
    assert left.columns == docs.columns
    assert order(x["doc_id"] for x in left.collect()) == order(x[0] for x in want if x[-1])
    assert quality_rules.judge(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0


def test_rules_run_by_rejections_per_cost():
    import time

    def dear(r):
        time.sleep(0.002)
        return True

    def cheap(r):
        return len(r.text) % 2 == 0

    def never(r):
        return False

    cascade = quality_rules.Cascade((dear, never, cheap), sample=20)
    for k in range(20):
        cascade.kept(quality_rules.Reading("x" * k))
    assert cascade.rules == [cheap, dear, never]


def test_base_phrases(spark, no_docs):
    texts = [
        None, "", "Released under the MIT License.", "under the mit license under the mit license", "xunder the mit license",
        "Licensed under the Apache-License, Version 2.0", "CC BY-NC 4.0 and under the MIT license", "nothing here",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x for x in licenses.scan(rows).collect()}
    get = lambda k: tuple(found[k][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert get(0) == get(1) == (0, 0, None, None, "")
    assert get(2) == (5, 1, 1, 1, "mit")
    assert get(3) == (8, 2, 0, 4, "mit")
    assert get(4) == (4, 0, None, None, "")
    assert get(5) == (8, 1, 3, 3, "apache-2")
    assert get(6) == (10, 2, 0, 6, "cc-by-nc,mit")
    assert found[7]["score"] == 0 and found[2]["score"] == 1 and found[7]["labels"] == ""
    assert licenses.scan(no_docs).count() == 0


def test_notices_with_typing_errors_are_found_and_others_are_not():
    scanner = licenses.Scanner(licenses.NOTICES)
    r = random.Random(6)
    for notice in licenses.NOTICES:
        for edits in range(notice.edits + 1):
            letters = list(notice.text)
            places = r.sample([k for k, c in enumerate(letters) if c != " " and 0 < k < len(letters) - 1], edits)
            for k in places:
                letters[k] = "z"
            words = ["lorem", *"".join(letters).split(), "ipsum"]
            best = [m for m in scanner.matches([w.encode() for w in words]) if m.label == notice.label]
            assert best and min(m.edits for m in best) <= edits
            assert any(m.start <= 2 and m.stop >= len(words) - 2 for m in best)
    assert not scanner.matches([b"the", b"general", b"reserved", b"rights", b"of", b"all"])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>A title &amp; more</h1><p><b>First   part.<br><p>Second&nbsp;part, longer than the first one, with a sentence. And one more.</p></article>
<footer>&copy; all rights &middot; reserved</footer></body></html>"""


def test_leaves_of_broken_markup():
    found = blocks.leaves(PAGE)
    assert [leaf.text for leaf in found] == [
        "T", "Home", "News", "Buy now.", "A title & more", "First part.",
        "Second part, longer than the first one, with a sentence. And one more.", "© all rights · reserved",
    ]
    assert found[1].linked == 1 and found[5].path == "html>body>article>p"
    assert blocks.leaves(None) == blocks.leaves("") == blocks.leaves("<p><") [:0]
    assert [x.text for x in blocks.leaves("a < b <p class='x>y'>c</p><script>d")] == ["a < b", "c"]


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    z = r.standard_normal((2, 5, 4 * blocks.HIDDEN)).astype(np.float32)
    wh = (r.standard_normal((blocks.HIDDEN, 4 * blocks.HIDDEN)) / 4).astype(np.float32)
    goal = r.standard_normal((2, 5, blocks.HIDDEN)).astype(np.float32)
    loss = lambda z, wh: float((blocks._run(z, wh) * goal).sum())
    kept = []
    blocks._run(z, wh, kept)
    dz, dwh = blocks._back(goal, kept, wh)
    for _ in range(10):
        at = tuple(r.integers(0, s) for s in z.shape)
        more, less = z.copy(), z.copy()
        more[at] += 1e-2
        less[at] -= 1e-2
        assert abs((loss(more, wh) - loss(less, wh)) / 2e-2 - dz[at]) < 2e-3
        at = tuple(r.integers(0, s) for s in wh.shape)
        more, less = wh.copy(), wh.copy()
        more[at] += 1e-2
        less[at] -= 1e-2
        assert abs((loss(z, more) - loss(z, less)) / 2e-2 - dwh[at]) < 1e-2


def test_main_texts_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net = blocks.train(pages)
    found = blocks.extract(pages, net).collect()
    html = {x["page_id"]: x["html"] for x in pages.collect()}
    right = 0
    for x in found:
        inside = html[x["page_id"]].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        want = [leaf.text for leaf in blocks.leaves(inside)]
        right += x["text"] == "\n\n".join(want)
        assert x["n_chars"] == len(x["text"])
    assert right >= 0.99 * len(found)
    # Layouts that training did not see, with known labels.
    r = np.random.default_rng(77)
    read = [blocks.leaves(h) for h in list(html.values())[:60]]
    others = [leaf.text for p in read for leaf in p]
    sure = []
    for page in read:
        other, labels = blocks.laid_out(page, others, r)
        if other:
            sure += ((blocks.chances(net, [blocks.vectors(other)])[0] >= 0.5) == (labels >= 0.5)).tolist()
    assert np.mean(sure) > 0.98
    odd = spark.createDataFrame([(1, None, None, 2), (None, "u", "", 3)], "page_id long, url string, html string, text long")
    assert order(tuple(x) for x in blocks.extract(odd, net).collect()) == order([(1, None, "", 0), (None, "u", "", 0)])
    assert blocks.extract(odd.limit(0), blocks.train(odd)).count() == 0


def test_classifier_on_held_out_rows(spark, docs, no_docs):
    folder = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = nbsvm.train(table, labels, rows=1500)
    scores = nbsvm.score(table.join(labels, "doc_id").where("doc_id % 3 = 0"), model)
    found = scores.join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert np.mean([x["predicted"] == x["quality"] for x in found]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in found)
    # Held-out labels take no part: turned around, they change nothing.
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 4) = 2 then 1 - quality else quality end as quality")
    again = nbsvm.train(table, turned, rows=1500)
    assert np.array_equal(again.weights, model.weights) and again[1:] == model[1:]
    odd = nbsvm.score(docs, model)
    assert odd.count() == docs.count() and nbsvm.score(no_docs, model).count() == 0
    none = nbsvm.train(no_docs, labels.limit(0))
    assert nbsvm.score(docs, none).where("score <> 0.5").count() == 0


def test_all_words_of_a_block_are_in_its_vector():
    head = "word " * 64
    make = lambda tail: blocks.vectors([blocks.Leaf("body>div", head + tail, 0.0)])[0]
    one, other = make("alpha beta gamma."), make("delta kappa sigma.")
    assert (one != other)[blocks.PATH_BINS : -blocks.MEASURES].any()


def sliding_edits(notice, line):
    """Fewest edits of ``notice`` to any stretch of ``line`` between blanks, by the full table of edit distances."""
    starts = [0] + [k + 1 for k, c in enumerate(line) if c == 32]
    stops = {k for k, c in enumerate(line) if c == 32} | {len(line)}
    best = len(notice)
    for start in starts:
        row = list(range(len(notice) + 1))
        for at in range(start, min(len(line), start + len(notice) + 12)):
            above, row = row, [at - start + 1]
            for k, c in enumerate(notice):
                row.append(min(above[k] + (c != line[at]), above[k + 1] + 1, row[k] + 1))
            if at + 1 in stops:
                best = min(best, row[-1])
    return best


def test_notices_are_found_exactly_within_their_edits():
    """Texts with damaged notices, some grown together with other letters, against a table of edit distances over the text."""
    r = random.Random(4)
    scanner = licenses.Scanner(licenses.NOTICES)
    seen = 0
    for _ in range(150):
        notice = r.choice(licenses.NOTICES)
        text = list(notice.text)
        for _ in range(r.randrange(notice.edits + 3)):
            k = r.randrange(len(text))
            text[k : k + 1] = r.choice([[], [text[k], r.choice("abcxyz")], [r.choice("abcxyz")]])
        glue = r.choice([*" " * 5, "é", "x", "ß"])
        words = licenses.folded_words("some words before" + glue + "".join(text) + r.choice([*" " * 5, "é", "q"]) + "and after it")
        line = b" ".join(words)
        want = {n.label for n in licenses.NOTICES if sliding_edits(n.text.encode(), line) <= n.edits}
        assert {m.label for m in scanner.matches(words)} == want, line
        seen += bool(want)
    assert seen > 20


def test_letters_beyond_ascii_belong_to_their_word():
    scanner = licenses.Scanner(licenses.NOTICES)
    for text in ("émozilla public licenseé", "öall rights reservedö", "all rights reservedß"):
        found = scanner.matches(licenses.folded_words(text))
        assert all(m.edits for m in found), text
    assert scanner.matches(licenses.folded_words("é mozilla public license é"))


def test_license_scan_of_odd_rows(spark):
    long = "word " * 20_000 + "under the mit license " + "tail " * 5_000
    rows = [(None, "under the mit license", "a"), (1, None, "b"), (1, None, "b"), (2, long, "c"), (3, "", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, labels string").withColumn("score", F.lit("clash"))
    got = {(x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["base_labels"]) for x in licenses.scan(frame).collect()}
    assert got == {(None, 4, 1, 0, "mit"), (1, 0, 0, None, ""), (2, 25_004, 1, 20_000, "mit"), (3, 0, 0, None, "")}
    assert licenses.scan(frame).count() == 5 and licenses.scan(frame.limit(0)).count() == 0
