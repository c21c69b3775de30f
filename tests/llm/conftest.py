from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, words string"


def sample_rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, repeated rows, nulls, empty and long texts, and odd blanks."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["The", "the", "Ünder", "naïve", "a", "x-y", "MIT", "don't", "漢字", "😀"]

    def text(k: int) -> str:
        return " ".join(r.choice(vocabulary) for _ in range(k))

    rows = [(k, text(r.randint(0, 120))) for k in range(n)]
    base = text(200)
    rows += [(1000 + k, base) for k in range(8)]
    words = base.split()
    for k in range(6):
        own = list(words)
        own[20 * k + 5] = f"changed{k}"
        rows.append((2000 + k, " ".join(own)))
    passage = text(60)
    rows += [(3000 + k, f"{text(30)}\n{passage}\n{text(25)}") for k in range(10)]
    rows += [
        (4000, None), (4001, ""), (4002, "  \t \n "), (4003, "word"), (4004, "same " * 90), (4005, "same " * 90),
        (4006, text(5000)), (4007, "a b c\x1cd  e"), (4008, "<|endoftext|> x <|startoftext|>"), (4009, "İstanbul ΑΣ é"),
        (4010, "line one\nline one\nline one\n\nline two"), (None, "no id here " * 10), (None, base), (None, None),
    ]
    rows += [rows[3], rows[3], (5, "another text with the number of an earlier document " * 3)]
    sources = ["s1", "s1", "s1", "s2", "s3", None]
    return [(i, t, "en", sources[k % len(sources)], None if t is None else len(t), k, "clash") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def order(values):
    return sorted(values, key=repr)
