import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slidewatch.llm import records, token_counts
from slidewatch.session import work_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
WORD_LIBRARY, BYTE_LIBRARY = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
COUNTER = token_counts.PrefixCounter(BYTES)
ENCODER = records.WordEncoder(WORDS, 2)
BITS = [
    "don't", "we've", "''s", "'", "'r", "  ", "   ", "\n", " \n ", "\t", "abc", " the", "123", "é", "ß", "ÉCOLE", "Σ", "ΑΣ ", "İ", " ",
    " ", "\x1c", "\x85", "​", "😀", "<|endoftext|>", "<|endoftext|", "<|startoftext|>", " ", "…", "###", "$$$", "x" * 30, "é",
    "́", "漢字", "１２", "\r\n", "ſ", "ﬁ", "½", "_", "\x00",
]


def library_count(text):
    return len(BYTE_LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_at_every_prefix_are_those_of_the_library():
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(BITS) for _ in range(r.randint(0, 9)))
        table = COUNTER.table(text)
        assert [token_counts.count_at(table, k) for k in range(len(text) + 1)] == [library_count(text[:k]) for k in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_any_text_has_the_library_s_tokens(text):
    assert token_counts.count_at(COUNTER.table(text), len(text)) == library_count(text)
    assert np.frombuffer(ENCODER.texts([text])[0], "<u2").tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def word_ids(encoder, texts):
    return [np.frombuffer(ids, "<u2").tolist() for ids in encoder.texts(texts)]


def library_ids(texts):
    return [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_texts_in_pieces_have_the_library_s_tokens(monkeypatch):
    r = random.Random(6)
    marks = [*".,;:!?$%&*#", "é", "É", "ö.", "×.", "÷,", "Ã", "a.b,c", "e\u0301."]
    texts = ["".join(r.choice(BITS + marks) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["", "a" * 300, " ", ""]
    want = library_ids(texts)
    for size in (1, 60, 4 << 20):
        monkeypatch.setattr(records, "PIECE_BYTES", size)
        for kept in (1, 20, 1000):
            assert word_ids(records.WordEncoder(WORDS, 2, kept), texts) == want
    assert ENCODER.texts([]) == [] and ENCODER.texts(["", ""]) == [b"", b""]


def test_each_different_word_of_a_piece_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    encoder = records.WordEncoder(WORDS, 2)
    encoder.words = Counted()
    texts = ["one word, and one Word more. " * 50] * 20
    assert word_ids(encoder, texts) == library_ids(texts)
    assert 0 < encoder.words.asked <= 6


def test_a_full_cache_stays_within_its_bound_and_words_of_both_halves_are_not_encoded_again():
    encoder = records.WordEncoder(WORDS, 2, 50)
    texts = [" ".join(f"w{k}" for k in range(at, at + 40)) for at in range(0, 400, 40)]
    assert word_ids(encoder, texts) == library_ids(texts)
    assert len(encoder.words) <= 50 and len(encoder.old) <= 50

    encoder = records.WordEncoder(WORDS, 2, 4)
    encoder.texts(["a b c"])
    encoder.texts(["d e"])
    encode, encoded = encoder._encode_words, []
    encoder._encode_words = lambda words: encoded.extend(words) or encode(words)
    texts = ["a b c f g h"]
    assert word_ids(encoder, texts) == library_ids(texts)
    assert encoded == [b"f", b"g", b"h"]


def test_budgets_are_answered_without_encoding():
    text = "Then the thernd edtioned, and 12 more\n\nwords don't fit."
    table = COUNTER.table(text)
    for budget in range(library_count(text) + 2):
        cut = token_counts.longest_within(table, budget)
        assert library_count(text[:cut]) <= budget
        assert all(library_count(text[:k]) > budget for k in range(cut + 1, len(text) + 1))


def test_counts_of_a_table(docs, no_docs, rows):
    found = token_counts.prefix_counts(docs, BYTES, limit=100).collect()
    want = sorted(
        ((i, len((t or "").encode()), n := library_count(t or ""), n > 100) for i, t, *_ in rows), key=repr
    )
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in found), key=repr) == want
    assert all(len(x["prefixes"]) >= x["cut_at"] for x in found)
    assert token_counts.prefix_counts(no_docs, BYTES).count() == 0


def test_records_round_trip(spark, docs, rows):
    path = work_path(spark, "test_records")
    records.write_records(docs, path, WORDS, end_id=1, files=3)
    found = records.read_records(spark, path).orderBy("start").collect()
    want = {}
    for i, t, *_ in rows:
        ids = [*WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    start = 0
    for x in found:
        assert x["start"] == start
        start += x["n_tokens"]
        got.setdefault(x["doc_id"], []).append((x["n_tokens"], x["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [x["doc_id"] for x in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    index = {(x["file"], x["record"]): x for x in spark.read.parquet(f"{path}/index").collect()}
    files = {int(r["path"].rsplit("part-", 1)[1][:5]): bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{path}/records").collect()}
    for x in found:  # a shuffled reader goes by the index alone
        row = index[x["file"], x["record"]]
        ids = records.read_ids(files[x["file"]], row["offset"], row["n_bytes"])
        assert zlib.crc32(ids.astype("<u4").tobytes()) == x["ids_crc32"]


def test_no_documents_give_no_records(spark, no_docs):
    path = work_path(spark, "test_no_records")
    records.write_records(no_docs, path, WORDS)
    assert records.read_records(spark, path).count() == 0


def test_damage_is_found():
    data = records.frame(records.payload(7, b"\x01\x00", 2)) + b"\n"
    assert [records.record_ids(p)[0] for _, _, p in records.frames(data)] == [7]
    for k in range(len(data) - 1):
        broken = bytearray(data)
        broken[k] ^= 4
        with pytest.raises(ValueError):
            list(records.frames(bytes(broken)))
