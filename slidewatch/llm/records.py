"""Token ids in length-delimited binary records, with a separate offset index.

A record file is a run of frames::

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | "\\n"

All numbers are little endian. The payload is ``u8 flags | i64 doc_id | u8 bytes per id | u32 count | ids``; bit 0 of the
flags marks a null doc_id. The mask turns the checksum right by 15 bits and adds a constant, so that a checksum stored in
data that is itself checked does not weaken it. Ids take two bytes where the vocabulary allows, else four. The closing
newline is what Spark's text writer puts after every row: readers go by the lengths, never by newlines.

Files are written and committed by Spark's writer (a lost executor only repeats its tasks) and read by Spark's
``binaryFile`` source, so any store that Spark reaches will do. One range partition of doc_id becomes one file, files and
records ascend by doc_id. The index is a Parquet table with one row per record: file number, record number, doc_id, byte
offset, byte length, first token within the file, token count. A shuffled reader takes any order of index rows and reads
those byte ranges.

Tokens are those of the library for the whole text. White space separates its words before merging (the normaliser and
the word pattern never join characters across a blank), so each distinct word is encoded once by the library and kept in
a bounded cache. Arrow numbers the distinct words of a piece of text, so that Python's work is by distinct word.

Defined results: null text is an empty text (one end id); null doc_id comes first, flagged; rows with one doc_id are
ordered by a hash of their text; repeated rows give repeated records; an empty table gives no records; other columns are
not looked at.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidewatch.llm.common import kept, let_go, map_rows, pick
from slidewatch.session import size_in_bytes

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<BqBI")
_CRC = struct.Struct("<I")

#: Words whose ids a Python worker keeps, twice this at most.
WORDS_KEPT = 300_000

#: Words that the library encodes in one call, whose results take far more memory than the ids.
WORDS_AT_ONCE = 16_384

#: Input of one record file, at most about so much.
FILE_BYTES = 256 * 1024 * 1024

#: Text that is cut into words at once, at most about so much; a longer text on its own. Rows that are handed to that.
PIECE_BYTES = 4 << 20
ROWS_AT_ONCE = 2048

_LETTER = "(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
#: What a byte is to the cutting into words: a blank of ``bytes.split``, a mark, an ASCII letter, the first or second byte of a
#: small Latin letter beyond ASCII, or nothing of these.
_BLANK, _MARK, _ASCII, _FIRST, _SECOND = 1, 2, 3, 4, 5
_KINDS = bytes(
    _BLANK if b in b" \t\n\r\x0b\x0c" else _MARK if b in b".,;:!?$%&*#" else _ASCII if bytes([b]).isalpha() else _FIRST if b == 0xC3
    else _SECOND if 0x9F <= b <= 0xBF and b != 0xB7 else 0
    for b in range(256)
)
#: Lines that are one run of Latin letters, small beyond ASCII, and other lines.
_RUNS = re.compile(f"^(?:({_LETTER}+)|(.*))$".encode("latin-1"), re.MULTILINE)
#: Where this occurs in any case, a text may hold a special token, whose name is not to be lowered.
_SPECIAL = b"<|"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _PAYLOAD.pack(doc_id is None, doc_id or 0, width, len(ids) // width) + ids


def frame(data: bytes) -> bytes:
    """One frame without the newline."""
    length = struct.pack("<Q", len(data))
    return length + _CRC.pack(masked(zlib.crc32(length))) + data + _CRC.pack(masked(zlib.crc32(data)))


def record_ids(data: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    flags, doc, width, n = _PAYLOAD.unpack_from(data)
    return None if flags & 1 else doc, np.frombuffer(data, f"<u{width}", n, _PAYLOAD.size)


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, bytes of the frame, payload) of each frame of a file; raises ValueError where a checksum differs."""
    at = 0
    while at < len(data):
        length, crc = _HEAD.unpack_from(data, at)
        if masked(zlib.crc32(data[at : at + 8])) != crc:
            raise ValueError(f"length of the record at byte {at} is damaged")
        payload = data[at + 12 : at + 12 + length]
        if len(payload) < length or masked(zlib.crc32(payload)) != _CRC.unpack_from(data, at + 12 + length)[0]:
            raise ValueError(f"record at byte {at} is damaged")
        yield at, length + 16, payload
        at += length + 17


class WordEncoder:
    """Ids of a text as bytes, through a cache of words; the library encodes what is not in it.

    Marks are parted from the letters before them and A-Z is lowered in the whole text, which the library does as well, so
    that few different words are left. Each of them is looked up once for some megabytes of text.
    """

    def __init__(self, file: str, width: int, kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.kept = kept
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        """One library call for many short texts."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[bytes]) -> list[bytes]:
        """As ``_encode`` for single runs of letters, encoded as one text: each run ends with a token that ends a word."""
        joined = self.tokenizer.encode_batch_fast([b" ".join(runs).decode()], add_special_tokens=False)[0]
        ids = np.array(joined.ids, self.kind)
        ends = (np.flatnonzero(self.last[ids]) + 1) * ids.itemsize
        if len(ends) != len(runs):
            return self._encode([r.decode() for r in runs])
        data, ends = ids.tobytes(), [0, *ends.tolist()]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = {}
        for at in range(0, len(words), WORDS_AT_ONCE):
            runs, rest = [], []
            for run, other in _RUNS.findall(b"\n".join(words[at : at + WORDS_AT_ONCE])):
                if run:
                    runs.append(run)
                else:
                    rest.append(other)
            if runs:
                found.update(zip(runs, self._encode_runs(runs)))
            if rest:
                found.update(zip(rest, self._encode([w.decode("utf-8", "replace") for w in rest])))
        return found

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of ``words``, each there once. Adds them to the cache, which becomes the older half whenever it is full."""
        ids = list(map(self.old.get, words))
        unknown = [k for k, found in enumerate(ids) if found is None]
        encoded = self._encode_words([words[k] for k in unknown])
        for k in unknown:
            ids[k] = encoded[words[k]]
        step = max(1, min(WORDS_AT_ONCE, self.kept))
        for at in range(0, len(words), step):
            part = words[at : at + step]
            if len(self.words) + len(part) > self.kept:
                self.words, self.old = {}, self.words
            self.words.update(zip(part, ids[at : at + step]))
        return ids

    def texts(self, texts: list[str]) -> list[bytes]:
        out, piece, size = [], [], 0
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            if size + len(data) > PIECE_BYTES and piece:
                out += self._piece(piece)
                piece, size = [], 0
            piece.append(data if _SPECIAL in data else data.lower())
            size += len(data)
        return out + self._piece(piece) if piece else out

    def _piece(self, texts: list[bytes]) -> list[bytes]:
        """Ids of some texts: Arrow numbers their different words, and only those are looked up."""
        words, ends = _words(texts)
        coded = words.dictionary_encode()
        different = _values(coded.dictionary)
        ids = list(map(self.words.get, different))
        gaps = [k for k, found in enumerate(ids) if found is None]
        if gaps:
            for k, found in zip(gaps, self._learn([different[k] for k in gaps])):
                ids[k] = found
        return _values(pa.array(ids, pa.large_binary()).take(coded.indices), np.append(0, ends))


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, and how many there are up to the end of each text.

    Words stand between ASCII blanks, and a mark after a Latin letter begins another one: the word pattern never joins letters
    and marks, so that cut changes no id.
    """
    data = b"\n".join([b"", *texts])
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
    solid = kinds != _BLANK
    begins = np.zeros(len(kinds), bool)
    np.greater(solid[1:], solid[:-1], out=begins[1:])
    marks = np.flatnonzero(kinds == _MARK)
    before = kinds[marks - 1]
    begins[marks[(before == _ASCII) | ((before == _SECOND) & (kinds[marks - 2] == _FIRST))]] = True
    ends = np.searchsorted(np.flatnonzero(begins), np.cumsum([1 + len(t) for t in texts]), side="right")
    letters = np.frombuffer(data, np.uint8)[solid]
    offsets = np.append(np.flatnonzero(begins[solid]), len(letters)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), ends


def _values(array: pa.Array, cuts: np.ndarray | slice = slice(None)) -> list[bytes]:
    """Values of a binary array, or all that stand between two cuts as one. ``to_pylist`` is slower."""
    if not len(array):
        return [] if isinstance(cuts, slice) else [b""] * (len(cuts) - 1)
    _, offsets, data = array.buffers()
    data = bytes(memoryview(data or b""))
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(array.type) else np.int32, len(array) + 1)[cuts].tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


def _encoder(file: str, width: int, words_kept: int) -> WordEncoder:
    return kept(("words", file, width, words_kept), lambda: WordEncoder(file, width, words_kept))


def vocabulary_width(file: str) -> int:
    """Bytes per id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(file).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_records(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None, words_kept: int = WORDS_KEPT, by_id: bool = True,
) -> None:
    """Writes ``path/records`` (frames, ascending by id) and ``path/index`` (Parquet) from every text of ``docs``.

    ``files`` is the number of range partitions, that is of files; by default Spark's number of shuffle partitions, or more
    so that none has above about ``FILE_BYTES`` of input: a reader takes whole files, and those end at 2 GB. Ranges are
    cut by id and hash of the text, so many rows of one id share no file. With ``by_id`` False rows are neither moved nor
    sorted: records stand in the order in which ``docs`` is read, a file per partition, as a mix wants that is shuffled already.
    ``words_kept`` bounds each worker's cache.
    """
    spark = docs.sparkSession
    width = vocabulary_width(vocabulary)
    tail = b"" if end_id is None else int(end_id).to_bytes(width, "little")
    count = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_in_bytes(docs) // FILE_BYTES))

    def framed(batches):
        encoder = _encoder(vocabulary, width, words_kept)
        for ids, texts in batches:
            out = []
            for doc, data in zip(ids, encoder.texts([t or "" for t in texts])):
                out.append(frame(payload(doc, data + tail, width)))
            yield (out,)

    rows = pick(docs, _id=id_col, _text=text_col).select(F.col("_id").cast("long"), "_text")
    if by_id:
        order = [F.col("_id"), F.xxhash64("_text")]
        rows = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    coded = map_rows(rows, "frame binary", framed, rows=ROWS_AT_ONCE)
    coded.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    index = _decode(spark, f"{path}/records").drop("ids_crc32")
    index.write.parquet(f"{path}/index")


def _part_number():
    return F.regexp_extract("path", r"part-(\d+)", 1).cast("long")


def _decode(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files: place, doc_id, ids before it in its file, number and crc32 of its ids."""

    def parsed(batches):
        let_go()  # the files are written, so the encoder has done its work
        for files, contents in batches:
            for number, content in zip(files, contents):
                out, before = [], 0
                for record, (offset, size, data) in enumerate(frames(content)):
                    doc, ids = record_ids(data)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((number, record, doc, offset, size, before, len(ids), crc))
                    before += len(ids)
                yield tuple(zip(*out)) if out else ((),) * 8

    if not _has_files(spark, path):
        return spark.createDataFrame([], _RECORD)
    files = spark.read.format("binaryFile").load(path).select(_part_number().alias("file"), "content")
    return map_rows(files, _RECORD, parsed, rows=1)


_RECORD = (
    "file long, record long, doc_id long, offset long, n_bytes long, local_start long, n_tokens long, ids_crc32 long"
)


def _has_files(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(s.getPath().getName().startswith("part-") for s in system.listStatus(where))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files, checked, with ``start``: all ids of the files before it.

    The running total needs one number per file. Its window has one row per file, not per record.
    """
    rows = _decode(spark, f"{path}/records")
    totals = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    return rows.join(before, "file").select(
        "doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file", "record", "offset",
        "n_bytes",
    )


def read_ids(data: bytes, offset: int, n_bytes: int) -> np.ndarray:
    """Ids of one record, by its row of the index."""
    ((_, _, found),) = frames(data[offset : offset + n_bytes])
    return record_ids(found)[1]
