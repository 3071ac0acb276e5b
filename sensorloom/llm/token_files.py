"""Token ids of documents as binary files: a concatenated id array with Elias-Fano coded document boundaries.

``write`` brings the documents into the order of their keys (range partitions), tokenises them where they lie and writes
one file per segment of about ``segment_ids`` ids. A segment holds whole documents. Spark's text writer puts the bytes into files
of any store that Spark can write to; it ends each file with a line feed, which is part of the format.

A file: ``HEAD`` (little-endian), the documents' ends as an Elias-Fano sequence, their keys as another (differences to the
smallest; documents without a key come first and are only counted), then the ids with 2 or 4 bytes each, by the size of the vocabulary. The
head tells how many documents and ids of the same writing task precede the segment. Beside the files, ``index`` holds one row
per writing task with its documents and ids; its running totals turn places within a task into places in the whole array.
Readers carry these totals along: one pair of numbers per task that wrote, whatever the data's size. Making the index takes the first bytes of each file,
for which Spark reads the files once more.

``read`` gives all documents back, in parallel over the files. ``Segment`` reads one document of a file by its number or key, by select
operations on the coded sequences, without unpacking the rest.

The tokenizer may not carry anything over white space: a text is cut at ASCII white space and each distinct piece of a slice is
encoded once. This suits tokenizers that drop white space and normalise within words, as the one of the query does; a test compares with
whole texts.

Defined results: a null text counts as empty and has only the end id (nothing, where ``end_id`` is None); null keys come first; rows with one
key stand in the order of a hash of their texts, and repeated rows one behind the other; an empty table gives an archive without documents;
other columns are not written, so their names cannot clash. The ids of one document have to fit into a cell (2 GB).
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import elias_fano
from sensorloom.llm.bpe import byte_characters
from sensorloom.llm.common import Remembered, gather, packed, pieces, split_words, word_codes

MAGIC = b"SLTOKEF1"
# Magic, id width, writing task, segment of the task, documents, ids, documents and ids of the task before, documents without key, smallest key.
HEAD = "<8sB3xIIQQQQQq"
HEAD_BYTES = struct.calcsize(HEAD)
SEGMENT_IDS = 4 << 20
SLICE_BYTES = 4 << 20
MARKS = ".,;:!?"
PLAIN = f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{MARKS}]?)"  # precomposed letters that stay one character in lower case


NOT_LOWERED = r"<\||\p{M}"  # special tokens, and marks that may join a small letter but not its capital


def takes_plain_letters(tokenizer: str) -> bool:
    """Does a tokenizer (its JSON) only lower such words, split letters from marks, and show bytes as characters?"""
    made = json.loads(tokenizer)
    normal = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
    splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
    known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    return normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and pattern == known


def id_width(tokenizer: str) -> int:
    """Bytes that hold every id of a tokenizer (its JSON)."""
    made = json.loads(tokenizer)
    last = max([*made["model"]["vocab"].values(), *(t["id"] for t in made["added_tokens"])], default=0)
    return 2 if last < 1 << 16 else 4


class WordEncoder:
    """Ids of slices of texts. Each distinct piece between white space is encoded once while it is remembered.

    With ``letters`` a piece of plain letters, or of letters and one mark behind them, goes to the library's merges without
    its normaliser and splitter, which would only lower the letters and part the mark.
    """

    def __init__(self, tokenizer: str, width: int, letters: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.width = Tokenizer.from_str(tokenizer), "H" if width == 2 else "I", width
        self.plain = re.compile(PLAIN if letters else "(?!)")
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.marks = {m: self.whole([m])[0] for m in MARKS} | {"": b""} if letters else {}
        self.known = Remembered()

    def whole(self, pieces_: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces_, add_special_tokens=False)]

    def merge(self, words: Iterator[str]) -> Iterator[bytes]:
        model = self.tokenizer.model
        for w in words:
            shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.shown)
            yield array(self.kind, [t.id for t in model.tokenize(shown)]).tobytes()

    def learn(self, found: list[str]) -> list[bytes]:
        plain = [self.plain.fullmatch(p) for p in found]
        words = self.merge(m[1].lower() for m in plain if m)
        others = iter(self.whole([p for p, m in zip(found, plain) if not m]))
        return [next(words) + self.marks[m[2]] if m else next(others) for m in plain]

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each text, the end id included."""
        if self.marks and not pc.any(pc.match_substring_regex(texts, NOT_LOWERED)).as_py():
            texts = pc.ascii_lower(texts)  # fewer distinct pieces
        rows, words = split_words(texts)
        codes, distinct = word_codes(words)
        entries = self.known.get(distinct.to_pylist(), self.learn)
        lengths = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        ids = gather(np.frombuffer(b"".join(entries), f"<u{self.width}"), lengths, codes)
        counts = np.bincount(rows, lengths[codes], len(texts)).astype(np.int64)
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(texts), end_id, ids.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
        return out, counts + 1


def segment_bytes(keys: list[int | None], counts: np.ndarray, ids: np.ndarray, task: int, number: int, docs_before: int, ids_before: int) -> bytes:
    """One file. ``keys`` ascend, nulls first."""
    nulls = sum(k is None for k in keys)
    known = keys[nulls:]
    least = known[0] if known else 0
    head = struct.pack(HEAD, MAGIC, ids.dtype.itemsize, task, number, len(counts), len(ids), docs_before, ids_before, nulls, least)
    spans = np.array([k - least for k in known], np.uint64)  # Python integers: no overflow between negative and positive keys
    return head + elias_fano.encode(np.cumsum(counts)) + elias_fano.encode(spans) + ids.tobytes()


class Segment:
    """One file's bytes, read in place."""

    def __init__(self, data: bytes):
        magic, self.width, self.task, self.number, self.n_docs, self.n_ids, self.docs_before, self.ids_before, self.nulls, self.least = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends = elias_fano.Sequence(data, HEAD_BYTES)
        self.keys = elias_fano.Sequence(data, self.ends.end)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, self.keys.end)

    def start(self, i: int) -> int:
        """Ids of the file before its i-th document."""
        return self.ends[i - 1] if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.ends[i]]

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys[i - self.nulls] + self.least

    def find(self, key: int) -> range:
        """The numbers of the documents with this key."""
        first, behind = (self.keys.rank(max(0, k - self.least)) for k in (key, key + 1))
        return range(self.nulls + first, self.nulls + behind)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Write an archive below ``path``: ``segments`` and ``index``. ``tokenizer`` is the library's JSON, ``key`` an integer column."""
    width, letters = id_width(tokenizer), takes_plain_letters(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = WordEncoder(tokenizer, width, letters), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        number = docs_before = ids_before = waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number, docs_before, ids_before, waiting
            keys, counts, ids = [k for h in held for k in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = segment_bytes(keys, counts, ids, task, number, docs_before, ids_before)
            held, number, docs_before, ids_before, waiting = [], number + 1, docs_before + len(keys), ids_before + len(ids), 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for piece in pieces(batches, "text", SLICE_BYTES):
            ids, counts = encoder.encode(pc.fill_null(piece.column("text"), ""), end_id)
            keys, at, first = piece.column("key").to_pylist(), np.cumsum(counts), 0
            while first < len(keys):  # as many documents as the segment takes, at least one
                done = int(at[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(at, done + segment_ids - waiting, "right")))
                held.append((keys[first:last], counts[first:last], ids[done : at[last - 1]]))
                waiting += int(at[last - 1]) - done
                first = last
                if waiting >= segment_ids or first < len(keys):
                    yield flush()
        if held:
            yield flush()

    # Rows alike in key and text are spread by their place in the table, so that copies don't meet in one task.
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = own.repartitionByRange(F.asc_nulls_first("key"), "hash", "place").sortWithinPartitions(F.asc_nulls_first("key"), "hash", "place")
    files = ordered.select("key", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(f"{path}/segments")
    _heads(docs.sparkSession, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/segments")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """Documents and ids per writing task, from the first bytes of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack(HEAD, h) for h in batch.column("head").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (2, 4, 5)], names=["task", "docs", "ids"])

    heads = _files(spark, path).select(F.substring("content", 1, HEAD_BYTES).alias("head"))
    return heads.mapInArrow(run, "task long, docs long, ids long").groupBy("task").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``number`` (its place among all documents), ``start`` (ids before it in the whole array), ``n_tokens`` and ``ids`` (packed
    little-endian unsigned 32-bit integers) of every document of an archive."""
    index = spark.read.parquet(f"{path}/index").orderBy("task").toPandas()  # one row per writing task
    before = {int(t): (int(d), int(i)) for t, d, i in zip(index["task"], index["docs"].cumsum() - index["docs"], index["ids"].cumsum() - index["ids"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = Segment(batch.column("content")[i].as_buffer())
                docs, ids = before[found.task]
                ends, keys = found.ends.all(), [None] * found.nulls + [k + found.least for k in found.keys.all().tolist()]
                for first in range(0, found.n_docs, 1024):
                    last = min(first + 1024, found.n_docs)
                    begin = int(ends[first - 1]) if first else 0
                    borders = np.concatenate([[begin], ends[first:last]])
                    starts = borders[:-1] + found.ids_before + ids
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[first:last], pa.int64()), pa.array(np.arange(first, last) + found.docs_before + docs), pa.array(starts), pa.array(np.diff(borders)),
                        packed(found.ids[begin : borders[-1]].astype("<u4"), borders - begin),
                    ], names=["doc_id", "number", "start", "n_tokens", "ids"])

    return _files(spark, path).select("content").mapInArrow(run, "doc_id long, number long, start long, n_tokens long, ids binary")
