"""Byte-level BPE with the tokenizers library, over Arrow batches.

``encode`` gives the token ids of a text and, on request, the characters each token covers; ``decode``
turns ids back into bytes. Both are narrow: no shuffle, no row meets another.

The rank file is turned into a vocabulary and merges once, on the driver; its size is fixed, so it travels
to the tasks with the function. Bytes are mapped to printable characters, as byte-level BPE does; the
table is reversed for decoding.

A text is first cut where the split pattern surely starts a match, such as before a single space that
stands between two non-space characters. The parts tokenise independently, so a part that repeats in a
slice of texts is encoded once and its ids are gathered with array operations; a bounded per-task memory
keeps parts across slices. ``round_trip`` encodes and decodes in one pass, so that a core runs one Python process.

Defined results: a null text counts as empty and has no tokens; repeated rows give repeated rows; other
columns are not carried over, so their names cannot clash; an empty table gives an empty table. Ids that are not in the vocabulary
raise an error in ``decode``.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sensorloom.llm.common import Remembered, packed, pieces, word_codes

REMEMBER = 150_000  # parts in each of the two generations of a task's memory
SLICE_BYTES = 2 << 20
SPACE_NEAR_SPACE = r" [\s\v\x1c-\x1f\x{85}\p{Z}]|[\s\v\x1c-\x1f\x{85}\p{Z}] "
LINE_FEED = re.compile(r"(?<=\S)(\n)(?=\S)")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: apply all earlier merges and see what is left."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks) << 8), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            raise ValueError(f"token {token!r} is not made of earlier tokens")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def tokenizer_json(ranks_path: str, pattern: str) -> str:
    """The tokenizer of a rank file in the library's own format."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, shown = read_ranks(ranks_path), byte_characters()
    show = lambda token: "".join(shown[b] for b in token)
    merges = [tuple(map(show, last_merge(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made.to_str()


@functools.lru_cache(maxsize=4)
def token_bytes(made: str) -> list[bytes | None]:
    """The bytes of each id, by the reversed byte table."""
    value = {c: b for b, c in enumerate(byte_characters())}
    vocab = json.loads(made)["model"]["vocab"]
    out: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(value[c] for c in token)
    return out


class _Encoder:
    """Encodes slices of texts. A part is encoded once per task while it is remembered: its ids packed, and
    with ``offsets`` the starts and ends of its tokens packed likewise."""

    def __init__(self, made: str, offsets: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.offsets = Tokenizer.from_str(made), offsets
        self.known = Remembered(REMEMBER)

    def learn(self, parts: list[str]) -> Iterator[tuple[bytes, ...]]:
        run = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        for e in run(parts, add_special_tokens=False):
            entry = (array("I", e.ids).tobytes(),)
            if self.offsets:
                entry += tuple(array("i", side).tobytes() for side in zip(*e.offsets))
            yield entry

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Ids of all texts, the starts and ends of their tokens, and where each text's ids end."""
        rows, chunks = _chunks(texts)
        codes, distinct = word_codes(chunks)
        parts, n_parts = [], np.zeros(len(distinct), np.int64)
        for i, chunk in enumerate(distinct.to_pylist()):
            own = _parts(chunk)
            parts += own
            n_parts[i] = len(own)
        # Lay the parts of the distinct chunks out flat, then gather the chunks in text order.
        asked = list(dict.fromkeys(parts))
        entry = dict(zip(asked, self.known.get(asked, self.learn)))
        flat = [entry[p] for p in parts]
        part_ids = np.fromiter(map(len, (f[0] for f in flat)), np.int64, len(flat)) // 4
        chunk_of_part = np.repeat(np.arange(len(n_parts)), n_parts)
        n_ids = np.bincount(chunk_of_part, part_ids, len(n_parts)).astype(np.int64)
        taken = n_ids[codes]
        at = np.arange(taken.sum()) + np.repeat((np.cumsum(n_ids) - n_ids)[codes] - (np.cumsum(taken) - taken), taken)
        ends = np.cumsum(np.bincount(rows, taken, len(texts)).astype(np.int64))
        ids = np.frombuffer(b"".join([f[0] for f in flat]), np.uint32)[at]
        if not self.offsets:
            return ids, [], ends
        part_chars = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = np.bincount(chunk_of_part, part_chars, len(n_parts)).astype(np.int64)
        in_chunk = np.cumsum(part_chars) - part_chars - (np.cumsum(chars) - chars)[chunk_of_part]
        all_chars = np.cumsum(chars[codes])
        text_chars = np.bincount(rows, chars[codes], len(texts)).astype(np.int64)
        in_text = all_chars - chars[codes] - (np.cumsum(text_chars) - text_chars)[rows]
        shift = np.repeat(in_chunk, part_ids)[at] + np.repeat(in_text, taken)
        return ids, [np.frombuffer(b"".join([f[i] for f in flat if len(f) > i]), np.int32)[at] + shift for i in (1, 2)], ends


def _chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Cut texts before single spaces between two other characters that are no white space."""
    plain = pc.invert(pc.match_substring_regex(texts, SPACE_NEAR_SPACE))
    if not pc.all(plain).as_py():  # rare: cut every text of this slice with the exact rule
        cut = [BEFORE_SPACE.split(t) if t else [] for t in texts.to_pylist()]
        return np.repeat(np.arange(len(cut)), list(map(len, cut))), pa.array([c for cs in cut for c in cs], pa.string())
    lists = pc.split_pattern(texts, " ")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat, first = lists.flatten(), np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    flat = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise("", flat, " "))
    full = pc.greater(pc.binary_length(flat), 0)
    return rows[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def _parts(chunk: str) -> list[str]:
    """Cut a chunk where the split pattern surely cuts: around a lone line feed, before a full stop or
    comma that ends the chunk after a plain letter."""
    out = []
    for p in LINE_FEED.split(chunk) if "\n" in chunk else [chunk]:
        if len(p) > 1 and p[-1] in ",." and "a" <= p[-2] <= "z":
            out += [p[:-1], p[-1]]
        else:
            out.append(p)
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """``key``, ``ids`` (packed little-endian unsigned 32-bit integers), and with ``offsets`` the arrays
    ``starts`` and ``ends``: the characters of the text that a token covers. A character split over several
    tokens is covered by each of them."""
    made = tokenizer_json(ranks_path, pattern)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(made, offsets)
        for piece in pieces(batches, "text", SLICE_BYTES):
            ids, spans, ends = encoder.encode(pc.fill_null(piece.column("text"), ""))
            at = np.concatenate([[0], ends])
            columns = [piece.column("key"), packed(ids.astype("<u4"), at)]
            if offsets:
                columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s, pa.int32())) for s in spans]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "starts", "ends"][: len(columns)])

    schema = f"`{key}` {kind}, ids binary" + (", starts array<int>, ends array<int>" if offsets else "")
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids``, ``decoded`` (all bytes), ``text`` (the complete characters; bytes that are no UTF-8
    become U+FFFD) and ``tail``: the bytes of a character that the ids cut off at the end. Whoever decodes
    slices of a text puts the tail before the next slice. Null ids count as none."""
    made = tokenizer_json(ranks_path, pattern)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = token_bytes(made)
        for piece in pieces(batches, "ids", SLICE_BYTES):
            yield _decoded(piece.column("key"), piece.column("ids"), values, key)

    return encoded.select(encoded[key].alias("key"), "ids").mapInArrow(run, f"`{key}` {kind}, {DECODED}")


DECODED = "ids binary, decoded binary, text string, tail binary"


def _decoded(keys: pa.Array, ids: pa.Array, values: list[bytes | None], key: str) -> pa.RecordBatch:
    import codecs

    decoded, texts, tails = [], [], []
    for own in ids.to_pylist():
        raw = b"".join([values[i] for i in np.frombuffer(own or b"", "<u4").tolist()])
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        decoded.append(raw)
        texts.append(reader.decode(raw))
        tails.append(reader.getstate()[0])
    return pa.RecordBatch.from_arrays(
        [keys, ids, pa.array(decoded, pa.binary()), pa.array(texts, pa.string()), pa.array(tails, pa.binary())], names=[key, "ids", "decoded", "text", "tail"],
    )


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``decode`` gives for the ids of ``encode``, in one pass over the texts."""
    made = tokenizer_json(ranks_path, pattern)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, values = _Encoder(made, False), token_bytes(made)
        for piece in pieces(batches, "text", SLICE_BYTES):
            ids, _, ends = encoder.encode(pc.fill_null(piece.column("text"), ""))
            yield _decoded(piece.column("key"), packed(ids.astype("<u4"), np.concatenate([[0], ends])), values, key)

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, {DECODED}")
