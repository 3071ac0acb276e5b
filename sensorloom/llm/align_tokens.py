"""Alignment of two tokenizers' tokens on the same text: a byte-level BPE (A) and a sentencepiece model (B).

Both libraries say which part of the text a token covers: tokenizers in characters, sentencepiece in its immutable proto (the
installed version calls it ``proto``) in bytes. Those spans are coarse cuts: A's tokens that share a character have one span, and of B's byte
pieces for a character only the last has a span. Between the cuts the places come from the bytes that the tokens decode to. A place where
both have an end closes a group; two tokens whose bytes overlap are linked.

A text is cut into chunks before each single space between two other characters that are no white space. No piece of
either vocabulary goes on over such a place, so chunks tokenise as in the whole text (``check_pieces`` tests B's
vocabulary for it), and each distinct chunk of a slice is worked on once.

``align`` gives ids, ends and groups per document. ``agreement`` judges each link by how often its pair of ids is
linked in the whole corpus. A task counts the pairs of a slice of documents first; what is shuffled is one row per slice and
distinct pair, and a short list of (pair of the slice, times) per document. Corpus counts come back to the slices by a join, and a slice's
documents meet them in one group, which the slice's size bounds.

Defined results: a text that is null or empty, or that one of the tokenizers doesn't give back byte by byte, has no tokens and zeros; special
tokens' strings are plain text; null keys and repeated rows give rows of their own; other columns are not carried over, so their names
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.bpe import _chunks as chunks_of
from sensorloom.llm.bpe import byte_characters
from sensorloom.llm.common import Remembered, gather, packed, pieces, stage, word_codes

SLICE_BYTES = 2 << 20
MARKS = ".,;:!?"
PLAIN = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
REMEMBER = 200_000  # parts in each of the two generations of a task's memory
SPACE = "▁"


def check_pieces(model: bytes) -> None:
    """Raise if a piece of B has a space after another character: chunks would not be independent."""
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} goes on over a space")


class Aligner:
    """Tokens, byte ends and groups of chunks. Each chunk begins with a space."""

    def __init__(self, tokenizer: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(tokenizer), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        value = {c: bytes([i]) for i, c in enumerate(byte_characters())}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values(), default=-1) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = b"".join([value.get(c, c.encode()) for c in token])
        size = self.b.get_piece_size()
        self.byte_ids = {i for i in range(size) if self.b.is_byte(i)}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if i in self.byte_ids else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        # A mark behind a letter is a part of its own where no piece of B holds the two side by side; A's splitter parts them anyway.
        joined = "\n".join(map(self.b.id_to_piece, range(size)))
        self.marks = {m for m in MARKS if not re.search(rf"[A-Za-zÀ-ÖØ-öø-ÿ]{re.escape(m)}", joined) and self.b.id_to_piece(self.b.piece_to_id(m)) == m}
        self.known = Remembered(REMEMBER)

    def a_ends(self, chunk: str, ids: list[int], spans: list[tuple[int, int]]) -> list[int]:
        if chunk.isascii():
            return [end for _, end in spans]
        place = [0]
        for c in chunk:
            place.append(place[-1] + len(c.encode()))
        out, done = [], 0
        for i, (token, (_, end)) in enumerate(zip(ids, spans)):
            shared = i + 1 < len(spans) and spans[i + 1][0] < end  # the next token has a part of the last character
            done = done + len(self.a_bytes[token]) if shared else place[end]
            out.append(done)
        return out

    def b_ends(self, ids: list[int], ends: list[int]) -> list[int]:
        """``ends`` count the bytes of the text that B gets, which lacks the space in front."""
        if self.byte_ids.isdisjoint(ids):
            return [end + 1 for end in ends]
        out, done = [], 0
        for i, end in zip(ids, ends):
            done = done + 1 if i in self.byte_ids else end + 1
            out.append(done)
        return out

    def a_tokens(self, parts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """A's ids and byte ends of each part. A space and letters are one match of A's splitter, so their bytes go to the merges as they are."""
        tokenize, space, plain = self.a.model.tokenize, self.shown[32], [PLAIN.fullmatch(p) is not None for p in parts]
        others = [p for p, known in zip(parts, plain) if not known]
        encoded = iter(zip(others, self.a.encode_batch(others, add_special_tokens=False)))
        for part, known in zip(parts, plain):
            if not known:
                part, e = next(encoded)
                yield e.ids, self.a_ends(part, e.ids, e.offsets)
            elif part.isascii():
                found = tokenize(space + part[1:])  # spans in bytes of what is shown: two for the space
                yield [t.id for t in found], [t.offsets[1] - 1 for t in found]
            else:
                shown = part.encode().decode("latin-1").translate(self.shown)
                found, raw = tokenize(shown), shown.encode()  # a character is shown for each byte of the part
                yield [t.id for t in found], [len(raw[: t.offsets[1]].decode()) for t in found]

    def b_tokens(self, parts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """B's ids and byte ends of each part."""
        for part, b in zip(parts, self.b.encode([p[1:] for p in parts], return_type="proto", num_threads=1)):
            if len(part) == 1:  # a space at the end, for which B gets nothing, or a mark
                yield [self.b.piece_to_id(SPACE if part == " " else part)], [1]
            else:
                found = list(b.pieces)
                ids = [p.id for p in found]
                yield ids, self.b_ends(ids, [p.end for p in found])

    def learn(self, parts: list[str]) -> Iterator[bytes]:
        """Of each part, packed: the number of A's tokens; A's ids, B's ids, A's ends, B's ends. No ids if bytes are lost."""
        raw = [p.encode() for p in parts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        kept, sides = np.ones(len(parts), bool), []
        for tokens, decoded in ((self.a_tokens, self.a_bytes), (self.b_tokens, self.b_bytes)):
            n, ids, ends = array("q"), array("I"), array("I")
            for own, at in tokens(parts):
                n.append(len(own))
                ids.extend(own)
                ends.extend(at)
            found = [decoded[i] for i in ids]
            n, length = np.frombuffer(n, np.int64), np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
            last = np.cumsum(n)
            if not (np.array_equal(length[last] - length[last - n], size) and b"".join(found) == b"".join(raw)):
                kept &= [b"".join(found[s:e]) == r for s, e, r in zip((last - n).tolist(), last.tolist(), raw)]
            sides.append((n, np.frombuffer(ids, np.uint32), np.frombuffer(ends, np.uint32)))
        (n_a, a_ids, a_ends), (n_b, b_ids, b_ends) = sides
        width = 1 + 2 * (n_a + n_b)
        first = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[first] = n_a
        for n, values, start in ((n_a, a_ids, first + 1), (n_b, b_ids, first + 1 + n_a), (n_a, a_ends, first + 1 + n_a + n_b), (n_b, b_ends, first + 1 + 2 * n_a + n_b)):
            out[np.arange(len(values)) + np.repeat(start - (np.cumsum(n) - n), n)] = values
        data = out.tobytes()
        for s, e, whole in zip((4 * first).tolist(), (4 * (first + width)).tolist(), kept.tolist()):
            yield data[s:e] if whole else bytes(4)

    def slice(self, texts: pa.Array) -> "Aligned":
        """The tokens of a slice of texts (no nulls)."""
        rows, chunks = chunks_of(texts)
        first = np.ones(len(rows), bool)
        first[1:] = rows[1:] != rows[:-1]
        chunks = pc.if_else(pa.array(first), pc.binary_join_element_wise(" ", chunks, ""), chunks)
        codes, distinct = word_codes(chunks)
        marked = pc.match_substring_regex(distinct, f"^{PLAIN.pattern}[{re.escape(''.join(sorted(self.marks)))}]$") if self.marks else pa.array(np.zeros(len(distinct), bool))
        heads = pc.if_else(marked, pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
        part_of, parts = word_codes(pa.concat_arrays([heads, pc.utf8_slice_codeunits(distinct.filter(marked), -1)]))
        two = marked.to_numpy(zero_copy_only=False)
        lengths = 1 + two.astype(np.int64)
        flat = np.empty(int(lengths.sum()), np.int64)
        flat[np.cumsum(lengths) - lengths] = part_of[: len(distinct)]
        flat[np.cumsum(lengths)[two] - 1] = part_of[len(distinct) :]
        return Aligned(self.known.get(parts.to_pylist(), self.learn), gather(flat, lengths, codes), np.repeat(rows, lengths[codes]), len(texts))


class Aligned:
    """A slice of texts: the distinct chunks' tokens laid out one behind the other, and the chunks of each text."""

    def __init__(self, entries: list[bytes], codes: np.ndarray, rows: np.ndarray, n: int):
        words = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        flat = np.frombuffer(b"".join(entries), np.uint32).astype(np.int64)
        tokens = (words - 1) // 2
        keep = ~np.isin(rows, rows[(tokens == 0)[codes]])  # not one token of a text that lost bytes
        self.codes, self.rows, self.n = codes[keep], rows[keep], n
        self.n_a = flat[np.cumsum(words) - words]
        self.n_b = tokens - self.n_a
        # Each entry holds the number of A's tokens, A's ids, B's ids, A's ends, B's ends.
        lengths = np.stack([np.ones_like(words), self.n_a, self.n_b, self.n_a, self.n_b], 1)
        kind = np.repeat(np.tile(np.arange(5), len(entries)), lengths.ravel())
        self.a_ids, self.b_ids, self.a_ends, self.b_ends = (flat[kind == k] for k in range(1, 5))
        self.size = np.zeros(len(entries), np.int64)
        self.size[tokens > 0] = self.a_ends[np.cumsum(self.n_a)[tokens > 0] - 1]

    def per_text(self, of_chunk: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, of_chunk[self.codes], self.n).astype(np.int64)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of A's and B's tokens, counted over all distinct parts laid out one behind the other."""
        shift = np.cumsum(self.size) - self.size
        return self.a_ends + np.repeat(shift, self.n_a), self.b_ends + np.repeat(shift, self.n_b)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The links of the distinct parts, as A id << 32 | B id, and their number per part. Every stretch between two neighbouring
        ends lies in one token of each side, and tokens that overlap do so in one stretch."""
        a, b = self.places()
        ends = np.concatenate([a, b])
        ends.sort(kind="stable")
        ends = _distinct(ends)
        pairs = self.a_ids[np.searchsorted(a, ends)] << 32 | self.b_ids[np.searchsorted(b, ends)]
        part = np.searchsorted(np.cumsum(self.size), ends)  # an end belongs to the first part that reaches it
        return pairs, np.bincount(part, minlength=len(self.size)).astype(np.int64)

    def group_texts(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` per text: the ids of each group, in order."""
        a, b = self.places()
        both = _distinct(a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]) if len(b) else b
        sides = [_joined(pa.array(ids).cast(pa.string()), np.searchsorted(at, both, "right"), ",") for ids, at in ((self.a_ids, a), (self.b_ids, b))]
        groups = pc.binary_join_element_wise(*sides, "|")
        of_parts = _joined(groups, np.searchsorted(both, np.cumsum(self.size), "right"), ";")
        return _joined(of_parts.take(pa.array(self.codes)), np.searchsorted(self.rows, np.arange(1, self.n + 1)), ";")


def _distinct(ascending: np.ndarray) -> np.ndarray:
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return ascending[new]


def _joined(strings: pa.Array, ends: np.ndarray, separator: str) -> pa.Array:
    """Join the strings up to each end, beginning at the end before."""
    at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(at, strings), separator)


def align(docs: DataFrame, tokenizer: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``a_ids``, ``b_ids``, ``a_ends``, ``b_ends`` (packed little-endian unsigned 32-bit integers; ends count the bytes of a
    space and the text) and ``groups``."""
    check_pieces(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer, model)
        for piece in pieces(batches, "text", SLICE_BYTES):
            found = aligner.slice(pc.fill_null(piece.column("text"), ""))
            chunk_at = np.cumsum(found.size[found.codes]) - found.size[found.codes]
            text_size = found.per_text(found.size)
            in_text = chunk_at - (np.cumsum(text_size) - text_size)[found.rows]
            columns = []
            for values, n, moved in ((found.a_ids, found.n_a, False), (found.b_ids, found.n_b, False), (found.a_ends, found.n_a, True), (found.b_ends, found.n_b, True)):
                laid = gather(values, n, found.codes) + (np.repeat(in_text, n[found.codes]) if moved else 0)
                columns.append(packed(laid.astype("<u4"), np.concatenate([[0], np.cumsum(found.per_text(n))])))
            yield pa.RecordBatch.from_arrays([piece.column("key"), *columns, found.group_texts()], names=[key, "a_ids", "b_ids", "a_ends", "b_ends", "groups"])

    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return own.mapInArrow(run, f"`{key}` {kind}, a_ids binary, b_ids binary, a_ends binary, b_ends binary, groups string")


def pack_links(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and how often each occurs: differences and times, byte by byte of all, so that their many zero bytes compress."""
    both = np.stack([np.diff(codes, prepend=0), times]).astype("<u4")
    return np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def agreement(docs: DataFrame, tokenizer: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is linked at least as often in the corpus as any other
    of its B id), ``count_sum`` (over links, how often the pair is linked) and ``groups_sha256``."""
    check_pieces(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, slice_no = Aligner(tokenizer, model), TaskContext.get().partitionId() << 32
        for piece in pieces(batches, "text", SLICE_BYTES):
            found = aligner.slice(pc.fill_null(piece.column("text"), ""))
            pairs, per_chunk = found.links()
            counts = [found.per_text(n) for n in (found.n_a, found.n_b, found.n_a + found.n_b - per_chunk, per_chunk)]
            known, own = np.unique(pairs, return_inverse=True)
            chunk_times = np.bincount(found.codes, minlength=len(per_chunk))
            totals = np.bincount(own, np.repeat(chunk_times, per_chunk), len(known)).astype(np.int64)
            order = np.argsort(-totals, kind="stable")  # frequent pairs get small numbers
            number = np.empty(len(known), np.int64)
            number[order] = np.arange(len(known))
            lengths = per_chunk[found.codes]
            text_of_link = np.repeat(found.rows, lengths)
            met, times = np.unique(text_of_link * max(1, len(known)) + gather(number[own], per_chunk, found.codes), return_counts=True)
            text_of_met, code = np.divmod(met, max(1, len(known)))
            at = np.searchsorted(text_of_met, np.arange(found.n + 1)).tolist()
            links = [pack_links(code[s:e], times[s:e]) for s, e in zip(at, at[1:])]
            shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.group_texts().to_pylist()]
            n, shown = found.n, totals > 0
            used = order[shown[order]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, slice_no)), piece.column("key"), *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(links, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
                names=names,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([slice_no]), pa.nulls(1, piece.schema.field("key").type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([known[used]], pa.list_(pa.int64())), pa.array([totals[used]], pa.list_(pa.int64()))],
                names=names,
            )
            slice_no += 1

    names = ["slice", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "totals"]
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    found = stage(own.mapInArrow(run, f"slice long, key {kind}, {COUNTS}, groups_sha256 string, links binary, pairs array<long>, totals array<long>"), "aligned")
    per_slice = found.where("pairs is not null").select("slice", F.posexplode(F.arrays_zip("pairs", "totals")).alias("code", "link")).select("slice", "code", F.col("link.pairs").alias("pair"), F.col("link.totals").alias("n"))
    counts = per_slice.groupBy("pair").agg(F.sum("n").alias("total"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("highest"))
    judged = counts.join(highest, b_id == F.col("b_id")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    known = per_slice.join(judged, "pair").select(F.col("slice").alias("of"), "code", "total", "best")

    def judge(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("code")
        total, best = pairs.column("total").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
        n_best, count_sum = [], []
        for data in texts.column("links").to_pylist():
            code, times = unpack_links(data)
            n_best.append(int((best[code] * times).sum()))
            count_sum.append(int((total[code] * times).sum()))
        return pa.table({key: texts.column("key"), **{c: texts.column(c) for c in names[2:6]}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": texts.column("groups_sha256")})

    texts = found.where("pairs is null").drop("pairs", "totals")
    return texts.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(judge, f"`{key}` {kind}, {COUNTS}, n_best long, count_sum long, groups_sha256 string")
