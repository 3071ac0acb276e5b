"""Token files, aligned tokenizers and the Merkle manifest against brute-force versions, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import align_tokens, common, elias_fano, merkle, token_files
from sensorloom.llm.bpe import byte_characters
from tests.llm.test_operators import SCHEMA, awkward_rows

WORD_JSON, BYTE_JSON = (open(public_tokenizers.path(n), encoding="utf-8").read() for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
POOL = [" ", "  ", "\n", "a", "b.", "the ", " the", "\n\n", " \n", "é", "世", "世界", "😀", "'s", "1", "\x1c", " ", "\u0085", "\t", " x", "ing", "<|endoftext|>", "</s>", "<0x41>", "▁", "ﬁ", "é", " ́", "ΑΣ", "İ", "\x00"]


def mixtures(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = awkward_rows() + [(100 + i, t, None, *["clash"] * 2, 1, *["clash"] * 4, 1, 1, 1, 1, "clash") for i, t in enumerate(mixtures(300, 4))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Elias-Fano --------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [0], [7], [0] * 600, [2**62], [0, 2**40, 2**62], list(range(5000)), [5] * 300 + [6] * 300])
def test_elias_fano_small(values):
    coded = b"head" + elias_fano.encode(np.array(values)) + b"tail"
    found = elias_fano.Sequence(coded, 4)
    assert coded[found.end :] == b"tail" and found.all().tolist() == values and [found[i] for i in range(len(found))] == values
    with pytest.raises(IndexError):
        found[len(values)]


def test_elias_fano_random_select_rank_and_space():
    rng = np.random.default_rng(2)
    for top in (1, 50, 10**4, 10**9, 2**61):
        values = np.sort(rng.integers(0, top, 3000))
        data = elias_fano.encode(values)
        found = elias_fano.Sequence(data)
        assert found.all().tolist() == values.tolist() and all(found[i] == values[i] for i in range(0, 3000, 7))
        for v in [0, top, *values[::501].tolist()]:
            assert found.rank(v) == int((values < v).sum())
        assert len(data) * 8 / 3000 < 2 + max(0, np.log2(top / 3000)) + 1.2
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))


# --- op11 --------------------------------------------------------------------------------------


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(WORD_JSON)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@pytest.mark.parametrize("segment_ids", [token_files.SEGMENT_IDS, 700])
def test_token_files_give_all_ids_back(spark, docs, tmp_path, segment_ids):
    path = str(tmp_path / "t")
    token_files.write(docs, path, WORD_JSON, end_id=2, segment_ids=segment_ids)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    got = token_files.read(spark, path).orderBy("number").collect()
    start = 0
    for g, r, ids in zip(got, rows, brute_ids([r.text for r in rows]), strict=True):
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids)) and bytes(g.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)


def test_one_document_of_a_file(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    token_files.write(docs.coalesce(1), path, WORD_JSON, segment_ids=3000)
    seen = 0
    for row in spark.read.format("binaryFile").load(f"{path}/segments").collect():
        s = token_files.Segment(row.content)
        ends = s.ends.all()
        assert s.width == 2 and s.n_docs == len(ends)
        for i in range(s.n_docs):
            assert s.document(i).tolist() == s.ids[(ends[i - 1] if i else 0) : ends[i]].tolist()
            assert s.key(i) is None or i in s.find(s.key(i))
        assert len(s.find(10**15)) == len(s.find(-(10**15))) == 0
        seen += s.n_docs
    assert seen == docs.count()


def test_token_files_of_nothing(spark, none, tmp_path):
    token_files.write(none, str(tmp_path / "t"), WORD_JSON, end_id=2)
    assert token_files.read(spark, str(tmp_path / "t")).count() == 0


def test_widest_keys_and_ids():
    keys, ids = [None, -(2**63), 2**62 - 2**63 - 1], np.arange(70000, 70005, dtype="<u4")
    s = token_files.Segment(token_files.segment_bytes(keys, np.array([0, 3, 2]), ids, 7, 1, 10, 20))
    assert [s.key(i) for i in range(3)] == keys and [s.document(i).tolist() for i in range(3)] == [[], [70000, 70001, 70002], [70003, 70004]]
    assert list(s.find(-(2**63))) == [1] and (s.task, s.number, s.docs_before, s.ids_before, s.width) == (7, 1, 10, 20, 4)


# --- op12 --------------------------------------------------------------------------------------


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    value = {c: bytes([i]) for i, c in enumerate(byte_characters())}
    a_side, b_side = Tokenizer.from_str(BYTE_JSON), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    a_side.encode_special_tokens = True
    out = []
    for t in texts:
        a, b = (a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)) if t else ([], [])
        a_raw = [b"".join(value[c] for c in a_side.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(a_raw) == b"".join(b_raw) == (" " + t).encode():
            out.append(([], [], [], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw)]
        spans = [[(e - len(x), e) for x, e in zip(raw, side)] for raw, side in zip((a_raw, b_raw), ends)]
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        groups, i, j = [], 0, 0
        a_at, b_at = ({e: k + 1 for k, e in enumerate(side)} for side in ends)
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = a_at[end], b_at[end]
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        out.append((a, b, *ends, links, ";".join(groups)))
    return out


def unpack(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_alignment_equals_whole_texts(docs):
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *map(tuple, w[:4]), w[5]) for r, w in zip(rows, brute_alignment([r.text for r in rows])))
    got = collections.Counter((r.doc_id, *(tuple(unpack(bytes(r[c]))) for c in ("a_ids", "b_ids", "a_ends", "b_ends")), r.groups) for r in align_tokens.align(docs, BYTE_JSON, MODEL).collect())
    assert got == want and any(not k[1] for k in want) and sum(bool(k[1]) for k in want) > 200


@pytest.mark.parametrize("slice_bytes", [align_tokens.SLICE_BYTES, 500])
def test_agreement_counts_over_the_corpus(docs, slice_bytes, monkeypatch):
    monkeypatch.setattr(align_tokens, "SLICE_BYTES", slice_bytes)
    rows = docs.select("doc_id", "text").collect()
    found = brute_alignment([r.text for r in rows])
    count = collections.Counter(p for w in found for p in w[4])
    highest = collections.defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    want = collections.Counter()
    for r, (a, b, _, _, links, groups) in zip(rows, found):
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want[r.doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), sha] += 1
    assert collections.Counter(map(tuple, align_tokens.agreement(docs, BYTE_JSON, MODEL).collect())) == want


def test_alignment_of_nothing(none):
    assert align_tokens.align(none, BYTE_JSON, MODEL).count() == 0 and align_tokens.agreement(none, BYTE_JSON, MODEL).count() == 0


def test_places_of_both_sides_are_merged_not_hashed():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(4, 12))) for _ in range(60_000)]
    found = align_tokens.Aligner(BYTE_JSON, MODEL).slice(pa.array([" ".join(words)]))

    def merged():
        a, b = found.places()
        ends = np.sort(np.concatenate([a, b]), kind="stable")
        return np.searchsorted(a, ends), np.searchsorted(b, ends), np.searchsorted(np.cumsum(found.size), ends)

    def least(work):
        out = []
        for _ in range(7):
            start = time.process_time()
            work()
            out.append(time.process_time() - start)
        return min(out)

    assert least(found.links) < 1.1 * least(merged)


def test_links_pack():
    codes, times = np.array([0, 3, 70000, 2**31]), np.array([1, 300, 2, 70000])
    back = align_tokens.unpack_links(align_tokens.pack_links(codes, times))
    assert back[0].tolist() == codes.tolist() and back[1].tolist() == times.tolist()
    assert [len(x) for x in align_tokens.unpack_links(align_tokens.pack_links(codes[:0], times[:0]))] == [0, 0]


# --- op13 --------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves, fanout):
    """Root and, per leaf, [(left siblings, right siblings)] from below."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for p, i in enumerate(at):
            run = i // fanout * fanout
            paths[p].append((nodes[run:i], nodes[i + 1 : run + fanout]))
            at[p] = i // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return (nodes or [None])[0], paths


def fold(node, path):
    for left, right in path:
        node = sha("".join(left) + node + "".join(right))
    return node


SOURCES = [(None, 3), ("", 1), ("a", 130), ("b", 17), ("c", 16), ("d", 1), ("e", 9), ("é", 40), ("f", 2), ("😀", 65)]


def merkle_rows(shape):
    rnd, rows = random.Random(9), []
    for source, n in shape:
        for i in range(n):
            rows.append((rnd.randint(-(10**6), 10**6), source, rnd.choice(["en", None]), rnd.choice([5, None]), rnd.choice([None, "", "Text É", "x" * i]), "clash", 1))
        rows += rows[-1:] if n == 17 else []
    return rows + ([(None, "a", None, None, None, "clash", 1), (7, "a", None, None, "B", "clash", 1), (7, "a", None, None, "A", "clash", 1)] if shape else [])


@pytest.mark.parametrize("fanout,levels,shape", [(16, 3, SOURCES), (16, 1, SOURCES), (3, 1, SOURCES), (2, 2, SOURCES), (2, 1, [("a", 33)]), (4, 1, [(str(i), 1 + i % 5) for i in range(23)]), (16, 1, [("a", 1)])])
def test_merkle_proofs(spark, fanout, levels, shape):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    rows = merkle_rows(shape)
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, root string, unit int").repartition(3)
    got = merkle.proofs(frame, "source", "doc_id", merkle.leaf(*fields), ("unit", "text"), fanout, levels)
    got = got.withColumn("folded", merkle.folded("leaf", "siblings", "places", "sizes")).withColumn("wrong", merkle.folded(F.sha2("leaf", 256), "siblings", "places", "sizes")).collect()

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = brute_tree([leaf(r) for r in by_source[s]], fanout)
    root, tops = brute_tree([trees[s][0] for s in order], fanout)
    want = collections.Counter()
    for s, top in zip(order, tops):
        for r, path in zip(by_source[s], trees[s][1]):
            whole = path + top
            siblings = "".join(d for left, right in whole for d in [*left, *right])
            want[r[0], s, leaf(r), trees[s][0], root, siblings, tuple(len(left) for left, _ in whole), tuple(len(left) + len(right) + 1 for left, right in whole)] += 1
            assert fold(leaf(r), whole) == root
    assert collections.Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, r.siblings, tuple(r.places), tuple(r.sizes)) for r in got) == want
    assert all(r.folded == root and r.unit == 1 and (r.wrong != root) for r in got)


def test_merkle_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    assert merkle.proofs(frame, "source", "doc_id", merkle.leaf("doc_id", "text")).count() == 0


def test_manifest_of_sources(spark):
    frame = spark.createDataFrame([(i, f"s{i % 3}") for i in range(50)], "doc_id long, source string")
    found = merkle.sources(merkle.proofs(frame, "source", "doc_id", merkle.leaf("doc_id", "source"))).collect()
    assert sorted((r.source, r.rows) for r in found) == [("s0", 17), ("s1", 17), ("s2", 16)] and len({r.root for r in found}) == 1


# --- Helpers -----------------------------------------------------------------------------------


def test_remembered_forgets_without_harm():
    calls = []

    def work(new):
        calls.extend(new)
        return [(s,) for s in new]

    known = common.Remembered(most=10, longest=3)
    rnd = random.Random(1)
    for _ in range(200):
        asked = [str(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 8))] + ["long one"]
        assert known.get(asked, work) == [(s,) for s in asked]
    assert len(known.young) <= 20 and len(known.old) <= 20 and calls.count("long one") == 200


def test_running_totals(spark):
    rows = [(p, i, (p * 7 + i) % 5) for p in (0, 2, 9) for i in range(4)]
    got = common.running(spark.createDataFrame(rows, "p long, i long, v long").withColumn("one", F.lit(1)), "p", "i", total="v", n="one").orderBy("p", "i").collect()
    assert [(r.total, r.n) for r in got] == [(sum(x[2] for x in rows[:k]), k) for k in range(len(rows))]


def test_crc_of_ids_is_the_library_s(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"\x01\x00\x00\x00"))).first()[0] == zlib.crc32(b"\x01\x00\x00\x00")


def test_one_pass_gives_what_two_give(docs):
    from sensorloom.llm import bpe

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    kinds = lambda df: collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded), r.text, bytes(r.tail)) for r in df.collect())
    assert kinds(bpe.round_trip(docs, path, pattern)) == kinds(bpe.decode(bpe.encode(docs, path, pattern), path, pattern))
