"""Each operator against a brute-force version, and on awkward tables: nulls, empty and long texts, ties,
repeated rows, no rows, extra columns with clashing names."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sensorloom.llm import bpe, chat, decontaminate, html_text, jaccard, pii, quality, shard, substring, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, id string, words string, n int, key string, hash string, sig string, row string, size int, shard int, label int, model int, ids string"


def vocabulary(n: int, seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abdeiklmnorstuéß") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def awkward_rows() -> list[tuple]:
    rnd, words = random.Random(7), vocabulary(300)
    base = [rnd.choice(words) for _ in range(90)]
    passage = [rnd.choice(words) for _ in range(30)]
    texts = [
        (1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:40], "changed", *base[41:]])), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one two"), (9, "ONE two"),
        (10, " ".join([rnd.choice(words) for _ in range(60)] + passage)), (11, " ".join(passage + [rnd.choice(words) for _ in range(60)])), (None, " ".join(base)), (12, "same " * 400), (13, "same " * 300),
        (14, " ".join(rnd.choice(words) for _ in range(30000))), (15, "emoji 😀 世界\x1c \u0085 end  \n two"), (15, "another text under a shared id"), (-3, " ".join(base[5:80])), (16, "x" * 50000),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, *["clash"] * 2, 1, *["clash"] * 4, 1, 1, 1, 1, "clash") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


# --- op4 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def unpack(raw: bytes) -> list[int]:
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_bpe_equals_the_rank_library(docs, tiktoken_encoding):
    got = collections.Counter((r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, RANKS, PATTERN).collect())
    want = collections.Counter((r.doc_id, b"".join(i.to_bytes(4, "little") for i in tiktoken_encoding.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert got == want


def test_bpe_on_random_mixtures_and_offsets(spark, tiktoken_encoding):
    rnd = random.Random(3)
    pool = [" ", "  ", "\n", "a", "b.", "c,", "\n\n", " \n", "é", "世", "😀", "'s", "1", "\x1c", " ", "\u0085", "\t", " x", "ing", "aaaa"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(rows, RANKS, PATTERN)
    for r in encoded.collect():
        ids, text = unpack(bytes(r.ids)), texts[r.doc_id]
        assert ids == tiktoken_encoding.encode_ordinary(text)
        assert len(ids) == len(r.starts) == len(r.ends)
        for i, a, b in zip(ids, r.starts, r.ends):  # a token's bytes lie within its characters
            assert tiktoken_encoding.decode_single_token_bytes(i) in text[a:b].encode()
    for r in bpe.decode(encoded, RANKS, PATTERN).collect():
        assert bytes(r.decoded) == texts[r.doc_id].encode() and r.text == texts[r.doc_id] and not r.tail


def test_decoding_keeps_a_split_character(spark, tiktoken_encoding):
    ids = tiktoken_encoding.encode_ordinary("\U0001f9ff")
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, bytearray(ids[0].to_bytes(4, "little"))), (2, None)], "doc_id long, ids binary")
    one, two = sorted(bpe.decode(cut, RANKS, PATTERN).collect(), key=lambda r: r.doc_id)
    assert one.text == "" and bytes(one.tail) == tiktoken_encoding.decode_single_token_bytes(ids[0]) and two.text == ""


# --- op2 ---------------------------------------------------------------------------------------


def brute_substrings(rows, width=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    out = collections.Counter()
    for i, t in rows:
        w = words_of(t)
        stay = [True] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                stay[k : k + width] = [False] * width
        out[(i, len(w), len(w) - sum(stay), b" ".join(x for x, s in zip(w, stay) if s).decode())] += 1
    return out


def test_substrings_equal_brute_force(docs):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedupe(docs).collect())
    assert got == brute_substrings([(r.doc_id, r.text) for r in docs.collect()])


def test_substrings_in_repetitive_texts(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("ab") if rnd.random() < 0.8 else rnd.choice("cdef") for _ in range(rnd.randint(0, 120))) for _ in range(120)]
    rows = list(enumerate(texts))
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_substrings(rows)


# --- op8 ---------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(table).split()
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, x) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return collections.Counter((i, len(x), None if i is None else least[root(a)]) for a, (i, x) in enumerate(sets))


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(docs, size, percent):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs, words=size, percent=percent).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], size, percent)


def test_jaccard_in_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # several blocks per group
    rnd, words = random.Random(2), vocabulary(4000)
    rows = []
    for base in range(3):
        text = [rnd.choice(words) for _ in range(120)]
        for _ in range(60):
            own = list(text)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((len(rows), " ".join(own)))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows, 3, 90)


def test_jaccard_forms_a_pair_about_once_however_many_shingles_it_shares(spark):
    rnd, words, percent = random.Random(33), vocabulary(3000, 33), 80
    base, rows = [rnd.choice(words) for _ in range(600)], []
    for i in range(24):  # near copies, about half of their pairs below the share
        at, many = rnd.randrange(500), 12 + 24 * (i % 2)
        rows.append((i, " ".join(base[:at] + [rnd.choice(words) for _ in range(many)] + base[at + many :])))
    rows += [(100 + i, " ".join(rnd.choice(words) for _ in range(600))) for i in range(10)]
    own = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    described = own.mapInArrow(lambda b: jaccard._describe(b, 3), "id long, sig long, n int, map binary, cell int, df long").where("cell IS NULL").cache()
    frequency = np.zeros(1 << jaccard.CELL_BITS, np.int64)
    groups = jaccard.blocked(own.mapInArrow(lambda b: jaccard._prefixes(b, 3, percent, frequency), "token long, sig long, n int, place int"), described).cache()
    name = {r.sig: r.id for r in described.collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    want = {(i, k) for i in sets for k in sets if i < k and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k])}
    ordered = groups.withColumn("label", F.col("sig")).coalesce(1).sortWithinPartitions("token", "low", "high", "n", "sig")
    formed = [tuple(sorted((name[r.a], name[r.b]))) for r in ordered.mapInArrow(lambda b: jaccard._candidates(b, percent, False), "a long, b long, apart int").collect()]
    assert 50 < len(want) < 24 * 23 // 2 and want <= set(formed)
    assert len(formed) <= 2 * len(set(formed))
    nearest = ordered.mapInArrow(lambda b: jaccard._candidates(b, percent, True), "a long, b long, apart int")
    assert nearest.count() <= 24 * 23


def test_jaccard_keeps_only_rows_texts_and_sets_that_may_be_in_a_pair(spark, monkeypatch):
    rnd, words = random.Random(5), vocabulary(9000, 5)

    def some(n):
        return [rnd.choice(words) for _ in range(n)]

    head, tail, rows = some(400), some(120), []
    for i in range(20):  # a rare passage in two texts whose sizes don't fit
        passage = some(60)
        rows += [(i, " ".join(head + passage)), (50 + i, " ".join(head + passage + tail))]
    passage, one, two = some(700), some(2300), some(2300)  # the rarest shingles in common, too long for the small parity maps, but no link
    rows += [(100, " ".join(passage + one)), (101, " ".join(passage + two))] + [(102 + i, " ".join((one, two)[i % 2])) for i in range(4)]
    text = some(80)
    rows += [(200, " ".join(text)), (201, " ".join(text[:-1] + ["end"]))]
    rnd.shuffle(rows)
    written, stage = {}, jaccard.stage

    def counted(df, kind):
        out = stage(df, kind)
        written[kind] = written.get(kind, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect())
    assert got == brute_components(rows, 3, 90)
    assert written["shared"] <= sum(n - -(-90 * n // 100) + 1 for i, n, _ in got if i in (100, 101, 200, 201))
    assert written["sets"] == 2


def test_narrowed_keeps_all_wanted_and_few_others(spark):
    ids = [None, *range(20_000)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(7, "again")], "id long, text string")
    wanted = spark.createDataFrame([(i,) for i in (7, 7, *range(100, 20_000, 50))], "id long")
    got = [(r.id, r.text) for r in jaccard.narrowed(rows, "id", wanted).collect()]
    assert {(7, "t7"), (7, "again")} <= set(got) and {i for i, _ in got} >= {r.id for r in wanted.collect()}
    assert len(got) == len(set(got)) < 3_000
    assert jaccard.narrowed(rows, "id", wanted.where("id < 0")).count() == 0


# --- op5 ---------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark):
    rnd, words = random.Random(4), vocabulary(3000)
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate((3, 5, 14, 30, 59, 30))] + [(90, None), (91, ""), (92, "!!"), (93, None)]
    items += [(94, items[3][1])]
    rows = []
    for i in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 90))]
        own = (items[i % 6][1]).split()
        if i % 3 == 0:
            if i % 2 and len(own) > 20:
                own[-1] = "other"
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() if rnd.random() < 0.1 else w + "," for w in own]
        rows.append((i, " ".join(text)))
    rows += [(70, items[4][1]), (70, items[4][1]), (71, " ".join(items[4][1].split()[:57])), (None, items[3][1]), (72, None), (73, ""), (74, items[3][1] + " " + items[3][1])]
    split = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
    bag = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    want = {}
    for d, t in rows:
        w = split(t)
        for i, it in items:
            iw = split(it)
            if not iw or not w:
                continue
            best = 0.0
            for s in range(max(1, len(w) - len(iw) + 1)):
                x, y = bag(w[s : s + len(iw)]), bag(iw)
                common = sum((x & y).values())
                best = max(best, common / (sum(x.values()) + sum(y.values()) - common))
            if best >= 0.8:
                want[(d, i)] = best
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, item string, size int")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, words string")
    got = {(r.doc_id, r.item): r.similarity for r in decontaminate.matches(docs, bench).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text is not None) == sorted((d, t) for d, t in rows if t is not None and (d, 0) not in want and not any((d, i) in want for i, _ in items))


def test_decontamination_finds_changed_items_in_longer_texts(spark):
    """Halves swapped, words inserted, deleted and repeated: every window within the radius is found, whatever its order."""
    rnd, words = random.Random(9), vocabulary(3000)
    items = [(i, [rnd.choice(words) for _ in range(n)]) for i, n in enumerate((60, 60, 75, 90, 110))]
    rows = []
    for i in range(200):
        text = list(items[i % 5][1])
        kind = i // 5 % 4
        if kind == 0:
            cut = rnd.randint(1, len(text) - 1)
            text = text[cut:] + text[:cut]
        for _ in range((0, rnd.randint(1, 2), 0, 1)[kind]):
            text.insert(rnd.randrange(len(text)), rnd.choice(words))
        for _ in range((0, 0, rnd.randint(1, 2), 1)[kind]):
            del text[rnd.randrange(len(text))]
        pad = [[rnd.choice(words) for _ in range(rnd.randint(0, 40))] for _ in range(2)]
        rows.append((i, " ".join(pad[0] + text + pad[1])))
    bag = lambda w: collections.Counter(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    printed = {}

    def fingerprint(b):
        total = sum(b.values())
        for x in b:
            printed.setdefault(x, xxhash.xxh64(x, seed=42).intdigest())
        return sum(1 << j for j in range(64) if 2 * sum(n for x, n in b.items() if printed[x] >> j & 1) > total)

    want, all_near = {}, set()
    for d, t in rows:
        w = t.split()
        for i, own in items:
            y = bag(own)
            for at in range(max(1, len(w) - len(own) + 1)):
                x = bag(w[at : at + len(own)])
                common = sum((x & y).values())
                score = common / (sum(x.values()) + sum(y.values()) - common)
                if score >= 0.8:
                    all_near.add((d, i))
                    if (fingerprint(x) ^ fingerprint(y)).bit_count() <= 15:
                        want[d, i] = max(want.get((d, i), 0), score)
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    got = {(r.doc_id, r.item): r.similarity for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(all_near) > 120 and len(got) >= 0.97 * len(all_near)
    assert sum(d // 5 % 4 == 0 for d, _ in got) >= 35  # swapped parts


def test_windows_are_all_that_can_reach_the_similarity(spark):
    """Against every start, for many sets of places; repeated items make whole runs of windows."""
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        n, size = rnd.randint(5, 60), rnd.choice((5, 9, 14, 30, 45))
        share = rnd.choice((0.1, 0.9, 1.0))
        rows.append((i, n, size, [a for a in range(n - 4) if rnd.random() < share]))
    df = spark.createDataFrame(rows, "i int, n int, size int, hits array<int>")
    got = {r.i: r.s for r in df.select("i", decontaminate.window_starts(F.col("hits"), F.col("n"), F.col("size"), 5, 0.8).alias("s")).collect()}
    for i, n, size, hits in rows:
        held, own = min(size, n) - 4, size - 4
        need = math.ceil(0.8 * (held + own) / 1.8 - 1e-9)
        assert sorted(got[i]) == [s for s in range(max(1, n - size + 1)) if sum(s <= a < s + held for a in hits) >= need], rows[i]


# --- op6 ---------------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    def fits(c):
        n, used = 1, 0
        for x in sizes:
            if x > c:
                return False
            if used + x > c:
                n, used = n + 1, 0
            used += x
        return n <= shards

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_shards_are_as_even_as_possible(spark, docs, shards):
    rnd = random.Random(shards)
    more = spark.createDataFrame([(100 + i, rnd.choice(["", "a", "bb"]) * rnd.randint(0, 900)) for i in range(700)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more)
    rows = shard.assign(table, shards).collect()
    told = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    groups, want = collections.defaultdict(int), collections.Counter()
    for r in table.collect():
        raw = (r.text or "").encode()
        key = -1 if r.text is None else int(hashlib.sha256(raw).hexdigest()[:15], 16)
        groups[key] += len(raw) + 16
        want[(r.doc_id, len(raw) + 16, zlib.crc32(raw))] += 1
    assert told == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values()) and max(by) < shards
    assert max(sum(x.size for x in v) for v in by.values()) == least_capacity([groups[k] for k in sorted(groups)], shards)
    crc = collections.defaultdict(set)
    for r in rows:
        crc[(r.text_crc32, r.size)].add(r.shard)
    assert all(len(v) <= 2 for v in crc.values())  # equal texts share a shard; null and empty look alike here


# --- op10 --------------------------------------------------------------------------------------


def brute_base(text):
    b = (text or "").encode()
    w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", b)]
    tri, covered, seen, dup = collections.Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for k in range(len(w) - 2):
        if tri[(w[k], w[k + 1], w[k + 2])] > 1:
            covered |= {k, k + 1, k + 2}
    for line in (text or "").split("\n"):
        if re.search(rb"[^\x20\x09-\x0D]", line.encode()):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_rules_equal_brute_force(docs):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.assess(docs).collect())
    assert got == collections.Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())


def test_model_is_a_distribution_and_bands_reject_noise(spark, docs):
    words = vocabulary(200)
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice(words) for _ in range(150)), "xx") for i in range(80)]
    bad = [(1000 + i, " ".join("".join(rnd.choice("qxzj#~0189") for _ in range(9)) for _ in range(150)), "xx") for i in range(3)]
    table = spark.createDataFrame(good + bad + [(5000, "lone language " * 20 + " ".join(words[:60]), "zz")], "doc_id long, text string, lang string")
    verdict = {r.doc_id: r.kept for r in quality.assess(table).collect()}
    assert all(verdict[i] for i, _, _ in good) and not any(verdict[i] for i, _, _ in bad)
    kept = quality.keep(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}
    models = quality.train(table, quality.languages(table))
    import numpy as np

    model = models[0]
    history = int(model.contexts[-1][0]) << quality.BITS
    assert abs(np.exp(model.score(np.arange(quality.SYMBOLS) + history)).sum() - 1) < 1e-3


def test_every_language_has_a_model_of_its_own(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(19):  # each language has its own letters; the later ones are rarer
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz"[k : k + 8]) for _ in range(rnd.randint(2, 7))) for _ in range(120)]
        rows += [(100 * k + i, " ".join(rnd.choice(words) for _ in range(120)), f"l{k:02d}" if k < 18 else None) for i in range(40 - k)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alone = {}
    for lang in ("l00", "l17", None):
        alone |= {r.doc_id: r for r in quality.assess(table.where(table.lang.eqNullSafe(lang))).collect()}
    together = quality.assess(table).collect()
    assert len(together) == len(rows) and all(r.low is not None for r in together)
    assert {r.doc_id: (r.log_perplexity, r.low) for r in together if r.doc_id in alone} == {i: (r.log_perplexity, r.low) for i, r in alone.items()}
    assert {r.doc_id for r in quality.keep(table).collect()} == {r.doc_id for r in together if r.kept}


def test_texts_full_of_symbols_are_counted_too(spark):
    rnd, words = random.Random(4), vocabulary(200)
    cells = [(i, "| ".join(rnd.choice(words) for _ in range(90)), "tables") for i in range(30)]
    plain = [(100 + i, " ".join(rnd.choice(words) for _ in range(90)), "plain") for i in range(30)]
    table = spark.createDataFrame(cells + plain, "doc_id long, text string, lang string")
    assert all(r.kept and r.log_perplexity is not None for r in quality.assess(table).collect())
    counted = quality.count_ngrams(table, quality.languages(table)).groupBy().agg(F.sum("n")).first()[0]
    assert counted == sum(len(t) + 1 for _, t, _ in cells + plain)  # every character and the border after each text


# --- op7 ---------------------------------------------------------------------------------------


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


CARDS = [f"{n}{next(d for d in range(10) if luhn(f'{n}{d}') % 10 == 0)}" for n in range(411111111111111, 411111111111111 + 60)]
PRIVATE = [
    "call +1 (384) 555-3571 or 384-555-3571", "card 4041894974608795 and 4041 8949 7460 8795", "bosbt.42@mail8.example.com from 21.174.229.103", "born 1984-02-29, 29.02.1984, 12/31/1999",
    "number 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", "+44 20 7946 0958",
]
PUBLIC = ["not 999.1.1.1 nor 2020-13-40", "version 1.2.3 of 12345", "x4041894974608795", "4041894974608796 fails its check digit", "000-45-6789", "nothing @ all", "", None]


def test_pseudonyms_change_values_only_and_can_be_undone(spark):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(PRIVATE + PUBLIC)], "doc_id long, text string, n string")
    hidden = pii.pseudonymise(rows)
    assert hidden.columns == rows.columns
    out = {r.doc_id: r.text for r in hidden.collect()}
    for i, t in enumerate(PRIVATE + PUBLIC):
        if i < len(PRIVATE):
            assert out[i] != t and re.sub(r"[0-9A-Za-z]", "", out[i]) == re.sub(r"[0-9A-Za-z]", "", t) and (i == 2 or len(out[i]) == len(t))
        else:
            assert out[i] == t
    assert [r.text for r in pii.pseudonymise(hidden, decrypt=True).orderBy("doc_id").collect()] == PRIVATE + PUBLIC
    assert pii.pseudonymise(rows, key="another").where("doc_id = 0").first().text != out[0]
    digits = lambda s: re.sub(r"\D", "", s)
    a, b = out[0].split(" or ")
    assert digits(a)[-10:] == digits(b)[-10:]
    a, b = out[1].split(" and ")
    assert digits(a) == digits(b) and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits(a)))) % 10 == 0
    assert all(int(x) < 256 for x in re.findall(r"[\d.]+$", out[2])[0].split("."))


def test_values_before_other_numbers_and_words(spark):
    told = {"4111 1111 1111 1111": " 05/27", "4111111111111111": " 123 x", "BE68 5390 0754 7034": " PAID by", "+44 20 7946 0958": " 2024", "2221 0000 0000 0009": ".", "DE89 3704 0044 0532 0130 00": " GB82 WEST 1234 5698 7654 32"}
    told = [(v + rest, v, rest) for v, rest in told.items()] + [(f"{v} 12", v, " 12") for v in CARDS]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(told)], "doc_id long, text string")
    hidden = pii.pseudonymise(rows)
    out = {r.doc_id: r.text for r in hidden.collect()}
    for i, (whole, value, rest) in enumerate(told):
        assert len(out[i]) == len(whole) and out[i][: len(value)] != value, whole
        assert out[i].endswith(rest) or "GB82" in rest or value in CARDS, whole
    assert [r.text for r in pii.pseudonymise(hidden, decrypt=True).orderBy("doc_id").collect()] == [t for t, _, _ in told]


def test_no_two_values_share_a_pseudonym(spark):
    rows = spark.range(3000).select("id", F.format_string("10.0.%d.%d", (F.col("id") / 256).cast("int"), F.col("id") % 256).alias("text"))
    assert pii.pseudonymise(rows).select("text").distinct().count() == 3000


# --- op3 ---------------------------------------------------------------------------------------


def test_layouts_meet_in_the_same_turns(spark):
    import json

    u, a = "hi <|im_end|>\n<\\| [1]", "yes  <|"
    records = [
        {"prompt": u, "completion": a}, {"question": u, "answer": a}, {"question": u, "answer": a, "system": None}, {"instruction": u, "output": a, "system": ""},
        {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}]}, {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]},
    ]
    other = ['{"unknown": 1}', "no json", "[1]", None, '{"messages": []}', '{"messages": [{"role": null, "content": null}]}']
    rows = spark.createDataFrame(list(enumerate([json.dumps(r) for r in records] + other)), "k long, record string")
    turns = {r.k: r.turns for r in chat.canonical(rows, "k", "record").collect()}
    assert all([(t.role, t.text) for t in turns[i]] == [("user", u), ("assistant", a)] for i in range(len(records)))
    n = len(records)
    assert turns[n] is turns[n + 1] is turns[n + 2] is turns[n + 3] is None and turns[n + 4] == [] and [tuple(t) for t in turns[n + 5]] == [("", "")]
    back = {r.k: r for r in chat.read_back(chat.render(chat.canonical(rows, "k", "record"), "k"), "k").collect()}
    for i in range(n):
        assert [(t.role, t.text) for t in back[i].turns] == [("user", u), ("assistant", a)] and back[i].loss_texts == [a]


def test_any_text_survives_the_template(spark):
    rnd = random.Random(8)
    pool = ["<", "|", "\\", "<|im_start|>", "<|im_end|>", "\n", "a", "世", "%", "assistant", ">"]
    made = [(c, t, rnd.choice(["user", "assistant", "tool\n<|x", "", None]), "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for c in range(150) for t in range(rnd.randint(1, 5))]
    back = chat.read_back(chat.render(chat.canonical(chat.records_of(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")), "conv_id", "record"), "conv_id"), "conv_id")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back.collect()}
    want = collections.defaultdict(list)
    for c, _, r, t in made:
        want[c].append((r or "", t))
    assert got == want


# --- op1 ---------------------------------------------------------------------------------------


def test_archives_come_back(spark, tmp_path):
    big, evil = "x" * 1500, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [(1, "http://a/ b", big), (2, None, big), (2, "http://c", big), (3, "http://d", "small"), (4, "http://d", "small"), (5, "http://[", None), (None, "u", big), (6, "http://e", evil), (7, "http://e\r\nX: y", "é" * 600)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, payload string")
    warc.write(pages, str(tmp_path / "a"))
    records = warc.read(spark, str(tmp_path / "a")).cache()
    assert records.count() == 3 * len(rows) and records.select("record_id").distinct().count() == 3 * len(rows)
    page = warc.field(F.col("metadata.fields"), "page-id").cast("long")
    got = collections.Counter((r.page, r.full_bytes, r.full_sha1, r.type, r.refers_to) for r in warc.resolve(warc.assemble(records), page).withColumn("page", page).collect())
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == big and i == 1
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None)] += 1
    assert got == want
    assert warc.unattached(records).count() == 0
    payloads = {r.page: bytes(r.payload) for r in warc.assemble(records).withColumn("page", page).where("type = 'response' and page > 2").collect()}
    assert payloads == {i: (h or "").encode() for i, _, h in rows if i and i > 2}


def test_links_in_either_direction_and_through_another_record(spark):
    rows = [("r", "response", ["q"]), ("q", "request", []), ("m", "metadata", ["q"]), ("lost", "metadata", ["nowhere"]), ("q2", "request", ["r"])]
    records = spark.createDataFrame([(i, k, c, None, None, i, None, None, None) for i, k, c in rows], warc.RECORD)
    one = warc.assemble(records).collect()
    assert len(one) == 1 and one[0].request.record_id == "q" and one[0].n_requests == 2 and one[0].metadata.record_id == "m"
    assert [r.record_id for r in warc.unattached(records).collect()] == ["lost"]


def test_other_archives(spark, tmp_path):
    import gzip

    plain = warc.record("resource", "<urn:1>", [], b"\r\n\r\nbody") + warc.record("metadata", "<urn:2>", [("WARC-Concurrent-To", "<urn:1>")], b"a: b\r\n")
    (tmp_path / "plain.warc").write_bytes(plain)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(plain.replace(b"urn:", b"urn:z")))
    one = warc.assemble(warc.read(spark, str(tmp_path))).collect()
    assert {bytes(r.payload) for r in one} == {b"\r\n\r\nbody"} and len(one) == 2 and all(r.n_metadata == 1 for r in one)
    with pytest.raises(ValueError):
        list(warc.records_in(plain[:-20]))


# --- op9 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain", "plain"), ("<p>One <b>two</b>three<p>Four", "One twothree\n\nFour"), ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f", "- a\n- b\n  3. c\n  4. d\n- e\n\nf"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>end", "Name       Qty\nApple pie  3\n\nend"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<pre>  x\n   y</pre>", "  x\n   y"),
    ("<head><title>t</title><style>s</style></head>v<script>var t='</p>'</script><span hidden>h</span><div style='color:red; display : none'>n</div>w", "vw"), ("x &amp; y &lt;z", "x & y <z"),
    ("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>", "a b c  d"), ("<div>a</div><div>b</div>", "a\nb"), ("<table><td>1<td>2", "1  2"), ("</p></td>broken<", "broken<"), ("<!-- c -->k", "k"), ("<option>a<option>b", "a\nb"),
])
def test_rendering(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a <svg><title>t</title><defs><text>no</text></defs><path d=''/><text>one</text><text>two</text><desc/></svg> b", "a one two b"),
    ("<p>x <math><semantics><mi>y</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></semantics></math>", "x y=2"),
    ("<head><title>t</title>bare <b>text</b>", "bare text"), *((f"<head><title>t</title><{tag}>in</{tag}> after", f"in{gap}after") for tag, gap in (
        ("h2", "\n\n"), ("header", "\n"), ("nav", "\n"), ("form", "\n"), ("center", "\n"), ("blockquote", "\n\n"), ("a", " "), ("span", " "))),
    ("<html><head><meta charset=x>\n<title>t</title>\n<script>s</script>\n<style>c</style>\n</head><body>b", "b"),
])
def test_drawings_formulas_and_open_heads(html, text):
    assert html_text.extract(html) == text


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "<p>a", "x"), (3, "<div>" * 20000 + "deep", "x"), (None, "<p>n", "x")], "page_id long, html string, text string")
    assert sorted(((r.page_id, r.text) for r in html_text.visible_text(rows).collect()), key=str) == sorted([(1, None), (2, ""), (2, "a"), (3, "deep"), (None, "n")], key=str)


# --- Empty tables ------------------------------------------------------------------------------


def test_empty_tables(spark, none, tmp_path):
    items = spark.createDataFrame([(1, "an item of some words here")], "item_id long, text string")
    for out in (bpe.encode(none, RANKS, PATTERN), bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS, PATTERN), substring.dedupe(none), jaccard.link_components(none), decontaminate.matches(none, items),
                decontaminate.remove(none, items), shard.assign(none, 40), quality.assess(none), quality.keep(none), pii.pseudonymise(none), html_text.visible_text(none, "doc_id", "text")):
        assert out.count() == 0
    some = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert decontaminate.remove(some, items.limit(0)).count() == 1
    warc.write(none, str(tmp_path / "empty"), "doc_id", "lang", "text")
    assert warc.assemble(warc.read(spark, str(tmp_path / "empty"))).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.canonical(chat.records_of(turns), "conv_id", "record"), "conv_id").count() == 0
