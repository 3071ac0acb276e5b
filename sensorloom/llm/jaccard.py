"""N-gram Jaccard join: documents whose sets of word shingles overlap by at least a given share.

1. Every text becomes a set of distinct shingles (64-bit hashes). Equal sets are one node from here on.
2. Rare first: document frequencies are estimated in 65,536 cells (a fixed size, summed over all documents).
   The shingles of a set are ordered by that estimate; two similar sets share one of their first
   n - ceil(share * n) + 1. Only those prefix shingles are shuffled, once and by shingle, and a row stays only where the next smaller or next larger
   set with its shingle is of a size that fits: rows without such a neighbour are in no pair.
3. A pair is formed at the first prefix shingle that its sets share: not where they also share one of the few shared shingles before it,
   as an earlier group has the pair then. There it passes the length filter, the positional filter (the common shingles can't exceed the
   shorter rest from that place on, nor those of the rest that any other set shares) and the suffix filter: a 512-bit parity
   map per set, whose Hamming distance never exceeds the symmetric difference. So a pair costs about one row, however many shingles it shares.
4. First each set is verified against its nearest earlier neighbour over all its groups, which already
   links most of what belongs together. Then every remaining pair that passes the filters and whose ends are not yet
   in one component is verified, once. Finer parity maps decide most pairs before whole sets are fetched, and only sets of pairs left are. Pairs inside a component aren't formed, so a group of
   thousands of copies costs rows in proportion to its size, while no link between components is lost.
   Texts, and rows of groups, that end in no pair are left behind by a bitmap of the wanted names before anything of them is shuffled.
5. Components come from alternating large-star and small-star steps.

A group of more than ``BLOCK`` sets is cut into blocks, and block pairs are spread over tasks. Verification is exact on
the whole sets. All steps are written to the shared folder.

Defined results: words are runs of anything but space and the controls 9 to 13, with A-Z in lower case. A text with fewer words
than a shingle has one shingle, all its words. A text without words, or null, has an empty set and links with nothing:
its component is its own id. A row with a null id links with nothing and has a null component. Rows that share an id count as separate texts
under one id. Repeated rows give repeated results. An empty table gives an empty table; other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import drop, hash_words, mix, packed, pieces, split_words, stage
from sensorloom.session import materialise

WORDS = 3
PERCENT = 90
CELL_BITS = 16
MAP_BITS = 512
BLOCK = 1024
EARLIER = 4  # shared shingles before a row's own that the row knows
CHUNK = 400_000  # pairs filtered at a time
BITS = 16  # of a bitmap, for each wanted value
MOST_BITS = 1 << 25  # beyond two million wanted values more than one in 16 others pass it
SEED = np.uint64(0x2545F4914F6CDD1D)


# --- Sets --------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by text and shingle, and the text each belongs to."""
    rows, found = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = hash_words(found)
    if not len(rows):
        return rows, hashes
    counts = np.bincount(rows, minlength=len(texts))
    long = counts >= words
    at = np.flatnonzero(long[rows])
    if len(at) >= words:
        at = at[: len(at) - words + 1][rows[at[words - 1 :]] == rows[at[: len(at) - words + 1]]]
    out = np.full(len(at), SEED)
    for k in range(words):
        out = mix(out * np.uint64(3) + hashes[at + k])
    owner = rows[at]
    few = np.flatnonzero(~long & (counts > 0))
    starts = np.searchsorted(rows, few)
    whole = mix(SEED + counts[few].astype(np.uint64))
    for k in range(words - 1):
        more = counts[few] > k
        whole[more] = mix(whole[more] * np.uint64(3) + hashes[starts[more] + k])
    out, owner = np.concatenate([out, whole]), np.concatenate([owner, few])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], out[new]


def signatures(owner: np.ndarray, shingles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each set and a 64-bit name of its content."""
    size = np.bincount(owner, minlength=n)
    ends = np.cumsum(size)
    total = np.append(np.uint64(0), np.cumsum(mix(shingles + SEED), dtype=np.uint64))
    return size, mix((total[ends] - total[ends - size]) ^ mix(size.astype(np.uint64)))


def parity_maps(owner: np.ndarray, shingles: np.ndarray, n: int) -> list[bytes]:
    """For each set MAP_BITS bits: how many of its shingles fall on the bit, modulo 2."""
    bit = (shingles & np.uint64(MAP_BITS - 1)).astype(np.int64)
    counts = np.bincount(owner * MAP_BITS + bit, minlength=n * MAP_BITS) & 1
    return [x.tobytes() for x in np.packbits(counts.reshape(n, MAP_BITS).astype(np.uint8), axis=1)]


def fine_maps(owner: np.ndarray, shingles: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parity maps of two to four bits per shingle, a power of two each."""
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * size, MAP_BITS))).astype(np.int64))
    ends = np.append(0, np.cumsum(bits))
    at = ends[owner] + (shingles & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    return packed(np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8)), ends // 8)


def _describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "sig", "n", "map", "cell", "df"]
    total, kind = np.zeros(1 << CELL_BITS, np.int64), None
    for piece in pieces(batches, "text"):
        owner, shingles = shingle_sets(piece.column("text"), words)
        size, sig = signatures(owner, shingles, piece.num_rows)
        total += np.bincount((shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
        kind, none = piece.column("id").type, piece.num_rows
        yield pa.RecordBatch.from_arrays(
            [piece.column("id"), pa.array(sig.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(parity_maps(owner, shingles, none), pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64())], names=names,
        )
    cells = np.flatnonzero(total)
    if len(cells):
        none = len(cells)
        yield pa.RecordBatch.from_arrays([pa.nulls(none, kind), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=names)


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, frequency: np.ndarray) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        owner, shingles = shingle_sets(piece.column("text"), words)
        size, sig = signatures(owner, shingles, piece.num_rows)
        _, first = np.unique(sig, return_index=True)  # copies in a slice once
        keep = np.zeros(piece.num_rows, bool)
        keep[first] = True
        owner, shingles = owner[keep[owner]], shingles[keep[owner]]
        order = np.lexsort((shingles, frequency[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)], owner))
        owner, shingles = owner[order], shingles[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        n = size[owner]
        inside = place < n + (-percent * n // 100) + 1
        own = owner[inside]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shingles[inside].view(np.int64)), pa.array(sig[own].view(np.int64)), pa.array(n[inside].astype(np.int32)), pa.array(place[inside].astype(np.int32))], names=["token", "sig", "n", "place"],
        )


def _contents(batches: Iterator[pa.RecordBatch], words: int, fine: bool) -> Iterator[pa.RecordBatch]:
    """The shingles of each set, or with ``fine`` its finer parity map."""
    for piece in pieces(batches, "text"):
        owner, shingles = shingle_sets(piece.column("text"), words)
        size, sig = signatures(owner, shingles, piece.num_rows)
        meant = pa.array(sig.view(np.int64) == piece.column("sig").to_numpy(zero_copy_only=False))
        content = fine_maps(owner, shingles, size) if fine else packed(shingles, np.append(0, np.cumsum(size)))
        columns = [piece.column("sig"), pa.array(size.astype(np.int32)), content]
        yield pa.RecordBatch.from_arrays([c.filter(meant) for c in columns], names=["sig", "n", "content"])


# --- Candidates --------------------------------------------------------------------------------


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, size and name. Groups are whole: the last one of a batch waits for the next batch.
    With ``nearest`` each set gets its nearest earlier one, and sets that are the earlier one of any pair are named alone."""
    held: pa.Table | None = None

    def groups() -> Iterator[pa.Table]:
        nonlocal held
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [held.column(c).to_numpy() for c in ("token", "low", "high")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            if len(change):
                cut = int(change[-1]) + 1
                yield held.slice(0, cut)
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield held

    for rows in groups():
        token, low, high, block, sig, n, place, left, label = (rows.column(c).to_numpy() for c in ("token", "low", "high", "block", "sig", "n", "place", "left", "label"))
        earlier = np.stack([rows.column(f"earlier_{k}").to_numpy() for k in range(EARLIER)], 1)
        maps = np.frombuffer(b"".join(rows.column("map").to_pylist()), np.uint64).reshape(len(token), MAP_BITS // 64)
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.cumsum(first) - 1
        start = np.flatnonzero(first)[group]
        # Sorted by group and size: the earlier sets that are not too small for a set begin at ``least``.
        n = n.astype(np.int64)
        # Of two sets, the one whose prefix ends first has all common shingles among its shared ones and those behind its prefix.
        common = left + -(-percent * n // 100) - 1
        span = int(n.max(initial=0)) + 1
        least = np.maximum(start, np.searchsorted(group * span + n, group * span + -(-percent * n // 100)))
        many = np.arange(len(token)) - least
        ends = np.cumsum(many)
        step = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + CHUNK, CHUNK), "right"))
        for a, b in zip([0, *step], [*step, len(token)]):
            count = many[a:b]
            if not count.sum():
                continue
            late = np.repeat(np.arange(a, b), count)
            early = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(least[a:b], count)
            total = n[late] + n[early]
            need = -(-percent * total // (100 + percent))
            after = np.minimum(n[late] - place[late], n[early] - place[early])
            fit = (after >= need) & (np.maximum(common[late], common[early]) >= need) & (label[late] != label[early]) & (sig[late] != sig[early])
            fit &= (low[late] == high[late]) | (block[late] != block[early])
            late, early, total, need = late[fit], early[fit], total[fit], need[fit]
            known = earlier[late]
            fit = np.ones(len(late), bool)
            for k in range(EARLIER):
                other = earlier[early, k]
                fit &= ~((known == other[:, None]).any(axis=1) & (other != 0))
            late, early, total, need = late[fit], early[fit], total[fit], need[fit]
            apart = np.bitwise_count(maps[late] ^ maps[early]).sum(axis=1, dtype=np.int64)
            fit = apart <= total - 2 * need
            late, early, apart = late[fit], early[fit], apart[fit]
            others = np.unique(sig[early]) if nearest else early[:0]
            if nearest and len(late):
                order = np.lexsort((sig[early], apart, late))
                one = order[np.append(True, late[order][1:] != late[order][:-1])]
                late, early, apart = late[one], early[one], apart[one]
            if len(late):
                yield pa.RecordBatch.from_arrays([pa.array(sig[late]), pa.array(sig[early]), pa.array(apart.astype(np.int32))], names=["a", "b", "apart"])
            if len(others):
                yield pa.RecordBatch.from_arrays([pa.array(others), pa.nulls(len(others), pa.int64()), pa.nulls(len(others), pa.int32())], names=["a", "b", "apart"])


def candidates(groups: DataFrame, labels: DataFrame | None, percent: int, nearest: bool) -> DataFrame:
    """Pairs (``a``, ``b``) that pass the filters. ``labels``: ``sig`` and ``label``; pairs inside a label are left out.
    With ``nearest`` the nearest ``b`` of each ``a``, null for sets that only stand on the other side of a pair."""
    rows = groups.withColumn("label", F.col("sig")) if labels is None else groups.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    sorted_ = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "sig")
    pairs = sorted_.mapInArrow(lambda b: _candidates(b, percent, nearest), "a long, b long, apart int")
    if nearest:
        return pairs.groupBy("a").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("apart", "b")))["b"].alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def blocked(prefixes: DataFrame, described: DataFrame, percent: int = 0) -> DataFrame:
    """Prefix rows of shingles that several sets have whose sizes allow the share, with parity maps, each in all block pairs of its group. ``left``: how many such
    rows the set has from this one on; ``earlier_0`` and on: the shingles of the rows just before, 0 for none."""
    group = Window.partitionBy("token")
    sized = group.orderBy("n", "sig")
    size = F.col("n").cast("long")
    fits = (100 * F.lag(size).over(sized) >= percent * size) | (100 * size >= percent * F.lead(size).over(sized))
    met = prefixes.withColumn("fits", fits).where("fits").withColumn("before", F.lag("sig").over(sized)).where("before IS NULL OR before != sig")
    fitting = met.withColumn("fits", fits).where("fits").withColumn("held", F.count("*").over(group))
    rows = stage(fitting.select("token", "sig", "n", "place", "held"), "shared")
    maps = described.where("sig IS NOT NULL AND n > 0").groupBy("sig").agg(F.first("map").alias("map"))
    own = Window.partitionBy("sig")
    earlier = [f"earlier_{k}" for k in range(EARLIER)]
    left = (F.count("*").over(own) - F.row_number().over(own.orderBy("place")) + 1).cast("int")
    ranked = rows.select("*", left.alias("left"), *[F.lag("token", k + 1, 0).over(own.orderBy("place")).alias(c) for k, c in enumerate(earlier)])
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    told = ranked.join(maps, "sig").withColumn("blocks", blocks).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("sig"), F.col("blocks"))).otherwise(0).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return told.withColumn("other", other).select("token", "sig", "n", "place", "left", *earlier, "map", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def narrowed(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be a value of ``wanted``, a written table of one column: all that are, and few others. The bitmap
    of the wanted hashes is bounded and goes to the tasks, so that the rows need not be shuffled to find out."""
    bits = min(MOST_BITS, 1 << max(16, (BITS * wanted.count()).bit_length()))

    def cell(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(bits))

    cells = wanted.select(cell(wanted.columns[0]).alias("_cell"))
    words = cells.groupBy(F.shiftright("_cell", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_cell % 64 AS int))")).alias("_bits"))
    own = rows.withColumn("_cell", cell(column)).withColumn("_word", F.shiftright("_cell", 6))
    return own.join(F.broadcast(words), "_word").where(F.bit_get("_bits", (F.col("_cell") % 64).cast("int")) == 1).select(*rows.columns)


# --- Verification and components ---------------------------------------------------------------


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("sig").alias("a"), F.col("content").alias("left"), F.col("n").alias("n_left"))
    right = sets.select(F.col("sig").alias("b"), F.col("content").alias("right"), F.col("n").alias("n_right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right", "n_left", "n_right")


def close(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose fine parity maps allow the share. The maps are a small part of the sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "left"):
            total = piece.column("n_left").to_numpy().astype(np.int64) + piece.column("n_right").to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            apart = []
            for x, y in zip(piece.column("left"), piece.column("right")):
                one, two = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                while len(one) > len(two):
                    one = one[: len(one) // 2] ^ one[len(one) // 2 :]
                while len(two) > len(one):
                    two = two[: len(two) // 2] ^ two[len(two) // 2 :]
                apart.append(int(np.bitwise_count(one ^ two).sum(dtype=np.int64)))
            mask = pa.array(np.array(apart, np.int64) <= most)
            yield pa.RecordBatch.from_arrays([piece.column("a").filter(mask), piece.column("b").filter(mask)], names=["a", "b"])

    return stage(beside(pairs, maps).mapInArrow(check, "a long, b long"), "close")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "left"):
            fit = []
            for x, y in zip(piece.column("left"), piece.column("right")):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(one, two, assume_unique=True))
                fit.append(100 * common >= percent * (len(one) + len(two) - common))
            mask = pa.array(fit, pa.bool_())
            yield pa.RecordBatch.from_arrays([piece.column("a").filter(mask), piece.column("b").filter(mask)], names=["a", "b"])

    return stage(beside(pairs, sets).mapInArrow(check, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """``sig`` and ``label``, the smallest name of the component, for every end of a link except the smallest itself."""
    edges, before = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u != v").distinct()
        edges = materialise(small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            return edges.select(F.col("u").alias("sig"), F.col("v").alias("label"))
        before = now


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest id that links lead to."""
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    described = stage(own.mapInArrow(lambda b: _describe(b, words), f"id {kind}, sig long, n int, map binary, cell int, df long"), "described")
    frequency = np.zeros(1 << CELL_BITS, np.int64)
    for r in described.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("df").alias("df")).collect():
        frequency[r["cell"]] = r["df"]
    described = described.where("cell IS NULL")
    known = own.where("id IS NOT NULL")
    prefixes = known.mapInArrow(lambda b: _prefixes(b, words, percent, frequency), "token long, sig long, n int, place int")
    groups = stage(blocked(prefixes, described.where("id IS NOT NULL"), percent), "groups")

    nearest = stage(candidates(groups, None, percent, True), "nearest")
    involved = nearest.select(F.col("a").alias("sig")).union(nearest.where("b IS NOT NULL").select("b")).distinct()
    chosen = stage(described.where("id IS NOT NULL").join(involved, "sig").groupBy("sig").agg(F.min("id").alias("id")), "chosen")

    def contents(wanted: DataFrame, fine: bool, kind: str) -> DataFrame:
        texts = narrowed(known, "id", wanted.select("id")).join(wanted, "id").select("sig", "text")
        return stage(texts.mapInArrow(lambda b: _contents(b, words, fine), "sig long, n int, content binary"), kind)

    def linked(pairs: DataFrame) -> DataFrame:
        near = close(pairs, fine, percent)
        ends = near.select(F.col("a").alias("sig")).union(near.select("b")).distinct()
        sets = contents(stage(chosen.join(ends, "sig"), "wanted"), False, "sets")
        links = verified(near, sets, percent)
        drop(sets)
        return links

    fine = contents(chosen, True, "fine")
    links = linked(nearest.where("b IS NOT NULL"))
    labels = components(links)
    rest = stage(candidates(narrowed(groups, "sig", chosen.select("sig")), labels, percent, False), "rest")
    drop(groups)
    more = linked(rest)
    if not more.isEmpty():
        labels = components(links.union(more))

    member = described.select("id", "n", "sig").join(labels, "sig", "left").select("id", "n", F.coalesce("label", "sig").alias("label"))
    named = F.col("id").isNotNull() & (F.col("n") > 0)
    # Written, so that the join below may split a component that holds a large part of all rows.
    least = materialise(member.where(named).groupBy("label").agg(F.min("id").alias("component")), "least")
    joined = member.where(named).join(least, "label").select("id", "n", "component")
    alone = member.where(~named).select("id", "n", F.col("id").alias("component"))
    return joined.union(alone).select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
