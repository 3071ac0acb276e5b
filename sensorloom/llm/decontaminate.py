"""Benchmark decontamination: windows of a text that are nearly equal to a benchmark item.

1. Words are runs of letters and digits in lower case; shingles are five words in a row, weighted by how
   often they occur (an item of fewer words is one shingle).
2. Item-sized windows: a window of m shingles reaches similarity t with an item of m shingles only if at least 2tm / (1 + t) of its
   places hold a shingle of an item of that size. Every window that has so many gets a fingerprint, wherever in it they stand, so
   that reordered, inserted and deleted words are found too. A text shorter than the item is one window, with its own bound.
3. Equal windows count once from here on. Each gets a 64-bit SimHash of its weighted shingles, as has each item.
4. Multi-index: ``radius + 1`` blocks of the bits. Two fingerprints within the radius agree in at least one
   block, so joining on (item size, block number, block value) finds all of them.
5. Candidates within the radius are verified by the weighted Jaccard similarity of the shingle texts.

At the limit of 0.8 the expected distance is 9.6 bits of 64, its deviation 2.9; the default radius of 15 hence loses about 2 %
of windows just at the limit, and none that is equal to an item.

DataFrame expressions only. The shingle rows of the texts meet the items' shingles in a join that is a broadcast while the items have at most
``BROADCAST_ROWS`` different shingles, and a shuffle beyond; the same holds for fetching window texts. Hot passages collapse in step 3.

Defined results: a null or empty text, and one without letters or digits, matches nothing; so does such an item. Null ids are kept as
ids of matches. Repeated rows and rows that share an id are matched by (id, text); equal rows give one match. Equal items give
a match each. Empty tables give no matches. ``remove`` keeps all columns and rows of texts without a match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import stage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BROADCAST_ROWS = 200_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """The hash of every shingle, in order; of all words where there are fewer."""
    def each(h: Column) -> Column:
        last = F.greatest(F.size(h) - size, F.lit(0))
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.coalesce(F.get(h, i + k), F.lit(0)) for k in range(size)])))

    return let(F.transform(words, lambda w: F.xxhash64(w)), each)


def shingle_texts(words: Column, size: int) -> Column:
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is proven to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def weighted(texts: DataFrame, key: list[str], size: int) -> DataFrame:
    """``key``, ``shingle``, ``weight`` of texts with a ``words`` array."""
    return texts.select(*key, F.explode(shingle_texts(F.col("words"), size)).alias("shingle")).groupBy(*key, "shingle").agg(F.count("*").alias("weight"))


def fingerprints(shingles: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``print`` (SimHash) and ``total`` (weight). A long holds two counters, so 32 sums count 64 bits."""
    hashed = shingles.withColumn("h", F.xxhash64("shingle"))
    pair = F.lit(0x0000000100000001)
    sums = [F.sum(F.col("weight") * F.shiftrightunsigned("h", j).bitwiseAND(pair)).alias(f"s{j}") for j in range(32)]
    counted = hashed.groupBy(*key).agg(F.sum("weight").alias("total"), *sums)
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{j}", 32)
        for count, place in ((low, j), (high, j + 32)):
            bits = bits.bitwiseOR(F.when(2 * count > F.col("total"), F.shiftleft(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long")))
    return counted.select(*key, bits.alias("print"), "total")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the radius + 1 blocks."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_rows(prints: DataFrame, radius: int) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("no"), F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for i, (a, n) in enumerate(blocks(radius))]
    return prints.withColumn("block", F.explode(F.array(*parts))).withColumn("no", F.col("block.no")).withColumn("value", F.col("block.value")).drop("block")


def within(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Pairs of a window fingerprint and an item fingerprint of the same size within the radius, each once."""
    left = block_rows(windows.withColumnRenamed("print", "own").withColumn("print", F.col("own")), radius).drop("print")
    right = block_rows(items.withColumnRenamed("print", "item_print").withColumn("print", F.col("item_print")), radius).drop("print")
    differ = F.col("own").bitwiseXOR(F.col("item_print"))
    same = F.array(*[differ.bitwiseAND(F.lit(signed(((1 << n) - 1) << a))) == 0 for a, n in blocks(radius)])
    first = F.array_position(same, True) - 1  # a pair that agrees in several blocks counts in the first
    found = left.join(right, ["size", "no", "value"]).withColumn("distance", F.bit_count(differ))
    return found.where((F.col("distance") <= radius) & (first == F.col("no")))


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def window_starts(hits: Column, n: Column, size: Column, shingle: int, similarity: float) -> Column:
    """All starts of windows of ``size`` words that can reach the similarity, from the sorted places of shingles of such items in a text
    of ``n`` words: the i-th place is the first one in the window, and the last one needed still lies in it."""
    held = F.greatest(F.least(size, n) - F.least(size, F.lit(shingle)) + 1, F.lit(1))  # shingles of a window
    own = F.greatest(size - shingle + 1, F.lit(1))  # and of the item
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (held + own) - 1e-9).cast("int")
    need = F.greatest(need, F.lit(1))

    def starts(i: Column) -> Column:
        low = F.greatest(F.when(i > 0, F.get(hits, i - 1) + 1).otherwise(F.lit(0)), F.get(hits, i + need - 1) - held + 1)
        high = F.least(F.get(hits, i), F.greatest(n - size, F.lit(0)))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(hits) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - need), starts))).otherwise(F.array().cast("array<int>"))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``key``, ``hash`` (of the text), ``item``, ``start`` and ``words`` (the window), ``distance`` and ``similarity``: the best window per text and item."""
    told = stage(items.select(F.col(item_key).alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0).withColumn("size", F.size("words")), "items")
    # Items shorter than a shingle are met by shingles of their own size.
    widths = sorted(r[0] for r in told.select(F.least("size", F.lit(size))).distinct().collect()) or [size]
    rows_of = lambda df, w, *keep: df.select(*keep, F.lit(w).alias("width"), F.posexplode(shingle_hashes(F.col("words"), w)).alias("at", "shingle"))
    spots = reduce(DataFrame.union, [rows_of(told.where(F.least("size", F.lit(size)) == w), w, "size") for w in widths]).drop("at").distinct()
    spots = small(stage(spots, "spots"))

    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    read = own.select("id", F.xxhash64("text").alias("hash"), words_of(F.col("text")).alias("words"))
    sized = read.withColumn("n", F.size("words"))
    placed = reduce(DataFrame.union, [rows_of(sized, w, "id", "hash", "n") for w in widths])
    # A group is one text and item size: at most a place per word of it, however often its row is repeated.
    hits = placed.join(spots, ["width", "shingle"]).groupBy("id", "hash", "size").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("at")).alias("hits"))
    windows = hits.select("id", "hash", "size", F.explode(window_starts(F.col("hits"), F.col("n"), F.col("size"), size, similarity)).alias("start"))
    windows = stage(windows, "windows")

    same = (F.col("w.id").eqNullSafe(F.col("r.id"))) & (F.col("w.hash") == F.col("r.hash"))
    cut = read.alias("r").join(small(windows).alias("w"), same).select("r.id", "r.hash", "size", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))
    cut = stage(cut.withColumn("content", F.array_join("words", " ")).distinct(), "cut")

    contents = cut.select("size", "content", "words").dropDuplicates(["size", "content"])
    window_shingles = stage(weighted(contents, ["size", "content"], size), "window_shingles")
    item_shingles = stage(weighted(told, ["size", "item"], size), "item_shingles")
    near = within(fingerprints(window_shingles, ["size", "content"]), fingerprints(item_shingles, ["size", "item"]).withColumnRenamed("total", "item_total"), radius)
    near = stage(near.select("size", "content", "item", "distance", "total", "item_total"), "near")

    other = item_shingles.select("size", "item", "shingle", F.col("weight").alias("item_weight"))
    common = near.join(window_shingles, ["size", "content"]).join(other, ["size", "item", "shingle"]).groupBy("size", "content", "item", "distance", "total", "item_total").agg(F.sum(F.least("weight", "item_weight")).alias("common"))
    score = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    good = common.withColumn("similarity", score).where(F.col("similarity") >= similarity).select("size", "content", "item", "distance", "similarity")

    best = F.max_by(F.struct("start", F.col("size").alias("words"), "distance"), F.struct("similarity", -F.col("distance"), -F.col("start"))).alias("best")
    found = cut.join(good, ["size", "content"]).groupBy("id", "hash", "item").agg(best, F.max("similarity").alias("similarity"))
    return found.select(F.col("id").alias(key), "hash", "item", "best.start", "best.words", "best.distance", "similarity")


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text has no window that matches an item."""
    hit = small(stage(matches(docs, items, key, text, **options).select(F.col(key).alias("hit_id"), F.col("hash").alias("hit_hash")).distinct(), "hits"))
    return docs.join(hit, docs[key].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs[text]) == hit["hit_hash"]), "left_anti")
