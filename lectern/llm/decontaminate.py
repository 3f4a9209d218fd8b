"""Benchmark decontamination in DataFrame functions only.

A window of a document is as many words as a benchmark item has.  The weights of an item's
shingles are summed over every window that they stand in, in whatever order; what a window
shares with the item is no more than this sum, so one below `least` of the item's weight can't
reach `least`, and no window that counts is left out.  The windows that stay and
items get a 64-bit SimHash of their weighted shingles.  Fingerprints are cut into four blocks of
16 bits; of two within the radius some block differs by at most a fourth of it, so items are
indexed by each block with up to so many bits flipped, and windows are looked up by each block as
it is.  That guarantees all pairs within the radius and lets about one in 25 of the others pass.
Pairs of one size that meet and lie within the radius are verified by exact weighted similarity:
the sum of the smaller weights over the sum of the larger ones, shingle by shingle, repeated
shingles as often as they stand.  A shingle weighs one over the number of items that hold it,
others weigh one.

Two bags of similarity 0.8 differ in about 10 of 64 bits, give or take 3, and nearer ones in
fewer; at a radius of 15 the tests find over nine in ten of the edited items that brute force
finds, and all whole copies.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, checked, finish, free_name, job_name, row_id, stored

BITS, BLOCKS = 64, 4


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def shingles_of(words: Column, width) -> Column:
    """Hashes of the runs of `width` words, by place; empty where there are fewer words."""
    width = width if isinstance(width, Column) else F.lit(width)
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(shingles: Column, weights: Column) -> Column:
    """SimHash: bit b is one if the shingles with a one there weigh more than the others."""
    pairs = F.zip_with(shingles, weights, lambda s, w: F.struct(s.alias("s"), w.alias("w")))

    def bit(b: Column) -> Column:
        vote = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + F.when(_bit(p.s, b) == 1, p.w).otherwise(-p.w))
        return F.when(vote > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda t, x: t.bitwiseOR(x))


def _bit(s: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", s, b).bitwiseAND(F.lit(1).cast("long"))


def blocks_of(simhash: Column) -> Column:
    """(number, bits) of the blocks."""
    wide = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(simhash, i * wide).bitwiseAND(F.lit((1 << wide) - 1).cast("long")).alias("bits")) for i in range(BLOCKS)])


def neighbours_of(block: Column, radius: int) -> Column:
    """The block with every choice of up to radius / BLOCKS of its bits flipped."""
    flips = [sum(1 << b for b in some) for k in range(radius // BLOCKS + 1) for some in combinations(range(BITS // BLOCKS), k)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in flips]), lambda m: F.struct(block["number"].alias("number"), block["bits"].bitwiseXOR(m).alias("bits")))


def similarity(shingles: Column, weights: Column, item_shingles: Column, item_weights: Column) -> Column:
    """Weighted similarity of two bags of shingles.  A shingle weighs the same in both, so the sum
    of the larger weights is what both weigh less the sum of the smaller ones, to which only
    shingles of the item add."""

    def of(w: Column) -> Column:
        return F.aggregate(w, F.lit(0.0), lambda t, x: t + x)

    def shared(p: Column) -> Column:
        number = lambda bag: F.size(F.filter(bag, lambda x: x == p.s))
        return p.w * F.least(number(shingles), number(item_shingles))

    item = F.array_distinct(F.zip_with(item_shingles, item_weights, lambda s, w: F.struct(s.alias("s"), w.alias("w"))))
    held = F.filter(item, lambda p: F.array_contains(shingles, p.s))
    sums = F.array(F.struct(of(F.transform(held, shared)).alias("less"), (of(weights) + of(item_weights)).alias("both")))
    return F.element_at(F.transform(sums, lambda p: F.when(p.both > p.less, F.round(p.less / (p.both - p.less), 12)).otherwise(0.0)), 1)


def small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """df, to be broadcast if its summed bytes are at most `most`; more are joined by a shuffle."""
    sizes = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        sizes = sizes + (24 + 8 * F.size(f.name) if kind.startswith("array") else 16 + F.coalesce(F.octet_length(f.name), F.lit(0)) if kind == "string" else F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(sizes.cast("long"))).first()[0] or 0) <= most else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8, radius: int = 15) -> DataFrame:
    """One row per document and item it holds: key, item, similarity, distance (of the
    fingerprints), start_word, n_words of the best window, the first of several.

    Items with fewer words than `width` are one shingle, and windows of that size are too.
    Null, empty or wordless texts and items match nothing; very long texts are taken whole;
    rows that repeat a key count as one document and rows that repeat an item count once; rows
    without a key are not reported; of windows that tie the first is given; an empty table on
    either side gives no rows; other columns are ignored.
    """
    job = job_name("leaks")
    items = benchmark.select(F.col(f"`{item}`").alias("item"), words_of(F.col(f"`{item_text}`").cast("string")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.size("words")).withColumn("width", F.least(F.lit(width), F.col("n"))).dropDuplicates(["item", "words"])
    items = stored(items.withColumn("shingles", shingles_of(F.col("words"), F.col("width"))).drop("words"), f"{job}/items")
    held = stored(items.select("item", F.explode("shingles").alias("s")).distinct().groupBy("s").agg((1.0 / F.count("*")).alias("w")), f"{job}/weights")
    places = items.select("item", "n", "width", F.explode("shingles").alias("s")).join(held, "s")
    whole = stored(places.groupBy("item", "n", "width").agg(F.sum("w").alias("whole")), f"{job}/wholes")
    starts = stored(places.distinct(), f"{job}/places")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most `width` values

    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = named.select("id", words_of(F.col("text")).alias("words"))
    # one scan lays the shingles of every width
    lists = F.map_from_arrays(F.array(*map(F.lit, widths)), F.array(*[shingles_of(F.col("words"), wide) for wide in widths])) if len(widths) > 1 else None
    if not widths:
        each = rows.select("id", F.lit(0).alias("size"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("s")).filter("false")
    elif len(widths) == 1:
        each = rows.select("id", F.size("words").alias("size"), F.posexplode(shingles_of(F.col("words"), widths[0])).alias("pos", "s"))
    else:
        each = rows.select("id", F.size("words").alias("size"), F.explode(lists).alias("wide", "list")).select("id", "size", F.posexplode("list").alias("pos", "s"))
    hits = stored(each.join(small(starts), "s"), f"{job}/hits")
    # a document without enough of an item in all of it has no window with enough
    enough = F.col("weight") >= F.col("whole") * (least - 1e-9)
    could = hits.groupBy("id", "item", "n").agg(F.sum("w").alias("weight")).join(small(whole), ["item", "n"]).filter(enough).select("id", "item", "n", "whole")
    could = stored(could, f"{job}/could")
    at = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("n") + F.col("width")), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("size") - F.col("n")))))
    laid = hits.join(small(could), ["id", "item", "n"]).select("id", "item", "n", "whole", "w", at.alias("start"))
    windows = stored(laid.groupBy("id", "item", "n", "start").agg(F.sum("w").alias("weight"), F.first("whole").alias("whole")).filter(enough).select("id", "n", "start").distinct(), f"{job}/windows")

    with_words = among(named, windows.select("id").distinct(), "id").select("id", words_of(F.col("text")).alias("words")).dropDuplicates(["id", "words"])
    cut = windows.join(with_words, "id").select("id", "n", "start", F.slice("words", F.col("start") + 1, F.col("n")).alias("words"))
    cut = cut.withColumn("shingles", shingles_of(F.col("words"), F.least(F.lit(width), F.size("words"))))
    # equal windows are fingerprinted once, however many documents share them
    bags = stored(cut.select("id", "n", "start", "shingles"), f"{job}/bags")
    kinds = bags.select("n", "shingles").distinct().withColumn("bag", F.xxhash64("n", "shingles"))
    weighed = kinds.select("bag", "n", F.posexplode("shingles").alias("at", "s")).join(small(held), "s", "left").groupBy("bag", "n").agg(F.array_sort(F.collect_list(F.struct("at", "s", F.coalesce("w", F.lit(1.0)).alias("w")))).alias("list"))
    printed = stored(weighed.select("bag", "n", F.col("list.s").alias("shingles"), F.col("list.w").alias("weights")).withColumn("print", fingerprint(F.col("shingles"), F.col("weights"))), f"{job}/prints")
    item_list = items.select("item", "n", F.posexplode("shingles").alias("at", "s")).join(held, "s").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("at", "s", "w"))).alias("list"))
    item_prints = stored(item_list.select("item", "n", F.col("list.s").alias("i_shingles"), F.col("list.w").alias("i_weights")).withColumn("i_print", fingerprint(F.col("i_shingles"), F.col("i_weights"))), f"{job}/item_prints")

    left = printed.select("bag", "n", "print", F.explode(blocks_of(F.col("print"))).alias("block"))
    right = item_prints.select("item", "n", "i_print", F.explode(blocks_of(F.col("i_print"))).alias("own")).select("item", "n", "i_print", F.explode(neighbours_of(F.col("own"), radius)).alias("block"))
    right = stored(right, f"{job}/neighbours")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("i_print")))
    near = left.join(small(right), ["n", "block"]).withColumn("distance", distance).filter(F.col("distance") <= radius).select("bag", "item", "n", "distance").distinct()
    checked = near.join(printed.select("bag", "shingles", "weights"), "bag").join(small(item_prints.select("item", "n", "i_shingles", "i_weights")), ["item", "n"])
    kept = checked.withColumn("similarity", similarity(F.col("shingles"), F.col("weights"), F.col("i_shingles"), F.col("i_weights"))).filter(F.col("similarity") >= least).select("bag", "item", "n", "distance", "similarity")
    found = bags.withColumn("bag", F.xxhash64("n", "shingles")).drop("shingles").join(kept, ["bag", "n"])
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"), F.col("n"), F.col("distance")))
    out = stored(found.groupBy("id", "item").agg(best.alias("b")), "found")
    finish(docs.sparkSession, job)
    return out.select(F.col("id").alias(key), F.col("item").alias(item), (-F.col("b.s")).alias("similarity"), F.col("b.distance").cast("int").alias("distance"), F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs whose own text holds no benchmark item, with all columns.  Rows are told
    apart by key and text, so a missing or repeated key spares or condemns no other text; null and
    empty texts stay."""
    name = free_name(docs.columns, "row")
    marked = docs.withColumn(name, row_id(key, text))
    leaked = stored(find_leaks(marked.select(name, F.col(f"`{text}`").alias("text")), benchmark, name, "text", **settings).select(name).distinct(), "leaked")
    return marked.join(checked(leaked), name, "left_anti").drop(name)
