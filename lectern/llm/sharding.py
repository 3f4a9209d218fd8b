"""Sharding: a uniform shuffle of rows into shards of exact sizes, by columns alone.

Every input partition is permuted where it lies.  How many of its rows go to each shard is drawn
from the distribution that a uniform permutation of all rows would give (the communication
matrix, multivariate hypergeometric), so rows need not be compared across partitions.  The rows
of a partition are dealt by those counts, exchanged once, and permuted again within their shard.

The matrix is drawn by halving: the partitions' sizes are split in two, the left half's share of
every shard is drawn given the totals, and both halves go on alike.  A single draw walks outwards
from the mode of the hypergeometric distribution until its uniform number is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of a shard that are put into order together.
BUCKET_ROWS = 16384
#: Bits of monotonically_increasing_id() below the partition's number.
PLACE_BITS = 33


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 7, good to 1e-9."""
    x = n.cast("double") + 7.0
    down = F.lit(1.0)
    for k in range(1, 8):
        down = down * (n + F.lit(float(k)))
    return (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - F.ln(down)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that the parts fix."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * 2.0**-53


def hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """How many of `good` items are among `draws` out of `total`, by inversion with u from the
    mode outwards.  What rounding leaves of u beyond 12 deviations gives the mode."""
    rest = total - good
    least, most = F.greatest(F.lit(0), draws - rest), F.least(draws, good)
    mode = F.floor((draws + 1.0) * (good + 1.0) / (total + 2.0)).cast("long")
    spread = F.sqrt(draws * (good / F.greatest(total, F.lit(1))) * (rest / F.greatest(total, F.lit(1))))
    steps = F.least(most - least, F.ceil(12 * spread) + 30)

    none = F.lit(-1).cast("long")

    def walk(at: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            up = s.p_up * ((good - s.up) * (draws - s.up)) / ((s.up + 1.0) * (rest - draws + s.up + 1.0))
            down = s.p_down * (s.down * (rest - draws + s.down * 1.0)) / ((good - s.down + 1.0) * (draws - s.down + 1.0))
            further = let(
                F.struct(up.alias("up"), down.alias("down")),
                lambda p: F.struct(
                    (s.left - p.up - p.down).alias("left"), (s.up + 1).alias("up"), (s.down - 1).alias("down"), p.up.alias("p_up"), p.down.alias("p_down"),
                    F.when(s.left <= p.up, s.up + 1).when(s.left <= p.up + p.down, s.down - 1).otherwise(none).alias("x"),
                ),
            )
            return F.when(s.x >= 0, s).otherwise(further)

        def from_mode(p: Column) -> Column:
            first = F.struct((u - p).alias("left"), at.alias("up"), at.alias("down"), p.alias("p_up"), p.alias("p_down"), F.when(u <= p, at).otherwise(none).alias("x"))
            return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1)).cast("long")), first, step, lambda s: F.when(s.x >= 0, s.x).otherwise(at))

        return let(F.exp(log_choose(good, at) + log_choose(rest, draws - at) - log_choose(total, draws)), from_mode)

    return let(F.least(F.greatest(mode, least), most), walk)


def share(columns: Column, draws: Column, total: Column, *where: Column) -> Column:
    """How many of `draws` rows out of `total` go to each shard, given each shard's count."""
    start = F.struct(total.alias("total"), draws.alias("draws"), F.array().cast("array<long>").alias("out"))

    def one(s: Column, c: Column) -> Column:
        u = uniform(*where, F.size(s.out))
        return let(hypergeometric(u, s.total, c, s.draws), lambda x: F.struct((s.total - c).alias("total"), (s.draws - x).alias("draws"), F.concat(s.out, F.array(x)).alias("out")))

    return F.aggregate(columns, start, one, lambda s: s.out)


def total_of(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t + p.n)


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, counts (an array over shards) for sizes(part, n): row sums are the sizes, column
    sums differ by one at most, and all tables with these sums are as likely as under a uniform
    permutation of all rows.  Sizes stand in one row at first, eight bytes a partition."""
    top = sizes.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).filter(F.size("parts") > 0)
    rows = total_of(F.col("parts"))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"n div {shards}") + (s < F.col("n") % shards).cast("long"))
    nodes = top.withColumn("n", rows).select("parts", even.alias("columns"))
    deep = math.ceil(math.log2(max(1, sizes.count())))
    for level in range(deep):
        half = F.greatest(F.lit(1), F.expr("size(parts) div 2"))
        nodes = nodes.withColumn("head", F.slice("parts", F.lit(1), half)).withColumn("tail", F.slice("parts", half + 1, F.size("parts")))
        drawn = share(F.col("columns"), total_of(F.col("head")), total_of(F.col("parts")), F.lit(seed), F.lit(level), F.col("parts")[0].part)
        nodes = nodes.withColumn("mine", F.when(F.size("tail") > 0, drawn).otherwise(F.col("columns")))
        left = F.struct(F.col("head").alias("parts"), F.col("mine").alias("columns"))
        right = F.struct(F.col("tail").alias("parts"), F.zip_with("columns", "mine", lambda a, b: a - b).alias("columns"))
        nodes = nodes.select(F.explode(F.filter(F.array(left, right), lambda x: F.size(x.parts) > 0)).alias("half")).select("half.parts", "half.columns")
        if level == 6:
            nodes = nodes.repartition(F.col("parts")[0].part)
    return nodes.select(F.col("parts")[0].part.alias("part"), F.col("columns").alias("counts"))


def shuffled(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """shard (0 to shards - 1), slot (from 0 without gaps within the shard) and row (all columns
    of docs, as a struct, so that no name clashes) for every row of docs.

    Counts of shards differ by one at most, and every order is as likely as another.  Keys and
    texts play no part: nulls, empty and very long texts, ties and repeated rows are rows like
    others, and repeated ones are spread like others.  An empty table gives no rows; with fewer
    rows than shards some shards stay empty.  The same seed over the same partitions gives the
    same result, also after a lost executor, since drawn numbers are stored before they are used.
    """
    lying = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.rand(seed).alias("u")).sortWithinPartitions("u")
    rows = stored(lying.select("row", F.monotonically_increasing_id().alias("id")), "permuted")
    part, place = F.shiftright("id", PLACE_BITS), F.col("id").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    upto = F.aggregate("counts", F.array().cast("array<long>"), lambda a, c: F.concat(a, F.array(c + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")))))
    matrix = stored(communication_matrix(sizes, shards, seed).select("part", upto.alias("upto")), "matrix")
    buckets = 1 + rows.count() // (shards * BUCKET_ROWS)
    again = F.xxhash64(F.lit(seed + 1), F.col("id"))
    shard = F.size(F.filter("upto", lambda t: t <= F.col("place")))
    dealt = rows.withColumn("part", part).withColumn("place", place).join(matrix, "part").select("row", "id", shard.alias("shard"), F.pmod(again, F.lit(buckets)).alias("bucket"), again.alias("again"))
    order = "sum(n) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).selectExpr("shard", "bucket", f"coalesce({order}, 0) AS before")
    slot = F.expr("row_number() OVER (PARTITION BY shard, bucket ORDER BY again, id) - 1 + before")
    return dealt.join(starts, ["shard", "bucket"]).select("shard", slot.cast("long").alias("slot"), "row")


def write_shards(rows: DataFrame, path: str) -> None:
    """A folder of Parquet for each shard of rows(shard, slot, row); its files follow the slots."""
    dealt = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("shard", "slot", "row.*").write.partitionBy("shard").parquet(path)
