"""The best chunks by shared token weights, without scoring every pair that shares a token.

Every token has a largest weight in its book, so it can add only so much to a question's score.
A question's threshold is what its k-th best chunk reaches by one token alone.  Tokens whose
bounds together stay below it cannot bring a chunk among the best by themselves, so only the
lists of the other tokens are read; the common tokens, whose lists are long and weights small,
are mostly among those left out.  A chunk found so is scored exactly only if what it has and what
the left-out tokens may add reach the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import settled
from .retrieval import DIGITS

#: Rows of a posting list that are joined together; longer lists are split.
LIST_ROWS = 100_000
#: What rounding to DIGITS may hide.
SLACK = 1e-6


def list_heads(chunk_weights: DataFrame, k: int) -> DataFrame:
    """book_id, token, top (the largest weight), kth (the k-th largest, 0 if there are fewer) and
    parts of every posting list."""
    one = Window.partitionBy("book_id", "token").orderBy(F.desc("weight"))
    first = chunk_weights.select("book_id", "token", "weight").withColumn("n", F.row_number().over(one)).filter(F.col("n") <= k)
    heads = first.groupBy("book_id", "token").agg(F.max("weight").alias("top"), F.coalesce(F.min(F.when(F.col("n") == k, F.col("weight"))), F.lit(0.0)).alias("kth"))
    sizes = chunk_weights.groupBy("book_id", "token").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    return heads.join(sizes, ["book_id", "token"])


def needed_tokens(query_weights: DataFrame, heads: DataFrame) -> DataFrame:
    """query_id, book_id, token, q, parts, least (the question's threshold), rest (what all the
    tokens left out may add): the tokens of each question whose lists must be read."""
    joined = query_weights.select("query_id", "book_id", "token", F.col("weight").alias("q")).join(heads, ["book_id", "token"])
    one = Window.partitionBy("query_id", "book_id")
    bounds = joined.withColumn("bound", F.col("q") * F.col("top")).withColumn("least", F.max(F.col("q") * F.col("kth")).over(one))
    upto = F.sum("bound").over(one.orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, 0))
    marked = bounds.withColumn("upto", upto).withColumn("needed", F.col("upto") >= F.col("least") - SLACK)
    rest = F.coalesce(F.max(F.when(~F.col("needed"), F.col("upto"))).over(one), F.lit(0.0))
    return marked.withColumn("rest", rest).filter("needed").select("query_id", "book_id", "token", "q", "parts", "least", "rest")


def sparse_top(query_weights: DataFrame, chunk_weights: DataFrame, k: int) -> DataFrame:
    """query_id, book_id, chunk_id, sparse, rank: the k best chunks of each question's book among
    those that share a token, equal scores by the id as a string.

    query_weights(query_id, book_id, token, weight) and chunk_weights(book_id, chunk_id, token,
    weight) hold weights above 0, each token once.  Long lists are dealt in parts, and what a
    question asks of them is sent to every part.
    """
    chunks = chunk_weights.select("book_id", "chunk_id", "token", F.col("weight").alias("c"))
    heads = settled(list_heads(chunk_weights, k))
    needed = settled(needed_tokens(query_weights, heads))
    long = heads.filter("parts > 1").select("book_id", "token", F.col("parts").alias("of"))
    salted = chunks.join(long, ["book_id", "token"], "left").withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.coalesce("of", F.lit(1)))).drop("of")
    asked = needed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    found = asked.join(salted, ["book_id", "token", "salt"]).groupBy("query_id", "book_id", "chunk_id").agg(F.sum(F.col("q") * F.col("c")).alias("part"), F.first("least").alias("least"), F.first("rest").alias("rest"))
    live = found.filter(F.col("part") + F.col("rest") >= F.col("least") - SLACK).select("query_id", "book_id", "chunk_id")
    weights = query_weights.select("query_id", "book_id", "token", F.col("weight").alias("q"))
    pairs = live.join(chunks, ["book_id", "chunk_id"]).join(weights, ["query_id", "book_id", "token"])
    scored = pairs.groupBy("query_id", "book_id", "chunk_id").agg(F.round(F.sum(F.col("q") * F.col("c")), DIGITS).alias("sparse"))
    order = Window.partitionBy("query_id", "book_id").orderBy(F.desc("sparse"), F.col("chunk_id").cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
