"""Ranked lexical search: the best documents of every query by saturated term weights.

A document's impact vector has a coordinate for each term of the queries; its score for a query
is the inner product with the query's weights.  Vectors are ordered by length and cut into
buckets.  By Cauchy and Schwarz a bucket whose longest vector cannot reach a query's current
threshold is skipped for it.  Inside a bucket the query's heaviest coordinates are read first:
what they give, and the lengths of what is left on both sides, bound each score from above, and
only documents whose bound reaches the threshold are scored, in whole numbers.

Thresholds begin with what the longest vectors reach, so every task prunes from its first bucket.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, new_path, stored

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Search:
    """Results of a query; queries and bytes of a block of queries; longest vectors that set the
    first thresholds; coordinates read before a score is bounded; cells of a bucket."""

    top: int = 50
    block_queries: int = 4096
    block_bytes: int = 4 << 20
    seeds: int = 512
    focus: int = 6
    cells: int = 4 << 20


def terms(text: str | None) -> list[str]:
    return TERM.findall(text.encode().translate(LOWER).decode()) if text else []


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def vectors(docs: DataFrame, key: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """key, n_terms, and for each term of the vocabulary that the whole text holds its number and
    occurrences (ids ascending)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for at in range(len(batch)):
                found = terms(batch.column(1)[at].as_py())
                held = sorted((known[t], n) for t, n in Counter(found).items() if t in known)
                sizes.append(len(found))
                ids.append([h[0] for h in held])
                tfs.append([h[1] for h in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["key", "n_terms", "ids", "tfs"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_terms long, ids array<int>, tfs array<int>")


class Best:
    """The best results of one query so far; equal scores by key, a missing one first."""

    def __init__(self, top: int, least: int):
        self.top, self.least, self.rows = top, least, []

    def add(self, scores: list[int], keys: list) -> None:
        self.rows += zip(scores, keys)
        if len(self.rows) >= 4 * self.top:
            self.cut()

    def cut(self) -> None:
        self.rows = sorted(self.rows, key=lambda r: (-r[0], r[1] is not None, r[1]))[: self.top]
        if len(self.rows) == self.top:
            self.least = max(self.least, self.rows[-1][0])


class Query:
    """Term numbers and weights, heaviest first, and the length of what the focus leaves out."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, focus: int):
        order = np.argsort(-weights, kind="stable")
        self.ids, self.weights = ids[order], weights[order]
        self.length = math.sqrt(float(np.sum(self.weights.astype(float) ** 2)))
        self.rest = math.sqrt(float(np.sum(self.weights[focus:].astype(float) ** 2)))


def search_bucket(cells: np.ndarray, length: np.ndarray, keys: list, queries: list[Query], best: list[Best], focus: int) -> None:
    """Take a bucket of impact vectors (terms x documents) of the given lengths into best."""
    longest = float(length.max())
    square = length**2
    for query, found in zip(queries, best):
        if longest * query.length * (1 + 1e-9) < found.least or not len(query.ids):
            continue
        head = cells[query.ids[:focus]]
        part = query.weights[:focus] @ head
        left = np.sqrt(np.maximum(square - np.einsum("ij,ij->j", head, head, dtype=np.float64), 0)) * query.rest
        live = np.flatnonzero((part + left) * (1 + 1e-9) >= max(found.least, 1))
        if not len(live):
            continue
        score = part[live] + query.weights[focus:] @ cells[np.ix_(query.ids[focus:], live)]
        kept = score >= max(found.least, 1)
        if kept.any():
            found.add(score[kept].tolist(), [keys[i] for i in live[kept]])


def best_of(rows: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], least: list[int], n_terms: int, rule: Search) -> DataFrame:
    """query, key, score: each task's best rows of vectors(key, length, ids, xs), ordered by
    length, for every query; never fewer than rule.top of those that reach the threshold."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, least))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Query(ids, weights, rule.focus) for ids, weights in shared.value[0]]
        best = [Best(rule.top, t) for t in shared.value[1]]
        width = max(16, min(2048, rule.cells // max(1, n_terms)))
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, length = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            ids, xs = batch.column(2), batch.column(3)
            ends = np.asarray(ids.offsets)
            ids, xs = np.asarray(ids.values), np.asarray(xs.values)
            for a in range(0, len(keys), width):
                b = min(a + width, len(keys))
                cells = np.zeros((n_terms, b - a), np.int64)
                cut = slice(ends[a], ends[b])
                cells[ids[cut], np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))] = xs[cut]
                search_bucket(cells, length[a:b], keys[a:b], asked, best, rule.focus)
        for k, found in enumerate(best):
            found.cut()
            if found.rows:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found.rows), pa.int32()), pa.array([r[1] for r in found.rows], key_type), pa.array([r[0] for r in found.rows], pa.int64())], names=["query", "key", "score"])

    return rows.select("key", "length", "ids", "xs").mapInArrow(run, f"query int, key {kind}, score long")


def ranked(rows: DataFrame, top: int, *within: str | Column) -> DataFrame:
    order = Window.partitionBy("query", *within).orderBy(F.desc("score"), F.asc_nulls_first("key"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def block_results(docs: DataFrame, asked: list[str | None], key: str, text: str, rule: Search) -> DataFrame:
    """query (a place in asked), key, score, rank for one block of query texts."""
    spark = docs.sparkSession
    held = [sorted(set(terms(t))) for t in asked]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*held)))} if held else {}
    path = new_path(spark, "vectors")
    found = stored(vectors(docs, key, text, vocabulary), "vectors", path)
    n, size = found.filter("n_terms > 0").agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    spread = {r.id: r.df for r in found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect()}
    weights = np.array([term_weight(n, spread.get(k, 0)) for k in range(len(vocabulary))], np.int64)
    queries = [(at := np.array([vocabulary[t] for t in h], np.int64), weights[at]) for h in held]
    m = F.expr(f"50L + (cast(50 * n_terms as decimal(38, 0)) * {n}) div {max(1, size)}")
    rows = found.filter("size(ids) > 0").withColumn("m", m).withColumn("xs", F.expr("transform(tfs, f -> (1000000000L * f) div (1000L * f + 20L * m))"))
    length = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    lengths = rows.select("key", length.alias("length"), F.xxhash64("key", "ids", "tfs").alias("salt"), "ids", "xs")
    by_length = lengths.repartitionByRange(F.desc("length"), "salt").sortWithinPartitions(F.desc("length"))
    ordered_path = new_path(spark, "impacts")
    ordered = stored(by_length, "impacts", ordered_path)
    discard(spark, path)
    first = ordered.select("length", "salt").orderBy(F.desc("length"), "salt").limit(rule.seeds).agg(F.min(F.struct("length", (-F.col("salt")).alias("salt"))).alias("last")).first().last
    if first is None:
        return spark.createDataFrame([], f"query int, key {rows.schema['key'].dataType.simpleString()}, score long, rank int")
    seed = (F.col("length") > first.length) | ((F.col("length") == first.length) & (-F.col("salt") >= first.salt))
    begun = stored(best_of(ordered.filter(seed), queries, [0] * len(queries), len(vocabulary), rule), "seeds")
    enough = {r.query: r.score for r in ranked(begun, rule.top).filter(F.col("rank") == rule.top).collect()}
    more = best_of(ordered.filter(~seed), queries, [enough.get(k, 0) for k in range(len(queries))], len(vocabulary), rule)
    both = stored(begun.unionByName(more), "best")
    discard(spark, ordered_path)
    # two steps: what many tasks found for one query is cut down in parts first
    return ranked(ranked(both, rule.top, F.pmod(F.xxhash64("key"), F.lit(16))).drop("rank"), rule.top)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rule: Search = Search()) -> DataFrame:
    """item_key, rank, key, score: the `top` documents of each item with a score above 0.

    Statistics cover all documents.  Null and empty texts have no terms, are not counted and
    found by nothing; an item without terms finds nothing; very long texts are read whole.  Equal
    scores come by ascending key, a missing key first; rows that repeat a key are ranked each by
    itself, repeated items answered each; empty tables give no rows; other columns are ignored,
    whatever their names.  Items are asked in blocks of bounded size, each against all documents.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("asked"))
    texts = rows.filter("asked is not null").select("asked").distinct()
    count, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("asked")), F.lit(0))).first()
    blocks = max(1, -(-count // rule.block_queries), -(-size // rule.block_bytes))
    out = None
    for block in range(blocks):
        asked = [r.asked for r in texts.filter(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == block).collect()]
        found = block_results(docs, asked, key, text, rule)
        names = spark.createDataFrame(list(enumerate(asked)), "query int, asked string")
        part = found.join(F.broadcast(names), "query").drop("query")
        out = part if out is None else out.unionByName(part)
    return rows.join(out, "asked").select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
