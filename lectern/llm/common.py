"""Shared pieces: shared-folder tables, text batches inside tasks, byte hashes, components.

Text crosses into tasks as Arrow batches.  ``text_chunks`` cuts a batch into runs of rows
whose joined bytes stay near one megabyte (a longer text is a chunk of its own), so numpy
work areas stay bounded whatever the batch size is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where it is unset a temporary folder serves, but
    only in local mode, where driver and tasks share one machine; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job_name(name: str) -> str:
    """A folder, within the shared one, for the tables of one job: the start of their names."""
    return f"{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a
    lost executor costs no recomputation."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def finish(spark: SparkSession, job: str) -> None:
    """Delete all tables of a job, whose results are stored elsewhere by now."""
    discard(spark, f"{shared_dir(spark)}/{job}")


#: Ids are broadcast up to this many bytes of them, and only where each has a fixed size.
BROADCAST_BYTES = 2 << 20
WIDTHS = {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "date": 4, "timestamp": 8, "double": 8, "float": 4}


def checked(ids: DataFrame) -> DataFrame:
    """ids (fixed-size columns), marked for a broadcast if their counted bytes allow it; joins
    with more of them are shuffled."""
    widths = [WIDTHS.get(f.dataType.simpleString()) for f in ids.schema.fields]
    if None in widths:
        return ids
    return F.broadcast(ids) if ids.count() * sum(widths) <= BROADCAST_BYTES else ids


def among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is in ids (one column of that name, no repeats)."""
    return df.join(checked(ids), column, "left_semi")


def free_name(columns: list[str], wish: str) -> str:
    """A column name that none of `columns` takes, in whatever case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def row_id(key: str, text: str) -> Column:
    """What tells rows apart: 64 bits of key and text together.  Rows that repeat both are equal;
    texts that share a key, or have none, stay apart."""
    return F.xxhash64(F.lit("row"), F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))


def text_column(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input never clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, joined UTF-8 bytes, offsets within them); a null is empty."""
    texts = batch.column(column).fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (Stafford's variant 13), on unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, base: int, n: int) -> np.ndarray:
    have = _powers[which]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[which] = have if len(have) <= 4 * CHUNK_BYTES else _powers[which]
    return have[:n]


class ByteHash:
    """Hashes of any ranges of one array of bytes, or of words given by their hashes, from prefix
    sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data if data.dtype == np.uint64 else _CODES[data]) * _power(0, _BASE, n), out=self.sums[1:])
        self.down = _power(1, _INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


#: Longest word that the sums hash: modulo 2**64 they can't tell some words of 1024 bytes apart,
#: whatever the base.  Longer ones, which are few, are hashed one by one.
SUMMED_BYTES, SEED = 128, 0x5DEECE66D


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: ByteHash | None = None) -> np.ndarray:
    """Hashes of words that do not overlap."""
    made = (sums or ByteHash(data)).ranges(start, end)
    for k in np.flatnonzero(end - start > SUMMED_BYTES):
        made[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), SEED)
    return made


#: Byte values lower-cased over A-Z only, and the byte values that separate words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ that never cross rows; words per row."""
    n = len(data)
    inside = ~BLANK[data]
    first = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    if n:
        last[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every end of edges(a, b); component is the smallest node
    reachable.  In a round every node points to its least neighbour (a minimum, so hot nodes
    are combined before the shuffle), pointers are followed to their ends, and the edges are
    contracted to the ends; edges within one end go.  A round at least halves the nodes that
    still have edges, and a step of following doubles the pointers' reach, so both loops end.
    Tables that the next one replaces are deleted."""
    spark = edges.sparkSession
    left_path = new_path(spark, name)
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name, left_path)
    whole, whole_path = None, None
    while True:
        tasks = 1 + left.count() // 250_000  # rounds over few edges are not worth many tasks

        def put(df: DataFrame, old: str | None, tasks: int = tasks) -> tuple[DataFrame, str]:
            path = new_path(spark, name)
            made = stored(df.coalesce(tasks), name, path)
            if old:
                discard(spark, old)
            return made, path

        ways = left.select(F.col("b").alias("node"), F.col("a").alias("near")).union(left.select(F.col("a").alias("node"), F.col("b").alias("near")))
        points, path = put(ways.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")), None)
        moved = True
        while moved:
            ends = points.select(F.col("node").alias("component"), F.col("component").alias("end"))
            points, path = put(points.join(ends, "component").select("node", F.col("end").alias("component"), (F.col("end") != F.col("component")).alias("moved")), path)
            moved = not points.filter("moved").isEmpty()
            points = points.select("node", "component")
        one, two = points.toDF("a", "x"), points.toDF("b", "y")
        left, left_path = put(left.join(one, "a").join(two, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), left_path)
        if whole is None:
            whole, whole_path = points, path
        else:
            ends = points.select(F.col("node").alias("component"), F.col("component").alias("end"))
            whole, whole_path = put(whole.join(ends, "component", "left").select("node", F.coalesce("end", "component").alias("component")), whole_path)
            discard(spark, path)
        if left.isEmpty():
            return whole
