"""Quality rules: compression bands over whole documents and fixed chunks.

zstandard squeezes the whole text and every fixed chunk of it; the ratio (input bytes over
compressed bytes) must lie inside a band that depends on the length, since short texts
compress little and long ones more.  Repetitive text lies above its band, random text below.
A text of more than one chunk is measured to its end: its last chunk ends there and overlaps
the one before, so all chunks have one length and one band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, text_chunks, text_column, word_bounds


@dataclass(frozen=True)
class Bands:
    """(bytes from, least ratio, greatest ratio) by length, longest last; chunk rules."""

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.9, 3.0), (256, 1.1, 2.6), (1024, 1.3, 2.6), (8192, 1.5, 2.9), (65536, 1.6, 3.5))
    chunk_bytes: int = 4096
    chunk_least: float = 1.3
    chunk_most: float = 2.8
    bad_chunk_share: float = 0.3
    level: int = 3


SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
FIELDS = "n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, worst_chunk double, best_chunk double, bad_chunks long, n_chunks long"


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words in windows of `width` words found twice or more, by doubling exact ranks."""
    if len(ids) <= width:
        return 0
    rank, span = ids, 1
    while span < width:
        pair = rank[:-span].astype(np.int64) * (int(rank.max()) + 1) + rank[span:]
        rank = np.unique(pair, return_inverse=True)[1]
        span *= 2
    hit = np.bincount(rank)[rank] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[width : width + len(hit)] -= hit
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def measure(raw: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple:
    words = raw.split()
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    continuation = int(histogram[128:192].sum())
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    ratio = len(raw) / len(squeeze.compress(raw)) if raw else 0.0
    worst = best = ratio
    bad = count = 0
    if len(raw) > bands.chunk_bytes:
        last = len(raw) - bands.chunk_bytes
        parts = [raw[i : i + bands.chunk_bytes] for i in [*range(0, last, bands.chunk_bytes), last]]
        rates = [len(p) / len(squeeze.compress(p)) for p in parts]
        worst, best, count = max(rates), min(rates), len(rates)
        bad = sum(not bands.chunk_least <= r <= bands.chunk_most for r in rates)
    return len(raw), len(words), len(raw) - continuation - int(histogram[BLANK].sum()), int(histogram[SYMBOLS].sum()), again, repeated_words(ids), ratio, worst, best, bad, count


def passes(stats: tuple, bands: Bands) -> bool:
    """The verdict on measure(): enough words, not too many repeated, inside the bands."""
    n_bytes, n_words, n_repeat, ratio, bad, count = stats[0], stats[1], stats[5], stats[6], stats[9], stats[10]
    least, most = [b[1:] for b in bands.whole if n_bytes >= b[0]][-1]
    failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    return not failed and (n_bytes == 0 or least <= ratio <= most) and bad <= bands.bad_chunk_share * count


def passing(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of docs whose own text passes the base rules and lies in its bands, with all
    columns.  Null and empty texts have no words and go; a row's key, missing or repeated, plays
    no part; very long texts are measured whole; repeated rows are judged alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([passes(measure((s or "").encode(), bands, squeeze), bands) for s in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def compression_bands(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: key, the word and line statistics, the ratios, in_band.

    Null or empty text: zero words, ratio 0, in the band of the shortest length (base rules
    then judge it).  Repeated rows are judged alike; an empty table gives no rows.  Other
    columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [measure((s or "").encode(), bands, squeeze) for s in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.float64() if isinstance(c[0], float) else pa.int64()) for c in zip(*rows)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *[f.split()[0] for f in FIELDS.split(", ")]])

    kind = docs.schema[key].dataType.simpleString()
    out = text_column(docs, key, text).mapInArrow(run, f"key {kind}, {FIELDS}")
    size = F.col("n_bytes")
    least, most = F.lit(bands.whole[0][1]), F.lit(bands.whole[0][2])
    for start, low, high in bands.whole[1:]:
        least, most = F.when(size >= start, low).otherwise(least), F.when(size >= start, high).otherwise(most)
    inside = F.col("ratio").between(least, most) & (F.col("bad_chunks") <= bands.bad_chunk_share * F.col("n_chunks"))
    return out.withColumn("in_band", inside | (size == 0)).withColumnRenamed("key", key)
