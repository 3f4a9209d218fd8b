"""Token-ID / binary output: texts to token ids, range-coded into checksummed blocks.

Documents are dealt out by ranges of their key and sorted, so files follow ascending key.  A
row of the written table is a run of whole documents: their keys and counts of ids, and the
coded file of their ids (see id_codec), whose blocks can each be read alone; a checksum covers the
keys and counts.  Spark's writer
commits the rows, so a lost executor only costs the task it ran.

A text is cut before each space that is followed by something else than white space, and where
letters, digits, signs and a line break meet.  The tokenizer never joins across such a cut, so
equal pieces, which Arrow's dictionaries bring together, are encoded once for a task and looked up
after that; texts with other spacing or added tokens are encoded whole, and all texts are where
the tokenizer does not split as byte-level ones do.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import id_codec
from .common import shared_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
ODD = r" (?=\s|\Z)|<\|"
#: Pieces that the tokenizer surely splits no further before its merges: the model can take them.
ONE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Kinds of bytes: 1 letters, 2 digits, 3 signs but for the apostrophe, which may begin a token.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(33, 127)]] = 3
KINDS[[*range(65, 91), *range(97, 123), 0xC3]] = 1
KINDS[[*range(48, 58)]] = 2
KINDS[39] = 0
MOST_PIECES = 500_000
RUN_IDS = 1_500_000
GROUP_BYTES = 8 << 20
#: Characters of a text that decide where it goes among those of its key.
HEAD = 64


#: The byte-level form of a text read as Latin-1: bytes that are no signs move to 256 and on.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
FORM = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    added = sorted(re.escape(t.content) for t in made.get_added_tokens_decoder().values())
    split = made.pre_tokenizer
    plain = made.normalizer is None and type(split).__name__ == "ByteLevel" and not split.add_prefix_space and split.use_regex
    return made, re.compile("|".join([ODD, *added]) if plain else "")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin."""
    kind = KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    sign = (data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)  # of times and division
    kind[lead] = ~sign
    kind[lead + 1] = ~sign
    known, line = kind > 0, data == 10
    begins = data == 32
    begins[1:] |= known[1:] & known[:-1] & (kind[1:] != kind[:-1]) | line[1:] & known[:-1]
    begins[2:] |= known[2:] & line[1:-1] & known[:-2]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


class Pieces:
    """Ids of pieces, each encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.odd = tokenizer_of(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.pool, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        ids, lengths, rest = [], [], []
        for p in pieces:
            if ONE.fullmatch(p):
                form = p.replace(" ", FORM[32]) if p.isascii() else p.encode().decode("latin-1").translate(FORM)
                made = [t.id for t in self.model.tokenize(form)]
                self.place[p] = len(self.place)
                ids += made
                lengths.append(len(made))
            else:
                rest.append(p)
        found = self.whole(rest)
        self.place.update(zip(rest, range(len(self.place), len(self.place) + len(rest))))
        self.pool = np.concatenate([self.pool, np.array(ids, np.int64), *found])
        self.lengths = np.concatenate([self.lengths, np.array(lengths + [len(f) for f in found], np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        odd = [i for i, t in enumerate(texts) if self.odd.search(t)]
        alone = self.whole([texts[i] for i in odd])
        plain = pa.array(texts, pa.large_string())
        if odd:
            kept = np.ones(len(texts), bool)
            kept[odd] = False
            plain = pa.array([t if k else "" for t, k in zip(texts, kept)], pa.large_string())
        _, where, data = plain.buffers()
        offsets = np.frombuffer(where, np.int64)[: len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        starts = cuts(raw, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        if len(self.place) > MOST_PIECES:
            self.clear()
        names = pieces.dictionary.to_pylist()
        self.learn([n for n in names if n not in self.place])
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[pieces.indices.to_numpy()]
        size = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        first = np.cumsum(self.lengths) - self.lengths
        ids = self.pool[np.repeat(first[at] - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[np.searchsorted(starts, offsets)]
        counts = np.diff(ends)
        if odd:
            ids = np.insert(ids, np.repeat(ends[odd], [len(a) for a in alone]), np.concatenate(alone))
            counts[odd] = [len(a) for a in alone]
        return ids, counts


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows whose texts are cut together: some megabytes, or one longer text."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GROUP_BYTES, side="right")))
        yield at, end
        at = end


FILES = "part int, number int, first long, keys array<long>, counts array<long>, ids_in_run long, check long, file binary"


def checksum(first: int, keys: list, counts: list) -> int:
    """Of a run's place, keys (a missing one is told from any other) and counts."""
    held = np.array([first, *(0 if k is None else k for k in keys), *(k is None for k in keys), *counts], "<i8")
    return zlib.crc32(held.tobytes())


def write_files(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int | None = END_ID, run_ids: int = RUN_IDS) -> str:
    """Write docs as coded files in ascending key order and return their folder.

    A row: part and number (its place), first (ids of the part before it), keys and counts of
    its documents, their ids in all, and the file.  Null and empty texts are the end id alone;
    very long texts are never split between files; keys are cast to long; rows without a key come
    first; rows of one key come in the order of their texts, repeated ones as often as they stand;
    an empty table gives no rows; other columns are ignored.  `tokenizer` is a name in the folder of public tokenizers or a path.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    place = tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # rows of one key, or without any, are dealt by the head of their texts, which keeps the order
    dealt = named.repartitionByRange(parts, "key", F.substring("text", 1, HEAD)).sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part = Pieces(place), TaskContext.get().partitionId()
        number = first = held = 0
        keys, counts, ids = [], [], []

        def row():
            joined = np.concatenate(ids)
            names = [f.split()[0] for f in FILES.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            values = [part, number, first, keys, counts, len(joined), checksum(first, keys, counts), id_codec.encode(joined)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for lo, hi in groups(batch.column(1)):
                made, sizes = pieces.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                if end_id is not None:
                    made = np.insert(made, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                named, made, ends = batch.column(0).slice(lo, hi - lo).to_pylist(), made.astype(np.int32), np.append(0, np.cumsum(sizes))
                for i in range(0, hi - lo, 200):
                    j = min(i + 200, hi - lo)
                    keys += named[i:j]
                    counts += sizes[i:j].tolist()
                    ids.append(made[ends[i] : ends[j]])
                    held += len(ids[-1])
                    if held >= run_ids:
                        yield row()
                        number, first, held = number + 1, first + held, 0
                        keys, counts, ids = [], [], []
        if keys:
            yield row()

    dealt.mapInArrow(run, FILES).write.parquet(path)
    return path


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of written files: key, start (ids of all documents before it),
    n_tokens, ids_crc32, and the ids themselves if asked for."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("ids_in_run").alias("n"))
    # one row for each part written, not for each document
    before = totals.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, keys, counts, check, file = (batch.column(c)[i].as_py() for c in ("part", "first", "keys", "counts", "check", "file"))
                if checksum(first, keys, counts) != check:
                    raise ValueError("keys or counts do not match their checksum")
                ids = id_codec.decode(file).astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a file does not hold the ids of its documents")
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                columns = [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(first + starts), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    got = rows.select("part", "first", "keys", "counts", "check", "file").mapInArrow(run, "part int, key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    joined = got.join(F.broadcast(before), "part")
    return joined.select("key", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
