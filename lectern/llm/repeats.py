"""Suffix-array dedup: bytes covered by a string that also starts anywhere else.

Every start of a `length`-byte string belongs to one anchor: the k-gram of it with the least
hash (the leftmost, if several).  Equal strings have equal anchors, so they meet when anchors
are grouped by k-gram, and only neighbourhoods of k-grams that occur twice are looked at
again.  The starts of one anchor are a run; the bytes of their strings are its span.

Equal spans are counted without their bytes: all their strings repeat.  Where one k-gram has
several different spans, one copy of each goes to the shard of the k-gram.  A shard joins its
spans, builds their suffix array by induced sorting and the permuted common prefixes, and
marks the starts that share `length` bytes or more with a neighbour in suffix order.  As each
start of the corpus is in one span, nothing is compared with itself.

A k-gram with more than `most_spans` different spans is split before it fills a shard: each of
its spans falls into the starts whose strings go on for at least half of what is left behind the
k-gram and those that go on before it, and both are filed by these bytes too.  Equal strings take
the same way.  This is repeated while a group is crowded; as the bytes in common grow to the
whole string, where only one kind is left, it ends, and every string is judged in a suffix array
or by a span that is equal as a whole.

Before a suffix array is built, spans are sifted: a string of `length` bytes goes on for half of
what is left behind its k-gram or before it, so a span that shares neither half with another one
of the k-gram repeats nothing.

Passages of `words` words that also stand in another document are found on the way, whatever their
bytes: their anchors are k-grams of words, marked by the lowest bit of the gram, in the same
tables, and a shard ranks their windows by prefix doubling.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ByteHash, finish, job_name, row_id, stored, text_chunks, word_bounds, word_hashes
from .suffix import common_prefixes, suffix_array

SEPARATOR = 255  # never a byte of UTF-8


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int, sums: ByteHash | None = None) -> tuple[np.ndarray, ...]:
    """(row, first start, end of the last string, place of the k-gram in the span, hash of the
    k-gram, hash of the span), of bytes or of words' hashes."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = sums or ByteHash(data)
    at = np.arange(n - k + 1)
    grams = sums.ranges(at, at + k)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    owner = (sliding_least(keys, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(n - length + 1)
    row = np.searchsorted(offsets, starts, side="right") - 1
    whole = starts + length <= offsets[row + 1]
    starts, row, owner = starts[whole], row[whole], owner[whole]
    if not len(starts):
        return anchors(data[:0], offsets[:1], length, k)
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    lo = starts[first]
    hi = starts[np.append(first[1:], len(starts)) - 1] + length
    return row[first], lo - offsets[row[first]], hi - offsets[row[first]], owner[first] - lo, grams[owner[first]], sums.ranges(lo, hi)


def repeated_runs(spans: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For every span the runs of bytes covered by strings found elsewhere among the spans."""
    joined = np.frombuffer(bytes([SEPARATOR]).join(spans), np.uint8)
    plcp, phi = common_prefixes(joined, suffix_array(joined))
    long = np.flatnonzero(plcp >= length)
    hit = np.zeros(len(joined), bool)
    hit[long] = hit[phi[long]] = True
    begins = np.concatenate([[0], np.cumsum([len(s) + 1 for s in spans])])
    out = []
    for i, s in enumerate(spans):
        found = np.flatnonzero(hit[begins[i] : begins[i] + max(0, len(s) - length + 1)])
        out.append(runs_of(found, length))
    return out


def shared_runs(spans: list[bytes], ids: list[int], opens: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """For every span of words the runs of windows that another document has too; a span that is
    not open stands in several.  Windows are ranked by prefix doubling."""
    joined = np.frombuffer(b"".join(spans), np.uint64)
    sizes = np.array([len(s) // 8 for s in spans])
    ends = np.cumsum(sizes)
    rank = np.unique(joined, return_inverse=True)[1]
    size = 1
    while size < length:
        step = min(size, length - size)
        rank = np.unique(rank[:-step] * len(joined) + rank[step:], return_inverse=True)[1]
        size += step
    of = np.repeat(np.arange(len(spans)), sizes)
    starts = np.flatnonzero(of[: len(rank)] == of[length - 1 :])
    of, rank = of[starts], rank[starts]
    named = np.unique(np.array(ids, np.int64), return_inverse=True)[1][of]
    least, most = np.full(len(joined), len(spans)), np.full(len(joined), -1)
    np.minimum.at(least, rank, named)
    np.maximum.at(most, rank, named)
    most[rank[~np.array(opens)[of]]] = len(spans)
    found = least[rank] < most[rank]
    starts, of = starts[found], of[found]
    cuts = np.searchsorted(of, np.arange(len(spans) + 1))
    return [runs_of(starts[a:b] - (e - n), length, 1) for a, b, e, n in zip(cuts, cuts[1:], ends, sizes)]


def runs_of(starts: np.ndarray, length: int, gap: int | None = None) -> list[tuple[int, int]]:
    """The covered runs of sorted starts, which are at most `gap` apart (else: length)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > (gap or length))
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def sifted(spans: list[bytes], ats: list[int], sizes: list[int], length: int, unit: int = 1) -> list[int]:
    """Which spans of one gram share half of what is left with another, behind the gram or before."""
    sides = []
    for raw, at, size in zip(spans, ats, sizes):
        after = -(-(length - size) // 2)
        before = length - size - after + 1
        ends = (at + size + after) * unit
        sides.append(((size, raw[at * unit : ends]) if ends <= len(raw) else None, (-size, raw[(at - before) * unit : (at + size) * unit]) if at >= before else None))
    seen = Counter(s for both in sides for s in both if s)
    return [i for i, both in enumerate(sides) if any(s and seen[s] > 1 for s in both)]


def halves(raw: bytes, at: int, size: int, length: int, unit: int = 1) -> list[tuple[int, int, bytes, int, int]]:
    """A span whose strings all hold its bytes at `at` to `at + size`, as (side, start, bytes, at,
    size) of up to two spans of larger common bytes; each of its strings is in one of them.  All
    but the bytes themselves count in units of `unit` bytes."""
    n = len(raw) // unit
    after = -(-(length - size) // 2)
    before = length - size - after + 1
    first = min(max(0, at + size + after - length), n - length + 1)  # of those that go on behind
    out = []
    if first <= n - length:
        out.append((1, first, raw[first * unit :], at - first, size + after))
    if first:
        out.append((0, 0, raw[: (first - 1 + length) * unit], at - before, size + before))
    return out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RUNS_SQL = "array<struct<start:bigint,end:bigint>>"


def as_runs(rows: list) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], RUNS)


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, k: int = 100, most_spans: int = 500, shard_bytes: int = 1 << 19, words: int = 51, k_words: int = 12) -> DataFrame:
    """row (row_id of key and text), runs: the runs of bytes of each document that are covered by a
    `length`-byte string that also starts anywhere else, in this document or another, and
    passages: runs of its words, each window of `words` words of which also stands in a document
    of another key or text, though not for each of its places in this document; documents without
    any are left out.

    Null, empty and shorter texts hold no such string.  Texts of any length are taken whole.
    Rows are told apart by key and text, so texts that share a key, or have none, are documents
    of their own; rows that repeat both repeat each other.  An empty table gives no rows; other
    columns are ignored.
    """
    kind, job = "long", job_name("repeats")
    named = docs.select(row_id(key, text).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in text_chunks(batch, "text"):
                sums = ByteHash(data)
                starts, ends, counts = word_bounds(data, offsets)
                hashes = word_hashes(data, starts, ends, sums)
                for mark, found in enumerate((anchors(data, offsets, length, k, sums), anchors(hashes, np.append(0, np.cumsum(counts)), words, k_words))):
                    row, lo, hi, place, gram, span = found
                    ids = batch.column(0).take(pa.array(at + row))
                    gram = gram & np.uint64(0xFFFFFFFFFFFFFFFE) | np.uint64(mark)
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (lo.astype(np.int32), hi.astype(np.int32), place.astype(np.int32), gram.astype(np.int64), span.astype(np.int64)))], names=["id", "lo", "hi", "at", "gram", "span"])

    found = stored(named.mapInArrow(find, f"id {kind}, lo int, hi int, at int, gram long, span long"), f"{job}/anchors")
    of_words = F.col("gram").bitwiseAND(1) == 1

    def times(elsewhere) -> Column:
        """How often bytes stand; of words, 2 if another document has them."""
        return F.when(~of_words, F.count("*")).otherwise(F.when(elsewhere, 2).otherwise(1))

    others = F.min("id") < F.max("id")
    spans = stored(found.groupBy("gram", "span").agg(times(others).alias("n"), F.min(F.struct("id", "lo", "hi", "at")).alias("one")), f"{job}/spans")
    grams = spans.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    ask = spans.filter("n = 1").join(grams, "gram").select("gram", "one.*", (F.col("kinds") > most_spans).alias("many"))
    # spans that occur more than once repeat whole, but others of the k-gram are held against them
    more = spans.filter("n > 1").join(grams, "gram").select("gram", "one.*", (F.col("kinds") > most_spans).alias("many"))
    wanted = ask.withColumn("open", F.lit(True)).union(more.withColumn("open", F.lit(False)))
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("gram", "lo", "hi", "at", "many", "open")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                raw = (one["text"] or "").encode()
                rows = one["asked"]
                packed = word_bytes(raw) if any(r["gram"] & 1 for r in rows) else b""
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array([one["id"]] * len(rows), batch.schema.field("id").type), "gram": pa.array([r["gram"] for r in rows], pa.int64()), "lo": pa.array([r["lo"] for r in rows], pa.int32()), "at": pa.array([r["at"] for r in rows], pa.int32()), "many": [r["many"] for r in rows], "open": [r["open"] for r in rows], "bytes": pa.array([packed[8 * r["lo"] : 8 * r["hi"]] if r["gram"] & 1 else raw[r["lo"] : r["hi"]] for r in rows], pa.binary())}
                )

    pieces = stored(named.dropDuplicates(["id"]).join(lists, "id").select("id", "text", "asked").mapInArrow(cut, f"id {kind}, gram long, lo int, at int, many boolean, open boolean, bytes binary").withColumn("size", F.when(of_words, k_words).otherwise(k)), f"{job}/pieces")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        held, sizes = ([], []), [0, 0]  # of bytes, of words

        def ready(mark: int):
            rows, held[mark][:], sizes[mark] = [*held[mark]], [], 0
            ids, los, opens, texts = zip(*rows)
            runs = shared_runs(texts, ids, opens, words) if mark else repeated_runs(texts, length)
            rows = [(i, [(a + lo, b + lo) for a, b in r]) for i, lo, o, r in zip(ids, los, opens, runs) if o and r]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([mark == 1] * len(rows), pa.bool_()), as_runs([r[1] for r in rows])], names=["id", "words", "runs"])

        def close(mark: int):
            _, _, _, texts, ats, lengths = zip(*group)
            for i in sifted(texts, ats, lengths, words if mark else length, 8 if mark else 1):
                held[mark].append(group[i][:4])
                sizes[mark] += len(texts[i])
            group.clear()

        for batch in batches:
            id_type = batch.schema.field("id").type
            for gram, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "id", "lo", "open", "bytes", "at", "size"))):
                if gram != last and group:
                    close(last & 1)
                    if sizes[last & 1] >= shard_bytes:
                        yield ready(last & 1)
                last = gram
                group.append(row)
        if group:
            close(last & 1)
        for mark in (0, 1):
            if held[mark]:
                yield ready(mark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                where, grams, los, raws, ats, sizes, marks = [], [], [], [], [], [], []
                for j, (gram, lo, raw, at, size) in enumerate(zip(*(part.column(c).to_pylist() for c in ("gram", "lo", "bytes", "at", "size")))):
                    for side, start, piece, place, more in halves(raw, at, size, words if gram & 1 else length, unit := 8 if gram & 1 else 1):
                        common = xxhash.xxh3_64_intdigest(piece[place * unit : (place + more) * unit], (2 * gram + side) & 0xFFFFFFFFFFFFFFFF)
                        where.append(j), grams.append((common - (1 << 63)) & ~1 | gram & 1), los.append(lo + start), raws.append(piece)
                        ats.append(place), sizes.append(more), marks.append(xxhash.xxh3_128_digest(piece))
                at = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), pa.array(grams, pa.int64()), pa.array(los, pa.int32()), pa.array(ats, pa.int32()), part.column("open").take(at), pa.array(raws, pa.binary()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())],
                    names=["id", "gram", "lo", "at", "open", "bytes", "size", "mark"],
                )

    columns = ["id", "gram", "lo", "open", "bytes", "at", "size"]
    few, same, crowded, level = pieces.filter("not many").select(columns), [], pieces.filter("many"), 0
    # at most one round for each doubling of `length`, as the bytes left are halved
    while not crowded.isEmpty():
        level += 1
        parts = stored(crowded.mapInArrow(split, f"id {kind}, gram long, lo int, at int, open boolean, bytes binary, size int, mark binary"), f"{job}/parts{level}")
        kinds = stored(parts.groupBy("gram", "mark").agg(times(others | ~F.min("open")).alias("n"), F.min(F.struct("id", "lo")).alias("one")), f"{job}/kinds{level}")
        again = kinds.filter("n > 1").select("gram", "mark")
        same.append(parts.filter("open").join(again, ["gram", "mark"]).select("id", of_words.alias("words"), F.array(F.struct(F.col("lo").cast("long").alias("start"), (F.col("lo") + F.octet_length("bytes") / F.when(of_words, 8).otherwise(1)).cast("long").alias("end"))).alias("runs")))
        grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        left = kinds.join(grams, "gram").select("gram", "mark", "n", "one", (F.col("kinds") > most_spans).alias("many"))
        kept = parts.join(left, ["gram", "mark"]).filter((F.col("id") == F.col("one.id")) & (F.col("lo") == F.col("one.lo")))
        kept = stored(kept.select("id", "gram", "lo", "at", (F.col("open") & (F.col("n") == 1)).alias("open"), "bytes", "size", (F.col("many") & (F.col("size") < F.when(of_words, words).otherwise(length))).alias("many")), f"{job}/kept{level}")
        few, crowded = few.union(kept.filter("not many").select(columns)), kept.filter("many")

    few = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(shard, f"id {kind}, words boolean, runs {RUNS_SQL}")
    equal = found.join(spans.filter("n > 1").select("gram", "span"), ["gram", "span"]).select("id", of_words.alias("words"), F.array(F.struct(F.col("lo").cast("long").alias("start"), F.col("hi").cast("long").alias("end"))).alias("runs"))
    # each is written by itself, so that a join with a hot k-gram can be split
    few, equal, *same = (stored(part, "runs") for part in (few, equal, *same))
    finish(docs.sparkSession, job)
    for part in same:
        equal = equal.union(part)
    return few.union(equal).groupBy("id").agg(*(F.flatten(F.collect_list(F.when(F.col("words") == mark, F.col("runs")))).alias(name) for name, mark in (("runs", False), ("passages", True)))).withColumnRenamed("id", "row")


def word_bytes(raw: bytes) -> bytes:
    """The words' hashes, eight bytes each."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends).tobytes()


def all_places(raw: bytes, found: list, length: int) -> list[tuple[int, int]]:
    """Sorted maximal runs of words: those found, and the other places of their windows."""
    hashes = np.frombuffer(word_bytes(raw), np.uint64)
    at = np.arange(len(hashes) - length + 1)
    windows = ByteHash(hashes).ranges(at, at + length)
    known = np.unique(np.concatenate([windows[r["start"] : r["end"] - length + 1] for r in found]))
    return merged([{"start": a, "end": b} for a, b in runs_of(np.flatnonzero(np.isin(windows, known)), length)])


def merged(runs: list) -> list[tuple[int, int]]:
    """Sorted maximal runs; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 51, **settings) -> DataFrame:
    """key, n_bytes, runs (maximal removed runs of bytes), kept (the bytes that remain),
    kept_text (these without characters that were cut through; null for a null text) and passages
    (maximal runs of words of `words`-word windows that another document has too, which are not
    removed), for every row of docs; see repeated_bytes for the cases."""
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(f"`{key}`").alias("id"), row_id(key, text).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = repeated_bytes(docs, key, text, words=words, **settings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept, texts, passages = [], [], [], [], []
            for s, r, p in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                raw = (s or "").encode()
                gone = merged(r)
                ends = [0, *(b for _, b in gone)]
                starts = [*(a for a, _ in gone), len(raw)]
                sizes.append(len(raw)), removed.append(gone), kept.append(b"".join(raw[a:b] for a, b in zip(ends, starts)))
                texts.append(None if s is None else kept[-1].decode("utf-8", "ignore"))
                passages.append(all_places(raw, p, words) if p else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), as_runs(removed), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), as_runs(passages)], names=["id", "n_bytes", "runs", "kept", "kept_text", "passages"])

    joined = named.join(runs, "row", "left").select("id", "text", "runs", "passages")
    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, runs {RUNS_SQL}, kept binary, kept_text string, passages {RUNS_SQL}").withColumnRenamed("id", key)
