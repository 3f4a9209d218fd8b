"""N-gram Jaccard join by universe partition and pigeonhole.

A document is its set of distinct word shingles.  Sizes fall into bands; in a band two sets
with Jaccard similarity t differ in at most H shingles, so the shingle universe is hashed into
m = H + 1 + x segments and two linked sets agree on more than x segments.  A set indexes its
segments under its own band, and under the next one if it is large enough to link with a set
of that.

Segments are paid for by cost.  As linked sets agree on more than x segments, either may leave
out any x of its own; each leaves out its x dearest ones: those that are empty first, as they
would match every other set that lacks them, then those that most sets hold.  The order is by
the number of sets that hold a segment, then by the segment, so it is the same for all; the
cheapest segment that two linked sets agree on has x others after it and is left out by neither.
A segment that nobody else holds costs nothing and finds nothing, so a set with m - x of them
links with no other, and falls out before anything is compared.

A set with more than x empty segments leaves none of the others out, and gives two to each: it
also indexes every neighbour with one shingle deleted.  As long as fewer than m - H / 2 segments
are empty in both of two such sets, some other one differs by at most one shingle.  Sets with
still more empty segments are indexed under one extra signature of their band, which keeps the
join exact.

Candidates are sifted by bitmaps and verified on the whole texts.  A bitmap holds, for each of
some one to two times as many places as the set has shingles, whether an odd number of them is
hashed there; two bitmaps differ in no more places than the sets differ in shingles, so a pair
whose bitmaps differ too much is no link, and texts are only sent for what is left.

Every set is first compared with the first one of each of its signatures, and the links found are
closed; a signature whose sets then lie in one component is finished, and so is one of two sets.
The sets of each of the others are compared in blocks of bounded size, with shared shingles
counted by matrix products, and only links that join parts not joined yet come back.  Equal sets
are folded into one before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, among, checked, components, finish, free_name, job_name, mix64, row_id, stored, text_chunks, word_bounds, word_hashes


@dataclass(frozen=True)
class Link:
    """Two sets link when per_100 <= 100 * intersection / union."""

    width: int = 3
    per_100: int = 90
    #: about so many sets in a block
    block: int = 400
    #: a band's greatest size over its least; wider bands repeat fewer sets in the next band
    #: but cut the smaller ones finer, and the rows are fewest near this
    spread: float = 1.5

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sizes of the bands up to one that holds `largest`, differences that links in
        the band can have, and segments."""
        starts = [1]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // self.per_100), int(starts[-1] * self.spread)))
        starts = np.array(starts, np.int64)
        last = np.append(starts[1:] - 1, starts[-1])
        # |x| + |y| - 2 * overlap with overlap >= t / (1 + t) * (|x| + |y|), sizes at most `last`
        most = (100 - self.per_100) * 2 * last // (100 + self.per_100)
        segments = most + 1
        least = np.append(starts[:1], starts[1:] * self.per_100 // 100)
        for _ in range(8):  # the allowance adds segments, and they add to the allowance
            empty = segments * np.exp(-least / segments)
            segments = most + 1 + np.where(most > 0, np.ceil(empty + 2 * np.sqrt(empty)), 0).astype(np.int64)
        return starts, most, segments


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, sorted; a row with fewer words than
    `width` has its whole sequence as one shingle, and one without words has none."""
    data = LOWER[data]
    starts, ends, counts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(counts)), counts)
    made = np.zeros(max(0, len(words)), np.uint64)
    step = np.uint64(0xA24BAED4963EE407)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place
    for i in range(width):
        there = left > i
        made[there] = mix64(made[there] * step + words[np.flatnonzero(there) + i] + np.uint64(i + 1))
    keep = (left >= width) | ((place == 0) & (left < width))
    row, made = row[keep], made[keep]
    order = np.lexsort((made, row))
    row, made = row[order], made[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (made[1:] != made[:-1])
    return row[first], made[first]


def signatures(row: np.ndarray, made: np.ndarray, n: int, link: Link) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, rule) under the row's own band and the next one.  The rule is twice the
    number of signatures that the row may leave out in the band, plus one for the next band."""
    sizes = np.bincount(row, minlength=n)
    starts, most, segments = link.bands(int(sizes.max(initial=1)) * 2)
    own = np.searchsorted(starts, sizes, side="right") - 1
    rows, sigs, rules = [], [], []
    for step in (0, 1):
        band = own + step
        # into the next band only if the set is large enough to link with one of its sets
        reaches = sizes * 100 >= link.per_100 * starts[band] if step else sizes > 0
        m = np.where(reaches & (sizes > 0), segments[np.maximum(band, 0)], 0)
        base = np.cumsum(m) - m
        here = m[row] > 0
        row_all, made_all, row, made = row, made, row[here], made[here]
        band_of = band[row].astype(np.uint64)
        slot = base[row] + (mix64(made ^ (band_of * np.uint64(0x9FB21C651E98DF25))) % m[row].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, slot, made)
        held = np.bincount(slot, minlength=len(total))
        owner = np.repeat(np.arange(n), m)
        number = (np.arange(len(total)) - base[owner]).astype(np.uint64)
        tag = mix64((band[owner].astype(np.uint64) << np.uint64(32)) + number + np.uint64(1))
        full = held > 0
        lacking = np.bincount(owner[~full], minlength=n)
        allowed = segments[band] - most[band] - 1
        rule = 2 * np.maximum(0, allowed - lacking) + step

        def put(who: np.ndarray, sig: np.ndarray, rule: np.ndarray = rule) -> None:
            rows.append(who), sigs.append(sig), rules.append(rule[who])

        put(owner[full], mix64(total[full] + tag[full]))
        fewer = lacking[row] > allowed[row]
        if fewer.any():
            put(row[fewer], mix64(total[slot[fewer]] - made[fewer] + tag[slot[fewer]]))
        bare = np.flatnonzero((m > 0) & (lacking > allowed) & (2 * (m - lacking) <= most[band]))
        if len(bare):
            put(bare, mix64(band[bare].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
        row, made = row_all, made_all
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(rules)


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(row_id(key, text).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))


def document_sets(docs: DataFrame, link: Link) -> DataFrame:
    """row, id, n_shingles and two hashes of the set of docs(row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "text"):
                n = end - at
                row, made = shingles(data, offsets, link.width)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(one, row, made)
                np.add.at(two, row, mix64(made))
                numbers = [np.bincount(row, minlength=n), one, two]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, n) for c in (0, 1)), *(pa.array(x.astype(np.int64)) for x in numbers)], names=["row", "id", "n_shingles", "h1", "h2"])

    return docs.mapInArrow(run, f"row long, id {docs.schema['id'].dataType.simpleString()}, n_shingles long, h1 long, h2 long")


def signature_rows(docs: DataFrame, link: Link) -> DataFrame:
    """A row (row, sig, rule) for every signature of docs(row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "text"):
                row, made = shingles(data, offsets, link.width)
                owner, sig, rule = signatures(row, made, end - at, link)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + owner)), pa.array(sig.astype(np.int64)), pa.array(rule.astype(np.int32))], names=["row", "sig", "rule"])

    return docs.select("row", "text").mapInArrow(run, "row long, sig long, rule int")


def signature_index(signed: DataFrame, job: str = "signatures") -> DataFrame:
    """(row, sig, first) of the signatures that no set leaves out and that several sets share;
    first is the least of their rows.  Counts are combined before they are shuffled, and only
    signatures held twice are looked at again."""
    counts = stored(signed.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"), f"{job}/counts")
    shared = signed.join(counts, "sig")
    dearest = Window.partitionBy("row", "rule").orderBy(F.desc("n"), F.desc("sig"))
    kept = stored(shared.withColumn("rank", F.row_number().over(dearest)).filter("rank > shiftright(rule, 1)").select("row", "sig").distinct(), f"{job}/shared")
    firsts = stored(kept.groupBy("sig").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter("first < last").select("sig", "first"), f"{job}/firsts")
    return kept.join(firsts, "sig").select("row", "sig", "first")


def as_sets(texts: list[str], width: int) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    row, made = shingles(np.frombuffer(b"".join(raw), np.uint8), offsets, width)
    cut = np.searchsorted(row, np.arange(len(raw) + 1))
    return [made[cut[i] : cut[i + 1]] for i in range(len(raw))]


def links_between(left: list[np.ndarray], right: list[np.ndarray], per_100: int) -> np.ndarray:
    """Boolean matrix of links: intersections as products of 0/1 matrices over the shingles
    found in more than one of the sets, a slice of shingles at a time."""
    both = left + right
    values, place = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    shared = np.bincount(place)[place] > 1
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    n, m = len(left), len(right)
    overlap = np.zeros((n, m), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    width = max(256, 4_000_000 // max(1, len(both)))
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [lo, lo + width])
        flat = np.zeros((len(both), width), np.float32)
        flat[owner[a:b], place[a:b] - lo] = 1
        overlap += flat[:n] @ flat[n:].T
    x, y = np.array([len(s) for s in left])[:, None], np.array([len(s) for s in right])[None, :]
    return (100 * overlap >= per_100 * (x + y - overlap)) & (x > 0) & (y > 0)


def spanning(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join parts not joined yet; `found` is over the nodes left x right."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    kept = []
    for i in range(len(left)):
        for j in np.flatnonzero(found[i]):
            a, b = root(int(left[i])), root(int(right[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((min(left[i], right[j]), max(left[i], right[j])))
    return kept


def bitmaps(texts: DataFrame, link: Link) -> DataFrame:
    """row, size and bits of the sets of texts(row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "text"):
                row, made = shingles(data, offsets, link.width)
                sizes = np.bincount(row, minlength=end - at)
                cut = np.append(0, np.cumsum(sizes))
                out = []
                for i, n in enumerate(sizes):
                    places = max(64, 1 << int(n).bit_length())
                    odd = np.bincount((made[cut[i] : cut[i + 1]] & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
                    out.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(sizes.astype(np.int64)), pa.array(out, pa.binary())], names=["row", "size", "bits"])

    return texts.select("row", "text").mapInArrow(run, "row long, size long, bits binary")


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of `width` bytes: halves are laid over each other, as places are taken modulo a
    power of two."""
    out = np.zeros((len(bits), width // 8), np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0)
    return out


def could_link(first: list[list], second: list[list], link: Link) -> tuple[np.ndarray, np.ndarray]:
    """Which of two blocks of (row, part, size, bits) may link with any of another part there."""
    width = min(len(r[3]) for r in first + second)
    x, y = folded([r[3] for r in first], width), folded([r[3] for r in second], width)
    part, size = np.array([r[1] for r in second]), np.array([r[2] for r in second])
    left, right = np.zeros(len(first), bool), np.zeros(len(second), bool)
    for i, r in enumerate(first):
        apart = np.bitwise_count(x[i] ^ y).sum(axis=1, dtype=np.int64)
        near = (part != r[1]) & (apart * (100 + link.per_100) <= (100 - link.per_100) * (size + r[2]))
        left[i] = near.any()
        right |= near
    return left, right


DEALT = "grp long, lo int, hi int, block int, row long, part long"


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
    """((grp, lo, hi), rows of block lo, rows of block hi) from sorted rows (grp, lo, hi, block,
    ...)."""
    last, sides = None, ([], [])
    for batch in batches:
        for grp, low, high, block, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (grp, low, high) != last:
                if sides[0] and sides[1]:
                    yield last, *sides
                last, sides = (grp, low, high), ([], [])
            if block == low:
                sides[0].append(row)
            if block == high:
                sides[1].append(row)
    if sides[0] and sides[1]:
        yield last, *sides


def sifted(dealt: DataFrame, prints: DataFrame, link: Link) -> DataFrame:
    """The rows of dealt that may link with another of their two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (grp, low, high), first, second in in_blocks(batches):
            left, right = could_link(first, second, link)
            rows = {(low, *first[i][:2]) for i in np.flatnonzero(left)} | {(high, *second[i][:2]) for i in np.flatnonzero(right)}
            out += [(grp, low, high, *r) for r in sorted(rows)]
            if len(out) >= 10_000:
                yield table(out)
                out = []
        yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names, kinds = zip(*(f.split() for f in DEALT.split(", ")))
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.int32()) for c, k in zip(columns, kinds)], names=list(names))

    ready = dealt.join(prints, "row").repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    return ready.select("grp", "lo", "hi", "block", "row", "part", "size", "bits").mapInArrow(run, DEALT)


def compare(first: list[tuple], second: list[tuple], same: bool, link: Link) -> list[tuple[int, int]]:
    """Links between two blocks of (row, part, text), or within one: those between parts."""
    left = as_sets([r[2] for r in first], link.width)
    right = left if same else as_sets([r[2] for r in second], link.width)
    if len(left) * len(right) == 1:
        shared = len(np.intersect1d(left[0], right[0], assume_unique=True))
        linked = len(left[0]) > 0 and 100 * shared >= link.per_100 * (len(left[0]) + len(right[0]) - shared)
        return [tuple(sorted((first[0][0], second[0][0])))] if linked and first[0][1] != second[0][1] else []
    found = links_between(left, right, link.per_100)
    found &= np.array([r[1] for r in first])[:, None] != np.array([r[1] for r in second])[None, :]
    return spanning(found, np.array([r[0] for r in first]), np.array([r[0] for r in second]))


def compare_blocks(dealt: DataFrame, texts: DataFrame, link: Link) -> DataFrame:
    """Links (a, b) of dealt(grp, lo, hi, block, row, part): in each (grp, lo, hi), between the
    rows of block lo and those of block hi.  texts has row and text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [pair for (_, low, high), first, second in in_blocks(batches) for pair in compare(first, second, low == high, link)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    ready = dealt.join(texts, "row").repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    return ready.select("grp", "lo", "hi", "block", "row", "part", "text").mapInArrow(run, "a long, b long")


def block_of(row: str, n: str, link: Link):
    return F.pmod(F.xxhash64(row, F.lit("block")), F.ceil(F.col(n) / link.block)).cast("int")


def star_links(index: DataFrame, texts: DataFrame, prints: DataFrame, link: Link, job: str = "stars") -> DataFrame:
    """Links of every row of index with the first one of its signatures, which is sent once for
    each block of rows that it is compared with."""
    pairs = index.filter("row <> first").select("first", "row").distinct()
    sizes = stored(pairs.groupBy("first").agg(F.count("*").alias("n")), f"{job}/stars")
    rest = pairs.join(sizes, "first").withColumn("hi", block_of("row", "n", link)).select(F.col("first").alias("grp"), F.lit(-1).alias("lo"), "hi", F.col("hi").alias("block"), "row")
    heads = sizes.withColumn("hi", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / link.block).cast("int") - 1)))
    heads = heads.select(F.col("first").alias("grp"), F.lit(-1).alias("lo"), "hi", F.lit(-1).alias("block"), F.col("first").alias("row"))
    dealt = rest.union(heads).withColumn("part", F.col("row"))
    return compare_blocks(stored(sifted(dealt, prints, link), f"{job}/sifted"), texts, link)


def open_links(index: DataFrame, first: DataFrame, texts: DataFrame, prints: DataFrame, link: Link, job: str = "open") -> DataFrame:
    """Links within each signature whose rows are not all joined by the links `first`, among the
    rows other than its first one."""
    parts = components(first, f"{job}/components")
    rest = index.filter("row <> first").join(parts, F.col("row") == parts.node, "left").select("sig", "row", F.coalesce("component", "row").alias("part"))
    unjoined = rest.groupBy("sig").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.bit_xor(F.xxhash64("row")).alias("same"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("more"), F.count("*").alias("n")).filter("x < y")
    # signatures with the same rows are compared once
    once = stored(unjoined.groupBy("n", "same", "more").agg(F.min("sig").alias("sig")).select("sig", "n"), f"{job}/open")
    placed = rest.join(once, "sig").withColumn("block", block_of("row", "n", link))
    other = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / link.block).cast("int") - 1))
    dealt = placed.withColumn("other", other).select(F.col("sig").alias("grp"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "row", "part")
    return compare_blocks(stored(sifted(dealt, prints, link), f"{job}/sifted"), texts, link)


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", link: Link = Link()) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the smallest key reachable by
    links), row (row_id of key and text), first (whether the row stands for its component: that
    of the smallest key, of several texts with that key the one of the smallest row).

    Null and empty texts have no shingles and link with nothing: each is its own component, and
    first.  Texts with fewer words than the width are one shingle, so equal short texts link.
    Very long texts are taken whole.  Rows that repeat come back as often, alike; texts that
    share a key are told apart.  Rows without a key are never linked and come back with a null
    component, as first.  An empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    rows, job = named(docs, key, text), job_name("jaccard")
    sets = stored(document_sets(rows, link), "sets")
    filled = sets.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    copies = stored(filled.groupBy("h1", "h2", "n_shingles").agg(F.min("row").alias("rep"), F.max("row").alias("last")).filter("rep < last").drop("last"), f"{job}/copies")
    held = stored(filled.join(copies, ["h1", "h2", "n_shingles"], "left").select("row", "id", "n_shingles", F.coalesce("rep", "row").alias("rep")), f"{job}/folded")
    own = held.filter("row = rep").select("row").distinct()
    signed = signature_rows(among(rows, own, "row"), link)
    index = stored(signature_index(signed, job), f"{job}/index")
    # whole texts of the sets that share a signature with another
    texts = stored(among(rows.select("row", "text"), index.select("row").distinct(), "row").dropDuplicates(["row"]), f"{job}/texts")
    prints = stored(bitmaps(texts, link), f"{job}/bitmaps")
    stars = stored(star_links(index, texts, prints, link, job), f"{job}/links")
    links = stars.union(stored(open_links(index, stars, texts, prints, link, job), f"{job}/links"))
    final = components(links, f"{job}/components")
    whole = stored(held.join(final, F.col("rep") == final.node, "left").select("row", "id", "n_shingles", F.coalesce("component", "rep").alias("part")), "parts")
    finish(docs.sparkSession, job)
    firsts = stored(whole.groupBy("part").agg(F.min(F.struct("id", "row")).alias("least")), "leasts")
    joined = whole.join(firsts, "part").select("id", "n_shingles", F.col("least.id").alias("component_id"), "row", (F.col("row") == F.col("least.row")).alias("first"))
    alone = sets.filter((F.col("n_shingles") == 0) | F.col("id").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"), "row", F.lit(True).alias("first"))
    return joined.union(alone).withColumnRenamed("id", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", link: Link = Link()) -> DataFrame:
    """The rows of docs that stand for their component, with all columns; a row that repeats
    key and text stays once.  Rows without words or without a key stay as often as they are."""
    found = stored(link_components(docs, key, text, link).select(F.col("row"), "first", (F.col("n_shingles") > 0) & F.col(f"`{key}`").isNotNull()).toDF("row", "first", "linked"), "linked")
    gone = found.filter("not first").select("row").distinct()
    again = found.filter("first and linked").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    name = free_name(docs.columns, "row")
    marked = docs.withColumn(name, row_id(key, text))
    gone, again = stored(gone.toDF(name), "gone"), stored(again.toDF(name), "again")
    left = marked.join(checked(gone), name, "left_anti")
    once = left.join(checked(again), name, "left_semi").dropDuplicates([name])
    return left.join(checked(again), name, "left_anti").union(once).drop(name)
