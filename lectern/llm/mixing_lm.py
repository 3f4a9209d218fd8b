"""LM scoring: online logistic context mixing over bytes, and its word-count base.

Every byte is eight binary decisions down its bit tree.  For each decision several predictors
look up the counts of zeros and ones seen after their context (the last 1, 2, 3 or 5 bytes,
hashed into `slots` counters per order).  A gated set of weights, chosen by the depth in the
tree and by how many contexts were seen before, mixes the predictions in the logistic domain;
a final table refines the result by the byte before.  A text ends with byte 255, which UTF-8 never
has; it is coded like any other, so the probabilities of all texts add up to no more than one.

Learning is online and spread over shards: training texts are dealt by a hash of key and text into shards of
about `shard_bytes`, in the order of the hash, so neither the partitions of the input nor the
number of executors changes the model.  A task predicts each batch with what it has gathered so
far, moves the weights along the gradient of the coding cost, then adds the batch to its
counters.  Counters and refinement counts of all shards are summed and weights averaged.  A text is
then scored by the frozen model.

The bit predictors have a fixed size (`Model.slots` times four orders), so they may be broadcast;
on a large corpus their contexts share counters.  What is learnt of whole words grows with the
corpus: wherever a word may begin, one more prediction gives the next word, or the end, its share
of the training tokens, and is mixed with what the bits give for the same bytes; it gives nothing
to a blank.  Both are probabilities, so the mixture is one.  Its weight is the one of `shares` that
makes the training texts cheapest; with 0 the bits stand alone.  Word counts are joined, but for
words frequent enough that at most `hot_bound` of them can exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, mix64, stored, text_chunks, word_bounds, word_hashes

ORDERS = (1, 2, 3, 5)
GATES = 8 * (len(ORDERS) + 1)
LEVELS = 33
SLOT_BITS = 20
BLOCK = 1 << 14
END = np.uint64(0x2545F4914F6CDD1D)  # the end counted as a token
END_BYTE = 255
SHARD_BYTES = 16 << 20
SHARES = (0.0, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2)  # weights that the words' own prediction may get


@dataclass
class Model:
    """counts[order][slot] of (zeros, ones); weights by gate; refinement (ones, all)."""

    slots: int = 1 << SLOT_BITS
    zeros: np.ndarray = field(default=None)
    ones: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)
    refine: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.zeros is None:
            self.zeros = np.zeros((len(ORDERS), self.slots), np.int32)
            self.ones = np.zeros((len(ORDERS), self.slots), np.int32)
            self.weights = np.full((GATES, len(ORDERS)), 0.35)
            self.refine = np.zeros((2, 256 * LEVELS))


def ended(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, each with its end."""
    return np.insert(data, offsets[1:], END_BYTE), offsets + np.arange(len(offsets))


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte in the lowest eight bits and the five before it above; 0 before a row's start."""
    n = len(data)
    out = data.astype(np.uint64)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, max(ORDERS) + 1):
        before = np.zeros(n, np.uint64)
        before[j:] = data[: n - j] if j < n else data[:0]
        before[place < j] = 0
        out |= before << np.uint64(8 * j)
    return out


def contexts(win: np.ndarray) -> list[np.ndarray]:
    return [mix64(((win >> np.uint64(8)) & np.uint64((1 << (8 * o)) - 1)) + np.uint64(o << 56)) for o in ORDERS]


def slots_of(hashed: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (((hashed ^ (node * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one, drawn to 0 where little was seen."""
    return np.log((ones + 0.3) / (zeros + 0.3))


def level_of(dot: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(dot * 2) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)


def learn(model: Model, win: np.ndarray, times: np.ndarray, pace: np.ndarray) -> float:
    """One online step over distinct windows and their counts; bits it would have cost."""
    hashed, symbol, before = contexts(win), win & np.uint64(255), ((win >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    cost = 0.0
    moves = []
    for depth in range(8):
        node = (symbol | np.uint64(256)) >> np.uint64(8 - depth)
        bit = ((symbol >> np.uint64(7 - depth)) & np.uint64(1)).astype(np.int64)
        x, known, at = [], np.zeros(len(win), np.int64), []
        for o in range(len(ORDERS)):
            slot = slots_of(hashed[o], node)
            zeros, ones = model.zeros[o][slot], model.ones[o][slot]
            known += (zeros + ones) > 0
            x.append(stretch(zeros, ones))
            at.append(slot)
        gate = depth * (len(ORDERS) + 1) + known
        dot = sum(model.weights[gate, o] * x[o] for o in range(len(ORDERS)))
        p = 1 / (1 + np.exp(-np.clip(dot, -12, 12)))
        cost -= float(np.sum(times * np.log2(np.where(bit == 1, p, 1 - p))))
        error = (bit - p) * times
        for o in range(len(ORDERS)):
            slope = np.bincount(gate, weights=error * x[o], minlength=GATES)
            pace[:, o] += slope**2
            model.weights[:, o] += 0.05 * slope / np.sqrt(pace[:, o] + 1)
        cell = before * LEVELS + level_of(dot)
        model.refine[1] += np.bincount(cell, weights=times, minlength=256 * LEVELS)
        model.refine[0] += np.bincount(cell, weights=times * bit, minlength=256 * LEVELS)
        moves.append((at, bit))
    for at, bit in moves:
        for o in range(len(ORDERS)):
            np.add.at(model.ones[o], at[o], (times * bit).astype(np.int32))
            np.add.at(model.zeros[o], at[o], (times * (1 - bit)).astype(np.int32))
    return cost


class Scorer:
    """log10 probabilities of windows under a frozen model, kept in a direct-mapped cache."""

    def __init__(self, model: Model, cache_bits: int = 21):
        self.stretch = stretch(model.zeros, model.ones).astype(np.float32)
        self.known = (model.zeros + model.ones) > 0
        self.weights, self.refine = model.weights, model.refine
        self.bits = cache_bits
        self.keys = np.full(1 << cache_bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(1 << cache_bits)

    def fresh(self, win: np.ndarray) -> np.ndarray:
        hashed, symbol, before = contexts(win), win & np.uint64(255), ((win >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(win))
        for depth in range(8):
            node = (symbol | np.uint64(256)) >> np.uint64(8 - depth)
            bit = ((symbol >> np.uint64(7 - depth)) & np.uint64(1)).astype(bool)
            known, at = np.zeros(len(win), np.int64), []
            for o in range(len(ORDERS)):
                at.append(slots_of(hashed[o], node))
                known += self.known[o][at[o]]
            gate = depth * (len(ORDERS) + 1) + known
            dot = sum(self.weights[gate, o] * self.stretch[o][at[o]] for o in range(len(ORDERS)))
            p = 1 / (1 + np.exp(-np.clip(dot, -12, 12)))
            cell = before * LEVELS + level_of(dot)
            refined = (self.refine[0][cell] + 30 * p) / (self.refine[1][cell] + 30)
            p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
            out += np.log10(np.where(bit, p, 1 - p))
        return out

    def __call__(self, win: np.ndarray) -> np.ndarray:
        slot = (mix64(win) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != win)
        if len(miss):
            new, place = np.unique(win[miss], return_inverse=True)
            got = np.concatenate([self.fresh(new[i : i + 100_000]) for i in range(0, len(new), 100_000)])
            out[miss] = got[place]
            at = (mix64(new) >> np.uint64(64 - self.bits)).astype(np.int64)
            self.keys[at], self.values[at] = new, got
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token hash, count) by row, with one end per row."""
    starts, ends, counts = word_bounds(data, offsets)
    n = len(counts)
    row = np.concatenate([np.repeat(np.arange(n), counts), np.arange(n)])
    made = np.concatenate([word_hashes(data, starts, ends), np.full(n, END)])
    order = np.lexsort((made, row))
    row, made = row[order], made[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (made[1:] != made[:-1])
    at = np.flatnonzero(first)
    return row[at], made[at], np.diff(np.append(at, len(row)))


def occurrences(data: np.ndarray, offsets: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token hash, log10 of what the bits give to it) of every token by row, and by row the
    number of blanks where a word could begin.  `cost` holds the bits' log10 for every byte of the
    rows with their ends.  A row's end that follows a word at once is no choice between words and
    blanks: its third value is not a number."""
    starts, ends, counts = word_bounds(data, offsets)
    n = len(counts)
    rows, words = np.arange(n), np.repeat(np.arange(n), counts)
    sums = np.concatenate([[0.0], np.cumsum(cost)])
    last = offsets[1:] + rows  # the end's place among the closed rows
    free = np.diff(offsets) == 0
    free[~free] = BLANK[data[offsets[1:][~free] - 1]]
    row = np.concatenate([words, rows])
    made = np.concatenate([word_hashes(data, starts, ends), np.full(n, END)])
    given = np.concatenate([sums[ends + words] - sums[starts + words], np.where(free, cost[last], np.nan)])
    blank = BLANK[data]
    open_ = blank.copy()
    open_[1:] &= blank[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    open_[heads] = blank[heads]
    before = np.concatenate([[0], np.cumsum(open_)])
    order = np.argsort(row, kind="stable")
    return row[order], made[order], given[order], before[offsets[1:]] - before[offsets[:-1]]


def gains(given: np.ndarray, share_log: np.ndarray, weights: tuple[float, ...]) -> list[np.ndarray]:
    """For each of `weights` what the mixture adds to the log10 of tokens, given what the bits give
    and log10 of the tokens' share in training (-inf: none)."""
    out = []
    for w in weights:
        if not w:
            out.append(np.zeros(len(given)))
            continue
        a, b = given + np.log10(1 - w), share_log + np.log10(w)
        most = np.maximum(a, b)
        out.append(np.where(np.isnan(given), 0.0, most + np.log10(10 ** (a - most) + 10 ** (b - most)) - given))
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


PIECES = "kind string, part long, n long, payload binary"


def pieces(kind: str, parts, counts, payloads=None) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(parts, pa.int64()), pa.array(counts, pa.int64()), pa.array(payloads if payloads is not None else [None] * n, pa.binary())], names=["kind", "part", "n", "payload"])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of the training: token counts, counter blocks, weights, refinement."""
    model, pace = Model(), np.zeros((GATES, len(ORDERS)))
    squeeze = zstandard.ZstdCompressor(level=1)
    held_keys, held_counts, held, seen = [], [], 0, 0
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch, "text"):
            data = LOWER[data]
            _, made, count = tokens(data, offsets)
            keys, counts = summed([made], [count])
            held_keys.append(keys), held_counts.append(counts)
            held += len(keys)
            if held > 2_000_000:
                keys, counts = summed(held_keys, held_counts)
                held_keys, held_counts, held = [keys], [counts], len(keys)
                if held > 1_500_000:
                    yield pieces("token", keys.astype(np.int64), counts)
                    held_keys, held_counts, held = [], [], 0
            if len(offsets) > 1:
                win, times = np.unique(windows(*ended(data, offsets)), return_counts=True)
                for i in range(0, len(win), 200_000):
                    learn(model, win[i : i + 200_000], times[i : i + 200_000], pace)
                seen += len(data) + len(offsets) - 1
    if held_keys:
        keys, counts = summed(held_keys, held_counts)
        for i in range(0, len(keys), 200_000):
            yield pieces("token", keys[i : i + 200_000].astype(np.int64), counts[i : i + 200_000])
    if seen:
        for o in range(len(ORDERS)):
            for j in range(0, model.slots, BLOCK):
                both = np.stack([model.zeros[o, j : j + BLOCK], model.ones[o, j : j + BLOCK]])
                yield pieces("counts", [o * model.slots + j], [seen], [squeeze.compress(both.tobytes())])
        yield pieces("weights", [0], [seen], [squeeze.compress((model.weights * seen).tobytes())])
        yield pieces("refine", [0], [seen], [squeeze.compress(model.refine.tobytes())])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of payloads by kind and part, one running sum for each."""
    totals: dict[tuple[str, int], list] = {}
    open_up = zstandard.ZstdDecompressor()
    for batch in batches:
        for kind, part, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
            got = np.frombuffer(open_up.decompress(payload), np.int32 if kind == "counts" else np.float64)
            have = totals.get((kind, part))
            if have is None:
                totals[kind, part] = [n, got.astype(np.int64 if kind == "counts" else np.float64)]
            else:
                have[0] += n
                have[1] += got
    squeeze = zstandard.ZstdCompressor(level=1)
    for (kind, part), (n, total) in totals.items():
        yield pieces(kind, [part], [n], [squeeze.compress(total.tobytes())])


def fit(training: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[Model, DataFrame]:
    """The model and the token counts (part, n) of training(id, text)."""
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = training.select("text", F.xxhash64("id", "text").alias("h")).repartition(1 + size // shard_bytes, "h").sortWithinPartitions("h", "text")
    found = stored(dealt.select("text").mapInArrow(gather, PIECES), "gathered")
    counts = stored(found.filter("kind = 'token'").groupBy("part").agg(F.sum("n").alias("n")), "tokens")
    model, open_up = Model(), zstandard.ZstdDecompressor()
    # of a fixed size: 64 blocks for each order, weights and refinement
    for r in found.filter("kind <> 'token'").repartition("kind", "part").mapInArrow(add_up, PIECES).toLocalIterator():
        got = open_up.decompress(r.payload)
        if r.kind == "counts":
            both = np.minimum(np.frombuffer(got, np.int64).reshape(2, BLOCK), (1 << 31) - 1)
            o, j = divmod(r.part, model.slots)
            model.zeros[o, j : j + BLOCK], model.ones[o, j : j + BLOCK] = both
        elif r.kind == "weights":
            model.weights = np.frombuffer(got).reshape(GATES, len(ORDERS)) / r.n
        else:
            model.refine = np.frombuffer(got).reshape(2, 256 * LEVELS)
    return model, counts


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out=None, hot_bound: int = 1 << 22, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """One row per row of docs: key, held_out, n_bytes, n_tokens, n_known, train_tokens,
    base_score, score (log10 of the model's probability of the lower-cased text and its end).

    Learns from rows where `held_out`, a boolean column expression (none: false), is false.
    Null and empty texts have the end as their only token and byte.  With no training rows
    every prediction is even and every token unknown.  Repeated rows count and are scored as
    often as they stand there; null keys are kept; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), held.alias("held_out"))
    model, counts = fit(named.filter("not held_out"))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, -(-total // hot_bound))  # at most hot_bound tokens can occur so often
    hot = counts.filter(F.col("n") >= least).toPandas().sort_values("part")
    known_keys, known_counts = hot["part"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((model, known_keys, known_counts))
    below = float(np.log10(total + 0.5 * (distinct + 1)))
    mixed = [f"mixed_{i}" for i in range(len(shares))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, seen = shared.value
        logs, share_logs = np.log10(seen + 0.5), np.log10(seen / max(1, total))
        scorer = Scorer(model)
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "text"):
                n, data = end - at, LOWER[data]
                closed, bounds = ended(data, offsets)
                cost = scorer(windows(closed, bounds))
                row, made, given, blanks = occurrences(data, offsets, cost)
                made = made.astype(np.int64)
                place = np.minimum(np.searchsorted(keys, made), max(0, len(keys) - 1))
                hit = keys[place] == made if len(keys) else np.zeros(len(made), bool)
                rest = ~hit

                def by_row(values, rows=row[hit], n=n):
                    return np.bincount(rows, weights=values, minlength=n).astype(np.float64)  # of nothing it counts in integers

                n_tokens = np.bincount(row, minlength=n).astype(np.int64)
                n_known = np.bincount(row[hit], minlength=n).astype(np.int64)
                base = by_row(logs[place[hit]])
                whole = by_row(cost, np.repeat(np.arange(n), np.diff(bounds)))
                more = gains(given[hit], share_logs[place[hit]], shares)
                scores = [whole + by_row(g) + blanks * np.log10(1 - w) for w, g in zip(shares, more)]
                cut = pa.array(np.searchsorted(row[rest], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_known), pa.array(base), *map(pa.array, scores), pa.ListArray.from_arrays(cut, pa.array(made[rest])), pa.ListArray.from_arrays(cut, pa.array(given[rest]))],
                    names=["id", "held_out", "n_bytes", "n_tokens", "n_known", "base", *mixed, "rare", "given"],
                )

    schema = f"id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, {', '.join(f'{m} double' for m in mixed)}, rare array<long>, given array<double>"
    rows = stored(named.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "given")).alias("t")).select("row", F.col("t.rare").alias("part"), F.col("t.given").alias("given"))
    # tokens that training never saw count 0.5; the others are too rare to be broadcast
    unseen = F.coalesce(F.col("n"), F.lit(0))

    def gain(w: float):
        if not w:
            return F.lit(0.0)
        alone = F.lit(float(np.log10(1 - w)))
        a, b = F.col("given") + alone, F.log10(F.col("n") * F.lit(w / max(1, total)))
        both = F.greatest(a, b) + F.log10(F.pow(F.lit(10.0), a - F.greatest(a, b)) + F.pow(F.lit(10.0), b - F.greatest(a, b))) - F.col("given")
        return F.when(F.isnan("given"), 0.0).when(F.col("n").isNull(), alone).otherwise(both)

    more = [F.sum(gain(w)).alias(f"more_{m}") for w, m in zip(shares, mixed)]
    met = pairs.join(counts, "part", "left").groupBy("row").agg(F.count_if(unseen > 0).alias("more_known"), F.sum(F.log10(unseen + 0.5)).alias("more"), *more)
    joined = stored(
        rows.drop("rare", "given").join(met, "row", "left").select("*", *[(F.col(m) + F.coalesce(f"more_{m}", F.lit(0.0))).alias(f"whole_{m}") for m in mixed]), "mixed"
    )
    costs = joined.filter("not held_out").agg(*[F.sum(f"whole_{m}") for m in mixed]).first()
    best = max(range(len(shares)), key=lambda i: costs[i]) if costs[0] is not None else 0
    return joined.select(
        F.col("id").alias(key), "held_out", "n_bytes", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), F.col(f"whole_{mixed[best]}").alias("score"),
    )
