"""Spelling variants: words one edit apart, found with search schemes over FM-indexes.

The pattern of a word is cut into two halves.  One error leaves one of them whole, so the right
half is matched exactly and the left one with an error, and then the other way round.  Both go
step by step over intervals of suffix ranks: the first scheme in an index of the words, which
reads leftwards, the second in an index of the words reversed, the other direction of the search.

Words meet the patterns whose half they hold: a word of m letters is filed under its ends of the
lengths that patterns of m - 1, m and m + 1 letters ask for, two on either side.  Each task
builds indexes over bounded pieces of what it is dealt; an end that more words hold than a piece
takes is split, and its patterns go to every part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, discard, new_path, stored, text_column

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it sends its sums on.
HELD_WORDS = 200_000


@dataclass(frozen=True)
class Variants:
    """Words from `letters` letters and `least` occurrences; how much commoner a form must be;
    words and letters of a piece; states widened by rank up to `wide`, beyond by letter."""

    letters: int = 5
    least: int = 3
    times: int = 2
    piece_words: int = 40_000
    piece_letters: int = 600_000
    wide: int = 64
    states: int = 200_000


def mutated(begun: int, run: str, every: int) -> str:
    """The run, less one letter where the checksum of key, colon and run is a multiple of
    `every`; begun is the checksum up to the colon."""
    h = zlib.crc32(run.encode(), begun)
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, rule: Variants = Variants()) -> DataFrame:
    """word, n of the runs of letters of whole texts, some of which lose a letter.  Occurrences
    are summed within a task first.  Null and empty texts have none; a missing key counts as the
    empty text; repeated rows count as often as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for at in range(len(batch)):
                value = batch.column(1)[at].as_py()
                if not value:
                    continue
                begun = zlib.crc32(f"{batch.column(0)[at].as_py() or ''}:".encode())
                for word, n in Counter(RUN.findall(value.encode().translate(LOWER).decode())).items():
                    word = mutated(begun, word, every)
                    if len(word) >= rule.letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    rows = text_column(docs, key, text).select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(f"n >= {rule.least}")


def text_order(text: np.ndarray) -> np.ndarray:
    """The order of the rotations of a text, by doubling ranks."""
    n, span = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while span < n and rank.max() < n - 1:
        both = rank * (n + 1) + np.roll(rank, -span)
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        span *= 2
    return np.argsort(rank, kind="stable")


class Index:
    """An FM-index over words, each closed by a 0.  Ranks of the rotations that begin with 0 are
    the places of the words that follow, in their order."""

    def __init__(self, words: list[np.ndarray]):
        text = np.concatenate([np.append(w, 0) for w in words]).astype(np.int64)
        order = text_order(text)
        self.size, self.words = len(text), len(words)
        self.last = np.roll(text, 1)[order]
        self.step = np.sort(self.last * self.size + np.arange(self.size))
        self.letters = np.unique(text[text > 0])
        to = np.empty(self.size, np.int64)
        to[np.argsort(self.last, kind="stable")] = np.arange(self.size)
        self.to = to

    def before(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with a letter put before them."""
        return np.searchsorted(self.step, letter * self.size + low), np.searchsorted(self.step, letter * self.size + high)

    def any_before(self, low: np.ndarray, high: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
        """(state, letter, low, high) for every letter that stands before a match.  Narrow
        intervals are read rank by rank, wide ones are asked for every letter."""
        width = high - low
        narrow, broad = np.flatnonzero(width <= wide), np.flatnonzero(width > wide)
        state = np.repeat(narrow, width[narrow])
        rank = np.arange(len(state)) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow]) + low[state]
        letter, to = self.last[rank], self.to[rank]
        order = np.lexsort((to, letter, state))
        state, letter, to = state[order], letter[order], to[order]
        first = np.ones(len(state), bool)
        first[1:] = (state[1:] != state[:-1]) | (letter[1:] != letter[:-1])
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(state)))
        out = [(state[heads], letter[heads], to[heads], to[heads] + sizes)]
        if len(broad):
            asked, put = np.repeat(broad, len(self.letters)), np.tile(self.letters, len(broad))
            a, b = self.before(put, low[asked], high[asked])
            out.append((asked[a < b], put[a < b], a[a < b], b[a < b]))
        state, letter, low, high = (np.concatenate(c) for c in zip(*out))
        real = letter > 0
        return state[real], letter[real], low[real], high[real]


def search(index: Index, patterns: list[np.ndarray], whole: np.ndarray, rule: Variants) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word) for patterns whose last `whole` letters stand unchanged at the end of a
    word that differs from them by one edit further left."""
    size = np.fromiter(map(len, patterns), np.int64, len(patterns))
    at = np.cumsum(size) - size
    text = np.concatenate(patterns).astype(np.int64) if len(patterns) else np.zeros(0, np.int64)
    q = np.arange(len(patterns))
    low, high, left = np.zeros(len(q), np.int64), np.full(len(q), index.words), size.copy()
    for _ in range(int(whole.max(initial=0))):
        go = left[q] > size[q] - whole[q]
        if not go.any():
            break
        a, b = index.before(text[at[q[go]] + left[q[go]] - 1], low[go], high[go])
        low[go], high[go] = a, b
        left[q[go]] -= 1
        kept = low < high
        q, low, high = q[kept], low[kept], high[kept]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # states without an error, and those with one: pattern, interval, letters left to match
    clean, rest, waiting = (q, low, high, left[q]), [], 0

    def spent(q: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> None:
        """Match what is left exactly, then the end of a word."""
        while len(q):
            done = left == 0
            a, b = index.before(np.zeros(int(done.sum()), np.int64), low[done], high[done])
            found.append((q[done][a < b], a[a < b]))
            q, low, high, left = q[~done], low[~done], high[~done], left[~done]
            low, high = index.before(text[at[q] + left - 1], low, high)
            kept = low < high
            q, low, high, left = q[kept], low[kept], high[kept], left[kept] - 1

    while len(clean[0]):
        q, low, high, left = clean
        for part in range(0, len(q), max(1, rule.states // rule.wide)):
            cut = slice(part, part + max(1, rule.states // rule.wide))
            state, letter, a, b = index.any_before(low[cut], high[cut], rule.wide)
            own, to_go = q[cut][state], left[cut][state]
            rest.append((own, a, b, to_go))  # the word has a letter more
            other = to_go > 0
            other[other] = letter[other] != text[at[own[other]] + to_go[other] - 1]
            rest.append((own[other], a[other], b[other], to_go[other] - 1))  # another letter
            more = left[cut] > 0
            rest.append((q[cut][more], low[cut][more], high[cut][more], left[cut][more] - 1))  # a letter less
            waiting += sum(len(r[0]) for r in rest[-3:])
            if waiting >= rule.states or len(rest) >= 3000:
                spent(*(np.concatenate(c) for c in zip(*rest)))
                rest, waiting = [], 0
        q, low, high, left = (c[left > 0] for c in clean)
        low, high = index.before(text[at[q] + left - 1], low, high)
        kept = low < high
        clean = (q[kept], low[kept], high[kept], left[kept] - 1)
    if rest:
        spent(*(np.concatenate(c) for c in zip(*rest)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate([f[0] for f in found]) * index.words + np.concatenate([f[1] for f in found]))
    return pairs // index.words, pairs % index.words


def near_in_piece(words: list[str], asked: list[str], side: str, rule: Variants) -> Iterator[tuple[str, str]]:
    """(word asked, word near it) within one piece.  Side R keeps the right half whole; side L
    the left half, and leaves out what side R finds as well."""
    turn: Callable[[str], str] = (lambda w: w) if side == "R" else (lambda w: w[::-1])
    have = sorted(turn(w) for w in words)
    code = lambda w: np.frombuffer(w.encode("utf-32-le"), np.uint32)
    index = Index([code(w) for w in have])
    patterns = [turn(w) for w in asked]
    whole = np.fromiter((len(w) - len(w) // 2 if side == "R" else len(w) // 2 for w in patterns), np.int64, len(patterns))
    p, w = search(index, [code(x) for x in patterns], whole, rule)
    for one, other in zip(p.tolist(), w.tolist()):
        mine, near = asked[one], turn(have[other])
        if side == "R" or not near.endswith(mine[len(mine) // 2 :]):
            yield mine, near


def filed(words: DataFrame) -> DataFrame:
    """side, half, asks, word: every word under the ends that near patterns may keep whole; asks
    where the half is the word's own."""
    m = F.length("word")

    def ends(side: str, size, half) -> list:
        # halves of patterns one letter shorter, as long, and one letter longer: two lengths
        lengths = F.array_distinct(F.array(size(m - 1), size(m), size(m + 1)))
        return F.transform(lengths, lambda k: F.struct(F.lit(side).alias("side"), half(k).alias("half"), (k == size(m)).alias("asks")))

    right = ends("R", lambda n: F.ceil(n / 2).cast("int"), lambda k: F.right("word", k))
    left = ends("L", lambda n: F.floor(n / 2).cast("int"), lambda k: F.left("word", k))
    return words.select("word", F.explode(F.concat(right, left)).alias("end")).select("end.*", "word")


def near_words(words: DataFrame, rule: Variants = Variants()) -> DataFrame:
    """word, near: all ordered pairs of words(word) that are one edit apart, each once.

    Words are distinct and not null; letters are code points.  An empty table has no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(side: str) -> Iterator[pa.RecordBatch]:
            have = list(dict.fromkeys(w for _, _, indexed, w in held if indexed))
            asked = list(dict.fromkeys(w for _, asks, _, w in held if asks))
            pairs = list(near_in_piece(have, asked, side, rule)) if have and asked else []
            for k in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs[k : k + 50_000])], names=["word", "near"])

        last = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("side", "half", "salt", "asks", "indexed", "word"))
            for side, half, salt, asks, indexed, word in zip(*columns):
                # a piece ends between ends, and where the side changes
                if held and (side, half, salt) != last and (side != last[0] or len(held) >= rule.piece_words or size >= rule.piece_letters):
                    yield from out(last[0])
                    held, size = [], 0
                elif len(held) >= 4 * rule.piece_words:  # more patterns than a piece takes: ask, and keep the words
                    yield from out(side)
                    held = [(half, False, True, w) for _, _, indexed_too, w in held if indexed_too]
                last = (side, half, salt)
                held.append((half, asks, indexed, word))
                size += len(word)
        if held:
            yield from out(last[0])

    rows = filed(words.select("word"))
    crowded = rows.groupBy("side", F.xxhash64("half").alias("hash")).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("letters"))
    over = F.greatest(F.ceil(F.col("n") / rule.piece_words), F.ceil(F.col("letters") / rule.piece_letters)).cast("long")
    split = crowded.select((F.col("side") == "R").cast("int").alias("r"), "hash", over.alias("parts")).filter("parts > 1")
    marked = rows.withColumn("r", (F.col("side") == "R").cast("int")).withColumn("hash", F.xxhash64("half")).join(checked(split), ["r", "hash"], "left")
    parts, own = F.coalesce("parts", F.lit(1)), F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    salts = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own))
    dealt = marked.withColumn("own", own).withColumn("salt", F.explode(salts)).withColumn("indexed", F.col("salt") == F.col("own"))
    sent = dealt.select("side", "half", "salt", "asks", "indexed", "word").repartition("side", "half", "salt").sortWithinPartitions("side", "half", "salt", F.desc("indexed"), "word")
    return sent.mapInArrow(run, "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): the end of the chain of forms, by following pointers that
    double their reach each round.  A word without a form is its own root."""
    spark, path = forms.sparkSession, new_path(forms.sparkSession, "roots")
    at = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots", path)
    while True:
        ends = at.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        old, path = path, new_path(spark, "roots")
        at = stored(at.join(ends, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots", path)
        discard(spark, old)
        if at.filter("moved").isEmpty():
            return at.drop("moved")


def spelling_forms(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, rule: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs.

    A word's form is its commonest near word (ties: the smallest by code points) if that is
    `times` as common as the word; forms grow ever more common, so every chain ends.  Null and
    empty texts have no words; very long texts are read whole and very long words taken as they
    are; a missing key counts as the empty text; repeated rows count again; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    words = stored(word_counts(docs, key, text, every, rule), "words")
    pairs = near_words(words, rule).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    takes = -F.col("best.less") >= rule.times * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    formed = stored(formed, "forms")
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
