import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import mixing_lm, quality, queries

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {r.doc_id: r for r in mixing_lm.score(docs, held_out=held, hot_bound=1 << 12).collect()}
    rows = [(r.doc_id, (r.text or "").encode().translate(LOWER)) for r in docs.collect()]
    count, out = Counter(), {}
    for k, raw in rows:
        out[k] = zlib.crc32(str(k).encode()) % 5 == 1
        if not out[k]:
            count.update(SPACE.findall(raw))
            count[b""] += 1
    whole = sum(count.values())
    below = math.log10(whole + 0.5 * (len(count) + 1))
    bits = size = bits_even = 0
    for k, raw in rows:
        tokens = [*SPACE.findall(raw), b""]
        g = got[k]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out[k], len(tokens), sum(t in count for t in tokens), whole)
        assert math.isclose(g.base_score, sum(math.log10(count[t] + 0.5) - below for t in tokens), rel_tol=1e-9)
        if out[k]:
            bits -= g.score / math.log10(2)
            size += len(raw)
    assert got[-1].score == got[-2].score < 0
    # held-out text costs far less than order 0 would (about 4.2 bits a byte)
    assert bits / size < 2.6


def test_language_model_learns_from_nothing(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in mixing_lm.score(docs, held_out=F.lit(True)).collect()}
    assert rows[1].n_known == 0 and rows[1].train_tokens == 0 and rows[1].score < rows[2].score < 0
    assert mixing_lm.score(docs.limit(0)).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_quality(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "a b c d e f g h\n" * 30), (-4, "x\n\n \nx y\nx")]
    got = {r.doc_id: r for r in quality.compression_bands(docs.union(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    for k, t in [*extra, *((r.doc_id, r.text) for r in docs.collect())]:
        g = got[k]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute_quality(t or ""), k
    assert not got[-3].in_band
    assert quality.compression_bands(docs.limit(0)).count() == 0


def test_quality_measures_chunks_to_the_end(spark):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(4096))
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(600)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))[:n]

    rows = [(1, noise + prose(3000)), (2, prose(5000)), (3, prose(4096)), (4, prose(4097)), (5, prose(8192) + noise[:2000]), (6, prose(7000) + noise[:1192])]
    got = {r.doc_id: r for r in quality.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.n_chunks for k, r in got.items()} == {1: 2, 2: 2, 3: 0, 4: 2, 5: 3, 6: 2}
    assert got[1].ratio >= 1.3 and got[1].bad_chunks == 1 and not got[1].in_band
    assert got[2].in_band and got[4].in_band and got[4].bad_chunks == 0
    last = rows[4][1].encode()[-4096:]
    assert got[5].best_chunk == len(last) / len(zstandard.ZstdCompressor(level=3).compress(last))


BANDS = [(65536, 1.6, 3.5), (8192, 1.5, 2.9), (1024, 1.3, 2.6), (256, 1.1, 2.6), (0, 0.9, 3.0)]


def test_quality_query_equals_brute_force(spark, sf):
    """The whole query, verdict and ratios included."""
    sf = sf.replace("0.001", "0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = lambda raw: len(zstandard.ZstdCompressor(level=3).compress(raw))
    verdicts = Counter()
    for r in queries.op6_quality_rules(spark, sf).collect():
        raw, stats = texts[r.doc_id].encode(), brute_quality(texts[r.doc_id])
        failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
        ratio = len(raw) / size(raw) if raw else 0.0
        starts = [*range(0, len(raw) - 4096, 4096), len(raw) - 4096] if len(raw) > 4096 else []
        bad = sum(not 1.3 <= 4096 / size(raw[i : i + 4096]) <= 2.8 for i in starts)
        low, high = next(b[1:] for b in BANDS if len(raw) >= b[0])
        kept = not failed and low <= ratio <= high and bad <= 0.3 * len(starts)
        assert tuple(r) == (r.doc_id, *stats, failed, kept, ratio, bad)
        verdicts[failed, kept] += 1
    assert sum(verdicts.values()) == len(texts) and verdicts[False, True] > 0


def test_every_query_has_rows(spark, sf):
    for name, f in queries.queries().items():
        assert not f(spark, sf).isEmpty(), name


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    words = {k: (r.text or "").encode().split() for k, r in rows.items()}
    ids = {r.doc_id for r in kept.collect()}
    assert ids and all(len(words[k]) >= 20 for k in ids)
    single = corpus_pipeline.near_duplicates(spark, kept, sf)
    left = [r.doc_id for r in single.collect()]
    assert len(left) == len(set(left)) and set(left) <= ids
    shingles = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k in ids for w in [(rows[k].text or "").encode().translate(LOWER).split()]}

    def linked(a, b):
        common = len(shingles[a] & shingles[b])
        return 100 * common >= 80 * (len(shingles[a]) + len(shingles[b]) - common)

    order = sorted(left)
    assert not any(linked(a, b) for i, a in enumerate(order) for b in order[:i])
    clean = corpus_pipeline.decontamination(spark, single, sf)
    mixture = corpus_pipeline.target_mixture(spark, clean, sf)
    assert clean.columns == mixture.columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {r.doc_id for r in out.collect()} <= set(left)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_nothing(spark, sf, name, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert stage(spark, docs, sf).count() == 0


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 1
    one, many = ({r.doc_id: r.score for r in mixing_lm.score(docs.repartition(n), held_out=held).collect()} for n in (1, 16))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)


def mixed64(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def one_byte_at_a_time(model, raw):
    """log10 of every byte and of the end, bit by bit from the model's tables."""
    out = []
    for i, byte in enumerate([*raw, 255]):
        past = [raw[i - j] if i >= j else 0 for j in range(1, 6)]
        total = 0.0
        for depth in range(8):
            node, bit = (byte | 256) >> (8 - depth), byte >> (7 - depth) & 1
            x, known = [], 0
            for k, o in enumerate(mixing_lm.ORDERS):
                context = mixed64((sum(past[j] << 8 * j for j in range(o)) + (o << 56)) % 2**64)
                slot = (context ^ node * 0x9E3779B97F4A7C15 % 2**64) * 0xBF58476D1CE4E5B9 % 2**64 >> 44
                zeros, ones = int(model.zeros[k][slot]), int(model.ones[k][slot])
                known += zeros + ones > 0
                x.append(float(np.float32(math.log((ones + 0.3) / (zeros + 0.3)))))
            dot = sum(w * v for w, v in zip(model.weights[depth * 5 + known], x))
            p = 1 / (1 + math.exp(-min(12, max(-12, dot))))
            cell = past[0] * 33 + min(32, max(0, round(2 * dot) + 16))
            p = (p + (model.refine[0][cell] + 30 * p) / (model.refine[1][cell] + 30)) / 2
            total += math.log10(min(1 - 1e-6, max(1e-6, p if bit else 1 - p)))
        out.append(total)
    return out


def word_by_word(raw, cost, share, count):
    """The bits' cost mixed with the words' own prediction, walked from the left."""
    total, at, whole = 0.0, 0, sum(count.values())
    while at <= len(raw):
        word = SPACE.match(raw, at)
        stop = word.end() if word else at + 1
        p = (1 - share) * 10 ** sum(cost[at:stop])
        if word or at == len(raw):
            p += share * count[word.group() if word else b""] / whole
        total += math.log10(p)
        at = stop
        if word:  # what ends a word is no choice between words and blanks
            total += cost[at]
            at += 1
    return total


def test_score_against_a_walk_by_bits_and_words(spark):
    texts = ["the cat sat on the mat", "the  cat\nran", None, "", " the end ", "un\u00e9 cat\tand a dog ", "the cat", "THE CAT SAT", "zebra quagga the", "\n"]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 5 == 1
    model, _ = mixing_lm.fit(docs.filter(~held).select(F.col("doc_id").alias("id"), "text"))
    lower = {i: (t or "").encode().translate(LOWER) for i, t in rows}
    count = Counter(w for i, raw in lower.items() if i % 5 != 1 for w in [*SPACE.findall(raw), b""])
    costs = {i: one_byte_at_a_time(model, raw) for i, raw in lower.items()}
    tried = {w: {i: word_by_word(raw, costs[i], w, count) for i, raw in lower.items()} for w in (0.0, 0.25, 0.5)}
    best = max(tried, key=lambda w: sum(v for i, v in tried[w].items() if i % 5 != 1))
    for shares, bound, want in (((0.0, 0.25, 0.5), 1 << 22, best), ((0.25,), 1 << 22, 0.25), ((0.25,), 4, 0.25)):  # all words broadcast; most of them joined
        got = {r.doc_id: r.score for r in mixing_lm.score(docs, held_out=held, hot_bound=bound, shares=shares).collect()}
        assert got.keys() == tried[want].keys() and all(math.isclose(got[i], tried[want][i], rel_tol=1e-6) for i in got)


def test_scores_are_a_distribution(spark):
    """The end is coded: a text and its prefixes share their probability."""
    texts = ["a", "ab", "abc", "b", "", "ba"]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id long, text string")
    got = {t: 10**r.score for r in mixing_lm.score(train).collect() for t in [(texts * 5)[r.doc_id]]}
    assert sum(got.values()) < 1


def prose(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aaeeiinrstlodum") for _ in range(rng.randint(2, 9))) for _ in range(120))


def test_quality_verdicts_by_row(spark):
    good = prose(1)
    rows = [(0, good, 1), (0, "short bad", 2), (None, "short bad", 3), (None, good, 4), (1, None, 5), (2, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long")
    assert sorted(r._gone for r in quality.passing(docs).collect()) == [1, 4]
    stats = quality.compression_bands(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    assert stats.filter(~failed & F.col("in_band")).count() == 2


def test_stages_keep_rows_and_clashing_names(spark, sf):
    """Repeated and missing ids with other texts, and columns named like the operators' own."""
    text = [prose(i) for i in range(4)]
    rows = [(1, text[0]), (1, text[1]), (None, text[2]), (None, text[2]), (2, text[3]), (2, text[3])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), *range(7)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int, _n int, _id int, _gone int, row int, n int, p int")
    left = corpus_pipeline.quality_rules(spark, docs, sf)
    assert left.columns == docs.columns and left.count() == 6
    left = corpus_pipeline.near_duplicates(spark, left, sf)
    assert left.columns == docs.columns and left.count() == 5
    left = corpus_pipeline.decontamination(spark, left, sf)
    assert left.columns == docs.columns and left.count() == 5
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    leaky = left.withColumn("text", F.when(F.col("text") == text[1], F.lit(item)).otherwise(F.col("text")))
    assert corpus_pipeline.decontamination(spark, leaky, sf).count() == 4
    left = corpus_pipeline.target_mixture(spark, left, sf)
    assert left.columns == docs.columns
    assert corpus_pipeline.token_output(spark, docs, sf).count() == 6
