import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lexical, queries, sharding, spelling

A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# sharding


@pytest.mark.parametrize("total,good,draws", [(60, 25, 17), (9, 1, 8), (1000, 990, 500), (5, 0, 3), (4, 4, 2), (1, 1, 0)])
def test_single_draws_follow_the_distribution(spark, total, good, draws):
    n = 8000
    x = sharding.hypergeometric(sharding.uniform(F.lit(5), F.col("id")), *(F.lit(v).cast("long") for v in (total, good, draws)))
    got = {r.x: r["count"] for r in spark.range(n).select(x.alias("x")).groupBy("x").count().collect()}
    want = {k: n * math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws) for k in range(max(0, draws - total + good), min(good, draws) + 1)}
    assert set(got) <= set(want) and sum(got.values()) == n
    big = {k: v for k, v in want.items() if v >= 5}
    chi = sum((got.get(k, 0) - v) ** 2 / v for k, v in big.items())
    assert chi < len(big) + 5 * math.sqrt(2 * len(big))


def test_large_draws_have_the_right_mean_and_spread(spark):
    total, good, draws = 10**10, 4 * 10**8, 3 * 10**9
    x = sharding.hypergeometric(sharding.uniform(F.lit(6), F.col("id")), *(F.lit(v).cast("long") for v in (total, good, draws)))
    got = np.array([r.x for r in spark.range(60).select(x.alias("x")).collect()], float)
    spread = math.sqrt(draws * (good / total) * (1 - good / total) * (total - draws) / total)
    assert abs(got.mean() - draws * good / total) < 5 * spread / math.sqrt(60) and 0.6 < got.std() / spread < 1.4


@pytest.mark.parametrize("sizes,shards", [([7, 0, 12, 1, 30], 4), ([3], 5), ([1, 1], 1), ([400] * 23, 24)])
def test_the_matrix_has_exact_sums(spark, sizes, shards):
    rows = spark.createDataFrame([(k * 3, n) for k, n in enumerate(sizes)], "part long, n long")
    got = {r.part: r.counts for r in sharding.communication_matrix(rows, shards, 9).collect()}
    assert {p: sum(c) for p, c in got.items()} == {k * 3: n for k, n in enumerate(sizes)}
    columns = [sum(c[s] for c in got.values()) for s in range(shards)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1 and all(v >= 0 for c in got.values() for v in c)


def test_sharding_is_uniform_exact_and_repeatable(spark):
    docs = spark.range(0, 24000, 1, 6).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) AS text", "id DIV 4000 AS part")
    got = sharding.shuffled(docs, shards=8, seed=3).select("shard", "slot", "row.*").collect()
    assert sorted(r.doc_id for r in got) == list(range(24000))
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(3000)) for v in by.values())
    table = np.zeros((6, 8))
    places = np.zeros((6, 10))
    for r in got:
        table[r.part, r.shard] += 1
        places[r.part, r.slot // 300] += 1
    # a uniform shuffle of 24000 rows: variance of a cell is about 500 * 7/8 * 5/6
    assert 12 < ((table - 500) ** 2 / 500).sum() < 70 and 15 < ((places - 400) ** 2 / 400).sum() < 90
    again = sharding.shuffled(docs, shards=8, seed=3).select("shard", "slot", "row.doc_id").collect()
    assert {(r.shard, r.slot, r.doc_id) for r in again} == {(r.shard, r.slot, r.doc_id) for r in got}
    other = sharding.shuffled(docs, shards=8, seed=4).select("shard", "slot", "row.doc_id").collect()
    assert {(r.shard, r.slot, r.doc_id) for r in other} != {(r.shard, r.slot, r.doc_id) for r in got}


def test_buckets_of_large_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    got = sharding.shuffled(spark.range(0, 2001, 1, 5), shards=3).collect()
    assert {s: sorted(r.slot for r in got if r.shard == s) for s in range(3)} == {s: list(range(667)) for s in range(3)}
    early = [r.row.id for r in got if r.slot < 100]
    assert 850 < sum(early) / len(early) < 1150


def test_sharding_cases(spark, tmp_path):
    rows = [(None, None, 1, 2, 3), (1, "", 1, 2, 3), (1, "", 1, 2, 3), (1, "x", None, None, None), (2, "é" * 700_000, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int, id int")
    got = sharding.shuffled(docs, shards=3).collect()
    assert sorted((tuple(r.row) for r in got), key=repr) == sorted(rows, key=repr)
    assert sorted(Counter(r.shard for r in got).values()) == [1, 2, 2]
    assert sharding.shuffled(docs.limit(0), shards=3).count() == 0
    few = sharding.shuffled(docs, shards=9).collect()
    assert len({r.shard for r in few}) == 5 and {r.slot for r in few} == {0}
    sharding.write_shards(sharding.shuffled(docs.select("doc_id", "text"), shards=2), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.shard, r.slot) for r in back.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_shard_query(spark, sf):
    got = queries.op11_hypergeometric_shards(spark, sf)
    assert not [n for n in ("Python", "Arrow", "Pandas") if n in got._jdf.queryExecution().toString()]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in docs.items()}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


# spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_search_schemes_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        words = list({"".join(rng.choice("abéÿ"[: rng.randint(1, 4)]) for _ in range(rng.randint(5, 9))) for _ in range(rng.randint(1, 90))})
        asked = rng.sample(words, rng.randint(1, len(words)))
        rule = spelling.Variants(wide=rng.choice([1, 4, 64]), states=rng.choice([40, 100_000]))
        got = [p for side in "RL" for p in spelling.near_in_piece(words, asked, side, rule)]
        assert sorted(got) == sorted((a, b) for a in asked for b in words if one_edit(a, b))


@pytest.mark.parametrize("piece", [40_000, 25])
def test_near_words_equal_brute_force(spark, piece):
    """Small pieces split the crowded ends, so patterns go to several parts."""
    rng = random.Random(8)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"".join(rng.choice("xyz") for _ in range(6)) for _ in range(150)} | {"a" * k for k in range(5, 12)}
    got = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), spelling.Variants(piece_words=piece)).collect()
    assert sorted(tuple(r) for r in got) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def plain_forms(rows, every=97):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form = {}
    out = {}
    for w in words:
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        form[w] = near[0][1] if near and -near[0][0] >= 2 * words[w] else None
        out[w] = (words[w], len(near), form[w], words[form[w]] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def test_forms_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["Straße", "ÉcoleX", "colour", "color", "colours", "letters", "aaaaa", "aaaaaa", "abcde" * 40]
    rows = [(k, " ".join(rng.choice(base) if rng.random() < 0.8 else rng.choice(base)[1:] for _ in range(rng.randint(0, 60)))) for k in range(200)]
    rows += [(None, "colour colour"), (5, None), (5, ""), (7, rows[7][1]), (7, rows[7][1]), (10**6, "x " * 700_000 + " color" * 9)] + [(k, "longer" * 500) for k in range(5)]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, word string, n int")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_forms(docs, every=7).collect()}
    assert got == plain_forms(rows, 7) and sum(r[2] is not None for r in got.values()) > 5 and any(r[2] and r[2] != r[4] for r in got.values())
    assert spelling.spelling_forms(docs.limit(0)).count() == 0


# lexical search


def plain_search(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(k, term.findall((t or "").translate(A_TO_Z))) for k, t in docs]
    n, size = sum(bool(ts) for _, ts in held), sum(len(ts) for _, ts in held)
    tfs = [Counter(ts) for _, ts in held]
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for (key, ts), tf in zip(held, tfs):
            m = 50 + (50 * len(ts) * n) // size if size else 50
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(term.findall((text or "").translate(A_TO_Z))) if tf[t])
            if score > 0:
                scored.append((-score, key is not None, key))
        out += [(item, k + 1, key, -s) for k, (s, _, key) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("rule", [lexical.Search(top=7, seeds=20, cells=1), lexical.Search(top=50), lexical.Search(top=3, seeds=1, focus=1, block_queries=5)])
def test_search_equals_brute_force(spark, rule):
    rng = random.Random(rule.top)
    words = [f"w{k}" for k in range(60)] + ["É", "ÿ1", "A", "a"]
    docs = [(k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.choice([1, 5, 30, 300])))) for k in range(400)]
    docs += [(1000 + k, "w1 w2 w50 w51") for k in range(90)] + [(None, "w50 w51 w52"), (None, None), (3, ""), (3, "w50"), (5, "w3 " * 300_000)]
    items = [(k, " ".join(rng.sample(words, rng.randint(1, 12)))) for k in range(14)] + [(100, None), (101, ""), (102, "nowhere"), (103, "w50 w51 w50"), (103, "w50 w51 w50"), (None, "w2")]
    left = spark.createDataFrame([(a, b, 1, 2, "z") for a, b in docs], "doc_id long, text string, score int, query int, key string").repartition(5)
    right = spark.createDataFrame([(a, b, 1, "q") for a, b in items], "item_id long, text string, doc_id int, asked string")
    got = lexical.search(left, right, rule=rule).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain_search(docs, items, rule.top), key=repr)


def test_search_over_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    full = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert lexical.search(docs, full.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical.search(full, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), full.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_buckets_are_skipped_by_length():
    """A bucket too short for a query is not read, and one that is read loses nothing."""
    query = lexical.Query(np.array([0, 1, 2]), np.array([5, 9, 1]), 1)
    assert query.ids.tolist() == [1, 0, 2] and abs(query.length - math.sqrt(107)) < 1e-9 and abs(query.rest - math.sqrt(26)) < 1e-9
    best = lexical.Best(2, 1000)
    cells = np.array([[1, 0], [2, 3], [0, 0]])
    lexical.search_bucket(cells, np.sqrt((cells**2).sum(0).astype(float)), ["a", "b"], [query], [best], 1)
    assert best.rows == []
    best.least = 23
    lexical.search_bucket(cells, np.sqrt((cells**2).sum(0).astype(float)), ["a", "b"], [query], [best], 1)
    assert best.rows == [(23, "a"), (27, "b")]


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    made = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(got.columns)
    want = made.fetchall()
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 100
