import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import postings


@pytest.mark.parametrize("k,rows", [(1, 100_000), (4, 25), (50, 7)])
def test_the_best_equal_brute_force(spark, monkeypatch, k, rows):
    """Common tokens of small weight, rare ones of large weight, equal scores, split lists."""
    monkeypatch.setattr(postings, "LIST_ROWS", rows)
    rng = random.Random(k)
    tokens = [f"t{i}" for i in range(30)]
    chunks = [("xy"[c % 2], c, t, round(rng.choice([0.25, 0.5, 1.0]) * (1 + tokens.index(t)), 3)) for c in range(160) for t in rng.sample(tokens[:4], 3) + rng.sample(tokens[4:], rng.randint(0, 3))]
    queries = [(q, "xyz"[q % 3], t, rng.choice([0.5, 1.0, 2.0])) for q in range(14) for t in rng.sample(tokens, rng.randint(1, 6))]
    left = spark.createDataFrame(queries, "query_id int, book_id string, token string, weight double")
    right = spark.createDataFrame(chunks, "book_id string, chunk_id int, token string, weight double")
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.sparse) for r in postings.sparse_top(left, right, k).collect())
    held, want = {}, []
    for b, c, t, w in chunks:
        held.setdefault((b, c), {})[t] = w
    for q in sorted({x[0] for x in queries}):
        own = {t: w for i, _, t, w in queries if i == q}
        scored = [(-round(sum(w * m.get(t, 0) for t, w in own.items()), 6), str(c), c) for (b, c), m in held.items() if b == "xyz"[q % 3] and set(m) & set(own)]
        want += [(q, i + 1, c, -s) for i, (s, _, c) in enumerate(sorted(scored)[:k])]
    assert got == sorted(want)


def test_lists_of_common_tokens_are_not_read(spark):
    """The rare token alone lifts k chunks above all that the common one can add."""
    chunks = [("b", c, "common", 0.1) for c in range(200)] + [("b", c, "rare", 5.0) for c in range(5)]
    right = spark.createDataFrame(chunks, "book_id string, chunk_id int, token string, weight double")
    left = spark.createDataFrame([(1, "b", "common", 1.0), (1, "b", "rare", 1.0)], "query_id int, book_id string, token string, weight double")
    needed = postings.needed_tokens(left, postings.list_heads(right, 5)).collect()
    assert [(r.token, r.least, round(r.rest, 6)) for r in needed] == [("rare", 5.0, 0.1)]
    assert {(r.chunk_id, r.sparse) for r in postings.sparse_top(left, right, 5).collect()} == {(c, 5.1) for c in range(5)}
    assert postings.sparse_top(left.limit(0), right, 5).count() == 0 and postings.sparse_top(left, right.filter(F.lit(False)), 5).count() == 0
