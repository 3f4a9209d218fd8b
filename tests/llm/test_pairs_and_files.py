import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from lectern.llm import decontaminate, id_codec, mixing, queries, setjoin, token_files

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute_components(rows, width, per):
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            common = len(s & u)
            if s and u and 100 * common >= per * (len(s) + len(u) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def edited(n, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(k)] for k in (1, 2, 3, 5, 8, 12, 20, 40, 150)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["zz" + str(rng.randrange(3))], [w[k], "q"]]) or ["a"]
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "A b"), (n + 4, "a B")]


@pytest.mark.parametrize("width,per", [(3, 90), (1, 80), (1, 60)])
def test_components_equal_brute_force(spark, width, per):
    rows = edited(350, width)
    docs = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id long, text string, sig string, row long, id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.link_components(docs, link=setjoin.Link(width, per, block=20)).collect()}
    assert got == brute_components(rows, width, per)


def test_sql_of_the_set_join_equals_brute_force():
    rows = edited(350, 3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    found = con.execute(queries.oracle_sql()["op9_ngram_jaccard"]).fetchall()
    assert {i: (n, c) for i, n, c in found} == brute_components(rows, 3, 90)


def test_components_equal_brute_force_on_documents(spark, sf):
    """Sets of hundreds of shingles, with passages that many of them share."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").filter("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()][:450]
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, t if i % 3 else f"{t[:900]} {passage} {t[:500]}") for i, t in rows] + [(10**6 + i, t + " one more end") for i, t in rows if i % 7 == 0]
    for width, per in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.link_components(spark.createDataFrame(rows, "doc_id long, text string"), link=setjoin.Link(width, per)).collect()}
        want = brute_components(rows, width, per)
        assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_one_of_each(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (2, "A b c", 2), (None, "a b c", 3), (None, "a b c", 4), (4, "x y z", 5), (4, "p q r", 6), (5, None, 7), (5, "", 8), (6, "p q r", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = [tuple(r) for r in setjoin.one_of_each(docs).collect()]
    assert sorted(r[2] for r in got) == [1, 3, 4, 5, 6, 7, 8]
    assert setjoin.one_of_each(docs.limit(0)).count() == 0


def test_components_of_nothing(spark):
    assert setjoin.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 1023, 1024, 1025, 5000):
        for ids in (rng.choice(50257, n), rng.zipf(1.3, n) % 50257, np.full(n, 65535)):
            assert (id_codec.decode(id_codec.encode(ids)) == ids).all()
    broken = bytearray(id_codec.encode(rng.choice(50257, 3000)))
    for place in (-100, 60):  # in a block, in the header
        broken[place] ^= 1
        with pytest.raises(ValueError):
            id_codec.decode(bytes(broken))
        broken[place] ^= 1
    assert len(id_codec.decode(bytes(broken))) == 3000


def test_codec_beats_order_zero(spark, sf):
    """Fewer bits an id than the ids' own entropy, header and order-0 table included."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    ids, _ = token_files.Pieces(token_files.public_tokenizers.path(token_files.TOKENIZER)).encode(texts)
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    coded = id_codec.encode(ids)
    assert 8 * len(coded) / len(ids) < min(9.0, entropy) and (id_codec.decode(coded) == ids).all()


def test_pieces_equal_whole_texts():
    """Texts of letters, signs, line breaks, apostrophes and added tokens in any order, and equal
    words behind other signs, which are learnt once."""
    pieces = token_files.Pieces(token_files.public_tokenizers.path(token_files.TOKENIZER))
    rng = random.Random(3)
    signs = ["a", "B", "é", "×", "÷", "ÿ", "Ã", "'", "'s", "'ll", " ", " ", "\n", "\n", "\t", "\r", "1", "²", "!", "-", "(", "<", "|", "<|", "<|endoftext|>", "\x1c", "\x85", "\xa0", "漢", "ß", "\u0301", "😀", "\0", "_", "’"]
    for _ in range(40):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(100)]
        ids, counts = pieces.encode(texts)
        whole = pieces.whole(texts)
        assert counts.tolist() == [len(w) for w in whole] and ids.tolist() == np.concatenate(whole).tolist()
    pieces.clear()
    pieces.encode(["one word, word. word\nword! (word) word's"])
    assert sum("word" in p for p in pieces.place) == 3 and [len(x) for x in pieces.encode([])] == [0, 0]


def test_token_files(spark, sf):
    odd = ["", " a", "a  b", "a ", "\n a", "a\n b c", "é <|endoftext|> x", "a   b", "don't 12 3!!", "\0a b", None]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 10**6)) + [(10**6, "twice")], "doc_id long, text string"))
    path = token_files.write_files(docs, run_ids=20_000)
    got = sorted((r.key, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_files(spark, path).collect())
    whole = token_files.Pieces(token_files.public_tokenizers.path(token_files.TOKENIZER)).whole
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    start, want = 0, []
    for k, ids in zip([r[0] for r in rows], whole([r[1] for r in rows])):
        ids = np.append(ids, 2).astype("<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert want == got


def test_leaks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(-1, "x " * 30 + items.first().text + " y z"), (-2, None), (-3, ""), (-4, "only three words")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    extra = items.union(spark.createDataFrame([(900, "three words"), (901, None)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(more, extra).collect()}

    def norm(t):
        return " " + " ".join("".join(c if c.isdigit() and c.isascii() or c.isascii() and c.islower() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split()) + " "

    texts = [(r.doc_id, norm(r.text)) for r in more.collect()]
    exact = {(d, r.item_id) for r in extra.collect() if norm(r.text).strip() for d, t in texts if norm(r.text) in t}
    assert exact and exact <= got and (-1, items.first().item_id) in got and (-4, 900) in got
    for d, i in got - exact:  # near copies only
        assert i != 900
    assert decontaminate.without_leaks(more, extra).filter("doc_id = -1").isEmpty()
    assert decontaminate.find_leaks(more.limit(0), extra).isEmpty() and decontaminate.find_leaks(more, extra.limit(0)).isEmpty()


def test_leaks_in_another_order(spark):
    words = [f"w{i}" for i in range(50)]
    noise = [f"n{i}" for i in range(60)]
    moved = noise[:30] + words[10:] + words[:10] + noise[30:]
    shuffled = noise[:30] + [w for i in range(45, -1, -5) for w in words[i : i + 5]] + noise[30:]
    rows = [(1, " ".join(moved)), (2, " ".join(shuffled)), (3, " ".join(noise)), (4, " ".join(words[10:] + words[:10]))]
    items = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(noise[:2] + words[:13]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 7), (4, 7)}
    assert (got[1, 7].start_word, got[1, 7].n_words, got[4, 7].start_word) == (30, 50, 0) and got[1, 7].similarity > 0.8


def test_recall_of_edited_items(spark, sf):
    """At least nine in ten of the documents that brute force finds at similarity 0.8 or more."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {i: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.translate(str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)}))).split() for i, t in items}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in plain.items() if len(w) >= 5}
    holders = Counter(s for bag in bags.values() for s in bag)
    rng = random.Random(4)
    rows = []
    for k in range(160):
        w = list(plain[rng.choice(list(bags))])
        for _ in range(rng.choice([0, 1, 1, 2])):  # an edit touches up to five shingles; most near an end
            w[rng.choice([0, 1, 2, -1, -2, rng.randrange(len(w))])] = f"new{rng.randrange(10**6)}"
        noise = [f"n{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((k, noise[:20] + w + noise[20:]))
    want = set()
    for k, w in rows:
        for i, bag in bags.items():
            n = len(plain[i])
            for at in range(len(w) - n + 1):
                window = Counter(tuple(w[j : j + 5]) for j in range(at, at + n - 4))
                weigh = lambda s, c: c / holders.get(s, 1)
                more = sum(weigh(s, max(window[s], bag[s])) for s in window | bag)
                if sum(weigh(s, min(window[s], bag[s])) for s in window & bag) >= 0.8 * more - 1e-12:
                    want.add((k, i))
                    break
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.9 * len(want)


def test_mixture(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.fit_mixture(docs, labels).toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    whole = rows.n_tokens.sum()
    for domain, share in mixing.Mix().targets.items():
        assert abs((rows.rate * rows.n_tokens * rows[f"p_{domain}"]).sum() / whole - share) < 0.01
    few = spark.createDataFrame([(1, None), (2, ""), (2, "a b")], "doc_id long, text string")
    assert mixing.fit_mixture(few, labels.limit(0)).count() == 3
    assert mixing.fit_mixture(few.limit(0), labels).count() == 0


def test_rates_equal_projected_gradient(spark, sf):
    """The fitted rates against the same descent in numpy, from the posteriors returned."""
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    mix = mixing.Mix(targets={"good": 0.6, "poor": 0.3, "toxic": 0.1})
    rows = mixing.fit_mixture(docs, labels, mix=mix).toPandas()
    p, tokens = rows[["p_good", "p_poor", "p_toxic"]].to_numpy(), rows.n_tokens.to_numpy(float)
    wanted = np.array([0.6, 0.3, 0.1]) * tokens.sum()
    rate, size = np.ones(len(rows)), (p * tokens[:, None]).sum(axis=0)
    for _ in range(mix.steps):
        now = (p * (rate * tokens)[:, None]).sum(axis=0)
        if np.abs(now - wanted).sum() <= mix.close * tokens.sum():
            break
        rate = np.maximum(0, rate - p @ ((now - wanted) / size))
    assert np.allclose(rows.rate, rate, rtol=1e-6, atol=1e-9) and rate.std() > 0.05
    assert ((rows.copies - rows.rate).abs() < 1).all()


def test_held_out_domains(spark, sf):
    """Posteriors of labelled documents that the classifier was not fitted on."""
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.withColumn("label", mixing.domain_of()).filter("label is not null")
    rows = mixing.fit_mixture(docs, labels.filter("doc_id % 4 <> 1")).join(known.filter("doc_id % 4 = 1").select("doc_id", "label"), "doc_id").toPandas()
    found = rows[["p_good", "p_poor", "p_toxic"]].to_numpy().argmax(axis=1)
    common = rows.label.value_counts(normalize=True).max()
    assert len(rows) > 100 and (found == rows.label).mean() > max(0.85, common)
