import hashlib
from collections import Counter
import random
import re

import numpy as np

from lectern.llm import queries, repeats, suffix


def brute(rows, length):
    where = {}
    for i, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            where.setdefault(raw[p : p + length], []).append((i, p))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for found in where.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + length] = True
    return {k: (int(g.sum()), hashlib.sha256(bytes(np.frombuffer((t or "").encode(), np.uint8)[~g])).hexdigest()) for (k, t), g in zip(rows, gone)}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(400):
        s = rng.integers(0, int(rng.choice([1, 2, 3, 5, 200])), int(rng.integers(0, 60))).astype(np.uint8)
        if rng.random() < 0.3:
            s = np.concatenate([s, s[:20], s[5:15]])
        raw = s.tobytes()
        sa = suffix.suffix_array(s)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        if len(raw) > 1:
            plcp, phi = suffix.common_prefixes(s, sa)
            for r in range(1, len(raw)):
                x, y = raw[sa[r] :], raw[sa[r - 1] :]
                same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
                assert plcp[sa[r]] == same and phi[sa[r]] == sa[r - 1]


def corpus(seed, n, words=40):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 90))) for _ in range(14)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(0, words)))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "xyz " * 200), (n + 3, rows[3][1]), (n + 4, rows[3][1])]
    return rows


def check(spark, rows, **settings):
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, runs string")
    got = {r.doc_id: (sum(x.end - x.start for x in r.runs), hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(docs, **settings).collect()}
    want = brute(rows, settings["length"])
    assert got == want
    return sum(v[0] > 0 for v in want.values())


def test_against_brute_force(spark):
    assert check(spark, corpus(1, 120), length=60, k=20, shard_bytes=2000) > 20


def test_many_spans_of_one_gram(spark):
    assert check(spark, corpus(2, 120), length=60, k=20, most_spans=2) > 20


def test_halves_hold_every_string_once():
    rng = random.Random(7)
    for _ in range(300):
        length = rng.randint(8, 40)
        k = rng.randint(1, length - 1)
        raw = bytes(rng.randrange(97, 100) for _ in range(rng.randint(length, 2 * length - k)))
        last = len(raw) - length
        at = rng.randint(last, length - k)
        todo, ended = [(0, raw, at, k)], []
        while todo:
            lo, piece, place, size = todo.pop()
            for _, start, part, there, more in repeats.halves(piece, place, size, length):
                assert size < more <= length and 0 <= there and there + more <= length and part == raw[lo + start : lo + start + len(part)]
                assert there >= len(part) - length  # every string of the part holds the bytes in common
                (todo if more < length else ended).append((lo + start, part, there, more))
        assert sorted(lo for lo, *_ in ended) == list(range(last + 1)) and all(len(part) == length for _, part, *_ in ended)


def test_edited_copies_crowd_a_gram(spark):
    """One passage in many texts, each with a letter of its own somewhere: groups stay crowded over
    several rounds of splitting, down to strings that are equal."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = []
    for i in range(90):
        at = rng.randrange(len(passage))
        rows.append((i, f"{i} " + passage[:at] + rng.choice("xyz") + passage[at + 1 :] + f" {i}"))
    assert check(spark, rows, length=60, k=20, most_spans=3, shard_bytes=2000) > 60


def test_documents_at_400_bytes(spark, sf):
    """Whole contract columns against brute force, with texts that share a key or have none."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = "".join(chr(97 + i * i % 26) + " " * (i % 7 == 0) for i in range(420))
    rows += [(None, f"é {passage} one"), (None, f"{passage}"), (5, f"two {passage}"), (5, passage[:399]), (-1, "q" * 401)]
    count = Counter(raw[i : i + 400] for _, t in rows for raw in [(t or "").encode()] for i in range(len(raw) - 399))
    want = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if count[raw[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want.append((k, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [(r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.runs), len(r.runs), hashlib.sha256(r.kept).hexdigest()) for r in got]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(found, key=order) == sorted(want, key=order) and sum(w[2] > 0 for w in want) > 100
    assert all(r.kept_text == r.kept.decode("utf-8", "ignore") for r in got if r.kept_text is not None)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def passages_by_brute_force(rows, words):
    where, texts = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for row, found in zip(rows, texts):
        for p in range(len(found) - words + 1):
            where.setdefault(tuple(found[p : p + words]), set()).add(row)
    out = []
    for (key, text), found in zip(rows, texts):
        hit = np.zeros(len(found), bool)
        for p in range(len(found) - words + 1):
            if len(where[tuple(found[p : p + words])]) > 1:
                hit[p : p + words] = True
        edges = np.flatnonzero(np.diff(hit.astype(int), prepend=0, append=0)).tolist()
        out.append((str(key), text or "", list(zip(edges[::2], edges[1::2]))))
    return sorted(out)


def test_passages_of_words(spark):
    """Passages that another document has too, short of the bytes that are removed: with other
    blanks, several times in a text, in texts that share a key, with words of over 128 bytes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    parts = [[word() for _ in range(rng.randint(5, 40))] for _ in range(9)]
    parts[0][3] = "long" * 60
    rows = []
    for i in range(150):
        found = [w for _ in range(rng.randint(0, 7)) for w in (rng.choice(parts) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 20))])]
        rows.append((i % 140 if i % 9 else None, rng.choice([" ", "\n", " \t"]).join(found)))
    own = " ".join(f"w{i % 30}" for i in range(90))
    rows += [(200, None), (201, ""), (202, own), (203, f"{own} {rows[5][1]} x {rows[5][1]}"), (204, rows[5][1]), (205, "z " * 99), (206, "y " * 99), (206, "y " * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = passages_by_brute_force(rows, 16)
    assert sum(bool(w[2]) for w in want) > 60
    for settings in ({}, {"most_spans": 2, "shard_bytes": 2000}):
        got = repeats.without_repeats(docs, length=400, words=16, k_words=5, **settings).select("doc_id", "passages").collect()
        assert sorted((str(r.doc_id), sorted((x.start, x.end) for x in r.passages)) for r in got) == sorted((k, p) for k, _, p in want)


def test_planted_passage_of_55_words(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"one {passage} two"), (2, f"three\n{passage}"), (3, passage[:150]), (4, f"{'x ' * 80}"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_passage_words) for r in queries.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 55), 2: (0, 55), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
