"""Answers that were wrong once."""

import re

import numpy as np
import pytest

from lectern.llm import common, decontaminate, id_codec, licenses, mixing_lm, pseudonyms, repeats, setjoin, token_files


def swapped_words(n=1024):
    """A word in the order of Thue and Morse, and the same with its letters swapped."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_long_words_are_told_apart(spark):
    one, other = swapped_words()
    data = np.frombuffer((one + other).encode(), np.uint8)
    first, second = common.ByteHash(data).ranges(np.array([0, 1024]), np.array([1024, 2048]))
    assert first == second  # what sums alone can't do
    docs = spark.createDataFrame([(1, f"{one} x y"), (2, f"{other} x y")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setjoin.link_components(docs, link=setjoin.Link(3, 90)).collect()}
    assert got == {1: 1, 2: 2}


def test_a_long_word_that_was_never_read_is_unknown(spark):
    one, other = swapped_words()
    docs = spark.createDataFrame([(1, f"{one} word"), (2, f"{other} word")], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.n_known for r in mixing_lm.score(docs, held_out=F.col("doc_id") == 2).collect()}
    assert got == {1: 3, 2: 2}


@pytest.mark.parametrize(
    "text,label",
    [
        ("Mozilla Public\nLicense, version 2.0", "mpl-2.0"),
        ("Boost Software\nLicense", "boost-1.0"),
        ("GNU Lesser General Public\n * License version 2.1", "lgpl-2.1"),
        ("Creative  Commons Attribution 4.0", "cc-by-4.0"),
        ("# under the terms of the Eclipse Public\n# License 2.0", "epl-2.0"),
        ("Apache 2.0", "apache-2.0"),
        ("see the GPL.", "gpl"),
        ("// Permission is hereby granted, free\n// of charge, to any person obtaining a\n// copy", "mit"),
    ],
)
def test_wrapped_license_names(spark, text, label):
    docs = spark.createDataFrame([(1, text), (2, text.replace("\n", "\r\n;; "))], "doc_id long, text string")
    assert all(label in r.labels for r in licenses.scan(docs).collect())


def test_gaps_need_white_space(spark):
    docs = spark.createDataFrame([(1, "mozilla/public*license"), (2, "mozilla. public license"), (3, "general and public domain")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).collect()] == [[], [], []]
    assert licenses.spaced(r"a b[ -]c\s+d") == rf"a{licenses.GAP}b[ -]c{licenses.GAP}d" and re.compile(licenses.GAP)


def test_phones_of_one_digit_groups_and_dots(spark):
    forms = ["+358 9 1234567", "+3589 1234567", "+358-9-123-4567", "+1.017.555.7713", "1-017-555-7713", "+33 1 23 45 67 89"]
    docs = spark.createDataFrame([(k, f"call {t} now") for k, t in enumerate(forms)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, secret="k").collect()}
    digits = {k: re.sub(r"\D", "", t) for k, t in got.items()}
    assert all(forms[k] not in t for k, t in got.items())
    assert digits[0] == digits[1] == digits[2] and digits[3] == digits[4] and all(len(digits[k]) == len(re.sub(r"\D", "", t)) for k, t in enumerate(forms))
    assert all(re.sub(r"\d", "0", got[k]) == re.sub(r"\d", "0", f"call {t} now") for k, t in enumerate(forms))


def test_ids_of_large_vocabularies():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 1 << 20, 3000), np.array([200_000]), np.array([(1 << 20) - 1, 0, 0, 131_072] * 700), np.zeros(5, np.int64)):
        assert (id_codec.decode(id_codec.encode(ids)) == ids).all()
    for bad in (1 << 20, -1):
        with pytest.raises(ValueError):
            id_codec.encode(np.array([1, bad]))


def test_files_with_hot_keys_and_changed_counts(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"text {i % 40:02d}") for i in range(90)] + [(7, "x" * 64 + str(i % 5)) for i in range(30)] + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = token_files.write_files(docs)
    got = sorted(token_files.read_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    named = sorted(((k is not None, k or 0, t or "") for k, t in rows))
    ids = token_files.Pieces(token_files.public_tokenizers.path(token_files.TOKENIZER)).whole([t for _, _, t in named])
    assert [r.key for r in got] == [k if known else None for known, k, _ in named]
    assert [list(r.ids) for r in got] == [[*i, 2] for i in ids]
    wrong = path + "-wrong"
    spark.read.parquet(path).withColumn("keys", F.transform("keys", lambda k: F.coalesce(k, F.lit(0)))).write.parquet(wrong)
    with pytest.raises(Exception, match="do not match their checksum"):
        token_files.read_files(spark, wrong).collect()


def test_jobs_delete_their_tables(spark):
    """Only what the results are read from stays."""
    from pathlib import Path

    docs = spark.createDataFrame([(i, f"{' '.join(f'w{k}' for k in range(60))} end {i % 3}") for i in range(9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)))], "item_id long, text string")
    shared = Path(common.shared_dir(spark).removeprefix("file:"))
    before = {p.name.split("-")[0] for p in shared.iterdir()}
    made = [setjoin.link_components(docs), repeats.without_repeats(docs, length=40, k=10), decontaminate.find_leaks(docs, items)]
    assert [d.count() for d in made] == [9, 9, 9]
    assert not {"jaccard", "repeats", "leaks"} & ({p.name.split("-")[0] for p in shared.iterdir()} - before)
