import re

import pytest

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import corpus

SCHEMA = "book_id string, page_no int, block_no int, line_no int, span_no int, block_type int, text string"


def book(name, pages):
    return [(name, p, 0, i, 0, 0, line) for p, lines in pages.items() for i, line in enumerate(lines)]


def built(spark, *books):
    return corpus.build_books(spark.createDataFrame([row for b in books for row in b], SCHEMA))


SOUND = {1: ["Contents", "Unit 1", "One", "1", "Unit 2", "Two", "2"], 2: ["alpha", "1", "Unit", "1"], 3: ["beta", "2", "Unit", "2"]}


def with_page(n, lines):
    return {**SOUND, n: lines}


FAULTS = {
    "no_contents": (with_page(1, ["Foreword"]), "contents: no page"),
    "no_units": (with_page(1, ["Contents", "Chapter 1", "One", "1"]), "contents: no unit"),
    "no_title": (with_page(1, ["Contents", "Unit 1", "One", "1", "Unit 2"]), "contents: no title of unit 2"),
    "no_number": (with_page(1, ["Contents", "Unit 1", "One", "1", "Unit 2", "Two"]), "contents: no page of unit 2"),
    "no_footer": (with_page(2, ["alpha"]), "offset: no footer of unit 1, printed page 1"),
    "other_unit": (with_page(3, ["beta", "2", "Unit", "9"]), "footer: page 3 of unit 2 names unit 9"),
    "no_text": ({1: SOUND[1], 2: ["1", "Unit", "1"], 3: ["2", "Unit", "2"]}, "no text in any unit"),
    # a unit without a number takes the next one's, which then vanishes: its pages tell
    "swallowed": ({1: ["Contents", "Unit 1", "One", "1", "Unit 2", "Two", "Unit 3", "Three", "3"], 2: SOUND[2], 3: SOUND[3], 4: ["gamma", "3", "Unit", "3"]}, "footer: page 3 of unit 1 names unit 2"),
}


def test_faulty_books_are_told_apart(spark):
    build = built(spark, book("sound", SOUND), *(book(name, pages) for name, (pages, _) in FAULTS.items()), [("empty", 1, 0, 0, 0, 1, "picture")])
    assert {r.book_id: r.reason for r in build.faults.collect()} == {name: reason for name, (_, reason) in FAULTS.items()} | {"empty": "contents: no page"}
    assert sorted((r.chunk_id, r.text) for r in build.chunks.collect()) == [("sound/1/1/0", "Unit 1, Lesson 1: One\nalpha"), ("sound/2/1/0", "Unit 2, Lesson 1: Two\nbeta")]


def test_no_spans(spark):
    build = built(spark)
    assert build.faults.count() == build.chunks.count() == build.ranges.count() == 0


def test_furniture_stages_and_windows(spark):
    """Line-wise stages and windows equal those of the whole unit text."""
    words = " ".join(f"w{k}" for k in range(1300))
    pages = {
        1: ["Contents", "Unit 7", "One", "11"],
        2: ["2026", "English for Today", "before", "", "One", "11", "Unit", "7"],
        3: ["12", "Unit", "7", "  1.1 New words here", words, "1.2.3 not one", "3 x"],
        4: ["2.10\tgo", "1.5", "Unit", "7", "2.2"],
        5: ["13", "Unit", "7", "Unit", "x", "Language Focus", "3.1  Language focus", "tail 9", "9", "Unit", "7"],
    }
    build = built(spark, book("b", pages))
    got = sorted((r.lesson_no, int(r.chunk_id.split("/")[-1]), r.type, r.page, r.text.split("\n", 1)[1]) for r in build.chunks.collect())
    assert build.faults.count() == 0
    text = "\n".join(["before", "  1.1 New words here", words, "1.2.3 not one", "3 x", "2.10\tgo", "1.5", "2.2", "Unit", "x", "Language Focus", "3.1  Language focus", "tail 9"])
    stages = [s.strip() for s in re.split(r"(?m)^(?=\s*\d+\.\d+(?!\.\d)\s)", text) if s.strip()]
    unit = spark.createDataFrame([("b", 7, "One", 2, text)], "book_id string, unit_no int, title string, first_page int, text string")
    whole = sorted((r.lesson_no, int(r.chunk_id.split("/")[-1]), r.type, r.page, r.text.split("\n", 1)[1]) for r in corpus.chunks(corpus.stages(unit)).collect())
    assert got == whole and max(r[0] for r in got) == len(stages) == 6 and [r[2] for r in got] == ["passage", "vocabulary", "vocabulary", "vocabulary", "exercise", "exercise", "exercise", "passage"]


@pytest.mark.parametrize("n", [1, 599, 600, 601, 1149, 1150, 1151, 1700, 1701])
def test_windows_of_every_size(spark, n):
    lines = [" ".join(f"w{k}" for k in range(a, min(n, a + 37))) for a in range(0, n, 37)]
    build = built(spark, book("b", {1: ["Contents", "Unit 1", "One", "1"], 2: [*lines, "1", "Unit", "1"]}))
    got = sorted((int(r.chunk_id.split("/")[-1]), r.text.split("\n", 1)[1]) for r in build.chunks.collect())
    words = spark.createDataFrame([(" ".join(lines),)], "text string").select(T.chunk_words(F.col("text")).alias("c")).first().c
    assert got == list(enumerate(words))


def test_a_page_in_two_units(spark):
    """Contents out of order give overlapping units, which their footers betray."""
    pages = {1: ["Contents", "Unit 1", "One", "1", "Unit 2", "Two", "4", "Unit 3", "Three", "2"], 2: ["a", "1", "Unit", "1"], 3: ["b"], 4: ["c"], 5: ["d"]}
    build = built(spark, book("b", pages))
    got = {(r.unit_no, r.first_page, r.last_page) for r in build.ranges.collect()}
    assert got == {(1, 2, 4), (2, 5, 2), (3, 3, 5)} and {r.text.split("\n")[1] for r in build.chunks.collect()} == {"a b c", "b c d"}
