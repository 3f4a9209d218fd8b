import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chat, evaluation, retrieval, style
from lectern.sources import files


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"suitable": true, "reason": "ok"}', (True, "ok", None)),
        ('```json\n{"suitable": false}\n```', (False, None, None)),
        ('  ```{"suitable": true, "reason": null}```', (True, None, None)),
        ("suitable: yes", (None, None, "suitable: yes")),
        ('```JSON\nno\n```', (None, None, "no")),
        ('{"reason": "x"}', (None, "x", '{"reason": "x"}')),
        ('{"suitable": "perhaps"}', (None, None, '{"suitable": "perhaps"}')),
        ("[true]", (None, None, "[true]")),
        ("", (None, None, "")),
        (None, (None, None, None)),
    ],
)
def test_verdicts(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(T.read_verdict(F.col("t")).alias("v")).first().v) == want


def test_a_verdict_that_cannot_be_read_does_not_pass(spark):
    answers = spark.createDataFrame([(k, "b", "We go home.") for k in range(4)] + [(9, "b", "word " * 30)], "message_id int, book_id string, answer string")
    vocab = spark.createDataFrame([("b", w) for w in ("we", "go", "home", "word")], "book_id string, word string")
    verdicts = spark.createDataFrame([(0, '{"suitable": true}'), (1, '{"suitable": false, "reason": "no"}'), (2, "?"), (9, '{"suitable": true}')], "message_id int, text string")
    got = {r.message_id: (r.judge_ran, r.judge_suitable, r.judge_reason, r.unparsed, r.passed) for r in style.style_reports(answers, vocab, verdicts).collect()}
    assert got == {0: (True, True, None, None, True), 1: (True, False, "no", None, False), 2: (True, None, None, "?", False), 3: (False, None, None, None, True), 9: (False, None, None, None, False)}


def test_nested_settings(spark):
    rows = [("a", '{"k": 5, "t": {"gate": 0.35, "list": [1, {"x": null}], "empty": {}, "none": []}, "a.b": "c"}'), ("b", '{"k": 5, "t": {"gate": 0.4, "list": [1, {"x": 2}, 3], "empty": {"y": 1}, "none": []}, "new": null}'), ("c", "7")]
    manifests = spark.createDataFrame(rows, "run_id string, settings string")
    flat = {(r.run_id, r.path): r.value for r in evaluation.flat_settings(manifests).collect()}
    assert {p: v for (run, p), v in flat.items() if run == "a"} == {"$.k": "5", "$.t.gate": "0.35", "$.t.list[0]": "1", "$.t.list[1].x": "null", "$.t.empty": "{}", "$.t.none": "[]", "$.a.b": '"c"'}
    assert flat["c", "$"] == "7"
    got = {r.name: (r.one, r.other) for r in evaluation.changed_settings(manifests, "a", "b").collect()}
    assert got == {"$.t.gate": ("0.35", "0.4"), "$.t.list[1].x": ("null", "2"), "$.t.list[2]": (None, "3"), "$.t.empty": ("{}", None), "$.t.empty.y": (None, "1"), "$.a.b": ('"c"', None), "$.new": (None, "null")}
    maps = spark.createDataFrame([("a", {"x": "1", "y": None}), ("b", {"x": "2", "y": None})], "run_id string, settings map<string,string>")
    assert [tuple(r) for r in evaluation.changed_settings(maps, "a", "b").collect()] == [("x", "1", "2")]


def test_nothing_to_ask_is_an_error(spark):
    questions = spark.createDataFrame([("dev", 2, "b"), ("dev", 1, "a"), ("test", 3, "c")], "split string, ordinal int, id string")
    assert [r.id for r in evaluation.take_questions(questions, "dev", 1).collect()] == ["a"]
    with pytest.raises(ValueError, match="nowhere"):
        evaluation.take_questions(questions, "nowhere")
    samples = spark.createDataFrame([(5, "x", "synthetic"), (6, "y", "real")], "grade int, teacher_answer string, provenance string")
    assert [r.teacher_answer for r in style.load_fewshot(samples, 5).collect()] == ["x"]
    assert [r.teacher_answer for r in style.load_fewshot(samples, 5, evaluating=True).collect()] == ["y"]
    with pytest.raises(ValueError):
        style.load_fewshot(samples.filter("grade = 5"), 5, evaluating=True)


def test_context_in_parts_is_the_whole_context(spark):
    rows = [("q", k, "é" * (k * 7 % 40)) for k in range(1, 60)] + [("r", 1, None), ("s", 1, "x" * 500), ("s", 2, "y")]
    parents = spark.createDataFrame(rows, "query_id string, position int, text string")
    parts = retrieval.context_parts(parents, 200).orderBy("query_id", "part").collect()
    whole = {q: "\n\n".join(f"[{p}] {t or ''}" for i, p, t in rows if i == q) for q in "qrs"}
    assert {q: "\n\n".join(r.context for r in parts if r.query_id == q) for q in "qrs"} == whole
    assert all(r.bytes == len(r.context.encode()) for r in parts) and max(r.bytes for r in parts if r.query_id == "q") < 300
    assert [(r.part, r.chunks) for r in parts if r.query_id == "s"] == [(0, 1), (2, 1)]


def test_places_in_sessions(spark):
    rows = [("s", 1, "assistant", 5), ("s", 2, "user", 5), ("s", 3, "user", 4), ("t", 1, "user", 9)]
    got = chat.ordered_messages(spark.createDataFrame(rows, "session_id string, ordinal int, role string, created_at int")).collect()
    assert {(r.session_id, r.ordinal): r.place for r in got} == {("s", 3): 1, ("s", 2): 2, ("s", 1): 3, ("t", 1): 1}


def test_media_total(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, n in (("a.MP4", 1500), ("deep/b.wav", 500), ("c.txt", 9)):
        (tmp_path / name).write_bytes(b"x" * n)
    listed = files.media_files(spark, str(tmp_path))
    assert [r.length for r in listed.collect()] == [1500, 500]
    assert tuple(files.media_total(listed).first()) == (2, 0.002)
    assert tuple(files.media_total(listed.limit(0)).first()) == (0, 0.0)


def test_contexts_of_lessons_are_those_of_their_rows(spark):
    """Lessons that begin inside parts, lie across blocks, interleave by page, or are empty."""
    rows = [("b", c, f"l{c % 3 if c < 200 else 3 + c % 2}", c % 3 if c < 200 else 7, 1, c % 11, None if c % 17 == 0 else "é" * (c * 7 % 60) + "x" * (c == 50) * 900) for c in range(300)] + [("z", 1, "l0", 1, 1, 1, "other")]
    chunks = spark.createDataFrame(rows, "book_id string, chunk_id int, lesson_id string, unit int, lesson_no int, page int, text string").repartition(3)
    hits = spark.createDataFrame([(1, "b", 0), (1, "b", 3), (1, "b", 1), (2, "b", 4), (2, "b", 6), (3, "b", 200), (3, "b", 201), (3, "b", 2), (4, "z", 1), (5, "b", 999)], "query_id int, book_id string, chunk_id int")
    want = sorted(map(tuple, retrieval.context_parts(retrieval.parent_lessons(hits, chunks), 150).collect()))
    lessons = retrieval.lessons_of(hits, chunks)
    got = retrieval.lesson_context_parts(lessons, chunks, 150).select("query_id", "part", "chunks", "bytes", "context")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert {(r.query_id, r.same_as) for r in retrieval.same_lessons(lessons).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
