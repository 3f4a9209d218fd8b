"""Operators on small literal inputs."""

import json
import random
from datetime import datetime, timedelta

import hashlib

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answer_cache, chat, corpus, evaluation, retrieval, style, support, transcripts
from lectern.sources import files
from lectern.streaming import live


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


def test_repair(spark):
    for found, want in [("VFLHQFH\x03¿FWLRQ", "science fiction"), ("3RVW\x032൶FH", "Post Office"), ("EX൵DOR", "EX൵DOR"), ("5HDG\x03 WKH", "Read  the"), ("BIRTH-day", "BIRTH-day"), ("a\tb\n", "a\tb\n")]:
        assert one(spark, T.repair_span, found) == want
    assert one(spark, T.common_word_share, "") == 0.0


def test_furniture_and_stages(spark):
    strip = lambda t, title: one(spark, T.strip_furniture, t, title)
    assert strip("2026\nSome lesson text here.\n2\nUnit\n1\nAt the Library\nEnglish for Today", "At the Library") == "Some lesson text here."
    assert strip("2026\na\nb\nc\nEnglish for Today\nWriting a Story\n110\nUnit\n20", "Writing a Story") == "a\nb\nc"
    assert one(spark, T.split_stages, "1.1 Look\nmore\n1.1.1 sub\n2.1 Next\nx") == ["1.1 Look\nmore\n1.1.1 sub", "2.1 Next\nx"]
    assert one(spark, T.split_stages, "intro\n1.1 Look") == ["intro", "1.1 Look"]
    kinds = spark.createDataFrame([("New Words\nx", 3), ("Read\nnew words", 1), ("Language Focus: x", 4), ("Fill in", 2)], "t string, n int").select(T.stage_type(F.col("t"), F.col("n")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["vocabulary", "passage", "passage", "exercise"]


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(150))
    got = one(spark, lambda c: T.chunk_words(c, 100, 20), words)
    assert len(got) == 2 and got[0].split()[-20:] == got[1].split()[:20] and got[1].split()[-1] == "w149"
    assert one(spark, T.chunk_words, "  \n") == []


def test_book(spark):
    lines = {1: ["Contents", "Unit 1", "At Home", "1", "Unit 2", "At School", "2"], 2: ["1.1 Hello there", "Mum cooks.", "1", "Unit", "1"], 3: ["1.1 School", "We read.", "2", "Unit", "2", "At School"]}
    spans = [("b", p, 0, i, 0, 0, t) for p, rows in lines.items() for i, t in enumerate(rows)] + [("b", 2, 0, 0, 1, 0, "!"), ("b", 2, 9, 0, 0, 1, "image")]
    df = spark.createDataFrame(spans, "book_id string, page_no int, block_no int, line_no int, span_no int, block_type int, text string")
    assert {r.page_no: r.text.split("\n")[0] for r in corpus.assemble_pages(df).collect()} == {1: "Contents", 2: "1.1 Hello there!", 3: "1.1 School"}
    read = corpus.parsed_contents(corpus.page_lines(df)).collect()
    assert [(r.error, [tuple(u) for u in r.units]) for r in read] == [(None, [(1, "At Home", 1, 0), (2, "At School", 2, 1)])]
    build = corpus.build_books(df)
    assert [(r.first_page, r.last_page) for r in build.ranges.orderBy("unit_no").collect()] == [(2, 2), (3, 3)]
    assert build.faults.count() == 0
    got = {(r.lesson_id, r.page, r.type): r.text for r in corpus.build_chunks(df).collect()}
    assert got == {("u1-s1", 2, "passage"): "Unit 1, Lesson 1: At Home\n1.1 Hello there! Mum cooks.", ("u2-s1", 3, "passage"): "Unit 2, Lesson 1: At School\n1.1 School We read."}
    assert [(r.chunk_count, r.status) for r in corpus.book_status(corpus.build_chunks(df), spark.createDataFrame([("b",), ("c",)], "book_id string")).orderBy("book_id").collect()] == [(2, "ready"), (0, "failed")]


def test_sentences(spark):
    assert one(spark, T.sentences, 'He said, "Why?" The answer is x. Yes। না।') == ['He said, "Why?"', "The answer is x.", "Yes।", "না।"]
    for text, want in [("আমি ভাত খাই", True), ("আমি noun বলি", True), ("A noun", False), ("A noun আমি is", False), ("", False)]:
        assert one(spark, T.is_bangla, text) is want
    for text in ("Dear students, welcome.", "Hello!", "I hope you are all doing well.", "Now, let's begin our lesson.", "This is Unit 3, Lesson 2.", "Look on page 12.", "I'll repeat that.", "Do you understand?", "Does that make sense?", "Can anyone tell me?", "Great job, all.", 'You asked, "What is it?"'):
        assert one(spark, T.is_scaffolding, text), text
    for text in ("The capital city of Indonesia is Jakarta.", "A noun is a naming word.", "They repeat the song."):
        assert not one(spark, T.is_scaffolding, text), text
    assert one(spark, T.max_sentence_words, "A noun is a naming word. It names a person, place, or thing.") == 7
    assert one(spark, T.mean_sentence_words, "A noun is a naming word. It names a person, place, or thing.") == 6.5
    assert one(spark, T.max_sentence_words, "") == 0 and one(spark, T.mean_sentence_words, "") == 0.0
    assert one(spark, T.reading_grade, "A short answer.") is None


def test_retrieval(spark):
    rows = spark.createDataFrame([("q", "b", "c", 0.9), ("q", "b", "a", 0.9), ("q", "b", "b", 0.1), ("r", "b", "2", 0.5), ("r", "b", "10", 0.5)], "query_id string, book_id string, chunk_id string, dense double")
    sparse = spark.createDataFrame([("q", "b", "b", 5.0)], "query_id string, book_id string, chunk_id string, sparse double")
    got = {(r.query_id, r.chunk_id): (r.dense_rank, r.sparse_rank) for r in retrieval.fuse(rows, sparse).collect()}
    assert got == {("q", "a"): (1, 2), ("q", "c"): (2, 3), ("q", "b"): (3, 1), ("r", "10"): (1, 1), ("r", "2"): (2, 2)}
    weights = spark.createDataFrame([("q", "b", "t1", 0.5), ("q", "b", "t2", 0.3)], "query_id string, book_id string, token string, weight double")
    chunk = spark.createDataFrame([("b", "c", "t1", 0.4), ("b", "c", "t3", 0.9)], "book_id string, chunk_id string, token string, weight double")
    assert retrieval.sparse_scores(weights, chunk).first().sparse == 0.2
    best = spark.createDataFrame([("x", 0.2), ("y", 0.35), ("z", 0.5)], "query_id string, dense double")
    asked = spark.createDataFrame([(k,) for k in "wxyz"], "query_id string")
    assert [r.refused for r in retrieval.gate(asked, best).orderBy("query_id").collect()] == [True, True, False, False]
    places = spark.createDataFrame([("b", "k2", "u1-s1", 1, 1, "T", 3, "two"), ("b", "k1", "u1-s1", 1, 1, "T", 2, "one"), ("b", "k3", "u2-s1", 2, 1, "U", 9, "no")], "book_id string, chunk_id string, lesson_id string, unit int, lesson_no int, lesson_title string, page int, text string")
    hits = spark.createDataFrame([("q", "b", "k2", 1, 0.9, 0.0, 0.03)], "query_id string, book_id string, chunk_id string, rank int, dense double, sparse double, rrf double")
    parents = retrieval.parent_lessons(hits, places)
    assert [r.chunk_id for r in parents.orderBy("position").collect()] == ["k1", "k2"]
    assert retrieval.context(parents).first().context == "[1] one\n\n[2] two"
    assert retrieval.sources(hits, places).select(retrieval.citation(F.col("sources")).alias("c")).first().c == "Unit 1, Lesson 1, page 3"


def test_dense_blocks_equal_columns(spark, sf):
    from lectern.operators import fusion
    from lectern.plans.queries import _vectors

    q, c = _vectors(spark, sf)
    a = {(r.query_id, r.chunk_id): r.dense for r in retrieval.dense_scores(q, c).collect()}
    asked, chunks = q.collect(), c.collect()
    dense, _ = fusion.Asked([(k, r.embedding, None) for k, r in enumerate(asked)]).scores([r.embedding for r in chunks], [None] * len(chunks))
    b = {(x.query_id, y.chunk_id): dense[i, j] for i, x in enumerate(asked) for j, y in enumerate(chunks)}
    assert a.keys() == b.keys() and sum(a[k] != b[k] for k in a) < 0.001 * len(a)


def test_chat(spark):
    turns = spark.createDataFrame([("s", 1, "user", "What is a noun?"), ("s", 2, "assistant", "A naming word."), ("s", 3, "system", "x"), ("s", 4, "user", "Why?")], "session_id string, ordinal int, role string, content string")
    got = chat.turns_with_history(turns).select("is_first_turn", chat.written_history(F.col("history")).alias("h"), chat.needs_rewrite(F.col("content"), F.size("history") > 0).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, "", False), (False, "Student: What is a noun?\nTeacher: A naming word.", True)]
    for text, want in [("What is the main idea of chapter three?", False), ("Can you explain it again with care please?", True), ("and what happens in the story later on?", True), ("tell me more about the long river story", True)]:
        assert one(spark, lambda c: chat.needs_rewrite(c, F.lit(True)), text) is want
    assert one(spark, chat.fallback_title, "one two three four five six seven") == "one two three four five six…" and one(spark, chat.fallback_title, " ") == "New conversation"
    assert one(spark, lambda a, b: chat.fill("{a}-{b}", {"a": a, "b": b}), "{b}", "x") == "{b}-x"
    assert one(spark, lambda s, c: chat.shown_text(s, c), "refused_unverified", "t") == chat.HIDDEN


def test_style(spark):
    vocab = spark.createDataFrame([("b", w) for w in ("a", "noun", "is")], "book_id string, word string")
    answers = spark.createDataFrame([("m", "b", "A noun is a zephyr, a quixotic zephyr."), ("e", "b", "")], "message_id string, book_id string, answer string")
    got = {r.message_id: r for r in style.coverage(answers, vocab).collect()}
    assert got["m"].unknown == ["zephyr", "quixotic"] and got["e"].coverage == 1.0 and got["e"].unknown == []
    fence = "```json\n{\"suitable\": false, \"reason\": \"too hard\"}\n```"
    assert one(spark, lambda c: T.parsed_verdict(c, style.VERDICT), fence).suitable is False
    verdicts = spark.createDataFrame([("e", fence)], "message_id string, text string")
    reports = {r.message_id: (r.judge_ran, r.passed) for r in style.style_reports(answers, vocab, verdicts).collect()}
    assert reports == {"m": (False, False), "e": (True, False)}
    guide = "intro\n## 1. A\nx\n---\n## 6. Grades\n| Grade | Words | Tone |\n|---|---|---|\n| 5 | 14 | |\n"
    assert one(spark, style.guide_sections, guide)[1] == "## 1. A\nx"
    assert one(spark, lambda c: style.grade_profile(style.guide_sections(c)[6], 5), guide) == "Words: 14"


def test_support(spark):
    answers = spark.createDataFrame([("m", "Dear students, hello. Cats drink milk. Dogs fly."), ("n", "Do you understand?"), ("o", "Cats drink milk.")], "message_id string, answer string")
    contexts = spark.createDataFrame([("m", 1, "u1-s1", "Unit 1\nCats drink milk. Birds sing."), ("n", 1, "u1-s1", "x\nA b.")], "message_id string, position int, lesson_id string, text string")
    sentences = support.hypotheses(answers)
    rows = support.verdicts(sentences, support.score_pairs(support.pairs(sentences, support.premises(contexts))))
    got = {(r.message_id, r.sentence): (r.supported, r.best_lesson_id) for r in rows.collect()}
    assert got == {("m", "Cats drink milk."): (True, "u1-s1"), ("m", "Dogs fly."): (False, "u1-s1"), ("o", "Cats drink milk."): (False, None)}
    out = {r.message_id: (r.ratio, r.passed, r.unsupported) for r in support.reports(answers, rows).collect()}
    assert out == {"m": (0.5, True, ["Dogs fly."]), "n": (1.0, True, []), "o": (0.0, False, ["Cats drink milk."])}
    assert one(spark, support.is_self_refusal, "The passages provided do not contain any information about X.")
    assert not one(spark, support.is_self_refusal, "A fact.")


def routed(config, best, stage1, tries, style_max=2, verify_max=1):
    if config == "A":
        return "answered", 0, 0
    if best < 0.35 or "do not contain" in stage1:
        return "refused_off_book", 0, 0
    if config == "B":
        return "answered", 0, 0
    s = v = 0
    for ok, supported in tries:
        s += 1
        if not ok and s <= style_max:
            continue
        if config == "C":
            return "answered", s, v
        v += 1
        if supported:
            return "answered", s, v
        if v > verify_max:
            return "refused_unverified", s, v
    return None, s, v


def test_route(spark, sf):
    from lectern.plans.queries import route_inputs

    questions, attempts = route_inputs(spark, sf)
    tries = {}
    for r in attempts.orderBy("question_id", "attempt", "style_passed", "verify_passed").collect():
        tries.setdefault(r.question_id, []).append((r.style_passed, r.verify_passed))
    got = {r.question_id: (r.status, r.style_attempts, r.verify_attempts) for r in support.route(questions, attempts).collect()}
    want = {q.question_id: routed(q.config, q.best_score, q.stage1_answer, tries.get(q.question_id, [])) for q in questions.collect()}
    assert got == want and {"refused_unverified", "answered", "refused_off_book"} <= {w[0] for w in want.values()}


def test_metrics(spark):
    schema = "run_id string, config string, split string, id string, answer string, status string, retrieved array<string>, expected_lesson_id string, type string, style struct<passed:boolean,max_sentence_words:int,fk_grade:double,vocab_coverage:double>, verification struct<supported_ratio:double>, faithfulness double"

    def row(status, expected=None, kind="factual", ratio=None):
        return ("r", "D", "dev", "1", "An answer.", status, ["u1"], expected, kind, (True, 12, 3.5, 0.9), None if ratio is None else (ratio,), None)

    rows = [row("answered", "u1", ratio=1.0), row("answered", "u2", ratio=0.5), row("answered", ""), row("refused_unverified", kind=None, ratio=0.0), row("refused_off_book", kind="off_book"), row("answered", kind="off_book")]
    m = evaluation.run_metrics(spark.createDataFrame(rows, schema)).first()
    assert (m.hit_rate, m.hit_rate_n, m.refusal_accuracy, m.false_refusal, m.hallucination, m.hallucination_n) == (0.5, 2, 0.5, 0.25, 0.25, 2)
    assert (m.unsupported_any_n, m.severe, m.fk, m.fk_n, m.faithfulness) == (3, 0.0, None, 0, None)
    manifests = spark.createDataFrame([("a", {"k": "5", "t": "1"}), ("b", {"k": "6", "t": "1", "u": "x"})], "run_id string, settings map<string,string>")
    assert {(r.name, r.one, r.other) for r in evaluation.changed_settings(manifests, "a", "b").collect()} == {("k", "5", "6"), ("u", None, "x")}


def test_transcripts(spark):
    rows = spark.createDataFrame([("a", "# head\n\nOne two three. Four five."), ("b", "#x\n#y")], "file string, text string")
    got = transcripts.file_stats(rows).collect()
    assert [(r.file, r.words, r.sentences, r.max_words, r.p95_words, r.median_words) for r in got] == [("a", 5, 2, 3, 2, 2.5)]
    whole = transcripts.combined_stats(rows)
    assert whole.first().punct_per_100w == 40.0 and transcripts.thresholds_table(whole).count() == 5


def test_cache(spark):
    calls = spark.createDataFrame([(1, "v", "m", "p", None, 'say "é"\n', 0.0, None), (2, "v", "m", "p", None, 'say "é"\n', 0.0, None), (3, "v", "m", "p", "s", "x", 0.7, 9)], "ordinal long, prompt_version string, model string, provider string, system string, prompt string, temperature double, max_tokens int")
    keyed = answer_cache.keyed(calls)
    for r in keyed.collect():
        blob = json.dumps({"prompt_version": r.prompt_version, "model": r.model, "provider": r.provider, "system": r.system, "prompt": r.prompt, "temperature": r.temperature, "max_tokens": r.max_tokens}, sort_keys=True, ensure_ascii=False)
        assert r.key == hashlib.sha256(blob.encode()).hexdigest()
    none = spark.createDataFrame([], "key string, text string, prompt_tokens int, completion_tokens int")
    need = answer_cache.to_call(keyed, none)
    made = need.select("key", F.lit("t").alias("text"), F.lit(7).alias("prompt_tokens"), F.lit(3).alias("completion_tokens"))
    out = answer_cache.answered(keyed, none, made)
    assert need.count() == 2 and [r.cached for r in out.orderBy("ordinal").collect()] == [False, True, False]
    assert tuple(evaluation.cache_stats(out).first()) == (3, 1, 2, 20)


def test_lockouts(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("k", t0 + timedelta(seconds=i), "failure") for i in range(5)] + [("k", t0 + timedelta(seconds=10), "failure"), ("k", t0 + timedelta(seconds=301), "failure"), ("o", t0 + timedelta(seconds=5), "failure")]
    got = {(r.key, r.ts): r.blocked for r in live.lockouts(spark.createDataFrame(rows, "key string, ts timestamp, outcome string")).collect()}
    assert got["k", t0 + timedelta(seconds=10)] and not got["k", t0 + timedelta(seconds=301)] and not got["o", t0 + timedelta(seconds=5)] and sum(got.values()) == 1


def test_lockouts_in_runs_equal_one_fold(spark):
    """Pauses about as long as the window, ties, a missing key and one key with most rows."""
    rng = random.Random(3)
    t0 = datetime(2026, 1, 1)
    rows = []
    for key, n in (("hot", 400), (None, 60), ("a", 60)):
        at = 0
        for _ in range(n):
            at += rng.choice([0, 1, 20, 100, 299, 300, 301])
            rows.append((key, t0 + timedelta(seconds=at), rng.choice(["failure"] * 6 + ["success"])))
    want = []
    for key in ("hot", None, "a"):
        mine = sorted((r[1:] for r in rows if r[0] == key))
        decided, _ = live.fold([(t.timestamp(), o) for t, o in mine], [], 5, 300)
        want += [(key, *m, *d) for m, d in zip(mine, decided)]
    got = live.lockouts(spark.createDataFrame([*rows, ("a", None, "failure")], "key string, ts timestamp, outcome string"), 5, 300).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(w[3] for w in want)


def test_streams(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [("k", t0 + timedelta(seconds=i), "failure") for i in range(6)] + [("k", t0 + timedelta(days=1), "failure")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, outcome string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = live.lockouts_stream(stream).writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("select count_if(blocked) from locks").first()[0] == 1
    named = stream.select(F.col("ts").alias("created_at"), F.col("outcome").alias("status"))
    run = live.status_by_window(named).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    run.processAllAvailable()
    run.stop()
    batch = {(r.start, r.n) for r in evaluation.running_status(df.select(F.col("ts").alias("created_at"), F.col("outcome").alias("status")), "1 hour").collect()}
    closed = {(r.start, r.n) for r in spark.table("windows").collect()}
    assert closed and closed <= batch


def test_files(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text('{"prompt_versions": {"a": "1"}, "run": "x"}\n\n  \n{"id": "1", "status": "answered"}\n', encoding="utf-8")
    manifests, records = files.read_run_log(spark, str(tmp_path / "run.jsonl"), "run string", "id string, status string")
    assert [r.run for r in manifests.collect()] == ["x"] and [r.id for r in records.collect()] == ["1"]
    assert files.read_jsonl(spark, str(tmp_path / "run.jsonl"), "id string").count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t/one.txt").write_text("# a\n# b\n\nBody here.\n", encoding="utf-8")
    (tmp_path / "t/two.MP3").write_bytes(b"x" * 1000)
    assert [tuple(r) for r in files.read_transcripts(spark, str(tmp_path / "t/one.txt")).collect()] == [("one", "Body here.")]
    assert [r.megabytes for r in files.media_files(spark, str(tmp_path / "t")).collect()] == [0.001]
