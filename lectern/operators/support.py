"""Support of answers by their sources, sentence by sentence, and the status that follows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions import text as T

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def premises(contexts: DataFrame) -> DataFrame:
    """message_id, place, lesson_id, premise from contexts(message_id, position, lesson_id,
    text): sentences of the chunks, headers dropped, in order."""
    rows = contexts.select("message_id", "position", "lesson_id", F.posexplode(T.sentences(T.body_of(F.col("text")))).alias("k", "premise"))
    return rows.select("message_id", (F.col("position").cast("long") * 1_000_000 + F.col("k")).alias("place"), "lesson_id", "premise")


def hypotheses(answers: DataFrame, echo: bool = False) -> DataFrame:
    """message_id, number, sentence, scored: answer sentences, and whether they are checked."""
    rows = answers.select("message_id", F.posexplode(T.sentences(F.col("answer"))).alias("number", "sentence"))
    skipped = T.is_scaffolding(F.col("sentence"))
    if echo:
        skipped = skipped | T.is_bangla(F.col("sentence"))
    return rows.withColumn("scored", ~skipped)


def pairs(answer_sentences: DataFrame, premise_rows: DataFrame) -> DataFrame:
    """Each checked sentence with each premise of its own message."""
    return answer_sentences.filter("scored").select("message_id", "number", "sentence").join(premise_rows, "message_id")


def word_overlap(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Share of a hypothesis's words found in the premise.  A stand-in for tests, not a model
    of entailment."""
    out = []
    for p, h in zip(premise.str.lower().str.findall(r"[a-z0-9']+"), hypothesis.str.lower().str.findall(r"[a-z0-9']+")):
        have = set(p)
        out.append(sum(w in have for w in h) / len(h) if h else 0.0)
    return pd.Series(out, dtype="float64")


def score_pairs(pair_rows: DataFrame, scorer: Scorer = word_overlap) -> DataFrame:
    """Pairs with their entailment; each distinct (premise, sentence) is scored once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(entailment=scorer(batch["premise"], batch["sentence"]).astype("float64"))

    scored = pair_rows.select("premise", "sentence").distinct().mapInPandas(run, "premise string, sentence string, entailment double")
    return pair_rows.join(scored, ["premise", "sentence"])


def verdicts(answer_sentences: DataFrame, scored: DataFrame, limits: Settings = SETTINGS) -> DataFrame:
    """message_id, number, sentence, entailment (best), supported, best_lesson_id; the first
    premise wins ties, and a sentence without premises is unsupported with 0."""
    best = scored.groupBy("message_id", "number").agg(F.max(F.struct("entailment", (-F.col("place")).alias("back"), "lesson_id")).alias("b"))
    joined = answer_sentences.filter("scored").join(best, ["message_id", "number"], "left")
    raw = F.coalesce(F.col("b.entailment"), F.lit(0.0))
    return joined.select("message_id", "number", "sentence", F.round(raw, 4).alias("entailment"), (F.col("b").isNotNull() & (raw >= limits.entailed_from)).alias("supported"), F.col("b.lesson_id").alias("best_lesson_id"))


def reports(answers: DataFrame, sentence_verdicts: DataFrame, limits: Settings = SETTINGS) -> DataFrame:
    """message_id, supported, total, ratio (1 with nothing to check), passed, unsupported."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("supported"), F.struct("number", "sentence"))))
    counts = sentence_verdicts.groupBy("message_id").agg(F.count_if("supported").alias("supported"), F.count("*").alias("total"), bad.alias("bad"))
    joined = answers.select("message_id").join(counts, "message_id", "left")
    ratio = F.coalesce(F.col("supported") / F.col("total"), F.lit(1.0))
    empty = F.array().cast("array<string>")
    return joined.select("message_id", F.coalesce("supported", F.lit(0)).alias("supported"), F.coalesce("total", F.lit(0)).alias("total"), ratio.alias("ratio"), (ratio >= limits.supported_from).alias("passed"), F.coalesce(F.transform("bad", lambda x: x.sentence), empty).alias("unsupported"))


def is_self_refusal(c: Column) -> Column:
    return F.rlike(c, F.lit(f"(?iuU){T.SELF_REFUSAL}"))


def support_feedback(unsupported: Column) -> Column:
    return F.when(F.size(unsupported) > 0, F.concat(F.lit("Not supported by the book: "), F.array_join(unsupported, " | ")))


def style_feedback(failed: Column) -> Column:
    return F.when(F.size(failed) > 0, F.array_join(failed, "; "))


def route(questions: DataFrame, attempts: DataFrame, limits: Settings = SETTINGS) -> DataFrame:
    """question_id, status, used_attempt, style_attempts, verify_attempts.

    questions(question_id, config, best_score, stage1_answer) and attempts(question_id,
    attempt, style_passed, verify_passed), the texts written for each attempt being known.  A
    style failure takes the next attempt while style attempts last, a support failure while
    support attempts last; style attempts go on counting after a support retry.
    """
    listed = attempts.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "style_passed", "verify_passed"))).alias("tries"))
    joined = questions.join(listed, "question_id", "left")
    start = F.struct(F.lit(0).alias("style"), F.lit(0).alias("verify"), F.lit(0).alias("used"), F.lit(None).cast("string").alias("status"))

    def step(s: Column, t: Column) -> Column:
        style = s.style + 1
        again = ~t.style_passed & (style <= limits.style_retries)
        asks = ~again & (F.col("config") == "D")
        verify = s.verify + F.when(asks, 1).otherwise(0)
        passed = F.when(F.col("config") == "C", F.lit(True)).otherwise(t.verify_passed)
        end = F.when(again, F.lit(None).cast("string")).when(passed, "answered").when(verify > limits.verify_retries, "refused_unverified")
        moved = F.struct(style.alias("style"), verify.alias("verify"), t.attempt.cast("int").alias("used"), end.alias("status"))
        return F.when(s.status.isNotNull(), s).otherwise(moved)

    folded = F.aggregate(F.coalesce("tries", F.array().cast("array<struct<attempt:int,style_passed:boolean,verify_passed:boolean>>")), start, step)
    off_book = (F.col("config") != "A") & ((F.col("best_score") < limits.off_book_below) | is_self_refusal(F.coalesce("stage1_answer", F.lit(""))))
    rows = joined.withColumn("f", folded)
    early = F.when(F.col("config") == "A", "answered").when(off_book, "refused_off_book").when(F.col("config") == "B", "answered")
    counts = early.isNull()
    return rows.select("question_id", "config", F.coalesce(early, F.col("f.status")).alias("status"), F.when(counts, F.col("f.used")).alias("used_attempt"), F.when(counts, F.col("f.style")).otherwise(0).alias("style_attempts"), F.when(counts, F.col("f.verify")).otherwise(0).alias("verify_attempts"))
