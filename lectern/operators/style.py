"""Style of written answers: vocabulary of a book, coverage, readability, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions import text as T

VERDICT = "suitable boolean, reason string"


def vocabulary(chunks: DataFrame, fewshot: DataFrame, grade: int) -> DataFrame:
    """book_id, word: lower-cased words of a book's chunks (headers dropped), and those of the
    sample answers of the grade, which hold for every book and have no book_id."""
    book = chunks.select("book_id", F.explode(F.array_distinct(T.words(F.lower(T.body_of(F.col("text")))))).alias("word")).distinct()
    samples = usable_fewshot(fewshot, grade).select(F.explode(T.words(F.lower("teacher_answer"))).alias("word")).distinct()
    return book.union(samples.select(F.lit(None).cast(chunks.schema["book_id"].dataType).alias("book_id"), "word"))


def usable_fewshot(fewshot: DataFrame, grade: int, evaluating: bool = False) -> DataFrame:
    """Samples of the grade, or all of them if it has none; real ones only when evaluating."""
    kept = fewshot.filter("provenance <> 'synthetic'") if evaluating else fewshot
    some = kept.agg((F.count_if(F.col("grade") == grade) > 0).alias("some"))
    return kept.join(F.broadcast(some)).filter(~F.col("some") | (F.col("grade") == grade)).drop("some")


def load_fewshot(fewshot: DataFrame, grade: int, evaluating: bool = False) -> DataFrame:
    """usable_fewshot, or an error where no sample is left."""
    kept = usable_fewshot(fewshot, grade, evaluating)
    if kept.isEmpty():
        raise ValueError("no few-shot samples" + " that are real" * evaluating)
    return kept


def coverage(answers: DataFrame, vocab: DataFrame) -> DataFrame:
    """message_id, n_words, n_unknown, coverage (1 without words, to three decimals), unknown
    words as first seen."""
    words = answers.select("message_id", "book_id", F.posexplode_outer(T.words(F.lower(T.without_bangla(F.col("answer"))))).alias("pos", "word"))
    own = vocab.filter("book_id is not null").distinct().withColumn("own", F.lit(True))
    common = vocab.filter("book_id is null").select("word").distinct().withColumn("common", F.lit(True))
    marked = words.join(own, ["book_id", "word"], "left").join(common, "word", "left").withColumn("known", F.coalesce("own", "common"))
    each = marked.groupBy("message_id", "word").agg(F.count("pos").alias("n"), F.min("pos").alias("pos"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
    missing = F.array_sort(F.collect_list(F.when(~F.col("known") & F.col("word").isNotNull(), F.struct("pos", "word"))))
    out = each.groupBy("message_id").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("n_unknown"), missing.alias("m"))
    return out.select("message_id", "n_words", "n_unknown", F.when(F.col("n_words") > 0, F.round(1 - F.col("n_unknown") / F.col("n_words"), 3)).otherwise(1.0).alias("coverage"), F.transform("m", lambda x: x.word).alias("unknown"))


def failures(longest: Column, covered: Column, unknown: Column, grade: Column, limits: Settings = SETTINGS) -> Column:
    """What is wrong, in words; an unknown grade passes."""
    return F.array_compact(
        F.array(
            F.when(longest > limits.most_sentence_words, F.format_string("a sentence has %d words, at most %d are allowed", longest.cast("int"), F.lit(limits.most_sentence_words))),
            F.when(covered < limits.least_coverage, F.format_string("only %.1f%% of the words are in the book, not: %s", covered * 100, F.array_join(unknown, ", "))),
            F.when(grade > limits.most_grade, F.format_string("reading grade %.2f is above %.2f", grade, F.lit(limits.most_grade))),
        )
    )


def style_reports(answers: DataFrame, vocab: DataFrame, verdicts: DataFrame | None = None, echo: bool = False, limits: Settings = SETTINGS) -> DataFrame:
    """One report per answer.  A verdict of verdicts(message_id, text) counts only where no
    number fails, as a judge is asked only then."""
    content = answers.withColumn("answer", F.array_join(T.content_sentences(F.col("answer"), echo), " "))
    rows = content.join(coverage(content, vocab), "message_id")
    rows = rows.select("message_id", T.max_sentence_words(F.col("answer")).alias("max_sentence_words"), T.mean_sentence_words(F.col("answer")).alias("mean_sentence_words"), T.reading_grade(F.col("answer")).alias("fk_grade"), "coverage", "unknown")
    rows = rows.withColumn("failures", failures(F.col("max_sentence_words"), F.col("coverage"), F.col("unknown"), F.col("fk_grade"), limits))
    if verdicts is None:
        return rows.withColumn("judge_ran", F.lit(False)).withColumn("judge_suitable", F.lit(None).cast("boolean")).withColumn("passed", F.size("failures") == 0)
    judged = rows.join(verdicts.select("message_id", T.read_verdict(F.col("text")).alias("v"), F.lit(True).alias("given")), "message_id", "left")
    ran = (F.size("failures") == 0) & F.col("given").isNotNull()
    read = judged.withColumn("judge_ran", ran).withColumn("judge_suitable", F.when(ran, F.col("v.suitable"))).withColumn("judge_reason", F.when(ran, F.col("v.reason"))).withColumn("unparsed", F.when(ran, F.col("v.unparsed")))
    # an answer whose verdict can't be read does not pass; one that nobody judged does
    passed = (F.size("failures") == 0) & F.coalesce("judge_suitable", ~ran)
    return read.withColumn("passed", passed).drop("v", "given")


def guide_sections(guide: Column) -> Column:
    """number -> text of the '## N.' sections of a guide."""
    parts = F.filter(F.split(guide, r"(?m)^(?=## \d+\.)"), lambda s: F.rlike(s, F.lit(r"^## \d+\.")))
    entries = F.transform(parts, lambda s: F.struct(F.regexp_extract(s, r"^## (\d+)\.", 1).cast("int").alias("k"), T.stripped(F.regexp_replace(T.stripped(s), r"\n-{3,}\s*$", "")).alias("v")))
    return F.map_from_entries(entries)


def grade_profile(section: Column, grade: int) -> Column:
    """The table row of a grade as 'column: value' pairs, empty cells left out; '' if none."""
    rows = F.filter(F.transform(F.split(section, "\n"), T.stripped), lambda r: F.startswith(r, F.lit("|")) & ~F.rlike(r, F.lit(r"^[|\- ]+$")))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), T.stripped))
    head = F.element_at(F.filter(cells, lambda c: F.lower(F.element_at(c, 1)) == "grade"), 1)
    row = F.get(F.filter(cells, lambda c: F.element_at(c, 1) == str(grade)), F.lit(0))
    pairs = F.zip_with(head, row, lambda k, v: F.when((v != "") & (F.lower(k) != "grade"), F.concat(k, F.lit(": "), v)))
    return F.coalesce(F.array_join(F.array_compact(pairs), "; "), F.lit(""))
