"""Style measurement over transcripts(file, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# English stop words.
STOP = """
the a an is are was were be been and or but if of to in on at for with so that
this these those it its we you your i he she they them his her our will can do does
did not no yes here there now then what who how why when where as by from have has had
""".split()


def lengths(transcripts: DataFrame, *by: str) -> DataFrame:
    """by..., length, n: how many sentences have each length above 0."""
    rows = transcripts.select(*by, F.explode(T.sentence_lengths(T.without_header(F.col("text")))).alias("length"))
    return rows.groupBy(*by, "length").agg(F.count("*").alias("n"))


def length_stats(histogram: DataFrame, *by: str) -> DataFrame:
    """Mean, median, largest and 95th percentile from a histogram of lengths.

    The percentile is the value at rank max(1, floor(0.95 n)), the median the mean of the
    middle two."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    upto = whole.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("total", F.sum("n").over(whole)).withColumn("cum", F.sum("n").over(upto))
    rank = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(0.95).cast("double")))

    def at(r: Column) -> Column:
        return F.min(F.when(F.col("cum") >= r, F.col("length")))

    grouped = ranked.groupBy(*by)
    return grouped.agg(
        F.first("total").alias("measured"), (F.sum(F.col("length") * F.col("n")) / F.first("total")).alias("mean_words"), F.max("length").alias("max_words"), at(rank).alias("p95_words"),
        ((at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2).alias("median_words"),
    )


def file_stats(transcripts: DataFrame, grade_digits: int = 2) -> DataFrame:
    """One row per file that has a measurable sentence; `sentences` counts all of them.  The grade
    is rounded to grade_digits before its range is tested."""
    body = transcripts.select("file", T.without_header(F.col("text")).alias("body"))
    found = T.words(F.col("body"))
    bangla = F.size(F.filter(found, lambda w: F.rlike(w, F.lit(f"[{T.BANGLA}]"))))
    own = body.select("file", F.size(found).alias("words"), F.size(T.sentences(F.col("body"))).alias("sentences"), F.when(F.size(found) > 0, F.round(bangla / F.size(found), 3)).otherwise(0.0).alias("bangla_ratio"), (bangla > 0).alias("has_bangla"), T.punctuation_density(F.col("body")).alias("punct_per_100w"), T.reading_grade(F.col("body"), grade_digits).alias("fk_grade"))
    return own.join(length_stats(lengths(transcripts, "file"), "file"), "file")


def combined_stats(transcripts: DataFrame) -> DataFrame:
    """One row over all files: sums of parts, so no text is joined in one place.  Without a word
    the ratios are 0 and the grade is null."""
    body = transcripts.select(T.without_header(F.col("text")).alias("body"))
    found, english = T.words(F.col("body")), T.without_bangla(F.col("body"))
    parts = body.select(F.size(found).alias("w"), F.size(F.filter(found, lambda w: F.rlike(w, F.lit(f"[{T.BANGLA}]")))).alias("b"), F.regexp_count("body", F.lit("[.!?।]")).alias("m"), F.size(T.tokens(english)).alias("t"), F.size(T.words(english)).alias("e"), F.size(T.sentences(english)).alias("s"), T.syllables(english).alias("y"))
    sums = parts.agg(F.count("*").alias("files"), F.sum("w").alias("words"), F.coalesce(F.round(F.sum("b") / F.nullif(F.sum("w"), F.lit(0)), 3), F.lit(0.0)).alias("bangla_ratio"), F.coalesce(F.sum("b") > 0, F.lit(False)).alias("has_bangla"), F.coalesce(F.round(100 * F.sum("m") / F.nullif(F.sum("w"), F.lit(0)), 1), F.lit(0.0)).alias("punct_per_100w"), T.grade_of(F.sum("t"), F.sum("e"), F.sum("s"), F.sum("y")).alias("fk_grade"))
    return sums.crossJoin(length_stats(lengths(transcripts)))  # one row each


def top_words(transcripts: DataFrame, k: int = 25, bangla: bool = False) -> DataFrame:
    """word, n of the k most frequent words; ties by word.  Content words are lower-cased, over
    two letters and no stop words."""
    rows = transcripts.select(F.explode(T.words(T.without_header(F.col("text")))).alias("word"))
    is_bangla = F.rlike("word", F.lit(f"[{T.BANGLA}]"))
    kept = rows.filter(is_bangla) if bangla else rows.filter(~is_bangla & (F.length("word") > 2)).select(F.lower("word").alias("word")).filter(~F.col("word").isin(*STOP))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def warnings() -> Column:
    """Why the numbers of a stats row may not be trusted.  Bangla is told by its words, since a
    ratio of few among many rounds to 0."""
    return F.array_compact(
        F.array(
            F.when(F.col("punct_per_100w") < 8, "few sentence marks"),
            F.when(F.col("max_words") > 60, "a missing full stop"),
            F.when(F.col("fk_grade").isNull(), "no reading grade"),
            F.when(~F.col("has_bangla"), "no Bangla"),
        )
    )


def thresholds_table(stats: DataFrame) -> DataFrame:
    """Markdown rows of a combined stats row."""
    rows = F.array(
        F.format_string("| Max sentence length | %d words | 95th percentile of %d sentences |", "p95_words", "measured"),
        F.format_string("| Mean sentence length | %.1f words | mean over %d transcripts |", "mean_words", "files"),
        F.format_string("| Bangla word ratio | %.1f%% | Bangla words of all words |", F.col("bangla_ratio") * 100),
        F.coalesce(F.format_string("| Reading grade | %.2f | all transcripts together |", "fk_grade"), F.lit("| Reading grade | none | too few words |")),
        F.format_string("| Corpus size | %d words | %d transcripts |", "words", "files"),
    )
    return stats.select(F.posexplode(rows).alias("row", "line"))
