"""Metrics of evaluation runs, all from one grouping of flat record rows.

Expected columns: run_id, config, split, id, question, answer, status, best_score,
retrieved (array of lesson ids), expected_lesson_id, type, style (struct passed,
max_sentence_words, fk_grade, vocab_coverage), verification (struct supported_ratio, passed),
faithfulness.  Means are null where nothing counts towards them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import hits_of

RUN = ("run_id", "config", "split")


def flagged(records: DataFrame) -> DataFrame:
    """Records with what each of them counts for."""
    answered = F.col("status") == "answered"
    off = F.coalesce(F.col("type") == "off_book", F.lit(False))
    spoken = answered & (F.coalesce(F.length("answer"), F.lit(0)) > 0)
    ratio = F.col("verification.supported_ratio")
    return records.select(
        *RUN,
        "status",
        hits_of(F.col("retrieved"), F.col("expected_lesson_id")).cast("int").alias("hit"),
        F.when(off, (~answered).cast("int")).alias("refused_right"),
        F.when(~off, (~answered).cast("int")).alias("refused_wrong"),
        F.when(answered, 1 - ratio).alias("unsupported"),
        F.when(answered & ratio.isNotNull(), (ratio == 0.0).cast("int")).alias("severe"),
        F.when(ratio.isNotNull(), 1 - ratio).alias("unsupported_any"),
        F.when(spoken, T.reading_grade(F.col("answer"))).alias("fk"),
        F.when(spoken, T.max_sentence_words(F.col("answer"))).alias("longest"),
        F.when(spoken, F.round(T.mean_sentence_words(F.col("answer")), 1)).alias("mean_words"),
        F.when(answered, F.col("style.passed").cast("int")).alias("style_passed"),
        F.when(answered, F.col("style.fk_grade")).alias("style_fk"),
        F.when(answered, F.col("style.max_sentence_words")).alias("style_longest"),
        F.when(answered, F.col("style.vocab_coverage")).alias("style_coverage"),
        F.when(spoken & ~F.isnan("faithfulness"), F.col("faithfulness")).alias("faithful"),
    )


def run_metrics(records: DataFrame) -> DataFrame:
    """One row per run, config and split with every metric and its n, in one shuffle.

    hallucination and severe are over answered rows; where an answer is refused unless it
    passes, severe is 0 by construction, so unsupported_any gives the same mean over all rows
    that were verified, whatever became of them."""
    means = {"hit_rate": "hit", "refusal_accuracy": "refused_right", "false_refusal": "refused_wrong", "hallucination": "unsupported", "severe": "severe", "unsupported_any": "unsupported_any", "fk": "fk", "max_sentence_words": "longest", "mean_sentence_words": "mean_words", "style_pass": "style_passed", "style_fk": "style_fk", "style_max_words": "style_longest", "style_coverage": "style_coverage", "faithfulness": "faithful"}
    statuses = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("answered", "refused_off_book", "refused_unverified")]
    return flagged(records).groupBy(*RUN).agg(F.count("*").alias("n"), *statuses, *[x for name, c in means.items() for x in (F.avg(c).alias(name), F.count(c).alias(f"{name}_n"))])


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def ablation_table(metrics: DataFrame, metric: str) -> DataFrame:
    """A row per split, a column per configuration."""
    return metrics.groupBy("split").pivot("config", ["A", "B", "C", "D"]).agg(F.first(metric))


def ablation_totals(records: DataFrame) -> DataFrame:
    """Counts by config and split, by each, and in all."""
    return records.cube("config", "split").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "answered").alias("answered"))


def failure_category() -> Column:
    off = F.coalesce(F.col("type") == "off_book", F.lit(False))
    answered = F.col("status") == "answered"
    missed = ~F.coalesce(hits_of(F.col("retrieved"), F.col("expected_lesson_id")), F.lit(True))
    return F.when(off & answered, "off_book_answered").when(~off & ~answered, "false_refusal").when(missed, "retrieval_miss").when(answered & (F.col("style.passed") == F.lit(False)), "style_failure").otherwise("none")


def failure_counts(records: DataFrame) -> DataFrame:
    return records.withColumn("category", failure_category()).groupBy(*RUN, "category").agg(F.count("*").alias("n"))


def cache_stats(calls: DataFrame) -> DataFrame:
    """Calls, hits, misses, and tokens, which only misses spend."""
    spent = F.when(~F.col("cached"), F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    return calls.agg(F.count("*").alias("calls"), F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"), F.coalesce(F.sum(spent), F.lit(0)).alias("tokens"))


def flat_settings(manifests: DataFrame, settings: str = "settings") -> DataFrame:
    """run_id, path, value: the leaves of nested settings, given as JSON text or VARIANT, by their
    path; a level of nesting is a round.  Null is a value of its own, and so are an empty object
    and an empty list."""
    kind = manifests.schema[settings].dataType.simpleString()
    tree = F.parse_json(settings) if kind == "string" else F.col(settings)
    nodes, out = manifests.select("run_id", F.lit("$").alias("path"), tree.alias("v")), None
    while True:
        shape = F.schema_of_variant("v")
        inner = (F.startswith(shape, F.lit("OBJECT<")) & (shape != "OBJECT<>")) | (F.startswith(shape, F.lit("ARRAY<")) & (F.to_json("v") != "[]"))
        leaves = nodes.filter(~inner).select("run_id", "path", F.to_json("v").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        deeper = nodes.filter(inner)
        if deeper.isEmpty():
            return out
        step = "concat(path, if(e.key is null, concat('[', e.pos, ']'), concat('.', e.key)))"
        nodes = deeper.lateralJoin(manifests.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e")).selectExpr("run_id", f"{step} AS path", "e.value AS v")


def changed_settings(manifests: DataFrame, one: str, other: str) -> DataFrame:
    """name, one, other where two runs of manifests(run_id, settings) differ.  Settings are a map,
    or nested JSON (text or VARIANT), whose leaves are named by their path; a setting that one run
    lacks is null there, one that is null reads null as JSON."""
    flat = manifests.schema["settings"].dataType.simpleString().startswith("map")
    rows = manifests.filter(F.col("run_id").isin(one, other))
    rows = rows.select("run_id", F.explode("settings").alias("name", "value")) if flat else flat_settings(rows).withColumnRenamed("path", "name")

    def of(run: str, name: str) -> DataFrame:
        return rows.filter(F.col("run_id") == run).select("name", F.col("value").alias(name))

    return of(one, "one").join(of(other, "other"), "name", "full_outer").filter(~F.col("one").eqNullSafe(F.col("other")))


def take_questions(questions: DataFrame, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Questions of a split, the first of them in file order (column ordinal); an error if there
    are none."""
    kept = questions.filter(F.col("split") == split) if split else questions
    if kept.isEmpty():
        raise ValueError(f"no questions of split {split!r}" if split else "no questions")
    return kept.orderBy("ordinal").limit(limit) if limit else kept


def running_status(messages: DataFrame, every: str = "1 day") -> DataFrame:
    """Counts of each status by time window, for a batch or a stream alike."""
    return messages.groupBy(F.window("created_at", every), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def event_order(events: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """request_id of requests whose steps come out of order: events(request_id, at, step)."""
    place = F.lit(None).cast("int")
    for i, s in enumerate(steps):
        place = F.when(F.col("step") == s, i).otherwise(place)
    before = F.lag("place").over(Window.partitionBy("request_id").orderBy("at"))
    return events.withColumn("place", place).withColumn("before", before).filter((F.col("place") < F.col("before")) | F.col("place").isNull()).select("request_id").distinct()
