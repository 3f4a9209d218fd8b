"""Mixing sources to target weights, in DataFrame functions only.

A classifier of words, fitted on labelled rows, gives every document a posterior over domains:
its soft membership.  Its words are those that tell most about the label there.  Nonnegative document rates, one to begin with, are then fitted
by projected gradient least squares, so that the expected tokens of each domain (rate times
tokens times posterior, summed over documents) come to the targets.  A step needs the domain
totals, an aggregate of a few numbers; a document's rate follows from its own posterior and the
steps so far, so no rates are sent around.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_id, stored
from .decontaminate import words_of

DOMAINS = ("good", "poor", "toxic")


@dataclass(frozen=True)
class Mix:
    """Shares of the tokens that the mixture shall have, as many in all as the input has."""

    targets: dict[str, float] = field(default_factory=lambda: {"good": 0.90, "poor": 0.08, "toxic": 0.02})
    #: most labelled rows that the classifier is fitted on, the first by a hash of the key
    most_labelled: int = 20_000
    features: int = 2000
    least_rows: int = 5
    steps: int = 60
    close: float = 1e-5


def domain_of() -> Column:
    """0 good, 1 poor, 2 toxic; null where a label is missing."""
    return F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 1, 0.0).when(F.col("quality") == 0, 1.0)


def features_of(text: Column) -> Column:
    """Words, and runs of symbols as words of their own."""
    return F.concat(words_of(text), F.coalesce(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>!]+"), F.lit(0)), F.array().cast("array<string>")))


def telling_words(training: DataFrame, mix: Mix) -> list[str]:
    """The words of training(label, words) with the most information about the label, at most
    mix.features of them."""
    labels = {int(r.label): r.n for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}
    whole = sum(labels.values())
    each = training.select("label", F.explode(F.array_distinct("words")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in labels]).filter(F.col("n") >= mix.least_rows)

    def term(both: Column, one: Column, other: int) -> Column:
        return F.when(both > 0, both / whole * F.log(both * float(whole) / (one * float(other)))).otherwise(0.0)

    gain = F.lit(0.0)
    for k, n in labels.items():
        gain = gain + term(F.col(f"n{k}"), F.col("n"), n) + term(F.lit(n) - F.col(f"n{k}"), F.lit(whole) - F.col("n"), n)
    return [r.word for r in counts.withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(mix.features).select("word").collect()]


def posteriors(docs: DataFrame, labels: DataFrame, key: str, text: str, mix: Mix) -> DataFrame:
    """row (row_id), id, n_tokens (words), p (array over DOMAINS), one row per row of docs."""
    named = docs.select(row_id(key, text).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{key}`").alias("id"), domain_of().alias("label")).filter("id is not null and label is not null").dropDuplicates(["id"])
    sample = stored(known.orderBy(F.xxhash64("id"), "id").limit(mix.most_labelled), "labelled")
    training = stored(named.filter("id is not null").join(F.broadcast(sample), "id").dropDuplicates(["row"]).select("label", features_of(F.col("text")).alias("words")), "training")
    seen = [r.label for r in training.select("label").distinct().collect()]
    rows = named.select("row", "id", features_of(F.col("text")).alias("words"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    vocabulary = telling_words(training, mix) if len(seen) > 1 else []
    if not vocabulary:
        even = [1.0 / len(DOMAINS)] * len(DOMAINS) if len(seen) != 1 else [float(i == int(seen[0])) for i in range(len(DOMAINS))]
        return rows.select("row", "id", "n_tokens", F.array(*map(F.lit, even)).alias("p"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="features").setBinary(True)
    regression = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, standardization=False)
    model = Pipeline(stages=[vectors, regression]).fit(training)
    p = vector_to_array("probability")
    # domains that no labelled row has get nothing
    filled = F.transform(F.sequence(F.lit(1), F.lit(len(DOMAINS))), lambda i: F.when(i <= F.size(p), F.element_at(p, i)).otherwise(0.0))
    return model.transform(rows).select("row", "id", "n_tokens", filled.alias("p"))


def rate_after(steps: list[list[float]]) -> Column:
    """A document's rate after gradient steps, kept at 0 or more after each."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    moves = F.array(*[F.array(*map(F.lit, s)) for s in steps])

    def move(r: Column, s: Column) -> Column:
        return F.greatest(F.lit(0.0), r - sum((F.col("p")[k] * s[k] for k in range(1, len(DOMAINS))), F.col("p")[0] * s[0]))

    return F.aggregate(moves, rate, move)


def fit_rates(rows: DataFrame, mix: Mix) -> list[list[float]]:
    """The gradient steps: for each domain its excess over the target, against its own size."""
    n = len(DOMAINS)

    def totals(rate: Column) -> list[float]:
        parts = [F.coalesce(F.sum(rate * F.col("n_tokens") * F.col("p")[k]), F.lit(0.0)).alias(f"t{k}") for k in range(n)]
        return list(rows.agg(*parts).first())

    first = totals(F.lit(1.0))
    whole = sum(first)
    if not whole:
        return []
    shares = sum(mix.targets.values())
    wanted = [mix.targets.get(d, 0.0) / shares * whole for d in DOMAINS]
    steps: list[list[float]] = []
    now = first
    for _ in range(mix.steps):
        if sum(abs(a - b) for a, b in zip(now, wanted)) <= mix.close * whole:
            break
        steps.append([(now[k] - wanted[k]) / first[k] if first[k] > 0 else 0.0 for k in range(n)])
        now = totals(rate_after(steps))
    return steps


def rated(docs: DataFrame, labels: DataFrame, key: str, text: str, mix: Mix) -> DataFrame:
    """row, id, n_tokens, p, rate, copies for every row of docs."""
    rows = stored(posteriors(docs, labels, key, text, mix), "posteriors")
    draw = F.pmod(F.xxhash64("row", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    out = rows.withColumn("rate", rate_after(fit_rates(rows, mix)))
    return out.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def fit_mixture(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mix: Mix = Mix()) -> DataFrame:
    """One row per row of docs: key, n_tokens, p_<domain>, rate, copies (rate rounded up or
    down by a hash of key and text, so that it holds on average).

    Null and empty texts have no tokens and are classified by the empty text; without labels
    posteriors are even, with one label they are sure.  A domain without any mass cannot be
    raised; its target stays unmet.  Very long texts are taken whole.  Repeated rows count as
    often as they stand and are rated alike; texts that share a key are rated each by itself; rows
    without a key have no label but are rated.  An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    out = rated(docs, labels, key, text, mix)
    return out.select(F.col("id").alias(key), "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")


def mixed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, each as often as its own copies say, with all columns; see fit_mixture
    for the cases."""
    name, times, each = (free_name(docs.columns, n) for n in ("row", "times", "each"))
    copies = stored(rated(docs, labels, key, text, mix).filter("copies > 0").select(F.col("row").alias(name), F.col("copies").alias(times)).distinct(), "copies")
    joined = docs.withColumn(name, row_id(key, text)).join(copies, name)
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(name, times, each)
