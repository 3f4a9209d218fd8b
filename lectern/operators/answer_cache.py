"""A cache of model answers as a table: keys, what must be called, and who gets which answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("prompt_version", "model", "provider", "system", "prompt", "temperature", "max_tokens")


def quoted(c: Column) -> Column:
    """A JSON string with non-ASCII kept."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for found, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(found), F.lit(short))
    for code in (*range(0x00, 0x08), 0x0B, *range(0x0E, 0x20)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def cache_key() -> Column:
    """SHA-256 of the seven fields as JSON with sorted names, ', ' and ': ' between."""

    def text(name: str) -> Column:
        return F.coalesce(quoted(F.col(name)), F.lit("null"))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    made = {"max_tokens": number("max_tokens"), "model": text("model"), "prompt": text("prompt"), "prompt_version": text("prompt_version"), "provider": text("provider"), "system": text("system"), "temperature": number("temperature")}
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in made.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def keyed(calls: DataFrame) -> DataFrame:
    return calls.withColumn("key", cache_key())


def to_call(keyed_calls: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per key that the cache lacks, its first call."""
    missing = keyed_calls.join(cache.select("key"), "key", "left_anti")
    return missing.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("ordinal"))).filter("k = 1").drop("k")


def answered(keyed_calls: DataFrame, cache: DataFrame, made: DataFrame) -> DataFrame:
    """Every call with its answer; the first use of a key that was missing is a miss, later
    ones are hits.  cache and made hold (key, text, prompt_tokens, completion_tokens)."""
    old = cache.select("key", "text", "prompt_tokens", "completion_tokens").withColumn("old", F.lit(True))
    new = made.select("key", "text", "prompt_tokens", "completion_tokens").withColumn("old", F.lit(False))
    first = F.row_number().over(Window.partitionBy("key").orderBy("ordinal")) == 1
    return keyed_calls.join(old.union(new), "key", "left").withColumn("cached", F.coalesce("old", F.lit(False)) | ~first).drop("old")
