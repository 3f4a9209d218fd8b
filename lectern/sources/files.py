"""Files in and out: JSON lines, run logs, transcripts, media listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MEDIA = ("mp4", "mkv", "webm", "mov", "avi", "m4a", "mp3", "wav", "opus", "flac")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped."""
    lines = spark.read.text(path).filter(T.stripped(F.col("value")) != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_logs(manifests: DataFrame, records: DataFrame, path: str) -> None:
    """A log for each run of manifests(run_id, ...) and records(run_id, ordinal, ...): a folder of
    its own with one file, the manifest in its first line and the records below in their order.
    Missing values are written as null, other scripts as they are.  Tasks sort, none holds a run."""

    def lines(df: DataFrame, ordinal) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "run_id"])
        return df.select("run_id", ordinal.cast("long").alias("ordinal"), F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))

    both = lines(manifests, F.lit(-1)).unionByName(lines(records, F.col("ordinal")))
    dealt = both.repartition("run_id").sortWithinPartitions("run_id", "ordinal")
    dealt.select("run_id", "value").write.mode("overwrite").partitionBy("run_id").text(path)


@dataclass(frozen=True)
class RunLogs:
    """manifests and records with the file they stand in; lines that are neither."""

    manifests: DataFrame
    records: DataFrame
    bad: DataFrame


def read_run_logs(spark: SparkSession, path: str, manifest: str, record: str) -> RunLogs:
    """Run logs whose lines are of two kinds: a manifest is known by its prompt_versions.  Blank
    lines are skipped; what is no JSON object, or does not fit its kind, is kept apart."""
    found = spark.read.text(path).filter(T.stripped(F.col("value")) != "").withColumn("file", F.col("_metadata.file_path"))
    run = [F.col("run_id").cast("string").alias("run_id")] if "run_id" in found.columns else []
    is_manifest = F.get_json_object("value", "$.prompt_versions").isNotNull()

    def parsed(schema: str):
        return F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})

    both = found.select("file", "value", *run, is_manifest.alias("is_manifest"), parsed(manifest).alias("m"), parsed(record).alias("r"))
    wrong = F.when(F.col("is_manifest"), F.col("m._bad")).otherwise(F.col("r._bad"))
    no_object = ~F.startswith(T.stripped(F.col("value")), F.lit("{"))
    marked = both.withColumn("is_bad", wrong.isNotNull() | no_object)
    good, names = marked.filter("not is_bad"), [c for c in ("file", "run_id") if c in both.columns]
    return RunLogs(
        good.filter("is_manifest").select(*names, "m.*").drop("_bad"),
        good.filter("not is_manifest").select(*names, "r.*").drop("_bad"),
        marked.filter("is_bad").select(*names, "value"),
    )


def read_run_log(spark: SparkSession, path: str, manifest: str, record: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, records) of run logs, whose first line is of another kind than the rest;
    both carry the file they stand in."""
    logs = read_run_logs(spark, path, manifest, record)
    return logs.manifests, logs.records


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole transcript files, # lines dropped."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.txt)?$", 1))
    return rows.select("file", T.without_header(F.col("value")).alias("text"))


def media_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = MEDIA) -> DataFrame:
    """path, length, megabytes of the files of some kinds below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*kinds)).select("path", "length", (F.col("length") / 1e6).alias("megabytes")).orderBy("path")


def media_total(listed: DataFrame) -> DataFrame:
    """files, megabytes of a listing."""
    return listed.agg(F.count("*").alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / 1e6).alias("megabytes"))


def manifest_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))
