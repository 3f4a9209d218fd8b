"""Queries that run as streams over the given tables, stopped and begun again in between, against
the SQL of the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import work_path
from ..streaming import live, runs
from .registry import SQL, documents, query, table

WEEK = 7 * 86400


def attempts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("outcome")).filter("outcome is not null")


@query("j1_lockout_stream", SQL["j1_lockouts"])
def j1_lockout_stream(spark, sf_dir):
    """Lockouts decided as attempts come in, in three runs from one checkpoint."""
    return runs.replay(attempts(spark, sf_dir), "ts", lambda s: live.lockouts_stream(s, window_s=WEEK), work_path(spark, "lockouts"))


@query("j2_reset_stream", SQL["j2_reset_requests"])
def j2_reset_stream(spark, sf_dir):
    """The limit on requests for a new password, as they come in."""
    errors = attempts(spark, sf_dir).filter("outcome = 'failure'").select(F.concat(F.lit("reset:"), "key").alias("key"), "ts", "outcome")
    return runs.replay(errors, "ts", lambda s: live.lockouts_stream(s, window_s=WEEK), work_path(spark, "resets")).drop("outcome")


#: Rows of the first nine days that come with the last part, days late.
LATE = "event_id % 50 = 7 and ts < timestamp '2024-01-10 00:00:00'"


@query(
    "j4_status_stream",
    f"""SELECT date_trunc('day', ts) AS start, event_type AS status, count(*) AS n FROM events WHERE NOT ({LATE}) GROUP BY ALL
    UNION ALL SELECT NULL, 'late', count(*) FROM events WHERE {LATE}""",
)
def j4_status_stream(spark, sf_dir):
    """Counts by day and status in three runs and a closing one; what came after the watermark
    had passed its day is counted as late."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("status"))
    end = rows.agg(F.max("created_at").alias("t")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("t") + F.expr("interval 10 days")).alias("created_at"), F.lit("closing").alias("status"))
    counted = runs.replay(rows, "created_at", lambda s: live.status_by_window(s, every="1 day"), work_path(spark, "status"), LATE.replace("ts <", "created_at <"), closing=end)
    counted = counted.select("start", "status", "n")
    late = rows.agg(F.count("*").alias("n")).crossJoin(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"))).select(F.lit(None).cast("timestamp").alias("start"), F.lit("late").alias("status"), (F.col("n") - F.col("m")).alias("n"))
    return counted.unionByName(late)


@query("j5_first_files", "SELECT sha256(coalesce(text, '')) AS file_hash, min(doc_id)::VARCHAR AS name FROM documents GROUP BY 1")
def j5_first_files(spark, sf_dir):
    """Documents as files that come in one a minute: the first of each content, in three runs."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.timestamp_seconds(1_700_000_000 + 60 * F.col("doc_id")).alias("arrived"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"))
    work = work_path(spark, "intake")
    most = rows.agg(F.max(F.col("name").cast("long"))).first()[0] or 0
    for k in range(3):
        part = F.least(F.lit(2), F.floor(F.col("name").cast("long") * 3 / (most + 1)))
        runs.land(rows.filter(part == k), f"{work}/landing", "arrived")
        runs.take_first_files(spark.readStream.schema(rows.schema).parquet(f"{work}/landing"), f"{work}/taken", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/taken").select("file_hash", "name")
