"""Streams run to the end of what has landed, again and again from one checkpoint.

Every call takes up the files that came since the last one and stops; state, offsets and what was
written are in the checkpoint and the sink's own log, so a stop in between loses and repeats
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream gives for the files there are now to Parquet at path."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def land(rows: DataFrame, path: str, time: str) -> None:
    """Append rows to a landing folder, in files that follow the time."""
    rows.repartitionByRange(time).sortWithinPartitions(time).write.mode("append").parquet(path)


def replay(rows: DataFrame, time: str, make, work: str, late: str = "false", steps: int = 3, closing: DataFrame | None = None) -> DataFrame:
    """What make(stream) gives when rows land in `steps` parts by time and the stream is stopped
    and begun again after each part.  Rows for which `late` holds land with the last part; rows of
    `closing` land at the end by themselves, to move the watermark past all windows."""
    spark = rows.sparkSession
    landing, sink, checkpoint = (f"{work}/{name}" for name in ("landing", "sink", "checkpoint"))
    first, last = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    span = max(1, (last or 0) - (first or 0) + 1)
    part = F.when(F.expr(late), steps - 1).otherwise(F.expr(f"(unix_micros({time}) - {first or 0}) * {steps} div {span}"))
    parts = [rows.filter(part == k) for k in range(steps)] + ([closing] if closing is not None else [])
    for landed in parts:
        land(landed, landing, time)
        drain(make(spark.readStream.schema(rows.schema).parquet(landing)), sink, checkpoint)
    return spark.read.parquet(sink)


def take_first_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take the first arrival of each content hash of a stream of files(name, arrived, file_hash)
    into path.  A batch is joined against what earlier batches took and written under its number,
    so a batch that is run again after a failure replaces itself."""
    spark = stream.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = spark.read.parquet(path).filter(F.col("batch") < number) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
        first = batch.groupBy("file_hash").agg(F.min(F.struct("arrived", "name")).alias("first")).select("file_hash", "first.*")
        fresh = first if known is None else first.join(known.select("file_hash"), "file_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
