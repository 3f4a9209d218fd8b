"""The chunk store: chunks of many books, with the status of each, published all or nothing.

A publication writes the chunks of its books into a folder of its own, then the new state of all
books (one slim row each) into another, and at last a small log file that names the state.  That
last step is a rename that fails where the name is taken, so it happens once or not at all:
readers see the state before or the one after, never chunks without their counts.  What a broken
publication leaves behind is named by no log file and is swept away later.

    chunks/batch=B/   written once, never changed; sorted by book, so readers skip other books
    states/B/                   book_id, status, chunk_count, batch
    log/00000007                the name of the state of version 7
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "book_id string, status string, chunk_count long, batch string"


class Folder:
    """The few file operations of the store, through Hadoop's interface, on any file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        self.gateway = spark.sparkContext._gateway

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> bool:
        """Write a small file under a name that nothing has yet; False if the name is taken."""
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.at("log"))
        options = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            self.context.rename(draft, self.at(name), options)
            return True
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in Folder(spark, path).names("log") if n.isdigit()]


def books(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """book_id, status, chunk_count, batch of all books in a version, the latest by default."""
    version = max(versions(spark, path), default=0) if version is None else version
    if not version:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{path}/states/{Folder(spark, path).read(f'log/{version:08d}')}")


def chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of the ready books of a version."""
    ready = books(spark, path, version).filter("status = 'ready'")
    if not Folder(spark, path).names("chunks"):
        raise ValueError(f"{path} holds no chunks yet")
    kept = spark.read.parquet(f"{path}/chunks")
    return kept.join(ready.select("batch", "book_id"), ["batch", "book_id"], "left_semi").drop("batch")


def write_batch(new: DataFrame, path: str, batch: str) -> DataFrame:
    """Write the chunks of a batch; book_id and chunk_count of what was written.  Rows of a large
    book are dealt to several tasks by chunk, and many small books share a file."""
    dealt = new.withColumn("book_id", F.col("book_id").cast("string")).repartition("book_id", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
    at = f"{path}/chunks/batch={batch}"
    dealt.sortWithinPartitions("book_id", "chunk_id").write.parquet(at)
    return new.sparkSession.read.schema("book_id string").parquet(at).groupBy("book_id").agg(F.count("*").alias("chunk_count"))


def publish(new: DataFrame, faults: DataFrame, path: str, retries: int = 5) -> int:
    """Make the chunks in new(book_id, chunk_id, ...) the contents of their books, ready with
    their counts, and mark those of faults(book_id, ...) failed; other books stay.  A failed book
    keeps the chunks it had, but readers skip it until it is ready again.  Publishing the same
    again changes nothing but the version.  Returns the version.

    Where another publication comes first, the state is made anew on top of it.
    """
    spark, batch = new.sparkSession, uuid.uuid4().hex
    counts = write_batch(new, path, batch).withColumn("batch", F.lit(batch))
    failed = faults.select(F.col("book_id").cast("string").alias("book_id")).distinct().join(counts.select("book_id"), "book_id", "left_anti")
    for _ in range(retries):
        last = max(versions(spark, path), default=0)
        old = books(spark, path, last)
        ready = counts.select("book_id", F.lit("ready").alias("status"), "chunk_count", "batch")
        broken = failed.join(old.drop("status"), "book_id", "left").select("book_id", F.lit("failed").alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "batch")
        named = ready.unionByName(broken)
        state = uuid.uuid4().hex
        old.join(named.select("book_id"), "book_id", "left_anti").unionByName(named).write.parquet(f"{path}/states/{state}")
        if Folder(spark, path).put_once(f"log/{last + 1:08d}", state):
            return last + 1
    raise RuntimeError(f"{path}: {retries} other publications came first")


def sweep(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all versions but the last `keep`, and every batch, state and draft that none of
    these names.  Not to be run beside a publication."""
    folder = Folder(spark, path)
    have = versions(spark, path)
    for v in have[:-keep]:
        folder.drop(f"log/{v:08d}")
    states = {folder.read(f"log/{v:08d}") for v in have[-keep:]}
    batches = {r.batch for v in have[-keep:] for r in books(spark, path, v).select("batch").distinct().collect()}
    for name in folder.names("states"):
        if name not in states:
            folder.drop(f"states/{name}")
    for name in folder.names("chunks"):
        if name.removeprefix("batch=") not in batches:
            folder.drop(f"chunks/{name}")
    folder.drop("drafts")
