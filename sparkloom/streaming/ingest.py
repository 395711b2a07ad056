"""Incremental ingestion of a folder by Structured Streaming: each file's content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.extract import MAX_BYTES, extracted

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).where(F.col("length") <= MAX_BYTES).select("path", "content")


def ingest_stream(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Extracts new files and appends documents whose content is new; a batch that is run again adds nothing.

    A batch writes to a folder of its own number, so a repeated one replaces itself; earlier content is an anti-join.
    """
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    def batch(new: DataFrame, number: int) -> None:
        docs = extracted(new).where("error is null").dropDuplicates(["content_hash"])
        if exists(target):
            seen = spark.read.parquet(target).where(F.col("batch") != number).select("content_hash")
            docs = docs.join(seen, "content_hash", "left_anti")
        docs.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
