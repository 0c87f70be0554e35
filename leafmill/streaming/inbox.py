"""An inbox of packages as a stream: each file is read and laid out once, with the same kernel as in a batch.

An extension of the batch queries; files that cannot be read arrive as rows with their error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources import word

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """(doc, arrived, content) of the files of a folder, as they come."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("doc"), F.col("modificationTime").alias("arrived"), "content")


def placed(stream: DataFrame) -> DataFrame:
    """Placed lines of the packages of a stream."""
    return word.word_lines(stream)


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the placed lines of all files as Parquet, each file once, also after a restart."""
    writer = placed(arriving(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Files and bytes by time of arrival, in windows; later files than the watermark allows are dropped."""
    sized = stream.select("arrived", F.octet_length("content").alias("bytes"))
    return sized.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes"))
