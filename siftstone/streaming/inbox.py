"""A folder as an inbox: files are identified as they come, and repeats are dropped. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shipping import ship
from ..operators.identity import identity

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of identity rows of the files that appear below ``path``."""
    source = ship(spark).readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path)
    files = source.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("modificationTime").alias("arrived"))
    ident = identity(files, entropy=False)
    return ident.withColumn("arrived", F.current_timestamp())


def first_seen(stream: DataFrame, within: str | None = None) -> DataFrame:
    """The first file of each SHA-256. With ``within`` (an interval) the state of older hashes is dropped, so it stays bounded."""
    if within:
        return stream.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["sha256"])
    return stream.dropDuplicates(["sha256"])


def start(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet; a restart goes on from the checkpoint without repeats."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
