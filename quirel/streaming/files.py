"""The same conversion on a stream of arriving files: it holds no state, so the batch operator runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirel.sources.convert import INPUT_MAX, convert

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    f = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).load(root)
    return f.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.when(F.col("length") <= INPUT_MAX, F.col("content")).alias("data"))


def convert_stream(spark: SparkSession, root: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Convert all files there are and end; run again for what has come since. Each file is converted once."""
    out = convert(stream_files(spark, root))
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
