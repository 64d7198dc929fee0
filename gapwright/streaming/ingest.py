"""Continuous conversion: raw sample files that arrive in a folder become SampleFrame rows.

The conversion keeps no state, so each file is handled once and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import RAW_SAMPLE
from ..sources.samples import convert


def arriving(spark: SparkSession, folder: str, split: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of SampleFrame rows of the JSON files that come into ``folder``."""
    raw = spark.readStream.schema(RAW_SAMPLE).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return convert(raw.withColumn("split", F.lit(split)))


def keep(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the stream as Parquet by split, and ends when what is there has been handled."""
    return stream.writeStream.partitionBy("split").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target)
