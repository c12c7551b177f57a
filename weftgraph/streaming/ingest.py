"""Continuous ingestion: new statement files are parsed, filtered and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import label_index
from ..sources.ntriples import parse_lines


def statement_stream(spark: SparkSession, folder: str, mode: str = "PERMISSIVE", files_per_trigger: int = 1000) -> DataFrame:
    """Triples of text files that appear in ``folder``, with the time of each file."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    lines = lines.withColumn("seen", F.col("_metadata.file_modification_time"))
    return parse_lines(lines, "value", mode)


def statement_counts(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Statements per property and time window; windows close once data can't be later than ``late``."""
    return stream.withWatermark("seen", late).groupBy(F.window("seen", window), "p").agg(F.count("*").alias("statements"))


def matched(stream: DataFrame, index: DataFrame, domain: str) -> DataFrame:
    """Labels in the stream joined to a static label index of other domains."""
    from .. import schemas as K

    labels = stream.where(F.col("p") == K.LABEL_P).select(F.lit(domain).alias("domain"), "s", F.col("o").alias("label"))
    probe = label_index(labels).select("key", F.col("resource").alias("source"))
    build = index.where(F.col("domain") != domain).select("key", F.col("domain").alias("target_domain"), F.col("resource").alias("target"))
    return probe.join(build, "key")


def append(stream: DataFrame, path: str, checkpoint: str, by: str = "p") -> StreamingQuery:
    """Everything available now, once, into Parquet partitioned by ``by``; restarts go on where it stopped."""
    return stream.writeStream.format("parquet").partitionBy(by).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
