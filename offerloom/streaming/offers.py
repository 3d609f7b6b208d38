"""Offers from a folder that texts arrive in.

The source systems have no streams; this runs the same row-wise parser incrementally, so that a folder of incoming
messages is parsed as it fills. Nothing is held between batches: a line's offers depend on that line alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import offer_lines, parse_offer_line
from ..sources.mails import mail_text


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of each file that arrives, whole."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text")
    )


def parsed_offers(messages: DataFrame) -> DataFrame:
    """Offers of messages (path, text), streaming or not."""
    lines = offer_lines(messages.withColumn("text", mail_text(F.col("text"))))
    return parse_offer_line(lines)


def run(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parses what has arrived since the last run, each file once, and ends."""
    return parsed_offers(incoming(spark, folder)).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation",
        checkpoint
    ).trigger(availableNow=True).start()
