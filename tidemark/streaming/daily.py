"""Daily mention counts of a stream of mentions, with a watermark for late posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts_stream(events: DataFrame, entity: str = "entity_id", time: str = "timestamp_utc", late: str = "1 day") -> DataFrame:
    """(entity, date, mention_count): a day is final, in append mode, once the watermark has passed it."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, "1 day"), entity).agg(F.count(F.lit(1)).alias("mention_count")).select(entity, F.col("window.start").cast("date").alias("date"), "mention_count")
