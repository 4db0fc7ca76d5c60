"""Places: stations near events and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.intervals import reached_labels


def merge_stations(df: DataFrame, name: str, lines: str) -> DataFrame:
    """one row per station name with the sorted union of its lines.

    Pairs are made distinct first, so a list holds at most the network's lines.
    """
    pairs = df.select(name, F.explode(lines).alias("_l")).filter("_l is not null").distinct()
    return pairs.groupBy(name).agg(F.array_join(F.array_sort(F.collect_list("_l")), ", ").alias(lines))


def affected_stations(events: DataFrame, stations: DataFrame, event_id: str, name: str, lines: str, metres: float = 500.0) -> DataFrame:
    """J12+F21: stations within reach of each event, with their lines."""
    pairs = reached_labels(events, stations.withColumn("_l", F.explode(lines)), metres, [event_id], [name, "_l"])
    return pairs.groupBy(event_id, name).agg(F.array_join(F.array_sort(F.collect_list("_l")), ", ").alias(lines))
