"""Which labels and series there are, and figures about what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.metric import canonical


def _allowed(logs: DataFrame, keys: list[str]) -> DataFrame:
    allow = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    return logs.select(F.map_filter("labels", lambda k, _: F.array_contains(allow, k)).alias("labels"))


def labels(logs: DataFrame, keys: list[str]) -> DataFrame:
    """The listed label keys that occur, sorted."""
    return _allowed(logs, keys).select(F.explode(F.map_keys("labels")).alias("label")).distinct().orderBy("label")


def label_values(logs: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """The values of a listed key, sorted; none for a key not listed."""
    source = logs if key in keys else logs.limit(0)
    return source.select(F.col("labels")[key].alias("value")).where("value is not null").distinct().orderBy("value")


def series(logs: DataFrame, keys: list[str]) -> DataFrame:
    """The different non-empty sets of listed labels."""
    sets = _allowed(logs, keys).where(F.size("labels") > 0)
    return sets.select(canonical(F.col("labels")).alias("series")).distinct().orderBy("series")


def index_stats(logs: DataFrame) -> DataFrame:
    """streams, entries and a nominal size of 120 bytes an entry."""
    return logs.agg(F.countDistinct(canonical(F.col("labels"))).alias("streams"), F.count("*").alias("entries"), (F.count("*") * 120).alias("bytes"))
