"""Streaming ingest and live tail. Nothing is dropped: a slow reader falls behind instead."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.values import QueryError
from timberline.operators.predicates import Scope, all_of
from timberline.operators.templates import Templates
from timberline.plans.ast import LogExpr
from timberline.plans.logql import parse
from timberline.plans.translate import translate
from timberline.sources import push
from timberline.sources.logs import log_rows, sized, with_day


def ingest_stream(bodies: DataFrame, path: str, rejected: str, checkpoint: str, templates: Templates | None = None, **trigger):
    """A stream of push bodies into the table at path; entries too large and bodies that were refused go to `rejected`. A
    batch is decoded once and written under its own number, so one that is tried again replaces what it wrote before.
    Returns the running query."""
    templates = templates or Templates()

    def write(batch: DataFrame, number: int) -> None:
        pushes = push.read_pushes(batch).persist()
        try:
            rows = log_rows(push.entries(pushes)).withColumn("ingested_at", F.lit(time.time_ns()))
            fit, large = sized(rows)
            stored = with_day(templates.materialize(log_rows(fit))).withColumn("batch", F.lit(number).cast("long")).sortWithinPartitions("ts_ns")
            replace = lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            replace(stored.write).partitionBy("batch", "day").parquet(path)
            turned_away = large.select("ts_ns", "line", F.lit("too large").alias("error")).unionByName(push.refused(pushes).select(F.lit(None).cast("long").alias("ts_ns"), F.col("body").alias("line"), "error"))
            replace(turned_away.withColumn("batch", F.lit(number).cast("long")).write).partitionBy("batch").parquet(rejected)
        finally:
            pushes.unpersist()

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tail(spark: SparkSession, path: str, text: str, templates: Templates | None = None, since_ns: int | None = None, schema=None, files_per_batch: int = 100) -> DataFrame:
    """A streaming DataFrame of the rows that match a log query and were ingested from now (or since_ns) on."""
    q = parse(text)
    if not isinstance(q, LogExpr):
        raise QueryError("a metric query has no tail")
    t = translate(q, templates)
    schema = schema or spark.read.parquet(path).schema
    logs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if "ingested_at" in logs.columns:
        logs = logs.where(F.col("ingested_at") >= (time.time_ns() if since_ns is None else since_ns))
    logs = t.program.extend(logs)
    return logs.where(all_of(t.predicates, Scope(logs, templates or Templates())))
