"""Logs as tables: ingest from pushes and files, storage as Parquet by day, compaction, retention."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timberline.functions.text_udfs import extra_labels
from timberline.functions.values import level_of
from timberline.operators.templates import Templates
from timberline.sources import push

MOST_BYTES, FRAME, ROWS_PER_FILE = 4_064, 27, 5_000_000
SCHEMA = "_schema.json"  # beside a table: its columns, so that reading it opens no footers


def overlay(stream: Column, metadata: Column) -> Column:
    """Stream labels under an entry's own metadata."""
    own = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    base = F.coalesce(stream, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def decode_push(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Push bodies (JSON) -> ts_ns, level, service, line, extra, labels of those that are not refused."""
    return log_rows(push.entries(push.read_pushes(bodies, column)))


def log_rows(rows: DataFrame) -> DataFrame:
    """Rows (ts_ns, line, labels or extra, ...) with every column a log has."""
    if "labels" not in rows.columns:
        rows = rows.withColumn("labels", extra_labels("extra"))
    if "extra" not in rows.columns:
        rows = rows.withColumn("extra", F.to_json("labels"))
    if "level" not in rows.columns:
        rows = rows.withColumn("level", F.coalesce(level_of(F.col("labels")["level"]), F.lit(1).cast("tinyint")))
    if "service" not in rows.columns:
        rows = rows.withColumn("service", F.lit("").cast("string"))
    return rows.select("ts_ns", "level", "service", "line", "extra", "labels", *[c for c in ("tenant", "ingested_at") if c in rows.columns])


def sized(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit a record, and those that don't."""
    size = F.octet_length("line") + F.octet_length(F.coalesce("extra", F.lit(""))) + FRAME
    return rows.where(size <= MOST_BYTES), rows.where(size > MOST_BYTES)


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date(F.timestamp_micros(F.expr("ts_ns div 1000"))))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _known_schema(spark: SparkSession, path: str) -> StructType | None:
    fs, at = _file(spark, f"{path}/{SCHEMA}")
    if not fs.exists(at):
        return None
    opened = fs.open(at)
    try:
        return StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")))
    finally:
        opened.close()


def _note_schema(spark: SparkSession, path: str, schema: StructType) -> None:
    """Adds columns to the table's; a column that is there keeps its place, with the newest metadata."""
    old, names = _known_schema(spark, path), {f.name for f in schema}
    merged = StructType([*(next(f for f in schema if f.name == o.name) if o.name in names else o for o in (old or [])), *(f for f in schema if old is None or f.name not in old.names)])
    fs, at = _file(spark, f"{path}/{SCHEMA}")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(merged.jsonValue()).encode()))
    out.close()


def store(rows: DataFrame, path: str, templates: Templates | None, mode: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes rows partitioned by day, in ranges of (day, time): a day is as many tasks and files as its rows need, and
    each file's times lie close together. Fields are read after the shuffle, once, by spark.sql.shuffle.partitions tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = with_day(log_rows(rows)).repartitionByRange(parts, "day", "ts_ns").sortWithinPartitions("day", "ts_ns")
    stored = (templates or Templates()).materialize(ranged)
    writer = stored.write.mode(mode).partitionBy("day").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    _note_schema(rows.sparkSession, path, stored.schema)


def ingest(rows: DataFrame, path: str, templates: Templates | None = None, mode: str = "append") -> DataFrame:
    """Adds rows to the table at path, typed fields materialised. Rows too large for a record are not stored but given
    back."""
    fit, large = sized(log_rows(rows))
    store(fit, path, templates, mode)
    return large


def load(spark: SparkSession, path: str, templates: Templates | None = None) -> DataFrame:
    """The table at path. Columns of fields keep the pattern they were read with, in their metadata. A table without
    its schema beside it is read by its footers."""
    schema = _known_schema(spark, path)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", "true").parquet(path)


def compact(spark: SparkSession, path: str, to: str, templates: Templates | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes the table again in files of many rows, in order of time, with fields as today's patterns read them."""
    store(log_rows(load(spark, path)), to, templates, "overwrite", rows_per_file)


def expire(spark: SparkSession, path: str, before: dt.date) -> list[str]:
    """Deletes the partitions of days before the given one; what went is returned."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < before.isoformat():
            fs.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of JSON lines {ts_ns, labels, line, level}."""
    rows = spark.read.schema("ts_ns bigint, labels map<string,string>, line string, level string").json(path)
    return log_rows(rows.withColumn("level", F.coalesce(level_of(F.col("level")), F.lit(1).cast("tinyint"))))


def _seconds(ns: Column) -> Column:
    """Nanoseconds as a JSON number of seconds."""
    part = F.pmod(ns, F.lit(10**9))
    whole = ((ns - part) / F.lit(10**9)).cast("decimal(20,0)")
    return F.concat(whole.cast("string"), F.when(part != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 9, "0"), "0+$", ""))).otherwise(""))


def plain_number(value: Column) -> Column:
    """A double as text without an exponent, in the fewest digits that give it back."""
    text = value.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(text, "^-", "")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[0-9.]+", 0), r"\.", ""), "^$", "0")
    point = F.length(F.regexp_extract(bare, r"^([0-9]+)", 1)) + F.coalesce(F.regexp_extract(bare, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    padded = F.concat(zeros(1 - point), digits, zeros(point - F.length(digits)))
    at = F.greatest(point, F.lit(1))
    whole, rest = F.substring(padded, F.lit(1), at), F.regexp_replace(F.substring(padded, at + 1, F.length(padded)), "0+$", "")
    number = F.concat(sign, F.regexp_replace(whole, "^0+(?=[0-9])", ""), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").otherwise(number)


def _point(ns: Column, value: Column) -> Column:
    return F.concat(F.lit("["), _seconds(ns), F.lit(',"'), plain_number(value), F.lit('"]'))


def matrix(rows: DataFrame) -> DataFrame:
    """Metric results (series, ts_ns, value) -> json, an object a series: metric, and values [seconds, number as text]."""
    point = F.struct("ts_ns", _point(F.col("ts_ns"), F.col("value")).alias("p"))
    one = rows.groupBy("series").agg(F.sort_array(F.collect_list(point)).alias("points"))
    return one.select(F.concat(F.lit('{"metric":'), "series", F.lit(',"values":['), F.array_join(F.col("points")["p"], ","), F.lit("]}")).alias("json"))


def vector(rows: DataFrame) -> DataFrame:
    """Metric results of one time -> json, an object a series: metric, and value [seconds, number as text]."""
    return rows.select(F.concat(F.lit('{"metric":'), "series", F.lit(',"value":'), _point(F.col("ts_ns"), F.col("value")), F.lit("}")).alias("json"))


def stream_objects(grouped: DataFrame) -> DataFrame:
    """What `streams` of a log query gives -> json, an object a stream: its labels, and values [nanoseconds as text, line]."""
    return grouped.select(F.concat(F.lit('{"stream":'), "stream", F.lit(',"values":'), F.to_json("values"), F.lit("}")).alias("json"))
