"""Sharding by sampled splitters: near-equal bytes in every shard.

Each record has a key (hash of its text, doc_id, row number), so equal texts lie next to each other and yet any
group of copies can be cut. A size-weighted sample of keys gives quantile boundaries for many small ranges; ranges
are counted exactly, and any that came out overfull is subdivided by a denser sample of its own keys. Inside each
range a running sum places every record exactly; a record goes to the shard that holds its first byte's place in
the whole order. The driver sees only the sample and the ranges' counts, both bounded by parameters.

Defined cases: null text counts as empty (size 1); a null doc_id sorts first; repeated rows are separate records; a
record larger than a shard's share fills what it fills; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import materialize

RANGES_PER_SHARD, SAMPLE_PER_RANGE, OVERFULL, ROUNDS = 32, 16, 2.0, 4


def records(docs: DataFrame) -> DataFrame:
    """What sharding needs of each record, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("k"),
        F.monotonically_increasing_id().alias("u"),
    )


def _boundaries(rows: list, step: float, weight: float) -> list[tuple[int, int, int]]:
    """Keys at which a weighted sample passes multiples of step."""
    out, seen, at = [], 0.0, step
    for h, k, u, size in sorted(rows):
        if seen >= at:
            out.append((h, k, u))
            at = (seen // step + 1) * step
        seen += max(size, weight)
    return out


def _drawn(df: DataFrame, total: int, wanted: int, seed: int) -> list:
    """A sample in which a record of size s is drawn with probability min(1, wanted * s / total)."""
    p = F.least(F.lit(1.0), F.col("size") * (wanted / max(1, total)))
    u = F.pmod(F.xxhash64("h", "k", "u", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return [tuple(r) for r in df.where(u < p).select("h", "k", "u", "size").collect()]


def assign_ranges(df: DataFrame, boundaries: list[tuple[int, int, int]]) -> DataFrame:
    """Adds range: how many boundaries are at or below a record's key."""
    if not boundaries:
        return df.withColumn("range", F.lit(0))
    firsts = np.array([b[0] for b in boundaries], dtype=np.int64)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            h = part["h"].to_numpy()
            lo, hi = np.searchsorted(firsts, h, "left"), np.searchsorted(firsts, h, "right")
            for i in np.flatnonzero(lo != hi):  # this text's hash is a boundary's: the rest of the key decides
                lo[i] = bisect_right(boundaries, (int(h[i]), int(part["k"].iat[i]), int(part["u"].iat[i])))
            part["range"] = lo.astype(np.int32)
            yield part

    return df.mapInPandas(place, StructType([*df.schema.fields, StructField("range", IntegerType())]))


def shard(docs: DataFrame, n_shards: int = 16, ranges_per_shard: int = RANGES_PER_SHARD, sample_per_range: int = SAMPLE_PER_RANGE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot."""
    rec = materialize(records(docs), "shard-records")
    total = rec.agg(F.sum("size")).first()[0] or 0
    n_ranges = n_shards * ranges_per_shard
    wanted = n_ranges * sample_per_range
    bounds = _boundaries(_drawn(rec, total, wanted, 0), total / n_ranges, total / wanted)
    for seed in range(1, ROUNDS + 1):
        ranged = assign_ranges(rec, bounds)
        counts = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        over = [r for r, (size, rows) in counts.items() if size > OVERFULL * total / n_ranges and rows > 1]
        if not over or seed == ROUNDS:
            break
        size = sum(counts[r][0] for r in over)
        share = max(1, round(n_ranges * size / total)) * sample_per_range
        inside = ranged.where(F.col("range").isin(over))
        more = _boundaries(_drawn(inside, size, 4 * share, seed), total / n_ranges, size / (4 * share))
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    before, offsets = (0, 0), []
    for r in sorted(counts):
        offsets.append((r, *before))
        before = (before[0] + counts[r][0], before[1] + counts[r][1])
    spark = docs.sparkSession
    start = spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long")  # a row per range
    w = Window.partitionBy("range").orderBy("h", "k", "u")
    placed = (
        ranged.withColumn("n", F.row_number().over(w) - 1)
        .withColumn("b", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(start), "range")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.expr(f"(bytes_before + b) * {n_shards} div {max(1, total)}"), F.lit(n_shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("n")).alias("place"),
        )
    )
    placed = materialize(placed, "shard-placed")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(n_shards)])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.element_at(starts, F.col("shard") + 1)).alias("slot"))
