"""Connected components by alternating large-star and small-star steps; all of it stays distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def forest(u: list[int], v: list[int]) -> dict[int, int]:
    """The smallest node of each node's component, for the edges (u[i], v[i])."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def stars(u: list[int], v: list[int]) -> pa.RecordBatch:
    """Edges (u, v) with the same components as the given ones, at most one for each node."""
    pairs = np.array([(x, m) for x, m in forest(u, v).items() if x != m], dtype=np.int64).reshape(-1, 2)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components, as few stars: those of each batch of rows on its own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield stars(batch.column("u").to_pylist(), batch.column("v").to_pylist())

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60, contract: bool = True) -> DataFrame:
    """edges (u, v) of long, any direction, any repeats -> (node, component): the smallest node of each node that has
    an edge. Each round's edges are written to the shared folder. contract: False for edges that come as stars from a
    Python stage already; one more behind it would keep twice as many workers."""
    edges = edges.where("u != v")
    edges = materialize((contracted(edges) if contract else edges).distinct(), "cc")
    mark = _mark(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u != v").distinct(), "cc")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
