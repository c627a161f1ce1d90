"""Neighbours and running sums in the order of a key, in runs of CHUNK order values, so that a key with very many rows isn't one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def _chunk(order: str) -> Column:
    return F.floor(F.col(order) / CHUNK)


def neighbours(df: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """df with prev_<name> and next_<name> of each value: that of the row before and after in the order of the key, null at its ends.

    Within a chunk this is lag and lead; at its edges the last row of the chunk before and the first of the chunk after are taken from
    a table of one row per chunk.
    """
    names = list(values)
    df = df.withColumns({"_chunk": _chunk(order), "_v": F.struct(*(v.alias(n) for n, v in values.items()))})
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    df = df.withColumns({"_p": F.lag("_v").over(w), "_n": F.lead("_v").over(w)})
    edge = df.groupBy(key, "_chunk").agg(F.min_by("_v", order).alias("_first"), F.max_by("_v", order).alias("_last"))
    by_chunk = Window.partitionBy(key).orderBy("_chunk")
    edge = edge.select(key, "_chunk", F.lag("_last").over(by_chunk).alias("_before"), F.lead("_first").over(by_chunk).alias("_after"))
    out = df.join(edge, [key, "_chunk"])
    cols = {f"prev_{n}": F.coalesce(F.col("_p"), F.col("_before"))[n] for n in names} | {f"next_{n}": F.coalesce(F.col("_n"), F.col("_after"))[n] for n in names}
    return out.withColumns(cols).drop("_chunk", "_v", "_p", "_n", "_before", "_after")


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows of the key up to each row."""
    df = df.withColumns({"_chunk": _chunk(order), "_x": value.cast("long")})
    sums = df.groupBy(key, "_chunk").agg(F.sum("_x").alias("_s"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(key, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum("_x").over(w)).join(start, [key, "_chunk"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_chunk", "_x", "_in", "_start")
