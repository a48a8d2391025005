"""Ordered folds over a key's events: running state that depends on order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utility(events: DataFrame, key: str, by: list[str], reward: Column, start: float = 0.5, step: float = 0.1) -> DataFrame:
    """(key, utility): u + step * (reward - u) over the rewards in order; null rewards change nothing.

    The recurrence is linear, so it is a weighted sum: the k-th reward from the
    end weighs step * (1 - step) ** (k - 1). Ranks come from a window that
    spills, and the sum is a partial aggregate: a key may hold any share of all rows.
    """
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in by])
    e = events.select(key, *by, reward.cast("double").alias("_r")).filter("_r is not null").withColumn("_k", F.row_number().over(back))
    g = e.groupBy(key).agg(F.sum(F.col("_r") * step * F.pow(F.lit(1 - step), F.col("_k") - 1)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return g.select(key, (F.col("_s") + start * F.pow(F.lit(1 - step), F.col("_n"))).alias("utility"))


def clamped_sum(events: DataFrame, key: str, by: list[str], value: Column, start: float, low: float, high: float, block: int = 4096) -> DataFrame:
    """(key, total): running sum in order, held between the bounds after each event.

    Adding and holding is a map x -> min(hi, max(lo, x + s)), and such maps
    compose; blocks of events are folded to one map each, then a key's maps are
    applied in order, so no task holds more than a block or a key's blocks.
    """
    w = Window.partitionBy(key).orderBy(*by)
    e = events.select(key, *by, F.coalesce(value.cast("double"), F.lit(0.0)).alias("_v")).withColumn("_n", F.row_number().over(w))
    part = e.groupBy(key, F.floor((F.col("_n") - 1) / block).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_n", "_v"))).alias("_e"))
    hold = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
    first = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    then = lambda f, x: F.struct((f["s"] + x["_v"]).alias("s"), hold(f["lo"] + x["_v"], F.lit(low), F.lit(high)).alias("lo"), hold(f["hi"] + x["_v"], F.lit(low), F.lit(high)).alias("hi"))
    maps = part.select(key, "_b", F.aggregate("_e", first, then).alias("_f"))
    g = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_b", "_f"))).alias("_m"))
    return g.select(key, F.aggregate("_m", F.lit(start), lambda x, m: hold(x + m["_f"]["s"], m["_f"]["lo"], m["_f"]["hi"])).alias("total"))


def resets(events: DataFrame, key: str, by: list[str], value: Column, bound: float) -> DataFrame:
    """(key, nudges): how often each key's running sum reached ``bound`` and started again at zero.

    Events are read in order from a sort that spills; a task holds one sum and one
    count, so a key may hold any share of all rows. Null values count as zero.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, n, seen = None, 0.0, 0, False
        for batch in batches:
            keys, counts = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not seen or k != last:
                    if seen:
                        keys.append(last)
                        counts.append(n)
                    last, total, n, seen = k, 0.0, 0, True
                total += v
                if total >= bound:
                    total, n = 0.0, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(counts, pa.int32())], names=[key, "nudges"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.column(0).type), pa.array([n], pa.int32())], names=[key, "nudges"])

    own = events.select(key, F.coalesce(value.cast("double"), F.lit(0.0)).alias("_v"), *by)
    return own.repartition(key).sortWithinPartitions(key, *by).select(key, "_v").mapInArrow(run, f"{key} {kind}, nudges int")


def every_nth(events: DataFrame, key: str, by: list[str], hit: Column, n: int, reset: Column) -> DataFrame:
    """Events at which a counter of hits since the last reset reaches a multiple of n.

    A window sum of resets cuts each key into segments, so any length is spilled.
    """
    w = Window.partitionBy(key).orderBy(*by)
    seg = events.withColumn("_segment", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    w2 = Window.partitionBy(key, "_segment").orderBy(*by)
    seg = seg.withColumn("count", F.sum(hit.cast("int")).over(w2.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return seg.filter(hit & (F.col("count") % n == 0)).drop("_segment")


def last_value(log: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """(key, value, at): the last write of each key wins."""
    return log.groupBy(key).agg(F.max(F.struct(at, tie, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col(f"m.{at}").alias(at))
