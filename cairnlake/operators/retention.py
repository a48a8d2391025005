"""Retention: purges that cascade, and ranked eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def purge(sessions: DataFrame, children: dict[str, DataFrame], now: float, days: float) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(kept sessions, kept children): sessions that ended strictly before the cut go, with their rows.

    Open sessions stay; child rows without a session stay. The removed ids are
    the join's side, since they are usually few; an anti join keeps the rest.
    """
    gone = sessions.filter(F.col("ended_at").isNotNull() & (F.col("ended_at") < now - days * 86400)).select("session_id").distinct()
    return sessions.join(gone, "session_id", "left_anti"), {k: c.join(gone, "session_id", "left_anti") for k, c in children.items()}


def detach(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows with ``key`` set to null where it points to something that is gone."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return rows.join(g, rows[key] == g._gone, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def evict(rows: DataFrame, id_col: str, tiers: list[tuple[Column, list[Column]]], cap: int) -> DataFrame:
    """(id, tier): at most ``cap`` rows to remove, earlier tiers first, each in its own order.

    A row falls into the first tier whose condition holds. Only the ``cap`` best
    of each tier are compared in one place.
    """
    out = None
    for t, (condition, order) in enumerate(tiers, 1):
        earlier = F.lit(False)
        for c, _ in tiers[: t - 1]:
            earlier = earlier | F.coalesce(c, F.lit(False))
        top = rows.filter(F.coalesce(condition, F.lit(False)) & ~earlier).orderBy(*order, id_col).limit(cap)
        n = Window.orderBy(*order, F.col(id_col))
        top = top.withColumn("_nth", F.row_number().over(n)).select(id_col, F.lit(t).alias("tier"), "_nth")
        out = top if out is None else out.unionByName(top)
    return out.orderBy("tier", "_nth").limit(cap).select(id_col, "tier")


def keep_best(rows: DataFrame, id_col: str, order: list[Column], cap: int) -> DataFrame:
    """The ``cap`` best rows by an order, ties by id."""
    return rows.orderBy(*order, id_col).limit(cap)


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Upsert: new rows win, but the ``keep`` columns of an old row stay; old rows without a new one stay."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_old"))
    n = new.select(key, *cols, F.lit(True).alias("_new"))
    j = o.join(n, key, "full")
    pick = [F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c in keep)), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return j.select(key, *pick)
