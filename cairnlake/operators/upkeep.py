"""Upkeep of stored rows: merging, invalidating, sweeping, operations from outside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_or_insert(near: DataFrame, new: DataFrame, stored: DataFrame, least: float, guarded: Column) -> DataFrame:
    """(id, action, into): what becomes of each new row.

    ``near``: query, id, cosine, rank (the nearest stored rows of each new one);
    ``new``, ``stored``: id and columns. A new row whose nearest stored one
    reaches ``least`` is merged into it, or skipped if that one is ``guarded``
    (a condition on ``stored``); any other is inserted.
    """
    top = near.filter((F.col("rank") == 1) & (F.col("cosine") >= least)).select(F.col("query").alias("_q"), F.col("id").alias("into"))
    kept = stored.select(F.col("id").alias("into"), F.coalesce(guarded, F.lit(False)).alias("_g"))
    j = new.select("id").join(top.join(kept, "into"), F.col("id") == F.col("_q"), "left")
    action = F.when(F.col("into").isNull(), "inserted").when(F.col("_g"), "skipped").otherwise("merged")
    return j.select("id", action.alias("action"), "into")


def first_stamp(rows: DataFrame, events: DataFrame, id_col: str, stamp: str) -> DataFrame:
    """``rows`` with ``stamp`` set where it was null, to the earliest of the events (id, at); a set one stays."""
    first = events.groupBy(F.col(id_col).alias("_id")).agg(F.min("at").alias("_at"))
    return rows.join(first, rows[id_col] == F.col("_id"), "left").withColumn(stamp, F.coalesce(stamp, "_at")).drop("_id", "_at")


def apply_operations(rows: DataFrame, ops: DataFrame, id_col: str, columns: list[str], allowed: Column, most: int) -> DataFrame:
    """``rows`` after at most ``most`` operations (op_no, op, id, columns), the first ones by number.

    ``update`` sets the columns that are not null, ``prune`` drops the row, both
    only where ``allowed``; ``add`` appends a row unless its id exists. Several
    operations on one row: the last update counts, a prune wins.
    """
    first = ops.orderBy("op_no").limit(most)
    last = first.filter("op = 'update'").groupBy(F.col("id").alias("_id")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("op_no"))).alias(f"_new_{c}") for c in columns])
    gone = first.filter("op = 'prune'").select(F.col("id").alias("_p")).distinct()
    j = rows.withColumn("_ok", F.coalesce(allowed, F.lit(False))).join(last, rows[id_col] == F.col("_id"), "left").join(gone, rows[id_col] == F.col("_p"), "left")
    j = j.filter(~(F.col("_ok") & F.col("_p").isNotNull()))
    out = j.select(*[F.when(F.col("_ok"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])
    new = first.filter("op = 'add'").groupBy("id").agg(*[F.max_by(c, "op_no").alias(c) for c in columns]).join(rows.select(F.col(id_col).alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    types = dict(rows.dtypes)
    return out.unionByName(new.select(*[F.col("id").alias(c) if c == id_col else F.col(c) if c in columns else F.lit(None).cast(types[c]).alias(c) for c in rows.columns]))


def sweep(near: DataFrame, rows: DataFrame, anchors: int, least: float, first: int, judge) -> DataFrame:
    """(id, by): stored rows that a newer one makes outdated.

    ``near``: query, id, cosine, rank for the newest live rows; ``rows``: id, at,
    live, text. The newest ``anchors`` live rows go one after the other, newest
    first; one that has been outdated meanwhile is passed over. Of the ``first``
    neighbours at or above ``least`` those older and still live are shown to
    ``judge(newer text, older text)``. A bounded set, since the order matters.
    """
    top = rows.filter("live").orderBy(F.desc("at"), "id").limit(anchors).select(F.col("id").alias("query"), F.col("at").alias("at1"), F.col("text").alias("newer"))
    order = Window.partitionBy("query").orderBy("rank")
    cut = near.filter(F.col("cosine") >= least).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= first)
    pairs = cut.join(top, "query").join(rows.filter("live").select("id", F.col("at").alias("at2"), F.col("text").alias("older")), "id").filter("at2 < at1")
    kind = dict(rows.dtypes)["id"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        gone: dict = {}
        for anchor, own in sorted(f.groupby("query"), key=lambda g: (-g[1]["at1"].iloc[0], g[0])):
            if anchor in gone:
                continue
            for r in own.sort_values("nth").itertuples():
                if r.id not in gone and judge(r.newer, r.older):
                    gone[r.id] = anchor
        return pd.DataFrame({"id": list(gone), "by": list(gone.values())})

    return pairs.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, f"id {kind}, by {kind}")


def keep_longest(entries: DataFrame, group: str, place: str, text: str, vec: str, least: float) -> DataFrame:
    """(group, place, text): of each cluster of like entries of a group the longest, the first of equally long ones.

    Entries of one memory slot: a bounded group, clustered in order.
    """
    from .cluster import clustered, greedy

    m = clustered(entries, group, place, [place], vec, lambda x: greedy(x, least))
    j = m.join(entries.select(group, place, text), [group, place])
    best = F.max_by(F.struct(place, text), F.struct(F.char_length(text), -F.col(place))).alias("b")
    return j.groupBy(group, "cluster").agg(best).select(group, F.col(f"b.{place}").alias(place), F.col(f"b.{text}").alias(text))


def like_pairs(vectors: DataFrame, id_col: str, vec: str, least: float) -> DataFrame:
    """(a, b, cosine): all pairs a < b of a bounded table (at most 4,096 rows, else an error) with cosine at least ``least``."""
    t = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).dropDuplicates(["id"]).limit(4097)
    rows = t.orderBy("id").collect()
    if len(rows) > 4096:
        raise ValueError("more than 4,096 vectors: use a neighbour search")
    x = np.array([r.v for r in rows], np.float64).reshape(len(rows), -1)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(x @ x.T, 6)
    i, j = np.nonzero(np.triu(s >= least, 1))
    return vectors.sparkSession.createDataFrame([(rows[a].id, rows[b].id, float(s[a, b])) for a, b in zip(i, j, strict=True)], "a long, b long, cosine double")
