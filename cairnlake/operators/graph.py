"""Edges between records: co-use pairs, partners, links between near vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(sets: DataFrame, key: str, item: str, at: str, most: int = 64) -> DataFrame:
    """(a, b, n, last_at): pairs a < b that occur in one key, counted over keys.

    Pairs are formed within the sorted distinct items of a key, row by row; the
    few keys with more than ``most`` items go through a join on the key instead,
    whose rows are spread by item, so that no row carries a large set.
    """
    own = sets.filter(F.col(item).isNotNull()).select(F.col(key).alias("_k"), F.col(item).alias("_i"), F.col(at).alias("_at"))
    size = own.groupBy("_k").agg(F.count_distinct("_i").alias("_n"), F.max("_at").alias("at"))
    per = own.join(size.filter(F.col("_n") <= most).select("_k"), "_k", "left_semi").groupBy("_k").agg(F.array_sort(F.collect_set("_i")).alias("items"), F.max("_at").alias("at"))
    first = per.select("at", "items", F.posexplode("items").alias("i", "a"))
    few = first.select("a", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))).alias("b"), "at")
    big = own.join(size.filter(F.col("_n") > most).select("_k", "at"), "_k").select("_k", "_i", "at").distinct()
    many = big.withColumnRenamed("_i", "a").join(big.select("_k", F.col("_i").alias("b")), "_k").filter("a < b").select("a", "b", "at")
    return few.unionByName(many).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every undirected edge from either end, as (node, other, rest)."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def partners(edges: DataFrame, least: int, k: int) -> DataFrame:
    """(node, other, n, rank): the most frequent partners of each node."""
    order = Window.partitionBy("node").orderBy(F.desc("n"), "other")
    return both_ways(edges).filter(F.col("n") >= least).select("node", "other", "n").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def links(near: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine): canonical edges of (query, id, cosine) rows at or above the bound."""
    e = near.filter(F.col("cosine") >= least)
    return e.groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.max("cosine").alias("cosine"))


def older_near(near: DataFrame, times: DataFrame, least: float, first: int) -> DataFrame:
    """(newer, older, cosine): among the ``first`` best at or above the bound, those that are older.

    ``near``: query, id, cosine, rank; ``times``: id, at. The cut comes before
    the comparison of times.
    """
    order = Window.partitionBy("query").orderBy("rank")
    top = near.filter(F.col("cosine") >= least).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= first)
    t = times.select(F.col("id").alias("_id"), "at")
    j = top.join(t.select(F.col("_id").alias("query"), F.col("at").alias("t1")), "query").join(t.select(F.col("_id").alias("id"), F.col("at").alias("t2")), "id")
    return j.filter("t2 < t1").select(F.col("query").alias("newer"), F.col("id").alias("older"), "cosine")


def merged_tags(own, other, cap: int):
    """Order-keeping union of two tag arrays, at most ``cap``."""
    return F.slice(F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(other, F.array().cast("array<string>")))), 1, cap)
