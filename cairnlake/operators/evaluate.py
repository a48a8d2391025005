"""Evaluation of ranked lists and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_scores(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, n_gold, recall, rr, ndcg) at ``k``; queries without gold have no row.

    ``ranked``: query, id, rank; ``gold``: query, id. A query that found nothing has zeros.
    """
    g = gold.select("query", "id").distinct()
    n = g.groupBy("query").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = ranked.filter(F.col("rank") <= k).join(g, ["query", "id"]).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    j = n.join(hit, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("query", "n_gold", F.round(zero(F.col("hits") / F.col("n_gold")), 6).alias("recall"), F.round(zero(1.0 / F.col("first")), 6).alias("rr"), F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"))


def any_all_at(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, any_at, all_at): is any, are all gold ids among the first ``k``."""
    g = gold.select("query", "id").distinct()
    n = g.groupBy("query").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = ranked.filter(F.col("rank") <= k).join(g, ["query", "id"]).groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    j = n.join(hit, "query", "left")
    return j.select("query", (F.coalesce("hits", F.lit(0)) > 0).cast("int").alias("any_at"), (F.coalesce("hits", F.lit(0)) == F.col("n_gold")).cast("int").alias("all_at"))


def session_scores(ranked: DataFrame, gold: DataFrame, k: int, depth: int) -> DataFrame:
    """(query, any_at, all_at, ndcg): any and all gold ids among the first ``k``, and the gain at ``depth``."""
    return any_all_at(ranked, gold, k).join(ranking_scores(ranked, gold, depth).select("query", "ndcg"), "query")


def counted_session_scores(hits: DataFrame, sizes: DataFrame, k: int, depth: int) -> DataFrame:
    """As ``session_scores``, where gold is too much to list: ``hits`` (query, rank) are the ranks of gold ids, ``sizes`` has (query, n_gold)."""
    near, deep = F.col("rank") <= k, F.col("rank") <= depth
    h = hits.groupBy("query").agg(F.sum(near.cast("int")).alias("hits"), F.sum(F.when(deep, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    found = F.coalesce("hits", F.lit(0))
    return sizes.join(h, "query", "left").select("query", (found > 0).cast("int").alias("any_at"), (found == F.col("n_gold")).cast("int").alias("all_at"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


def arm_scores(arms: dict[str, DataFrame], gold: DataFrame, k: int) -> DataFrame:
    """(arm, queries, recall, rr, ndcg): means of ``ranking_scores`` for each named list of (query, id, rank); none without gold."""
    out = None
    for name, ranked in arms.items():
        s = ranking_scores(ranked, gold, k).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "rr", "ndcg")])
        s = s.filter("queries > 0").select(F.lit(name).alias("arm"), "*")
        out = s if out is None else out.unionByName(s)
    return out


def threshold_sweep(scored: DataFrame, truth: str, score: str, bounds: list[float]) -> DataFrame:
    """(bound, tp, fp, fn, precision, recall) of calling a row true from each bound on; ``truth`` is 0 or 1, null rows are left out."""
    rows = scored.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(F.col(truth).alias("t"), F.col(score).alias("s"), F.explode(F.array(*[F.lit(float(b)) for b in bounds])).alias("bound"))
    n = lambda c: F.sum(c.cast("int"))
    yes, true = F.col("s") >= F.col("bound"), F.col("t") == 1
    g = rows.groupBy("bound").agg(n(yes & true).alias("tp"), n(yes & ~true).alias("fp"), n(~yes & true).alias("fn"))
    rate = lambda c: F.round(F.try_divide("tp", F.col("tp") + F.col(c)), 6)
    return g.select("bound", "tp", "fp", "fn", rate("fp").alias("precision"), rate("fn").alias("recall"))


def precision_recall(labels: DataFrame, truth: str, guess: str, source: str) -> DataFrame:
    """(source, label, tp, fp, fn, precision, recall): one row per source and label seen on either side."""
    rows = labels.filter(F.col(truth).isNotNull())
    sides = rows.select(source, F.explode(F.array_distinct(F.array(truth, guess))).alias("label"), truth, guess).filter(F.col("label").isNotNull())
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    t, g = F.col(truth) == F.col("label"), F.col(guess) == F.col("label")
    agg = sides.groupBy(source, "label").agg(n(t & g).alias("tp"), n(g & ~t).alias("fp"), n(t & ~F.coalesce(g, F.lit(False))).alias("fn"))
    return agg.select(source, "label", "tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))
