"""Fusion of ranked lists and diversity re-ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import recency
from ..functions.text import word_set


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(query, id, score, rank): reciprocal rank fusion of (query, id, rank) lists.

    The first hit of a list adds 1 / (k + 1). Ties go to the smaller id.
    """
    bag = lists[0].select("query", "id", "rank")
    for other in lists[1:]:
        bag = bag.unionByName(other.select("query", "id", "rank"))
    fused = bag.repartition("query").groupBy("query", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(order))


def aged(fused: DataFrame, times: DataFrame, at: str, now: float, weight: float, half_life: float, k: int) -> DataFrame:
    """(query, id, score, rank): fused hits gently demoted for their age, before the cut at ``k``; those without a time are not.

    ``times``: id and the time ``at`` (epoch seconds).
    """
    age = F.coalesce((F.lit(now) - F.col(at)) / 86400, F.lit(0.0))
    score = F.round(F.col("score") * (1 - weight * (1 - recency(age, half_life))), 9)
    s = fused.join(times.select("id", at), "id").select("query", "id", score.alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def seeded_mmr(hits: DataFrame, score: str, text: str, balance: float, k: int) -> DataFrame:
    """(query, id, pick): the best hit, then greedily balance * score less (1 - balance) * the largest likeness to a chosen one.

    Other than in ``mmr`` the score counts as it is, words are what stands between
    white space, and two texts without words are unlike. Some dozens per query.
    """

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["s", "id"], ascending=[False, True])
        ids, scores, words = f["id"].tolist(), f["s"].tolist(), [set((t or "").lower().split()) for t in f["t"]]
        picked, left = [0], list(range(1, len(f)))
        while left and len(picked) < k:
            like = lambda i: max(len(words[i] & words[j]) / len(words[i] | words[j]) if words[i] | words[j] else 0.0 for j in picked)  # noqa: B023, E731
            best = max(left, key=lambda i: (round(balance * scores[i] - (1 - balance) * like(i), 12), -i))
            picked.append(best)
            left.remove(best)
        return pd.DataFrame({"query": [f["query"].iloc[0]] * len(picked), "id": [ids[i] for i in picked], "pick": range(1, len(picked) + 1)})

    q, i = (hits.schema[c].dataType.simpleString() for c in ("query", "id"))
    return hits.select("query", "id", F.col(score).alias("s"), F.col(text).alias("t")).groupBy("query").applyInPandas(choose, f"query {q}, id {i}, pick int")


def mmr(hits: DataFrame, text: str, balance: float, k: int) -> DataFrame:
    """(query, id, pick): greedy choice of relevance against likeness to what is chosen.

    ``hits`` has query, id, score, text; at most some dozens per query (top-k
    lists). A hit's worth is balance * score / best score minus (1 - balance) *
    its largest word-set likeness to a chosen one; two empty sets are alike.
    Ties keep the earlier hit (higher score, smaller id). balance 1 keeps order.
    """

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "id"], ascending=[False, True])
        top = f["score"].max()
        rel = (f["score"] / top if top > 0 else f["score"] * 0).tolist()
        sets, ids, left, picked = [set(w) for w in f["words"]], f["id"].tolist(), list(range(len(f))), []
        nearest = [0.0] * len(f)
        while left and len(picked) < k:
            if balance >= 1 or not picked:
                best = left[0]
            else:
                best = max(left, key=lambda i: (round(balance * rel[i] - (1 - balance) * nearest[i], 12), -i))
            left.remove(best)
            picked.append(best)
            for i in left:
                both = sets[i] | sets[best]
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / len(both) if both else 1.0)
        return pd.DataFrame({"query": [f["query"].iloc[0]] * len(picked), "id": [ids[i] for i in picked], "pick": range(1, len(picked) + 1)})

    slim = hits.select("query", "id", "score", word_set(F.col(text)).alias("words"))
    q, i = (slim.schema[c].dataType.simpleString() for c in ("query", "id"))
    return slim.groupBy("query").applyInPandas(choose, f"query {q}, id {i}, pick int")
