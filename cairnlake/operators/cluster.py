"""Greedy, order-dependent clustering of bounded sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(x: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers: in order, join the closest centroid of at least ``least``, else open one.

    A centroid is the normalised running mean of its members.
    """
    centroids = np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    sums, out = centroids.copy(), np.zeros(len(x), np.int64)
    for i, v in enumerate(x):
        s = centroids @ v if len(centroids) else np.zeros(0)
        best = int(np.argmax(np.round(s, 9))) if len(s) else -1
        if best >= 0 and round(float(s[best]), 9) >= least:
            sums[best] += v
            n = np.linalg.norm(sums[best])
            centroids[best] = sums[best] / n if n else sums[best]
            out[i] = best
        else:
            sums, centroids = np.vstack([sums, v]), np.vstack([centroids, v])
            out[i] = len(centroids) - 1
    return out


def anchored(x: np.ndarray, least: float, most: int, fewest: int = 2) -> np.ndarray:
    """Cluster numbers by anchors, no centroids: a free row gathers later free rows
    of at least ``least`` up to ``most`` members; groups below ``fewest`` are -1."""
    out, number = np.full(len(x), -1, np.int64), 0
    taken = np.zeros(len(x), bool)
    for i in range(len(x)):
        if taken[i]:
            continue
        near = [j for j in range(i + 1, len(x)) if not taken[j] and round(float(x[i] @ x[j]), 9) >= least][: most - 1]
        if len(near) + 1 >= fewest:
            for j in (i, *near):
                out[j], taken[j] = number, True
            number += 1
    return out


def clustered(rows: DataFrame, group: str, id_col: str, order: list[str], vec: str, assign: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(group, id, cluster): ``assign`` run over each group's unit vectors in order.

    For capped sets (the newest some hundred rows of a group), not whole tables:
    the method depends on order and can't be split.
    """
    g, i = (rows.schema[c].dataType.simpleString() for c in (group, id_col))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        x = np.array(f[vec].tolist(), np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        return pd.DataFrame({group: f[group].to_numpy(), id_col: f[id_col].to_numpy(), "cluster": assign(x)})

    return rows.select(*dict.fromkeys([group, id_col, *order, vec])).groupBy(group).applyInPandas(run, f"{group} {g}, {id_col} {i}, cluster long")


def siblings(hits: DataFrame, vec: str, least: float, k: int) -> DataFrame:
    """(query, id, head, pick): in rank order, a hit like a kept one (cosine) becomes its sibling.

    ``hits``: query, id, rank and a vector; some dozens per query. At most ``k``
    heads are kept; head is the id a hit stands under, pick its head's place.
    """
    q, i = (hits.schema[c].dataType.simpleString() for c in ("query", "id"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        kept: list[tuple[object, np.ndarray]] = []
        rows = []
        for one, v in zip(f["id"], f[vec], strict=True):
            v = np.asarray(v, np.float64)
            v = v / max(np.linalg.norm(v), 1e-12)
            like = next((p for p, (_, h) in enumerate(kept) if round(float(h @ v), 9) >= least), None)
            if like is not None:
                rows.append((f["query"].iloc[0], one, kept[like][0], like + 1))
            elif len(kept) < k:
                kept.append((one, v))
                rows.append((f["query"].iloc[0], one, one, len(kept)))
        return pd.DataFrame(rows, columns=["query", "id", "head", "pick"])

    return hits.select("query", "id", "rank", vec).groupBy("query").applyInPandas(run, f"query {q}, id {i}, head {i}, pick int")


def cluster_summary(members: DataFrame, session: str, least_size: int, least_sessions: int) -> DataFrame:
    """(cluster, size, sessions): clusters of enough members from enough sessions."""
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.countDistinct(session).alias("sessions")).filter((F.col("size") >= least_size) & (F.col("sessions") >= least_sessions))
