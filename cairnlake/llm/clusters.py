"""Grouping records into similarity clusters (problem 6).

Density peaks: within each shard a blocked join counts every vector's
neighbours of at least the wanted cosine (its density) and finds its nearest
denser neighbour; vectors without one are peaks. Following the pointers labels
every vector with a peak. Peaks whose trees touch by a link are one cluster, and
so are clusters of different shards that share a vector, so the result is the
set of vectors connected by links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage, unstage
from .components import components
from .vectors import fit_centres, fold_equal, shard_matrix, sharded

#: Vectors of a shard up to which similarities are kept between the passes, and
#: rows of a block.
KEPT, BLOCK = 5000, 1024
#: Shards of each vector; one more than for neighbour search, since a lost link may split a cluster.
COPIES = 3


def _roots(pointer: np.ndarray) -> np.ndarray:
    """Ends of all pointer chains, by jumping; ends point to themselves."""
    while True:
        far = pointer[pointer]
        if np.array_equal(far, pointer):
            return pointer
        pointer = far


def density_peaks(x: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(label, density) of unit vectors: label is the row of a cluster's densest vector.

    weight: how many equal vectors a row stands for. Rows are ranked by density,
    ties by row, so that pointers have no cycle.
    """
    n = len(x)
    kept = x @ x.T if n <= KEPT else None
    block = lambda i: kept[i : i + BLOCK] if kept is not None else x[i : i + BLOCK] @ x.T
    density = np.zeros(n)
    for i in range(0, n, BLOCK):
        density[i : i + BLOCK] = (block(i) >= least) @ weight
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-np.arange(n), density))] = np.arange(n)
    pointer = np.arange(n)
    for i in range(0, n, BLOCK):
        s = block(i)
        denser = (s >= least) & (rank[None, :] > rank[i : i + BLOCK, None])
        near = np.argmax(np.where(denser, s, -2), axis=1)
        has = denser[np.arange(len(s)), near]
        pointer[i : i + BLOCK] = np.where(has, near, pointer[i : i + BLOCK])
    label = _roots(pointer)
    # trees that touch: by links between different labels, until none is left
    if len(np.unique(label)) < n:
        for _ in range(n):
            low = label.copy()
            for i in range(0, n, BLOCK):
                own = label[i : i + BLOCK, None]
                touch = (block(i) >= least) & (label[None, :] != own)
                r, c = np.nonzero(touch)
                if len(r):
                    pair = np.unique(np.stack([label[i + r], label[c]], axis=1), axis=0)
                    np.minimum.at(low, pair[:, 0], label[pair[:, 1]])
                    np.minimum.at(low, pair[:, 1], label[pair[:, 0]])
            new = _roots(np.minimum(low, np.arange(n)))[label]
            if np.array_equal(new, label):
                break
            label = new
    return label, density


def _shard_labels(dim: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        ids, x = shard_matrix(table, dim)
        first, group = fold_equal(ids, x)
        label, density = density_peaks(x[first], np.bincount(group).astype(float), least)
        own = label[group]
        size = np.bincount(own, minlength=len(first))
        smallest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(smallest, own, ids)
        some = size[own] > 1
        return pa.table({"id": ids[some], "part": smallest[own][some], "density": density[group][some]})

    return run


def _joined(local: DataFrame) -> DataFrame:
    """(id, cluster_id, density) from the clusters of the shards (id, part, density): those that share a vector are one.

    part is the smallest id of a shard's cluster; a vector is in at most COPIES.
    """
    per = stage(local.groupBy("id").agg(F.collect_set("part").alias("parts"), F.max("density").alias("density")).select("id", F.array_min("parts").alias("part"), "parts", "density"), "labels")
    unstage(local)
    # a vector in several shards joins all their clusters; parts are far fewer than vectors
    names = components(per.select("part", F.explode("parts").alias("other")).distinct(), "part", "other")
    return per.join(names, per.part == names.node).select("id", F.col("component").alias("cluster_id"), "density")


def vector_clusters(vectors: DataFrame, id_col: str, vec: str, dim: int, least: float) -> DataFrame:
    """(id, cluster_id, density): vectors connected by links of cosine ``least`` and more.

    cluster_id is the smallest id of the cluster; vectors without link have no
    row. Unusable vectors and null ids are left out, repeated ids count once.
    Links are looked for within shards of similar vectors (a vector is in
    several); cosines are of vectors rounded to half floats.
    """
    centres = fit_centres(vectors, id_col, vec, dim)
    parts = sharded(vectors, id_col, vec, dim, centres, COPIES)
    local = stage(parts.groupBy("shard").applyInArrow(_shard_labels(dim, least), "id long, part long, density double"), "parts")
    return _joined(local)


def counted_clusters(members: DataFrame, sessions: DataFrame, id_col: str, session: str, least_size: int, least_sessions: int) -> DataFrame:
    """Members of clusters of enough vectors from enough different sessions; null sessions do not count."""
    known = sessions.filter(F.col(session).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(session).alias("_s")).distinct()
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    spread = members.join(known, "id").select("cluster_id", "_s").distinct().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("sessions"))
    keep = size.join(spread, "cluster_id").filter((F.col("size") >= least_size) & (F.col("sessions") >= least_sessions))
    return members.join(keep, "cluster_id").select("id", "cluster_id", "density", "size", "sessions")


def typical_members(counted: DataFrame, most: int = 3) -> DataFrame:
    """(cluster_id, size, sessions, rank, id): the densest members of each cluster."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("density"), "id")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("cluster_id", "size", "sessions", "rank", "id")
