"""Most similar vectors for every vector (problem 2).

Each shard gets a robust-pruned directed graph: candidates of every vector are
pruned with a relaxed distance, so that its edges lead in different directions,
and a few long edges keep the graph in one piece. Vectors query the graph by
greedy beam search, those of the shard from their own node, others from a spread
of entry nodes; results of the shards are merged.

Candidates are proposed by a blocked product within the shard. Proposals by
greedy search over the growing graph were tried first and lost six of ten
neighbours on this data: groups of a few vectors lie at right angles to all
others, and no path leads to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .vectors import fit_centres, fold_equal, shard_matrix, sharded

#: Edges of a point (of these long ones), candidates before pruning, width of a
#: beam, relaxation of the pruning distance, entry nodes.
EDGES, LONG, PROPOSED, BEAM, ALPHA, ENTRIES = 20, 4, 32, 24, 1.2, 32
#: Rows of a block of similarities.
BLOCK = 1024
#: Share of the shards that a foreign query visits, and the fewest. A vector at
#: right angles to all others has its nearest anywhere, so a fixed number of
#: shards loses recall as the index grows.
PROBED, PROBES = 0.5, 24
#: Ids up to which the asked vectors are picked at the scan (8 MB); more are joined by shuffle.
SENT = 500_000


class Graph:
    """A robust-pruned graph over unit vectors."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.x, n = x, len(x)
        rng = np.random.default_rng(seed)
        self.entries = rng.permutation(n)[:ENTRIES].astype(np.int32)
        near = EDGES - LONG
        self.out = np.full((n, EDGES), -1, np.int32)
        self.out[:, near:] = rng.integers(0, n, (n, LONG))
        self.best = np.full(n, -2.0, np.float32)  # similarity of each point's nearest
        take = min(PROPOSED, n - 1)
        for i in range(0, n if take > 0 else 0, BLOCK):
            s = x[i : i + BLOCK] @ x.T
            rows = np.arange(len(s))
            s[rows, rows + i] = -np.inf
            ids = np.argpartition(-s, take - 1, axis=1)[:, :take].astype(np.int32)
            score = np.take_along_axis(s, ids, axis=1)
            by = np.argsort(-score, axis=1, kind="stable")
            self.best[i : i + BLOCK] = score.max(axis=1)
            self.out[i : i + BLOCK, :near] = self._prune(np.take_along_axis(ids, by, axis=1), np.take_along_axis(score, by, axis=1), near)

    def _prune(self, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Robust pruning of candidates (best first) to at most ``most``.

        A candidate falls if one already kept is closer to it, by the factor
        ALPHA, than the point itself is.
        """
        kept = np.full((len(ids), most), -1, np.int32)
        v = self.x[ids]
        between = 2 - 2 * (v @ v.transpose(0, 2, 1))
        far = 2 - 2 * score
        open_ = np.ones(ids.shape, bool)
        rows = np.arange(len(ids))
        for k in range(min(most, ids.shape[1])):
            pick = np.argmax(open_, axis=1)
            there = open_[rows, pick]
            if not there.any():
                break
            kept[there, k] = ids[rows, pick][there]
            open_ &= ALPHA * between[rows, pick] > far
            open_[rows, pick] = False
        return kept

    def search(self, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, of beam searches for vectors q from their start nodes; -1 pads."""
        step = max(1, min(2048, 40_000_000 // max(len(self.x), 1)))  # bounds the table of nodes seen
        parts = [self._search(q[i : i + step], start[i : i + step], beam) for i in range(0, max(len(q), 1), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        sim = q @ self.x.T  # one product; the walk below decides which entries count
        seen = np.zeros((n, len(self.x)), bool)
        wide = max(beam, start.shape[1])
        ids = np.full((n, wide), -1, np.int32)
        ids[:, : start.shape[1]] = start
        score = np.where(ids >= 0, np.take_along_axis(sim, np.maximum(ids, 0), axis=1), -np.inf).astype(np.float32)
        np.put_along_axis(seen, start.astype(np.int64), True, axis=1)
        fresh = ids >= 0
        live = np.arange(n)
        while len(live):
            best = np.argmax(np.where(fresh[live], score[live], -np.inf), axis=1)
            going = fresh[live, best]
            live, best = live[going], best[going]
            if not len(live):
                break
            fresh[live, best] = False
            near = self.out[ids[live, best]]
            at = np.maximum(near, 0)
            known = (near < 0) | seen[live[:, None], at]
            seen[live[:, None], at] |= near >= 0
            s = np.where(known, -np.inf, sim[live[:, None], at])
            all_s = np.concatenate([score[live], s], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live, :beam] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), top, axis=1)
            fresh[live, :beam] = np.take_along_axis(np.concatenate([fresh[live], ~known], axis=1), top, axis=1)
            score[live, :beam] = np.take_along_axis(all_s, top, axis=1)
            fresh[live, beam:], score[live, beam:] = False, -np.inf
        by = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, by, axis=1), np.take_along_axis(score, by, axis=1)
        # long edges may lead twice to one node
        first = np.zeros(ids.shape, bool)
        order = np.argsort(ids, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(ids, order, axis=1)
        np.put_along_axis(first, order, np.concatenate([np.ones((n, 1), bool), sorted_ids[:, 1:] != sorted_ids[:, :-1]], axis=1), axis=1)
        return np.where(np.isfinite(score) & first, ids, -1), score


def _answers(g: Graph, ids: np.ndarray, group: np.ndarray, q: np.ndarray, start: np.ndarray, asks: np.ndarray, k: int, least: float):
    """(asking id, other id, cosine) of the k nearest; ids, group: members of each node."""
    near, score = g.search(q, start, BEAM)
    ok = (near >= 0) & (score >= least)
    i, j = np.nonzero(ok)
    node, sim, who = near[i, j], score[i, j], asks[i]
    # a node stands for its members: at most k + 1 of them can be wanted
    by = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=len(g.x))
    begin = np.cumsum(size) - size
    out = []
    for r in range(int(min(k + 1, size.max()))):
        have = size[node] > r
        other = ids[by[begin[node[have]] + r]]
        out.append((who[have], other, sim[have]))
    a, b, s = (np.concatenate([o[m] for o in out]) for m in range(3))
    ok = a != b
    a, b, s = a[ok], b[ok], s[ok]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    nth = np.arange(len(a)) - np.repeat(edge, np.diff(np.append(edge, len(a))))
    return a[nth < k], b[nth < k], s[nth < k]


def _shard_neighbours(dim: int, k: int, least: float, own_ask: bool):
    def run(table: pa.Table) -> pa.Table:
        foreign = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        own = table.filter(pa.array(~foreign))
        empty = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if not own.num_rows or not (own_ask or foreign.any()):
            return empty
        ids, x = shard_matrix(own, dim)
        first, group = fold_equal(ids, x)
        g = Graph(x[first])
        if not own_ask:
            asks, q = shard_matrix(table.filter(pa.array(foreign)), dim)
            start = np.tile(g.entries, (len(asks), 1))
            a, b, s = _answers(g, ids, group, q, start, asks, k, least)
        else:
            # equal vectors search once and answer for every member; a point without
            # a neighbour of the wanted similarity among its candidates has none
            nodes = np.flatnonzero((g.best >= least) | (np.bincount(group, minlength=len(first)) > 1))
            a, b, s = _answers(g, ids, group, g.x[nodes], nodes[:, None].astype(np.int32), ids[first][nodes], k, least)
            by = np.argsort(group, kind="stable")
            size = np.bincount(group)
            if size.max() > 1:
                begin, nth = np.cumsum(size) - size, np.arange(len(by))
                node_of = dict(zip(ids[first].tolist(), range(len(first)), strict=True))
                src = np.array([node_of[i] for i in a.tolist()], np.int64)
                more = size[src] > 1
                extra = [(ids[by[begin[n] + 1 : begin[n] + size[n]]], b_, s_) for n, b_, s_ in zip(src[more], b[more], s[more], strict=True)]
                # members of a group: the next k of the group, cyclically
                place = nth - begin[group[by]]
                for gap in range(1, min(k, int(size.max()) - 1) + 1):
                    some = size[group[by]] > gap
                    m = by[some]
                    extra.append((ids[m], ids[by[begin[group[m]] + (place[some] + gap) % size[group[m]]]], 1.0))
                a = np.concatenate([a, *(e[0] for e in extra)])
                b = np.concatenate([b, *(np.broadcast_to(e[1], e[0].shape) for e in extra)])
                s = np.concatenate([s, *(np.broadcast_to(e[2], e[0].shape) for e in extra)])
                ok = a != b
                a, b, s = a[ok], b[ok], s[ok]
        return pa.table({"id": a, "other": b, "cosine": np.asarray(s, np.float64)})

    return run


def neighbours(vectors: DataFrame, id_col: str, vec: str, dim: int, k: int = 10, least: float = -2.0, every: int | None = None) -> DataFrame:
    """(id, other, cosine, rank): the k most similar other vectors, found by index.

    ``least``: neighbours below it are not wanted; ``every``: only ids divisible
    by it ask, each in its nearest PROBED of the shards; None: all vectors ask, each in
    its own shards. All rows are indexed. Vectors that are not of ``dim`` finite
    numbers or all zero are left out, null ids too; repeated ids count once; ties
    go to the smaller id. The measured loss is in the README. Cosines are of
    vectors rounded to half floats, within 0.0005.
    """
    centres = fit_centres(vectors, id_col, vec, dim)
    parts = sharded(vectors, id_col, vec, dim, centres).withColumn("asks", F.lit(False))
    if every is not None:
        asking = vectors.filter(F.pmod(F.col(id_col), F.lit(every)) == 0)
        parts = parts.unionByName(sharded(asking, id_col, vec, dim, centres, max(PROBES, int(np.ceil(PROBED * len(centres))))).withColumn("asks", F.lit(True)))
    found = parts.groupBy("shard").applyInArrow(_shard_neighbours(dim, k, least, every is None), "id long, other long, cosine double")
    best = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_vector_pairs(vectors: DataFrame, id_col: str, vec: str, dim: int, least: float, k: int = 10) -> DataFrame:
    """(a, b): pairs, smaller id first, of cosine at least ``least`` where one is among the other's k nearest.

    Pairs within 0.001 of the bound are decided on the vectors as given.
    """
    edge = 0.001
    near = neighbours(vectors, id_col, vec, dim, k, least - edge)
    pairs = near.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("cosine").alias("cosine"))
    pairs = stage(pairs, "pairs")
    sure = F.col("cosine") >= least + edge
    close = pairs.filter(~sure).select("a", "b")
    asked = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    if 2 * close.count() <= SENT:
        asked = F.broadcast(asked)  # so that only the asked vectors are shuffled
    full = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).join(asked, "id", "left_semi")
    full = full.filter(F.size("v") == dim).select("id", F.transform("v", lambda e: e.cast("double")).alias("v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    exact = close.join(full.select(F.col("id").alias("a"), F.col("v").alias("u")), "a").join(full.select(F.col("id").alias("b"), F.col("v").alias("w")), "b")
    exact = exact.filter(dot("u", "w") / F.sqrt(dot("u", "u") * dot("w", "w")) >= least).select("a", "b").distinct()
    return pairs.filter(sure).select("a", "b").unionByName(exact)
