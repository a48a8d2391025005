"""Filling fixed-capacity containers with items (problem 9).

Only the histogram of lengths (at most ``capacity`` bins, whatever the corpus)
comes to the driver. There shallow combinations of lengths that fill a container
are enumerated and their repeat counts solved against the histogram by
non-negative least squares, rounded down and the rest packed greedily, still on
the histogram. The plan is a list of rank intervals by length; every item finds
its container from its rank among the items of its length, in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .tokens import count_tokens

#: Ranks are counted within (hash bucket, length), so that a length that a third
#: of all items have is still spread over this many groups.
BUCKETS = 256


def _combinations(lengths: np.ndarray, capacity: int, slack: int, most: int) -> list[tuple[int, ...]]:
    """Combinations of at most three of the lengths that fill capacity to within slack."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    best_under = np.zeros(capacity + 1, int)  # the largest length that is there, at most i
    for i in range(1, capacity + 1):
        best_under[i] = i if have[i] else best_under[i - 1]
    found: set[tuple[int, ...]] = set()
    for a in lengths[::-1]:
        if a >= capacity - slack:
            found.add((int(a),))
        b = best_under[capacity - a]
        if b and a + b >= capacity - slack:
            found.add(tuple(sorted((int(a), int(b)), reverse=True)))
    step = max(1, len(lengths) // most)
    for a in lengths[::-1][::step]:
        for b in lengths[lengths <= min(a, capacity - a)][::-1][::step]:
            c = best_under[capacity - a - b]
            if c and a + b + c >= capacity - slack:
                found.add(tuple(sorted((int(a), int(b), int(c)), reverse=True)))
    return sorted(found, reverse=True)


def _nnls(combos: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with small weighted squares of (A x - counts), A sparse.

    Multiplicative updates keep x non-negative; long items weigh more, since an
    unplaced long item costs more space.
    """
    rows = np.concatenate([np.array(c) for c in combos])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    weight = np.arange(len(counts), dtype=float)
    b = weight * counts
    up = np.bincount(cols, weight[rows] * b[rows], len(combos))
    x = np.bincount(cols, counts[rows], len(combos)) / np.bincount(cols, minlength=len(combos)) / max(1.0, len(combos) / max(1, np.count_nonzero(counts)))
    for _ in range(rounds):
        fit = weight * np.bincount(rows, x[cols], len(counts))
        down = np.bincount(cols, weight[rows] * fit[rows], len(combos))
        x *= up / np.maximum(down, 1e-12)
    return x


def plan_containers(counts: np.ndarray, capacity: int, slack: int = 8, most: int = 160) -> list[tuple[tuple[int, ...], int]]:
    """(combination of lengths, repeats) that place every counted item once.

    ``counts[n]``: items of length n, 1 <= n <= capacity. Solved combinations
    first, then what is left by greedy best fit over the histogram.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], times: int) -> None:
        kinds, need = np.unique(combo, return_counts=True)
        times = int(min(times, (left[kinds] // need).min()))
        if times > 0:
            left[kinds] -= need * times
            plan.append((combo, times))

    lengths = np.flatnonzero(left)
    if len(lengths):
        combos = _combinations(lengths, capacity, slack, most)
        if combos:
            x = _nnls(combos, left.astype(float))
            for i in np.argsort(-x, kind="stable"):
                if x[i] < 1:
                    break
                use(combos[i], int(x[i]))
    # the rest: the longest item left, then always the longest that still fits;
    # a pattern is repeated for as long as its items last
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        combo, room, own = [], capacity, left.copy()
        while True:
            i = np.searchsorted(there, room, "right") - 1
            while i >= 0 and own[there[i]] == 0:
                i -= 1
            if i < 0:
                break
            n = int(there[i])
            if len(combo) >= 2 and room <= 3 * int(there[max(i, 0)]) and n != room:
                pair = _best_pair(there, own, room)
                if pair and sum(pair) > n:
                    for p in pair:
                        own[p] -= 1
                    combo += pair
                    room -= sum(pair)
                    continue
            own[n] -= 1
            combo.append(n)
            room -= n
        use(tuple(combo), max(1, int(left[there[-1]])))


def _best_pair(there: np.ndarray, own: np.ndarray, room: int) -> list[int]:
    """The two lengths left whose sum comes closest to the room."""
    fit = there[(there < room) & (own[there] > 0)]
    if not len(fit):
        return []
    j = np.searchsorted(fit, room - fit, "right") - 1
    ok = j >= 0
    a, b = fit[ok], fit[j[ok]]
    twice = (a == b) & (own[a] < 2)
    a, b = a[~twice], b[~twice]
    if not len(a):
        return []
    k = int(np.argmax(a + b))
    return [int(a[k]), int(b[k])]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """(id, piece_no, container_id, n_tokens): every document placed exactly once.

    A text of more than ``capacity`` tokens is split: full containers of its own
    and a rest that is packed like any other item; only such a text has
    piece_no above 0. Empty and null texts are not placed. Rows that share an id
    are all placed (ids are expected to be unique). Container ids are 0..n-1.
    """
    lens = stage(count_tokens(docs, id_col, text, vocabulary).filter("tokens > 0"), "lens")
    return pack_items(lens, id_col, "tokens", capacity)


def pack_items(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """As ``pack_documents``, for items of known size; sizes below 1 or null are left out."""
    size = F.col(size_col).cast("long")
    whole = F.greatest((size - 1) / capacity, F.lit(0)).cast("long")  # containers that the item fills alone
    base = items.filter(size > 0).select(F.col(id_col).alias("id"), size.alias("size"), whole.alias("whole"))
    rest = base.select("id", F.col("whole").alias("piece_no"), (F.col("size") - F.col("whole") * capacity).cast("int").alias("n"), F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    per = rest.groupBy("bucket", "n").agg(F.count(F.lit(1)).alias("c")).toPandas()  # at most BUCKETS * capacity rows
    table = np.zeros((BUCKETS, capacity + 1), np.int64)
    table[per["bucket"], per["n"]] = per["c"]
    starts = np.cumsum(table, axis=0) - table  # rank of the first item of (bucket, n)
    plan = plan_containers(table.sum(axis=0), capacity)

    # by length: intervals of ranks, each with its first container
    first, cuts = 0, {n: ([0], []) for n in range(1, capacity + 1)}
    for combo, times in plan:
        for n in combo:
            ends, at = cuts[n]
            at.append(first)
            ends.append(ends[-1] + times)
        first += times
    flat = {n: (np.array(e, np.int64), np.array(a, np.int64)) for n, (e, a) in cuts.items() if a}
    n_shared = first
    share = items.sparkSession.sparkContext.broadcast((starts, flat))

    def place(bucket: pd.Series, n: pd.Series, nth: pd.Series) -> pd.Series:
        starts, flat = share.value
        rank = starts[bucket.to_numpy(), n.to_numpy()] + nth.to_numpy() - 1
        out = np.zeros(len(n), np.int64)
        lengths = n.to_numpy()
        for v in np.unique(lengths):
            ends, at = flat[int(v)]
            own = lengths == v
            k = np.searchsorted(ends, rank[own], "right") - 1
            out[own] = at[k] + rank[own] - ends[k]
        return pd.Series(out)

    from pyspark.sql import Window

    order = Window.partitionBy("bucket", "n").orderBy("id", "piece_no")
    ranked = rest.withColumn("nth", F.row_number().over(order))
    placed = ranked.select("id", "piece_no", F.pandas_udf(place, "long")("bucket", "n", "nth").alias("container_id"), F.col("n").alias("n_tokens"))

    # pieces that fill a container alone are few; they are numbered by bucket too
    full = base.filter("whole > 0").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    sums = {r["bucket"]: r["w"] for r in full.groupBy("bucket").agg(F.sum("whole").alias("w")).collect()}  # at most BUCKETS rows
    begin, at = {}, n_shared
    for b in sorted(sums):
        begin[b], at = at, at + sums[b]
    offset = F.lit(n_shared).cast("long")
    if begin:
        offset = F.element_at(F.create_map(*[F.lit(x) for b, s in begin.items() for x in (b, s)]), F.col("bucket"))
    before = F.sum("whole").over(Window.partitionBy("bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1))
    # the window must see the items, not their pieces, so the pieces come after it
    numbered = full.select("id", "whole", (offset + F.coalesce(before, F.lit(0))).alias("c0"))
    alone = numbered.select("id", "c0", F.posexplode(F.sequence(F.lit(1), F.col("whole"))).alias("piece_no", "_k"))
    alone = alone.select("id", F.col("piece_no").cast("long").alias("piece_no"), (F.col("c0") + F.col("piece_no")).cast("long").alias("container_id"), F.lit(capacity).alias("n_tokens"))
    return placed.unionByName(alone).withColumnRenamed("id", id_col)
