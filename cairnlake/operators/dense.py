"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import usable

#: Queries of a block; a block's vectors are sent to every task (16 MB at 512 dimensions).
QUERIES = 4096


def _matrix(column, dims: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    m = flat.reshape(-1, dims)
    return m / np.linalg.norm(m, axis=1)[:, None]


def knn_topk(queries: DataFrame, query_id: str, query_vec: str, vectors: DataFrame, vec_id: str, vec: str, dims: int, k: int | None, exclude_self: bool = False) -> DataFrame:
    """(query, id, cosine, rank): exact ``k`` nearest vectors of each query by cosine.

    Each batch of vectors meets a block of at most QUERIES queries in one matrix
    product and sends only its own best k on, so the shuffle holds k rows per
    query and batch. Vectors that are not usable are left out on both sides;
    rows that repeat id and vector count once; ties go to the smaller id.
    ``exclude_self`` leaves out the vector whose id equals the query's. ``k`` None:
    all vectors of each query (for a bounded few queries), without a rank.
    """
    spark = vectors.sparkSession
    clean = vectors.filter(usable(F.col(vec), dims) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("v")).dropDuplicates(["id"])
    asked = queries.filter(usable(F.col(query_vec), dims) & F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v")).dropDuplicates(["q"])
    blocks = max(1, -(-asked.count() // QUERIES))
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked
        table = part.toArrow()
        ids = table.column("q").to_numpy()
        m = _matrix(table.column("v").combine_chunks(), dims) if len(ids) else np.zeros((0, dims))
        share = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            q, m = share.value
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                own = batch.column("id").to_numpy(zero_copy_only=False)
                s = np.round(m @ _matrix(batch.column("v"), dims).T, 6)
                if exclude_self:
                    s[q[:, None] == own[None, :]] = -np.inf
                if k is not None and s.shape[1] > k:
                    # all that reach the k-th best, ties included: the ids of ties decide later
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero((s >= least) & np.isfinite(s))
                else:
                    i, j = np.nonzero(np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(own[j]), pa.array(s[i, j])], names=["query", "id", "cosine"])

        got = clean.mapInArrow(run, "query long, id long, cosine double")
        found = got if found is None else found.union(got)
    if k is None:
        return found
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
