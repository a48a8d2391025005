"""Shards of similar vectors, for neighbour search and clustering.

Centres are fitted on a bounded sample (SAMPLE vectors, documented in the
README); every vector is then assigned to the COPIES nearest centres, so that
similar vectors meet in at least one shard. Centres that draw many sample
vectors are split further, since they stand for a hot region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that the centres are fitted on, wanted vectors of a shard, most
#: centres, shards of each vector.
SAMPLE, SHARD, CENTRES, COPIES = 20_000, 700, 4096, 2


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their unit vectors): ``dim`` finite numbers, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    rows = np.flatnonzero(size == dim)
    flat = column.values.to_numpy(zero_copy_only=False)
    x = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64) if len(rows) else np.zeros((0, dim))
    top = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(x).all(axis=1) & (top > 0)
    x = x[good] / top[good][:, None]  # against overflow and underflow of the squares
    return rows[good], (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-9)[:, None], c)
    return c


def fit_centres(vectors: DataFrame, id_col: str, vec: str, dim: int, seed: int = 7) -> np.ndarray:
    """Centres of the shards, from at most SAMPLE vectors; empty if none is usable."""
    total = vectors.count()
    # the first SAMPLE by a hash of the id, over all partitions alike: the hash bound keeps a fifth more
    part = min(1.0, 1.2 * SAMPLE / max(total, 1))
    drawn = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    sample = vectors.filter(drawn <= int(part * (1 << 40))).select(drawn.alias("_d"), F.col(id_col).alias("_i"), F.col(vec).alias("_v"))
    sample = sample.orderBy("_d", "_i").limit(SAMPLE).select("_v").toArrow()
    _, x = unit_rows(sample.column(0), dim)
    if not len(x):
        return np.zeros((0, dim), np.float32)
    rng = np.random.default_rng(seed)
    k = int(np.clip(total / SHARD, 1, min(CENTRES, len(x))))
    c = _kmeans(x, k, rng)
    near = np.argmax(x @ c.T, axis=1)
    count = np.bincount(near, minlength=len(c))
    most = max(4 * SHARD * len(x) / max(total, 1), 8)
    parts = [c[(count <= most)]]
    for i in np.flatnonzero(count > most):  # hot regions
        own = x[near == i]
        parts.append(_kmeans(own, int(np.ceil(len(own) / most)) + 1, rng))
    return np.concatenate(parts)


def sharded(vectors: DataFrame, id_col: str, vec: str, dim: int, centres: np.ndarray, copies: int = COPIES) -> DataFrame:
    """(shard, id, v): every usable vector in its nearest shards, as unit vector of half floats.

    Rows with a null id are left out.
    """
    share = vectors.sparkSession.sparkContext.broadcast(centres)  # at most CENTRES + SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = share.value
        k = min(copies, len(c))
        for batch in batches:
            rows, x = unit_rows(batch.column(1), dim)
            if not len(rows) or not k:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            close = x @ c.T
            near = np.argpartition(-close, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(x), 1))
            half = x.astype(np.float16)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(half), [None, pa.py_buffer(half.tobytes())]).cast(pa.binary())
            for j in range(k):
                yield pa.RecordBatch.from_arrays([pa.array(near[:, j].astype(np.int32)), pa.array(ids.astype(np.int64)), raw], names=["shard", "id", "v"])

    return vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec).mapInArrow(run, "shard int, id long, v binary")


def shard_matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of a shard, by id, repeated rows once."""
    ids = table.column("id").to_numpy()
    raw = b"".join(table.column("v").to_pylist())
    x = np.frombuffer(raw, np.float16).reshape(len(ids), dim).astype(np.float32)
    ids, first = np.unique(ids, return_index=True)
    return ids, x[first]


def fold_equal(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative row of each different vector, group number of every row)."""
    _, first, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, group.ravel()
