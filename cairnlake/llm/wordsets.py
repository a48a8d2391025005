"""Word sets of messages: hashed words, and the exact check of candidate pairs.

Shared by the operators on nearly equal texts. A record is a set of words (runs
of letters and digits, lower-cased); records are alike if the words in both are
at least ``share`` percent of the words in either. Candidates are looked for on
32 bits of a word's hash (words that fall together only add candidates); the
check is on 64 bits. Texts are cut in Arrow batches: every distinct word of a
batch is hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import stage, unstage
from .signatures import spread

#: Names of asked records up to which they are sent to every task (8 MB); more are joined by shuffle.
SENT = 500_000
#: Texts cut at a time.
TEXTS = 4000


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, their 64-bit hashes, flat, and the name of each word set)."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+")
    words = split.flatten().dictionary_encode()
    known = words.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both = np.sort((np.repeat(np.arange(len(size)), size) << 32) | code)
    both = both[np.concatenate([np.ones(min(len(both), 1), bool), both[1:] != both[:-1]])]  # distinct words of each text
    if "" in known:
        both = both[(both & 0xFFFFFFFF) != known.index("")]
    rec, keys = both >> 32, hashes[both & 0xFFFFFFFF]
    n = np.bincount(rec, minlength=len(size))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread(keys), dtype=np.uint64)])
    past = np.cumsum(n)
    return n, keys, spread(upto[past] - upto[past - n] + n.astype(np.uint64))


def word_sets(rows: DataFrame, text: str, least: int, *keep: str, full: bool = False) -> DataFrame:
    """(kept columns, h, n, keys array<int>): the distinct words of each record, hashed.

    Records of fewer than ``least`` different words, null and empty texts among
    them, are left out. ``h`` names the set: rows with equal word sets share it.
    ``full``: with k, the 64-bit hashes, for records that are kept to be compared.
    """
    held = rows.select(*keep, F.col(text).alias("_t"))
    own = [f for f in held.schema.fields if f.name != "_t"]
    types = [T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.IntegerType()))]
    types += [T.StructField("k", T.ArrayType(T.LongType()))] if full else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                n, keys, h = hashed_words(batch.column(len(own)))
                use = np.flatnonzero(n >= least)
                flat = keys[np.repeat(n >= least, n)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n[use])]), pa.int32())
                at = pa.array(use)
                out = [*(batch.column(i).take(at) for i in range(len(own))), pa.array(h[use].view(np.int64)), pa.array(n[use].astype(np.int32))]
                out.append(pa.ListArray.from_arrays(offsets, pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32))))
                if full:
                    out.append(pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in [*own, *types]])

    return held.mapInArrow(run, T.StructType([*own, *types]))


def verified(pairs: DataFrame, rows: DataFrame, id_col: str, text: str, names: DataFrame, share: int) -> DataFrame:
    """(a, b, shared): the pairs of set names whose words in both reach the share.

    ``pairs``: distinct; ``rows``: id, text; ``names`` (h, id): a row of each set.
    Only the asked rows are read out of ``rows`` with their text, each once.
    """
    asked = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct().join(names, "h").select(F.col("id").alias(id_col))
    if 2 * pairs.count() <= SENT:
        asked = F.broadcast(asked)
    lists = word_sets(rows.select(id_col, text).join(asked, id_col, "left_semi"), text, 0, id_col, full=True).select("h", "k")
    # a repeated id may have another text: sets that nobody asked for meet no pair
    lists = stage(lists.dropDuplicates(["h"]), "lists")
    one = lists.select(F.col("h").alias("a"), F.col("k").alias("k1"))
    two = lists.select(F.col("h").alias("b"), F.col("k").alias("k2"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.greatest(F.size("k1"), F.size("k2")).alias("n"), F.size(F.array_intersect("k1", "k2")).alias("shared"))
    out = stage(both.filter(100 * F.col("shared") >= share * F.col("n")).select("a", "b", "shared"), "alike")
    unstage(lists)
    return out
