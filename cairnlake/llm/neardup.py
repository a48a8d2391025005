"""Near-duplicate records with small edits (problem 7).

Generalised pigeonhole over word sets: correlated words are grouped into
partitions whose unequal thresholds are allocated by dynamic programming on
estimated candidate counts (``signatures``). Records that share a signature meet,
are held against size and sketch bounds, and what is left is verified on the
texts. A signature with more than GROUP records is cut into blocks, and pairs of
blocks are compared by different tasks, so no group is held by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage, unstage
from .components import components
from .signatures import BUCKETS, CLASS, PAIR_COST, Plan, Words, plan_for, signatures, word_counts
from .wordsets import verified, word_sets

#: Records of a signature that one task compares; of larger ones, of a block.
GROUP = 8192
#: Rows of signatures for a shuffle partition.
SHARD_ROWS = 400_000
#: Names a task remembers, so that copies in its input sign once.
REMEMBERED = 200_000
_SIGNED = "sig long, id long, s0 long, s1 long"
_LARGEST = (1 << 16) - 1


def _table(**columns) -> pa.RecordBatch:
    """A batch of numbers; Arrow arrays are taken as they are."""
    as_long = lambda v: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64))
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else as_long(v) for v in columns.values()], names=list(columns))


def _signed(sets: DataFrame, plan, share: int) -> DataFrame:
    """(sig, id, s0, s1): a row per record and signature; sig ends in 16 bits of the record's size.

    s0 and s1 are the record's sketch; wider ones are not carried along, as they
    would be shuffled once for each signature. ``plan``: broadcast. Equal sets of a task sign once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("h").to_numpy(zero_copy_only=False)
            _, first = np.unique(ids, return_index=True)
            fresh = np.sort(first[[h not in seen for h in ids[first].tolist()]]) if len(ids) else first
            if not len(fresh):
                continue
            if len(seen) < REMEMBERED:
                seen.update(ids[fresh].tolist())
            for lo in range(0, len(fresh), 2000):
                some = fresh[lo : lo + 2000]
                w = Words(batch.column("keys").take(pa.array(some)), plan.value.counts)
                rec, sig, _ = signatures(w, plan.value, share)
                named = (sig & ~np.uint64(_LARGEST)) | np.minimum(w.n[rec], _LARGEST).astype(np.uint64)
                yield _table(sig=named, id=ids[some][rec], s0=w.s0[rec], s1=w.s1[rec])

    return sets.select("h", "keys").mapInArrow(run, _SIGNED)


def _close(n1, n2, differ, share: int) -> np.ndarray:
    """False only where a pair can't be alike: sizes, and bits in which the sketches differ."""
    big, small = np.maximum(n1, n2), np.minimum(n1, n2)
    need = -(-share * big // 100)
    return (big >= _LARGEST) | ((small >= need) & (differ <= n1 + n2 - 2 * need))


def _bits(s0, s1, i, j) -> np.ndarray:
    return np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])


def _wide_bits(i: np.ndarray, j: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Bits in which the wide sketches of the pairs differ, the wider one folded to the other; 0 where one has none."""
    out = np.zeros(len(i), np.int64)
    width = np.array([len(m) if m is not None else 0 for m in more])
    wide = np.flatnonzero((width[i] > 0) & (width[j] > 0))
    for one, two in set(zip(width[i[wide]].tolist(), width[j[wide]].tolist(), strict=True)):
        at = wide[(width[i[wide]] == one) & (width[j[wide]] == two)]
        to = min(one, two)
        for lo in range(0, len(at), 100_000):
            some = at[lo : lo + 100_000]
            x, y = (np.frombuffer(b"".join(more[r].tolist()), np.uint64).reshape(len(some), -1, to // 8) for r in (i[some], j[some]))
            out[some] = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1)
    return out


def bits_allowed(n: np.ndarray, share: int) -> np.ndarray:
    """Bits in which the sketches of a record of n words and an alike one may differ, at most 255."""
    return np.where(n >= _LARGEST, 255, np.minimum(2 * (n - -(-share * n // 100)) + 2, 255)).astype(np.uint8)


def near_sketches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of two sets of sketches that differ in at most ``most`` (by row of the first) bits, in tiles that fit a cache."""
    for lo in range(0, len(most), 16):
        hi = lo + 16
        for left in range(0, len(b[0]), 4096):
            right = left + 4096
            differ = np.bitwise_count(a[0][lo:hi, None] ^ b[0][None, left:right])
            differ += np.bitwise_count(a[1][lo:hi, None] ^ b[1][None, left:right])
            i, j = np.divmod(np.flatnonzero(differ <= most[lo:hi, None]), differ.shape[1])
            yield i + lo, j + left


def _few(group: np.ndarray, n, s0, s1, share: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) within runs of equal ``group``, sorted by size, by distance: for small groups."""
    bound = bits_allowed(n, share)
    for gap in range(1, len(group)):
        same = group[:-gap] == group[gap:]
        if not same.any():
            return
        differ = np.bitwise_count(s0[:-gap] ^ s0[gap:]) + np.bitwise_count(s1[:-gap] ^ s1[gap:])
        left = np.flatnonzero(same & (differ <= bound[:-gap]))
        ok = _close(n[left], n[left + gap], differ[left].astype(np.int64), share)
        yield left[ok], left[ok] + gap


def _many(a: int, b: int, n, s0, s1, share: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of the rows a to b, sorted by size, in tiles."""
    bound = bits_allowed(n[a:b], share)
    for i in range(a, b, 128):
        e = min(i + 128, b)
        stop = b if n[e - 1] * 100 // share >= _LARGEST else a + int(np.searchsorted(n[a:b], 100 * n[e - 1] // share, "right"))
        for r, c in near_sketches((s0[i:e], s1[i:e]), (s0[i:stop], s1[i:stop]), bound[i - a : e - a]):
            keep = c > r
            r, c = r[keep] + i, c[keep] + i
            ok = _close(n[r], n[c], _bits(s0, s1, r, c), share)
            yield r[ok], c[ok]


def _groups(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[str, list[np.ndarray]]]:
    """("whole", rows of whole groups) of a stream sorted by its first column; ("part", rows) of groups of more than ``most`` rows."""
    held: list[list[np.ndarray]] = []
    rows, crowded = 0, None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if crowded is not None:
            stop = int(np.searchsorted(cols[0], crowded, "right"))
            if stop:
                yield "part", [c[:stop] for c in cols]
            cols = [c[stop:] for c in cols]
            crowded = crowded if not len(cols[0]) else None
        if not len(cols[0]):
            continue
        held.append(cols)
        rows += len(cols[0])
        if rows < 100_000 and (most is None or held[0][0][0] != cols[0][-1] or rows <= most):
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut:
            yield "whole", [c[:cut] for c in cols]
        cols = [c[cut:] for c in cols]
        held, rows = [cols], len(cols[0])
        if most is not None and rows > most:
            crowded = cols[0][-1]
            yield "part", cols
            held, rows = [], 0
    if held:
        yield "whole", [np.concatenate(c) for c in zip(*held, strict=True)]


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((y, x))
    x, y = x[by], y[by]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def _compared(cols: list[np.ndarray], group: np.ndarray, share: int, most: int, block: tuple[np.ndarray, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """kind 0: candidate pairs (x, y) of whole groups; kind 1: the rows of groups of more than ``most``."""
    sig, ids, s0, s1 = cols[0], cols[1], cols[2].view(np.uint64), cols[3].view(np.uint64)
    n = sig & _LARGEST
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(edge, len(group)))
    few = np.repeat((size > 1) & (size <= 32), size)
    at = np.flatnonzero(few)
    found = [(at[i], at[j]) for i, j in _few(group[at], n[at], s0[at], s1[at], share)] if len(at) else []
    for g in np.flatnonzero((size > 32) & (size <= most)):
        found += _many(edge[g], edge[g] + size[g], n, s0, s1, share)
    if found:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = ids[i] != ids[j]
        if block is not None:  # a cell of two blocks pairs one with the other
            own, low, high = block
            ok &= (own[i] != own[j]) | (low[i] == high[i])
        i, j = i[ok], j[ok]
        if len(i):
            x, y = _distinct(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))
            zero = np.zeros(len(x), np.int64)
            yield _table(kind=zero, sig=zero, x=x, y=y, s0=zero, s1=zero)
    large = np.repeat(size > most, size)
    if large.any():
        yield _crowded(sig[large], ids[large], s0[large], s1[large])


def _crowded(sig, ids, s0, s1) -> pa.RecordBatch:
    some = np.ones(len(sig), np.int64)
    return _table(kind=some, sig=sig, x=ids, y=0 * some, s0=s0, s1=s1)


_MET = "kind long, sig long, x long, y long, s0 long, s1 long"


def _meet(signed: DataFrame, shards: int, share: int, most: int) -> DataFrame:
    """kind 0: candidate pairs (x, y); kind 1: rows of crowded signatures (sig, x: id, s0, s1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the stream is sorted by signature and size; groups are those of the signature
        def named() -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sig = b.column("sig").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(sig >> 16), *b.columns], names=["g", *b.schema.names])

        for what, cols in _groups(named(), most):
            if what == "part":
                yield _crowded(*cols[1:])
            else:
                yield from _compared(cols[1:], cols[0], share, most)

    return signed.repartition(shards, F.shiftright("sig", 16)).sortWithinPartitions("sig").mapInArrow(run, _MET)


def _blocks(crowded: DataFrame, share: int, most: int) -> DataFrame:
    """Candidate pairs (a, b) of crowded signatures: every record goes to the cells of its block with each other one."""
    rows = crowded.select("sig", F.col("x").alias("id"), "s0", "s1").dropDuplicates(["sig", "id"]).withColumn("g", F.shiftright("sig", 16))
    count = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) * 2 / most).cast("int").alias("blocks"))
    own = rows.join(count, "g").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("long"))
    other = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    cell = other.select("g", "sig", "id", "s0", "s1", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block")
    cell = cell.withColumn("c", F.xxhash64("g", "lo", "hi"))
    size = F.col("sig").bitwiseAND(_LARGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _groups(batches, None):
            c, sig, ids, s0, s1, lo, hi, block, _ = cols
            yield from _compared([sig, ids, s0, s1], c, share, len(c) + 1, (block, lo, hi))

    spread_out = cell.select("c", "sig", "id", "s0", "s1", "lo", "hi", "block", size.alias("size")).repartition("c").sortWithinPartitions("c", "size")
    return spread_out.mapInArrow(run, _MET).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _wide(sets: DataFrame) -> DataFrame:
    """(h, n, more): size and wide sketch of each set that has one, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(b.column("keys"), np.zeros(BUCKETS, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(w.n.astype(np.int32)), w.wide()], names=["h", "n", "more"])

    return sets.select("h", "keys").mapInArrow(run, "h long, n int, more binary").filter("more is not null").dropDuplicates(["h"])


def _not_ruled_out(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose wide sketches let them be alike, or of which one has none."""
    large = _wide(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.arange(b.num_rows)
            n1, n2 = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n1", "n2"))
            more = np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for c in ("m1", "m2")])
            ok = (n1 == 0) | (n2 == 0) | _close(n1, n2, _wide_bits(at, len(at) + at, more), share)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    one, two = (large.select(F.col("h").alias(x), F.col("n").alias(f"n{i}"), F.col("more").alias(f"m{i}")) for i, x in ((1, "a"), (2, "b")))
    return pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", "n1", "n2", "m1", "m2").mapInArrow(run, "a long, b long")


def plan_of(sets: DataFrame, share: int, expected: int | None = None, pair_cost: float = PAIR_COST) -> tuple[Plan, int]:
    """(the plan for all records of staged ``sets``, how many there are); for as many as ``expected`` if they are the first of those."""
    small = F.when(F.col("n") < CLASS, F.col("n"))
    total = sets.agg(F.count(F.lit(1)).alias("rows"), F.avg(small).alias("small"), F.avg("n").alias("mean")).first()
    counts, rows = word_counts(sets), total["rows"]
    if expected and rows:
        counts = np.round(counts * max(1.0, expected / rows)).astype(np.int64)
    return plan_for(counts, max(rows, expected or 0), float(total["small"] or total["mean"] or 1), share, pair_cost), rows


def candidates(sets: DataFrame, share: int, most: int = GROUP) -> DataFrame:
    """(a, b): pairs of set names that share a signature and pass the bounds, staged. ``sets``: staged ``word_sets``."""
    spark = sets.sparkSession
    plan, rows = plan_of(sets, share)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows * plan.rows_each * 1.5 / SHARD_ROWS) + 1)
    met = stage(_meet(_signed(sets, spark.sparkContext.broadcast(plan), share), shards, share, most), "met")
    found, crowded = met.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")), met.filter("kind = 1")
    if not crowded.isEmpty():
        found = found.unionByName(_blocks(crowded, share, most))
    spark.sparkContext._jvm.System.gc()  # shuffle files of the signatures are no longer needed
    out = stage(_not_ruled_out(found.distinct(), sets, share), "candidates")
    unstage(met)
    return out


def alike_sets(sets: DataFrame, rows: DataFrame, id_col: str, text: str, names: DataFrame, share: int) -> DataFrame:
    """(a, b, shared): all pairs a < b of names of different word sets that are alike; see ``verified`` for ``names``."""
    found = candidates(sets, share)
    unstage(sets)
    out = verified(found, rows, id_col, text, names, share)
    unstage(found)
    return out


def similar_pairs(rows: DataFrame, id_col: str, text: str, share: int = 80, least: int = 1, expand: int = 200) -> DataFrame:
    """(a, b): pairs of ids, smaller first, whose word sets are alike.

    Exact: no candidate is dropped by number. Texts of fewer than ``least``
    different words, null and empty ones among them, are in no pair. Copies (equal
    texts, to the letter) of at most ``expand`` members are written out in all
    pairs; a larger group of copies is given by pairs with its smallest id, and
    stands in pairs with other texts, of the same words or not, by that id alone.
    """
    known_ids = rows.filter(F.col(id_col).isNotNull())
    sets = stage(word_sets(known_ids.withColumn("_copy", F.xxhash64(text)), text, least, id_col, "_copy"), "sets")
    members = stage(sets.groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct("h", "_copy")).alias("m")).select("id", "m.h", "m._copy"), "members")
    classes = members.groupBy("h", "_copy").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    known = members.join(classes, ["h", "_copy"])
    shown = known.filter((F.col("size") <= expand) | (F.col("id") == F.col("first"))).select("h", "id")
    names = members.groupBy("h").agg(F.min("id").alias("id"))
    links = alike_sets(sets, known_ids, id_col, text, names, share)
    left = shown.select(F.col("h").alias("a"), F.col("id").alias("i"))
    right = shown.select(F.col("h").alias("b"), F.col("id").alias("j"))
    across = links.join(left, "a").join(right, "b").select("i", "j")
    several = shown.join(members.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("h"), "h", "left_semi")
    inside = several.select("h", F.col("id").alias("i")).join(several.select("h", F.col("id").alias("j")), "h").filter("i < j").select("i", "j")
    star = known.filter((F.col("size") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("i"), F.col("id").alias("j"))
    return across.unionByName(inside).unionByName(star).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def similar_groups(rows: DataFrame, id_col: str, text: str, share: int = 80, least: int = 1) -> DataFrame:
    """(id, group_id, links): one row per text with a near-duplicate or copy.

    group_id is the smallest id reachable over links between alike texts; links
    counts other texts (not copies) that are alike, each text once.
    """
    known_ids = rows.filter(F.col(id_col).isNotNull())
    sets = stage(word_sets(known_ids, text, least, id_col), "sets")
    members = stage(sets.groupBy(F.col(id_col).alias("id")).agg(F.max("h").alias("h")), "members")
    classes = stage(members.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")), "classes")
    links = alike_sets(sets, known_ids, id_col, text, classes.select("h", F.col("first").alias("id")), share)
    ends = links.select(F.col("a").alias("h")).union(links.select("b")).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    name = classes.select("h", "first")
    by_id = links.join(name.withColumnRenamed("h", "a").withColumnRenamed("first", "i"), "a").join(name.withColumnRenamed("h", "b").withColumnRenamed("first", "j"), "b")
    groups = components(by_id, "i", "j").select(F.col("node").alias("first"), F.col("component").alias("group_id"))
    out = members.join(classes, "h").join(ends, "h", "left").join(groups, "first", "left").filter("size > 1 or links is not null")
    return out.select("id", F.coalesce("group_id", "first").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
