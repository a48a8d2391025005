"""Signatures of word sets by the generalised pigeonhole (problems 3 and 7).

A record that may lose d of its words gets partitions of its words with unequal
thresholds. Of a partition with k words and threshold t a pair that loses at
most t of them shares k - t words; it costs t + 1 of d + 1 units, so once a
record's partitions hold d + 1 units, one of them survives in any alike record.

The partitions are tiers of the document frequency (rare words first), and
within a tier, classes of a hash. What a tier demands in common (1 word, 2, 3 or
4: the threshold is k less that) and into how many partitions it falls is
allocated by dynamic programming on estimated candidate counts. Both are the
same for all records, and a record takes partitions in their common order until
it has its d + 1 units; so of two alike records the one that stops first has a
surviving partition which the other signs as well. A record short of units signs
all it has, which finds its pairs with others, and goes on to a coarser plan
to meet the other records that are short.

All counts are over all records. Nothing here decides results, only cost.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of document frequencies: a fixed number, so what is sent to the driver
#: and to the tasks is 1 MB however large the corpus is. Words that share one
#: count together and are taken for more frequent than they are.
BUCKETS = 1 << 18
#: Words of the smallest size class; each next one is twice as wide.
CLASS = 128
#: Cost of a candidate pair, as a part of that of a signature row.
PAIR_COST = 1 / 2000
#: Words of one text occur together: each further word of a signature is taken
#: to thin its group out like this share of an independent one.
INDEPENDENT = 0.5
#: How many times as many signatures of so many words a partition has as if words were
#: independent: those of a text occur together, and subsets of the fullest partitions
#: outweigh all others.
TOGETHER = {1: 1, 2: 1, 3: 3, 4: 12}
_PARTS = (2, 3, 4, 6, 8, 12, 16, 24, 32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def may_lose(n: np.ndarray, share: int) -> np.ndarray:
    """Words of a record of n that an alike record need not have; share in percent."""
    return n - -(-share * n // 100)


def size_class(n: np.ndarray) -> np.ndarray:
    """0 for fewer than CLASS words, one more for each doubling."""
    return np.maximum(np.floor(np.log2(np.maximum(n, 1) / CLASS)).astype(np.int64) + 1, 0)


@dataclass(frozen=True)
class Tier:
    """Words counted at most ``top`` times: ``parts`` partitions, ``common`` words to be shared in one."""

    top: float
    parts: int
    common: int


@dataclass
class Plan:
    """Counts of the word buckets and the tiers in order."""

    counts: np.ndarray
    tiers: list[Tier]
    rows_each: float = 1.0  # estimated signatures of a record
    coarser: list[list[Tier]] = field(default_factory=list)

    def levels(self) -> list[list[Tier]]:
        return [self.tiers, *self.coarser]


@cache
def _excess(rate: float, common: int) -> float:
    """Mean units of a partition: E[max(k - common + 1, 0)] for k words, Poisson."""
    p, out = math.exp(-rate), rate - common + 1
    for k in range(common):
        out += (common - 1 - k) * p
        p *= rate / (k + 1)
    return max(out, 0.0)


def allocate(occurrences: np.ndarray, tops: np.ndarray, records: float, need: float, pair_cost: float = PAIR_COST) -> tuple[list[Tier], float]:
    """Tiers of least estimated cost that give ``need`` units to a typical record.

    ``occurrences``: words of such a record by frequency bin, rarest first;
    ``tops``: largest count of each bin. Dynamic programming over (bin, units
    still needed): a tier is a run of bins with a number of partitions and of
    common words. Returns also the estimated signatures of a record.
    """
    bins, goal = len(occurrences), math.ceil(4 * need)  # in quarters of a unit
    total = np.concatenate([[0.0], np.cumsum(occurrences)])
    options = []
    for a in range(bins):
        for b in range(a + 1, bins + 1):
            words = total[b] - total[a]
            if words <= 0:
                continue
            often = float((occurrences[a:b] * tops[a:b]).sum() / words / max(records, 1))
            for common in (1, 2, 3, 4):
                for parts in (1,) if common == 1 else _PARTS:
                    rate = words / parts
                    units = words if common == 1 else parts * _excess(round(rate, 3), common)
                    rows = words if common == 1 else parts * rate**common / math.factorial(common) * TOGETHER[common]
                    group = records * often ** (1 + INDEPENDENT * (common - 1))
                    if units > 0.05:
                        options.append((a, b, parts, common, 3.6 * units, rows * (1 + group * pair_cost / 2), rows))
    starts: dict[int, list] = {}
    for o in options:
        starts.setdefault(o[0], []).append(o)
    # what is still needed at the end costs as much as pairs of the whole prefix
    short = goal / 2
    best: dict[tuple[int, int, int], tuple[float, float, list]] = {(0, goal, 1): (0.0, 0.0, [])}
    done: tuple[float, float, list] | None = None
    for at in range(bins + 1):
        for (a, left, least), (cost, rows, path) in sorted(best.items(), key=lambda kv: kv[0][1]):
            if a != at:
                continue
            end = cost + left * short
            if done is None or end < done[0]:
                done = (end, rows, path)
            if not left or at == bins:
                continue
            for _, b, parts, common, units, price, made in starts.get(at, []):
                if common < least:
                    continue
                part = min(1.0, left / units)
                key = (b, max(0, math.ceil(left - units)), common)
                new = (cost + part * price, rows + part * made, [*path, Tier(float(tops[b - 1]), parts, common)])
                if key not in best or new[0] < best[key][0]:
                    best[key] = new
            skip = (at + 1, left, least)
            if occurrences[at] <= 0 and (skip not in best or cost < best[skip][0]):
                best[skip] = (cost, rows, path)
    _, rows, path = done
    return path, rows


def word_counts(sets: DataFrame) -> np.ndarray:
    """Records by word bucket (the low bits of a hashed word), over all records of ``sets`` (keys array<int>)."""
    w = sets.select(F.explode("keys").alias("w"))
    got = w.groupBy(F.col("w").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.count(F.lit(1)).alias("c")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("b").to_numpy()] = got.column("c").to_numpy()
    return out


def plan_for(counts: np.ndarray, records: int, mean_words: float, share: int, pair_cost: float = PAIR_COST) -> Plan:
    """The plan for records of ``mean_words`` words, from counts over all of them."""
    held = counts[counts > 0].astype(float)
    bins = np.floor(np.log2(np.maximum(held, 1))).astype(int)
    most = int(bins.max()) + 1 if len(bins) else 1
    occurrences = np.bincount(bins, weights=held, minlength=most)
    occurrences = occurrences * (mean_words / max(occurrences.sum(), 1.0))
    tops = 2.0 ** (np.arange(most) + 1) - 1
    need = float(may_lose(np.array([max(int(mean_words), 1)]), share)[0]) + 1
    tiers, rows = allocate(occurrences, tops, records, need, pair_cost)
    top = tiers[-1].top if tiers else -1
    # a reserve of the words that the allocation left out, for records that need more units
    rest = float(occurrences[tops > top].sum())
    tiers = [*tiers, Tier(float("inf"), max(1, round(rest / 1.5)), 3)] if tiers else [Tier(float("inf"), 1, 1)]
    coarser = [[Tier(t.top, t.parts, min(t.common, 2)) for t in tiers]] if any(t.common > 2 for t in tiers) else []
    return Plan(counts, tiers, rows, coarser)


@cache
def _subsets(k: int, common: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(k), common)), np.int64).reshape(-1, common)


class Words:
    """The word sets of one Arrow batch, flat: record, key and count of every word."""

    def __init__(self, keys, counts: np.ndarray):
        offsets = keys.offsets.to_numpy().astype(np.int64)
        flat = keys.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        rec = np.repeat(np.arange(len(size)), size)
        self.n, self.rec, self.key = size, rec, flat.view(np.uint32).astype(np.uint64)
        self.count = counts[flat & (BUCKETS - 1)]
        # parity sketch: a word flips one of 128 bits, so sketches of two sets
        # differ in at most as many bits as the sets do in words
        bit = (self.key * _MIX) >> np.uint64(57)
        flip = np.uint64(1) << (bit & np.uint64(63))
        self.start = start = offsets[:-1] - offsets[0]
        self.s0, self.s1 = (np.bitwise_xor.reduceat(np.where(side, flip, np.uint64(0)), start) if len(size) else np.zeros(0, np.uint64) for side in (bit < 64, bit >= 64))


    def wide(self) -> pa.Array:
        """Parity sketches of twice as many bits as words, in powers of two from 256, for records of at least 64 words; null for others.

        A narrower one is a wider one folded in half.
        """
        out = np.full(len(self.n), None, object)
        large = np.flatnonzero(self.n >= 64)
        bits = 2 << np.ceil(np.log2(np.maximum(self.n, 2))).astype(np.int64)
        for width in np.unique(bits[large]):
            own = large[bits[large] == width]
            place = np.full(len(self.n), -1)
            place[own] = np.arange(len(own))
            at = np.flatnonzero(place[self.rec] >= 0)
            bit = (spread(self.key[at]) % np.uint64(width)).astype(np.int64)
            ones = np.bincount(place[self.rec[at]] * width + bit, minlength=len(own) * width) & 1
            packed = np.packbits(ones.reshape(len(own), width).astype(np.uint8), axis=1, bitorder="little")
            out[own] = [row.tobytes() for row in packed]
        return pa.array(out, pa.binary())


def _sign_level(w: Words, at: np.ndarray, rec: np.ndarray, scale: np.ndarray, need: np.ndarray, tiers: list[Tier], seed: int, singles: bool):
    """(record, signature) of the words ``at``; and the units that each signing record has beyond those it may lose, 0 if it is short.

    ``rec`` and ``scale``, ``need``: the signing record of each word, and per
    signing record the factor of its partitions and the units it needs.
    """
    key, count = w.key[at], w.count[at]
    tops = np.array([t.top for t in tiers[:-1]])
    tier = np.searchsorted(tops, count, "left")
    parts, common = np.array([t.parts for t in tiers]), np.array([t.common for t in tiers])
    single = common[tier] == 1
    part = np.where(single, 0, (spread(key + np.uint64(seed)) >> np.uint64(16)) % (parts[tier] * scale[rec]).astype(np.uint64)).astype(np.int64)
    by = np.lexsort((key, np.where(single, count, part), tier, rec))
    rec, key, tier, part, single = rec[by], key[by], tier[by], part[by], single[by]
    new = np.ones(len(rec), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (tier[1:] != tier[:-1]) | (part[1:] != part[:-1]) | single[1:]
    first = np.flatnonzero(new)
    k = np.diff(np.append(first, len(rec)))
    want = common[tier[first]]
    units = np.maximum(k - want + 1, 0)
    run = np.cumsum(units)
    owner = rec[first]
    base = np.zeros(len(need), np.int64)
    lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    base[owner[lead]] = run[lead] - units[lead]
    before = run - units - base[owner]
    have = np.bincount(owner, units, len(need))
    use = (units > 0) & (before < need[owner])
    out = []
    if singles:
        one = use & (want == 1)
        out.append((owner[one], spread(key[first[one]] + np.uint64(77))))
    for c in sorted({t.common for t in tiers} - {1}):
        for size in np.unique(k[use & (want == c)]):
            g = np.flatnonzero(use & (want == c) & (k == size))
            subset = _subsets(int(size), c)
            step = max(1, 2_000_000 // len(subset))
            for lo in range(0, len(g), step):
                some = g[lo : lo + step]
                sig = np.full((len(some), len(subset)), np.uint64(seed * 1000 + c), np.uint64) + scale[owner[some]].astype(np.uint64)[:, None]
                for j in range(c):
                    sig = spread(sig ^ key[first[some][:, None] + subset[:, j][None, :]])
                out.append((np.repeat(owner[some], len(subset)), sig.ravel()))
    out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    signed = np.bincount(owner[use], units[use], len(need)).astype(np.int64)
    return *(np.concatenate(x) for x in zip(*out, strict=True)), np.where(have < need, 0, signed - need + 1)


def signatures(w: Words, plan: Plan, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, 64-bit signature) of all records of a batch, and the coverage of each record.

    Any two alike records have a signature in common, and at least as many as the
    smaller coverage of both.
    """
    lose = may_lose(w.n, share)
    own, far = size_class(w.n), size_class(100 * w.n // share)
    recs, sigs, cover = [], [], np.full(len(w.n), 100)
    # a signing is a record in its own size class or, near its end, in the next one
    for other in (0, 1):
        live = np.flatnonzero(far > own) if other else np.arange(len(w.n))
        for level, tiers in enumerate(plan.levels()):
            if not len(live):
                break
            scale = 1 << np.minimum(own[live] + other, 40)
            place = np.full(len(w.n), -1)
            place[live] = np.arange(len(live))
            at = np.flatnonzero(place[w.rec] >= 0)
            rec, sig, spare = _sign_level(w, at, place[w.rec[at]], scale, lose[live] + 1, tiers, 1 + level, singles=not (other or level))
            recs.append(live[rec])
            sigs.append(sig)
            cover[live] = np.minimum(cover[live], np.where(spare > 0, spare, 100))
            live = live[spare == 0]
        if len(live):
            rec, sig = _prefix(w, live, lose, share)
            recs.append(rec)
            sigs.append(sig)
            cover[live] = 1
    return np.concatenate(recs), np.concatenate(sigs), cover


def _prefix(w: Words, live: np.ndarray, lose: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The last resort, which any record can sign: one of its d + 1 first words, or two of its d + 2 first ones if it has many."""
    low = 16
    high = -(-100 * low // share)
    chosen = np.zeros(len(w.n), bool)
    chosen[live] = True
    at = np.flatnonzero(chosen[w.rec])
    by = at[np.lexsort((w.key[at], w.count[at], w.rec[at]))]
    rec, key = w.rec[by], w.key[by]
    start = np.flatnonzero(np.concatenate([[True], rec[1:] != rec[:-1]]))
    place = np.arange(len(rec)) - np.repeat(start, np.diff(np.append(start, len(rec))))
    one = (place <= lose[rec]) & (w.n[rec] <= high)
    recs, sigs = [rec[one]], [spread(key[one] + np.uint64(7_001))]
    for r, s in zip(rec[start], start, strict=True):
        if w.n[r] >= low:
            k = key[s : s + lose[r] + 2]
            pair = _subsets(len(k), 2) if len(k) < 200 else np.stack(np.triu_indices(len(k), 1), axis=1)
            sigs.append(spread(spread(k[pair[:, 0]] + np.uint64(7_002)) ^ k[pair[:, 1]]))
            recs.append(np.full(len(pair), r))
    return np.concatenate(recs), np.concatenate(sigs)
