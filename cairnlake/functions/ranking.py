"""Scores and re-ranking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency(age_days: Column, half_life: float) -> Column:
    """Halved every ``half_life`` days; 1 for no age or no half-life."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def ucb1(distance: Column, uses: Column, wins: Column, total: Column, weight: float) -> Column:
    """Distance less an optimistic success rate: little-used arms get the benefit of doubt."""
    least = F.greatest(uses, F.lit(1))
    return distance - weight * (wins / least + F.sqrt(2 * F.ln(total + 1) / least))


def success_weighted(distance: Column, uses: Column, wins: Column, boost: float, least_uses: int) -> Column:
    return F.when(uses >= least_uses, distance - 0.01 * boost * wins / uses).otherwise(distance)


def name_overlap(distance: Column, name_words: Column, query_words: Column, weight: float) -> Column:
    """Distance less the share of the name's words that the query has."""
    shared = F.size(F.array_intersect(name_words, query_words))
    return F.when(F.size(name_words) > 0, distance - weight * shared / F.size(name_words)).otherwise(distance)


def contribution(uses: Column, wins: Column) -> Column:
    """(2 wins - uses) / uses, 0 for an unused arm."""
    return F.when(uses > 0, (2 * wins - uses) / uses).otherwise(F.lit(0.0))


def rate_label(uses: Column, wins: Column, least_uses: int) -> Column:
    """Percent, cut off rather than rounded; a dash below the least evidence."""
    return F.when(uses >= least_uses, F.concat(F.floor(100 * wins / uses).cast("string"), F.lit("%"))).otherwise("-")


def overlap_share(part: Column, whole: Column) -> Column:
    """Share of the distinct words of ``part`` that are in ``whole``; 0 for none."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


def two_sided(p_yes: Column, p_no: Column, bound: float) -> Column:
    """``yes`` if likely and its opposite unlikely, ``no`` likewise, else ``unsure``."""
    return F.when((p_yes >= bound) & (p_no <= 1 - bound), "yes").when((p_no >= bound) & (p_yes <= 1 - bound), "no").otherwise("unsure")


def clamp_int(c: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))
