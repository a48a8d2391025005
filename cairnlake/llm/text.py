"""Text expressions shared by the training-data operators (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and zero-width signs, for trimming and for "visible" tests.
BLANK = r"\s\p{Z}\p{Cf}\p{Cc}\x{FE00}-\x{FE0F}"


def strip(c: Column) -> Column:
    """Without white space and zero-width signs around it; null stays null."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def visible(c: Column) -> Column:
    """True if a character other than white space and zero-width signs is in it."""
    return F.coalesce(c.rlike(rf"[^{BLANK}]"), F.lit(False))


def words(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order; null gives none."""
    runs = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(runs, "")


def messages(chunks, id_col: str = "chunk_id"):
    """One row per id: repeated deliveries are one message.

    Rows of one id that differ are folded by taking the greatest struct, so the
    result does not depend on file order. Null ids are left out.
    """
    cols = [c for c in chunks.columns if c != id_col]
    best = F.max(F.struct(*cols)).alias("_m")
    return chunks.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(best).select(id_col, "_m.*")
