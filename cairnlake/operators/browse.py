"""Browsing sessions: transcripts, windows around a message, arcs, recent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(chunks: DataFrame, session: str = "session_id", turn: str = "turn_index", chunk: str = "chunk_id") -> DataFrame:
    """With ``pos`` from 1 within each session, by turn then id; null sessions are left out.

    One window sort per session: a session holding a tenth of all rows is sorted
    by one task, spilling, never collected.
    """
    order = Window.partitionBy(session).orderBy(F.col(turn).asc_nulls_first(), chunk)
    return chunks.filter(F.col(session).isNotNull()).withColumn("pos", F.row_number().over(order))


def bookends(chunks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` and last ``n`` messages of each session, with ``pos`` and ``from_end``."""
    p = numbered(chunks)
    back = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc_nulls_last(), F.desc("chunk_id"))
    return p.withColumn("from_end", F.row_number().over(back)).filter((F.col("pos") <= n) | (F.col("from_end") <= n))


def around(chunks: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """(anchor, offset, chunk columns): messages up to ``width`` places from each anchor chunk id."""
    p = numbered(chunks)
    at = p.join(anchors.select(F.col("chunk_id").alias("anchor")).distinct(), p.chunk_id == F.col("anchor")).select("anchor", F.col("session_id").alias("_s"), F.col("pos").alias("_p"))
    near = at.select("anchor", "_s", "_p", F.explode(F.sequence(F.col("_p") - width, F.col("_p") + width)).alias("_pos"))
    return near.join(p, (p.session_id == near._s) & (p.pos == near._pos)).select("anchor", (F.col("pos") - F.col("_p")).alias("offset"), "chunk_id", "role", "content")


def session_arcs(chunks: DataFrame, hits: DataFrame, limit: int, width: int, ends: int = 3) -> DataFrame:
    """(query, session_id, arc_rank, part, chunk_id, pos): best hit per session with its surroundings.

    ``hits``: query, id, rank. The best-ranked hit of a session is its anchor;
    the ``limit`` best sessions of each query are kept. part is start, anchor or
    end; a message may have several parts.
    """
    p = numbered(chunks)
    hit = hits.join(p.select(F.col("chunk_id").alias("id"), "session_id", F.col("pos").alias("at")), "id")
    best = hit.groupBy("query", "session_id").agg(F.min(F.struct("rank", "id", "at")).alias("b"))
    order = Window.partitionBy("query").orderBy("b.rank", "session_id")
    best = best.withColumn("arc_rank", F.row_number().over(order)).filter(F.col("arc_rank") <= limit).select("query", "session_id", "arc_rank", F.col("b.at").alias("at"))
    last = p.groupBy("session_id").agg(F.max("pos").alias("n"))
    spots = best.join(last, "session_id").select(
        "query", "session_id", "arc_rank",
        F.explode(
            F.concat(
                F.transform(F.sequence(F.lit(1), F.least(F.lit(ends), F.col("n"))), lambda i: F.struct(F.lit("start").alias("part"), i.alias("pos"))),
                F.transform(F.sequence(F.greatest(F.col("at") - width, F.lit(1)), F.least(F.col("at") + width, F.col("n"))), lambda i: F.struct(F.lit("anchor").alias("part"), i.alias("pos"))),
                F.transform(F.sequence(F.greatest(F.col("n") - ends + 1, F.lit(1)), F.col("n")), lambda i: F.struct(F.lit("end").alias("part"), i.alias("pos"))),
            )
        ).alias("s"),
    )
    spots = spots.select("query", "session_id", "arc_rank", "s.part", "s.pos")
    return spots.join(p.select("session_id", "pos", "chunk_id"), ["session_id", "pos"])


def recent_sessions(sessions: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(session_id, last_at, messages): the latest sessions; those without messages drop out after the limit."""
    s = sessions.dropDuplicates(["session_id"]).select("session_id", F.coalesce("ended_at", "started_at").alias("last_at"))
    top = s.orderBy(F.desc_nulls_last("last_at"), F.desc("session_id")).limit(limit)
    n = chunks.join(F.broadcast(top.select("session_id")), "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    return top.join(n, "session_id")


def tail_under_budget(chunks: DataFrame, tokens, budget: int) -> DataFrame:
    """The last messages of each session whose token counts add up to at most ``budget``."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc_nulls_last(), F.desc("chunk_id"))
    run = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = chunks.filter("session_id is not null").withColumn("tokens", F.coalesce(tokens, F.lit(0)))
    return c.withColumn("running", run).filter(F.col("running") <= budget)
