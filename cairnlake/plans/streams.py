"""Batch runs of the streaming operators and of the engine's files, as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.sinks import transcript_tails
from ..streaming.windows import archive_batch, session_counts
from .base import C, chunks, query, strip_sql



_ROLE = "lower(trim(role))"


@query(f"""SELECT CAST(session_id AS VARCHAR) AS session_key, 1 AS session_no, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, chunk_id) AS turn_index, {_ROLE} AS role, sha256({strip_sql("concat_ws(' ', CAST(chunk_id AS VARCHAR), content)")}) AS digest
 FROM {C} WHERE session_id IS NOT NULL AND turn_index IS NOT NULL AND {_ROLE} IN ('user','assistant','tool')""")
def st1_window_alignment(spark, d):
    """Messages replayed as overlapping windows of six come out once each."""
    c = chunks(spark, d).filter("session_id is not null and turn_index is not null")
    own = F.struct(F.lower(F.trim("role")).alias("role"), F.concat_ws(" ", F.col("chunk_id").cast("string"), "content").alias("content"))
    w = Window.partitionBy("session_id").orderBy("turn_index", "chunk_id")
    rows = c.select(F.col("session_id").cast("string").alias("session_key"), F.row_number().over(w).alias("window_no"), F.collect_list(own).over(w.rowsBetween(-5, 0)).alias("messages"))
    return archive_batch(rows).select("session_key", "session_no", "turn_index", "role", F.sha2("content", 256).alias("digest"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def st_session_windows(spark, d):
    return session_counts(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts")


@query(f"""SELECT session_id, right(string_agg(coalesce(role, '?') || ': ' || coalesce(content, ''), chr(10) ORDER BY turn_index NULLS FIRST, chunk_id), 3000) AS tail FROM {C} WHERE session_id IS NOT NULL GROUP BY session_id""")
def sk24_transcript_tails(spark, d):
    return transcript_tails(chunks(spark, d))
