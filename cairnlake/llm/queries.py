"""Queries pN_... over the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import clusters, conversations, history, neardup, neighbours, packing, personal, reading, splitting, sql, tokens
from .text import messages

# Bytes of a piece and of its overlap, tokens of a container.
PIECE, OVERLAP, CONTAINER = 4000, 200, 2048
# Alike messages have 78 percent of their words in common, and at
# least 22 different ones.
ALIKE, LEAST_WORDS = 78, 22
# Fixed value: numbers of a usable vector.
DIM = 128


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    verdicts = conversations.session_verdicts(read_table(spark, d, "chunks"))
    return verdicts.filter("reason is not null").select("session_id", "reason")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_turns(read_table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "chunks_vec")
    pairs = neighbours.similar_vector_pairs(vectors, "chunk_id", "embedding", DIM, 0.95)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.neighbours(read_table(spark, d, "chunks_vec"), "chunk_id", "embedding", DIM, every=100)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "rank", "cosine")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("chunk_id", "session_id", "content")
    intake = read_table(spark, d, "intake").select("session_id", "batch_no")
    found = history.repeated_messages(chunks, intake, "chunk_id", "session_id", "content", "batch_no", share=ALIKE, least=LEAST_WORDS)
    return found.select(F.col("id").alias("chunk_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("chunk_id", "content")
    return personal.personal_kinds(chunks, "chunk_id", "content", read_table(spark, d, "contacts")).withColumnRenamed("id", "chunk_id")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("chunk_id", "content")
    return personal.redacted_messages(chunks, "chunk_id", "content", read_table(spark, d, "contacts"))


def _long_messages(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("chunk_id", "content")
    big = messages(splitting.oversized(chunks, "content", PIECE))
    return splitting.item_ranges(big, "chunk_id", "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = splitting.boundary_kinds(_long_messages(spark, d), "bigint", PIECE)
    return kinds.select(F.col("id").alias("chunk_id"), "cut_at")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_long_messages(spark, d), "bigint", PIECE, OVERLAP).withColumnRenamed("id", "chunk_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(read_table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, d, "documents"), capacity=CONTAINER)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_profile(read_table(spark, d, "documents")).select("doc_id", "reading_band")


def p10_familiar(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_profile(read_table(spark, d, "documents"), familiar=0.05)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    members = clusters.vector_clusters(read_table(spark, d, "chunks_vec"), "chunk_id", "embedding", DIM, 0.70)
    chunks = read_table(spark, d, "chunks").select("chunk_id", "session_id")
    return clusters.counted_clusters(members, chunks, "chunk_id", "session_id", 5, 2)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select(F.col("id").alias("chunk_id"), "cluster_id")


def p6_typical(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical_members(_clusters(spark, d)).withColumnRenamed("id", "chunk_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("chunk_id", "content")
    pairs = neardup.similar_pairs(chunks, "chunk_id", "content", share=ALIKE, least=LEAST_WORDS)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("chunk_id", "content")
    return neardup.similar_groups(chunks, "chunk_id", "content", share=ALIKE, least=LEAST_WORDS).withColumnRenamed("id", "chunk_id")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": sql.P1_FOUND, "p1_conversations": sql.P1_CONVERSATIONS, "p2_found": sql.P2_FOUND, "p3_found": sql.P3_FOUND, "p6_found": sql.P6_FOUND, "p7_found": sql.P7_FOUND}
