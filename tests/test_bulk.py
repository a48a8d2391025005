"""Searches of all tasks: every query of its table, equal to DuckDB and to the operators for few queries."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairnlake.operators import bulk, dense, fusion, lexical

CHUNKS = [(1, 10, 0, "user", "the deploy failed on the cache server", 1.0), (2, 10, 1, "assistant", "cache the deploy deploy", 2.0), (3, 11, 0, "user", "nothing here", 3.0), (4, 11, None, "user", None, 4.0), (5, None, 0, "user", "re-run re-run deploy-fix", 5.0), (5, None, 0, "user", "re-run re-run deploy-fix", 5.0)]
TASKS = [(1, 10, "deploy the cache", "ok", '["a", "b"]'), (7, 11, "deploy-fix or re-run", "fail", '["b"]'), (100, 10, "nothing deploy", " OK", "["), (101, None, "the", "ok", '["b"]'), (102, 11, None, "ok", None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder whose tasks mostly have ids that are not divisible by 100."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(CHUNKS, "chunk_id long, session_id long, turn_index int, role string, content string, created_at double").write.parquet(f"{d}/chunks.parquet")
    spark.createDataFrame([(*t, None) for t in TASKS], "trajectory_id long, session_id long, task string, outcome string, skills_used string, created_at double").write.parquet(f"{d}/trajectories.parquet")
    spark.createDataFrame([(i, [float((i * 7 + j) % 5 - 2) for j in range(128)]) for i in (1, 2, 3, 5, 6)], "chunk_id long, embedding array<float>").write.parquet(f"{d}/chunks_vec.parquet")
    return d


def equal_to_sql(spark, d, name):
    con = duckdb.connect()
    for t in ("chunks", "trajectories", "chunks_vec"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, d)
    r = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in df.columns)} FROM ({entry.oracle_sql()[name]})")
    plain = lambda row: tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)
    got, want = sorted(plain(x) for x in df.collect()), sorted(plain(x) for x in r.fetchall())
    assert got == want
    return df.columns, got


def test_all_tasks_are_asked_for_words(spark, tables):
    _, got = equal_to_sql(spark, tables, "rt2_bm25_topk")
    assert {r[0] for r in got} == {"1", "7", "100", "101"}


def test_bulk_bm25_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bulk, "CHARS", 3000)
    words = "deploy cache re-run fix server node-1 the of queue index plan".split()
    text = lambda c, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(c, j), F.lit(len(words))).cast("int") + 1)), " ")
    docs = spark.range(1500).select("id", text(F.col("id"), F.pmod(F.col("id"), F.lit(40)) + 1).alias("body"))
    asked = spark.range(60).select(F.col("id").alias("q"), text(F.col("id") + 7000, F.lit(5)).alias("text"))
    got = {tuple(r) for r in bulk.bm25_topk(docs.union(docs.limit(90)), "id", "body", asked, "q", "text", 7).collect()}
    assert got == {tuple(r) for r in lexical.bm25_topk(docs, "id", "body", asked, "q", "text", 7).collect()} and len(got) == 420
    assert bulk.bm25_topk(docs.limit(0), "id", "body", asked, "q", "text", 7).count() == 0
    assert bulk.bm25_topk(docs, "id", "body", asked.limit(0), "q", "text", 7).count() == 0


def test_all_tasks_are_asked_for_both_lists(spark, tables):
    _, got = equal_to_sql(spark, tables, "rt5_rrf_fusion")
    assert {r[0] for r in got} == {"1", "7", "100", "101", "102"}


def test_bulk_knn_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bulk, "VECTORS", 900)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(4000, 8)), 1))]
    vectors = spark.createDataFrame(rows + rows[:300] + [(9999, [0.0] * 8), (9998, [1.0] * 7), (9997, None)], "id long, v array<float>")
    asked = spark.createDataFrame([(10 * i, 37 * i) for i in range(100)] + [(1, 9999), (2, 123456)], "q long, own long")
    few = asked.join(vectors.dropDuplicates(["id"]).withColumnRenamed("id", "own"), "own")
    got = {tuple(r) for r in bulk.knn_topk(asked, "q", "own", vectors, "id", "v", 8, 5).collect()}
    assert got == {tuple(r) for r in dense.knn_topk(few, "q", "v", vectors, "id", "v", 8, 5).collect()} and len(got) == 500
    assert bulk.knn_topk(asked, "q", "own", vectors.limit(0), "id", "v", 8, 5).count() == 0


def test_arcs_of_all_tasks(spark, tables):
    columns, got = equal_to_sql(spark, tables, "rt10_session_arcs")
    assert {r[columns.index("query")] for r in got} == {"1", "100", "101"}


def test_arms_over_all_tasks(spark, tables):
    columns, got = equal_to_sql(spark, tables, "ev2_arms")
    assert {r[columns.index("queries")] for r in got} == {"4"} and len(got) == 4


def test_reranked_hits_of_all_tasks(spark, tables):
    columns, got = equal_to_sql(spark, tables, "rt7_mmr_rerank")
    assert {r[columns.index("query")] for r in got} == {"1", "7", "100", "101", "102"}


def test_diversified_arm_over_all_tasks(spark, tables):
    row = entry.queries()["ev2_diversified_arm"](spark, tables).first()
    assert (row.arm, row.queries) == ("rrf_mmr", 4)


def test_bulk_mmr_equals_mmr(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w_{x}" for x in rng.integers(0, 12, rng.integers(0, 9))) or None) for i in range(80)], "id long, body string")
    hits = spark.createDataFrame([(q, int(i), float(round(1 / (60 + j // 2), 9))) for q in range(30) for j, i in enumerate(rng.permutation(90)[:25])], "query long, id long, score double")
    got = {tuple(r) for r in bulk.mmr(hits, docs.union(docs), "id", "body", 0.7, 8).collect()}
    assert got == {tuple(r) for r in fusion.mmr(hits.join(docs, "id"), "body", 0.7, 8).collect()} and len(got) == 240


def test_sessions_of_all_tasks(spark, tables):
    columns, got = equal_to_sql(spark, tables, "ev3_session_scores")
    assert {r[columns.index("query")] for r in got} == {"1", "7", "100", "101", "102"}


def test_union_sizes(spark, monkeypatch):
    monkeypatch.setattr(bulk, "MEMBERS", 7)
    members = spark.createDataFrame([([f"t{j}" for j in range(6) if (i >> j) & 1],) for i in range(64)], "has array<string>")
    sets = spark.createDataFrame([(["t0", "t3"],), ([],), (["t5"],), (["none", "t1", "t2", "t4"],), (["t5"],)], "tags array<string>")
    assert {tuple(r.tags): r.n for r in bulk.union_sizes(sets, "tags", members, "has").collect()} == {("t0", "t3"): 48, (): 0, ("t5",): 32, ("none", "t1", "t2", "t4"): 56}
