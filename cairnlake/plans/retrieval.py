"""Queries of the retrieval family."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranking, text
from ..functions.vectors import as_double, norm, usable
from ..operators import browse, bulk, cluster, dense, fusion, lexical
from ..runtime import shared_dir, stage
from ..sources.tables import read_table
from .base import (
    C, DESCRIBED, FACT_V, FACTS, K, NOW, S, SKILL_V, T, V, VEC, bm25_sql, chunks, described, documents, fact_vectors, facts, knn_sql, query, query_units_sql, raw_chunks, sessions, skill_vectors, skills, terms_sql,
    trajectories, vectors,
)

# The query set of the searches: every row whose id is divisible by 100.
TASKS = f"(SELECT * FROM {T} WHERE trajectory_id % 100 = 0)"
ASKED_V = f"(SELECT * FROM {V} WHERE chunk_id % 100 = 0)"


def tasks(spark, d, every=100):
    return trajectories(spark, d).filter(F.col("trajectory_id") % every == 0)


def _all_bm25(spark, d, k=25):
    """Every task against every message."""
    return bulk.bm25_topk(raw_chunks(spark, d), "chunk_id", "content", trajectories(spark, d), "trajectory_id", "task", k)


def _bm25(spark, d, k=25, every=100):
    return lexical.bm25_topk(raw_chunks(spark, d), "chunk_id", "content", tasks(spark, d, every), "trajectory_id", "task", k, repeated=True)


def _task_vectors(spark, d, every=100):
    """A task's vector: that of its session's first message that has one."""
    v = vectors(spark, d).select("chunk_id", "embedding").filter(usable(F.col("embedding"), VEC))
    first = chunks(spark, d).join(v, "chunk_id").groupBy("session_id").agg(F.min_by("embedding", F.struct("turn_index", "chunk_id")).alias("embedding"))
    return tasks(spark, d, every).filter("session_id is not null").select("trajectory_id", "session_id").join(first, "session_id")


def _all_nearest(spark, d, k=25):
    """The messages nearest to every task; its vector as in ``_task_vectors``."""
    raw = read_table(spark, d, "chunks_vec")  # a row delivered twice changes no minimum
    has = raw.filter(usable(F.col("embedding"), VEC)).select("chunk_id")
    first = raw_chunks(spark, d).filter("session_id is not null").join(has, "chunk_id").groupBy("session_id").agg(F.min(F.struct(F.coalesce("turn_index", F.lit(-1)), "chunk_id")).getField("chunk_id").alias("asked"))
    asked = stage(trajectories(spark, d).select("trajectory_id", "session_id").join(first, "session_id").select("trajectory_id", "asked"), "asked")
    return bulk.knn_topk(asked, "trajectory_id", "asked", raw, "chunk_id", "embedding", VEC, k)


def _all_fused(spark, d):
    """Words and vectors of every task, fused."""
    lists = [_all_bm25(spark, d).withColumnRenamed("doc", "id"), _all_nearest(spark, d)]
    return lists, fusion.rrf([x.select("query", "id", "rank") for x in lists])


TASK_V = f"(SELECT trajectory_id, v FROM {TASKS} t JOIN (SELECT session_id, min_by(v, (coalesce(turn_index, -1), c.chunk_id)) AS v FROM {C} c JOIN {V} w ON c.chunk_id = w.chunk_id WHERE session_id IS NOT NULL GROUP BY session_id) f ON f.session_id = t.session_id)"
ALL_TASK_V = TASK_V.replace(TASKS, T)


@query(f"SELECT query, array_to_string(u, ' ') AS unit, count(*) AS times FROM (SELECT trajectory_id AS query, unnest({query_units_sql('task')}) AS u FROM {TASKS}) GROUP BY ALL")
def rt1_query_terms(spark, d):
    return lexical.asked_units(tasks(spark, d), "trajectory_id", "task").select("query", "unit", "times")


@query(f"WITH {bm25_sql(C, 'chunk_id', 'content', T, 'trajectory_id', 'task', 25)} SELECT query, doc, score, rank FROM bm")
def rt2_bm25_topk(spark, d):
    return _all_bm25(spark, d)


# Rows in a script without word spaces, which the tables hardly have.
CJK_ROWS = [(9_000_001, "部署失败后重启数据库"), (9_000_002, "今日重启数据库并检查日志"), (9_000_003, "データベースを再起動した"), (9_000_004, "deploy notes 部署失败")]
CJK_ASKED = [(1, "重启数据库"), (2, "部署失败"), (3, "再起動"), (4, "志"), (5, "没有这个"), (6, "deploy 部署失败")]
_values = lambda rows: ", ".join(f"({i}, '{t}')" for i, t in rows)
CJK_DOCS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values(CJK_ROWS)}))"
CJK_Q = f"(SELECT * FROM (VALUES {_values(CJK_ASKED)}) v(q, text))"
LITERAL = f"""(SELECT q AS query, doc_id AS doc, row_number() OVER (PARTITION BY q ORDER BY doc_id DESC) AS rank FROM {CJK_Q} a JOIN {CJK_DOCS} x ON contains(lower(x.text), lower(a.text)))"""


def _cjk(spark, d):
    docs = documents(spark, d).select("doc_id", "text").unionByName(spark.createDataFrame(CJK_ROWS, "doc_id long, text string"))
    return docs, spark.createDataFrame(CJK_ASKED, "q long, text string")


@query(f"SELECT query, doc, rank FROM {LITERAL} WHERE rank <= 25")
def rt3_substring_fallback(spark, d):
    docs, asked = _cjk(spark, d)
    return lexical.substring_topk(docs, "doc_id", "text", asked, "q", "text", 25)


@query(f"WITH {bm25_sql(CJK_DOCS, 'doc_id', 'text', CJK_Q, 'q', 'text', 8)} SELECT query, doc, rank, 'terms' AS channel FROM bm UNION ALL SELECT query, doc, rank, 'literal' FROM {LITERAL} WHERE rank <= 8 AND query NOT IN (SELECT query FROM bm)")
def rt8_lexical_only(spark, d):
    """Words first; a query that no word answers is looked for as a literal."""
    docs, asked = _cjk(spark, d)
    return lexical.lexical_channel(docs, "doc_id", "text", asked, "q", "text", 8)


@query()
def rt2_stemmed_topk(spark, d):
    """As the word search, by Porter stems (held against SQLite's index in the tests)."""
    return lexical.bm25_topk(raw_chunks(spark, d), "chunk_id", "content", tasks(spark, d), "trajectory_id", "task", 25, stem=True, repeated=True)


@query(f"WITH {bm25_sql(T, 'trajectory_id', 'task', TASKS, 'trajectory_id', 'task', 10)} SELECT query, doc, score, rank FROM bm")
def ix1_stored_index(spark, d):
    """The same search out of a written index."""
    index = lexical.StoredIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return index.ensure(trajectories(spark, d), "trajectory_id", "task").search(tasks(spark, d), "trajectory_id", "task", 10)


@query(f"WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 25)} SELECT query, id, cosine, rank FROM kn")
def rt4_knn_topk(spark, d):
    v = vectors(spark, d)
    return dense.knn_topk(v.filter("chunk_id % 100 = 0"), "chunk_id", "embedding", v, "chunk_id", "embedding", VEC, 25, exclude_self=True)


def fused_sql(asked: str, asked_v: str) -> str:
    return f"""WITH {bm25_sql(C, 'chunk_id', 'content', asked, 'trajectory_id', 'task', 25)}, {knn_sql(asked_v, 'trajectory_id', 'v', 25, skip_self=False)},
 fu AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, round(sum(1.0/(60+rank)), 9) AS score FROM
  (SELECT query, doc AS id, rank FROM bm UNION ALL SELECT query, id, rank FROM kn) GROUP BY query, id))"""


FUSED, ALL_FUSED = fused_sql(TASKS, TASK_V), fused_sql(T, ALL_TASK_V)


def _fused(spark, d, every=100):
    lex = _bm25(spark, d, every=every).withColumnRenamed("doc", "id")
    v = vectors(spark, d)
    near = dense.knn_topk(_task_vectors(spark, d, every), "trajectory_id", "embedding", v, "chunk_id", "embedding", VEC, 25)
    return fusion.rrf([lex, near])


@query(ALL_FUSED + " SELECT query, id, score, rank FROM fu")
def rt5_rrf_fusion(spark, d):
    return _all_fused(spark, d)[1]


@query(FUSED + f" SELECT query, id, score, rank, session_id, length(content) AS chars FROM fu JOIN {C} c ON c.chunk_id = id WHERE rank <= 8")
def rt6_hybrid_search(spark, d):
    return hybrid_search(spark, d)


def hybrid_search(spark, d, every=100, k=8):
    """(query, id, score, rank, session_id, chars): fused hits of the tasks whose id is divisible by ``every``."""
    hit = _fused(spark, d, every).filter(F.col("rank") <= k)
    c = chunks(spark, d).select(F.col("chunk_id").alias("id"), "session_id", F.char_length("content").alias("chars"))
    return hit.join(c, "id").select("query", "id", "score", "rank", "session_id", "chars")


_WORD_SET = "list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}_]+'))"
MMR = ALL_FUSED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
 h AS MATERIALIZED (SELECT fu.query, id, score, {_WORD_SET} AS w, score / max(score) OVER (PARTITION BY fu.query) AS rel FROM fu JOIN {C} c ON c.chunk_id = id),
 j AS MATERIALIZED (SELECT a.query, a.id AS a, b.id AS b, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS likeness FROM h a JOIN h b ON a.query = b.query AND a.id <> b.id),
 r AS (SELECT query, 1 AS n, [min_by(id, (-score, id))] AS picked FROM h GROUP BY query
  UNION ALL SELECT query, n + 1, list_append(picked, min_by(id, (-round(0.7*rel - 0.3*nearest, 12), -score, id))) FROM
   (SELECT r.query, n, picked, h.id, any_value(score) AS score, any_value(rel) AS rel, max(likeness) AS nearest FROM r JOIN h ON h.query = r.query AND NOT list_contains(picked, h.id) JOIN j ON j.query = r.query AND j.a = h.id AND list_contains(picked, j.b) WHERE n < 8 GROUP BY r.query, n, picked, h.id) GROUP BY query, n, picked),
 last AS (SELECT query, max_by(picked, n) AS picked FROM r GROUP BY query)
 SELECT query, unnest(picked) AS id, CAST(unnest(range(1, len(picked) + 1)) AS INT) AS pick FROM last"""


@query(MMR)
def rt7_mmr_rerank(spark, d):
    return bulk.mmr(stage(_all_fused(spark, d)[1].drop("rank"), "fused"), raw_chunks(spark, d), "chunk_id", "content", 0.7, 8)


@query()
def rt9_snippets(spark, d):
    hit = _bm25(spark, d, 3).join(tasks(spark, d).select(F.col("trajectory_id").alias("query"), "task"), "query")
    hit = hit.join(chunks(spark, d).select(F.col("chunk_id").alias("doc"), "content"), "doc")
    return hit.select("query", "doc", "rank", text.snippet("content", "task").alias("snippet"))


NUM = f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index NULLS FIRST, chunk_id) AS pos FROM {C} WHERE session_id IS NOT NULL)"


@query(f"""WITH {bm25_sql(C, 'chunk_id', 'content', T, 'trajectory_id', 'task', 30)}, p AS MATERIALIZED {NUM},
 h AS (SELECT query, session_id, arg_min(pos, (rank, doc)) AS spot, min((rank, doc)) AS b FROM bm JOIN p ON p.chunk_id = doc GROUP BY query, session_id),
 r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY b, session_id) AS arc_rank FROM h) WHERE arc_rank <= 3),
 e AS (SELECT session_id, max(pos) AS n FROM p GROUP BY session_id),
 s AS (SELECT r.*, n FROM r JOIN e ON e.session_id = r.session_id)
 SELECT s.session_id, query, arc_rank, part, p.pos, chunk_id FROM s JOIN p ON p.session_id = s.session_id JOIN (VALUES ('start'),('anchor'),('end')) x(part)
  ON (part = 'start' AND p.pos <= 3) OR (part = 'anchor' AND p.pos BETWEEN spot - 5 AND spot + 5) OR (part = 'end' AND p.pos > n - 3)""")
def rt10_session_arcs(spark, d):
    hits = _all_bm25(spark, d, 30).withColumnRenamed("doc", "id")
    return browse.session_arcs(chunks(spark, d), hits, 3, 5)


@query(f"""WITH p AS MATERIALIZED {NUM} SELECT a.chunk_id AS anchor, p.pos - a.pos AS "offset", p.chunk_id, p.role, p.content FROM p JOIN (SELECT * FROM p WHERE chunk_id % 100 = 0) a
 ON a.session_id = p.session_id AND p.pos BETWEEN a.pos - 2 AND a.pos + 2""")
def rt11_expand_around(spark, d):
    c = chunks(spark, d)
    return browse.around(c, c.filter("chunk_id % 100 = 0"), 2)


@query(f"""WITH t AS (SELECT session_id, coalesce(ended_at, started_at) AS last_at FROM {S} ORDER BY 2 DESC NULLS LAST, 1 DESC LIMIT 50)
 SELECT t.session_id, last_at, count(*) AS messages FROM t JOIN {C} c ON c.session_id = t.session_id GROUP BY ALL""")
def rt12_recent_sessions(spark, d):
    return browse.recent_sessions(sessions(spark, d), chunks(spark, d), 50)


FIRST_V = f"(SELECT session_id, min_by(v, (coalesce(turn_index, -1), c.chunk_id)) AS v FROM {C} c JOIN {V} w ON c.chunk_id = w.chunk_id WHERE session_id IS NOT NULL GROUP BY session_id)"
def _first_vectors(spark, d):
    """Each session's first vector."""
    v = vectors(spark, d).filter(usable(F.col("embedding"), VEC))
    return chunks(spark, d).filter("session_id is not null").join(v, "chunk_id").groupBy("session_id").agg(F.min_by("embedding", F.struct(F.coalesce("turn_index", F.lit(-1)), "chunk_id")).alias("embedding"))


TRAJ_V = f"(SELECT trajectory_id, v FROM {T} t JOIN {FIRST_V} f ON f.session_id = t.session_id)"


@query(f"""WITH {bm25_sql(T, 'trajectory_id', 'task', TASKS, 'trajectory_id', 'task', 20)}, {knn_sql(TASK_V, 'trajectory_id', 'v', 20, own=TRAJ_V, vid='trajectory_id', skip_self=False)},
 fu AS (SELECT query, id, round(sum(1.0/(60+rank)), 9) AS score FROM (SELECT query, doc AS id, rank FROM bm UNION ALL SELECT query, id, rank FROM kn) GROUP BY query, id),
 sc AS (SELECT query, id, round(score * (1 - 0.3*(1 - CASE WHEN created_at IS NULL OR created_at >= {NOW} THEN 1 ELSE pow(0.5, ({NOW} - created_at)/86400.0/30) END)), 9) AS score FROM fu JOIN {T} t ON t.trajectory_id = id)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 3""")
def rt13_trajectory_search(spark, d):
    """Words and vectors of past tasks, fused; older ones are demoted before the cut."""
    t = trajectories(spark, d)
    lex = lexical.bm25_topk(t, "trajectory_id", "task", tasks(spark, d), "trajectory_id", "task", 20).withColumnRenamed("doc", "id")
    own = t.select("trajectory_id", "session_id").join(_first_vectors(spark, d), "session_id")
    near = dense.knn_topk(_task_vectors(spark, d), "trajectory_id", "embedding", own, "trajectory_id", "embedding", VEC, 20)
    return fusion.aged(fusion.rrf([lex, near]), t.select(F.col("trajectory_id").alias("id"), "created_at"), "created_at", NOW, 0.3, 30, 3)


REFLECT = f"(SELECT trajectory_id, utility, created_at, t.session_id, v FROM {T} t JOIN {FIRST_V} f ON f.session_id = t.session_id WHERE reflection IS NOT NULL AND utility IS NOT NULL AND created_at IS NOT NULL)"
WORDS4 = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c},'')), '[a-z0-9]{{4,}}'))"
NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index NULLS FIRST, chunk_id) AS pos FROM {C} WHERE session_id IS NOT NULL)"
CITED = f"""(SELECT a.session_id, a.chunk_id, b.chunk_id AS reply_id, round(len(list_intersect(wa, wb)) / len(wa), 6) AS share, CASE WHEN len(list_intersect(wa, wb)) / len(wa) >= 0.3 THEN 1 ELSE 0 END AS cited
 FROM (SELECT *, {WORDS4('content')} AS wa FROM {NUMBERED}) a JOIN (SELECT *, {WORDS4('content')} AS wb FROM {NUMBERED}) b ON b.session_id = a.session_id AND b.pos = a.pos + 1 WHERE len(wa) > 0 AND b.role = 'assistant')"""


def citations(spark, d):
    """(session_id, chunk_id, reply_id, share, cited): how much of a message the reply after it takes up."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").asc_nulls_first(), "chunk_id")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit("[a-z0-9]{4,}"), 0))
    p = chunks(spark, d).filter("session_id is not null").select("session_id", "turn_index", "chunk_id", "role", words.alias("wa"))
    p = p.withColumn("reply_id", F.lead("chunk_id").over(w)).withColumn("wb", F.lead("wa").over(w)).withColumn("r", F.lead("role").over(w))
    share = ranking.overlap_share(F.col("wa"), F.col("wb"))
    p = p.filter((F.size("wa") > 0) & (F.col("r") == "assistant"))
    return p.select("session_id", "chunk_id", "reply_id", F.round(share, 6).alias("share"), (share >= 0.3).cast("int").alias("cited"))


@query(f"""WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 20, own=REFLECT, vid='trajectory_id', skip_self=False)}, ci AS (SELECT session_id, count(*) AS views, sum(cited) AS cites FROM {CITED} GROUP BY session_id),
 sc AS (SELECT query, kn.id, round(cosine + 0.3*utility + 0.2*(coalesce(cites, 0) + 1)/(coalesce(views, 0) + 2) + 0.15*least(1, pow(0.5, ({NOW} - created_at)/86400.0/30)), 6) AS score
  FROM kn JOIN {T} t ON t.trajectory_id = kn.id LEFT JOIN ci ON ci.session_id = t.session_id WHERE cosine >= 0.6)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5""")
def rt14_reflection_retrieval(spark, d):
    """Nearest reflections, by likeness, utility, how often they were taken up, and age."""
    t = trajectories(spark, d).filter("reflection is not null and utility is not null and created_at is not null")
    own = t.select("trajectory_id", "session_id").join(_first_vectors(spark, d), "session_id")
    v = vectors(spark, d).filter("chunk_id % 100 = 0")
    near = dense.knn_topk(v, "chunk_id", "embedding", own, "trajectory_id", "embedding", VEC, 20).filter("cosine >= 0.6")
    seen = citations(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("views"), F.sum("cited").alias("cites"))
    j = near.join(t.select(F.col("trajectory_id").alias("id"), "session_id", "utility", "created_at"), "id").join(seen, "session_id", "left")
    fresh = ranking.recency((F.lit(NOW) - F.col("created_at")) / 86400, 30)
    cite = (F.coalesce("cites", F.lit(0)) + 1) / (F.coalesce("views", F.lit(0)) + 2)
    s = j.select("query", "id", F.round(F.col("cosine") + 0.3 * F.col("utility") + 0.2 * cite + 0.15 * fresh, 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter("rank <= 5")


@query()
def rt15_case_injection(spark, d):
    """Past cases like the task: the nearest first, then by raw likeness against words in common (held against brute force in the tests)."""
    t = trajectories(spark, d).filter("task is not null")
    own = t.select("trajectory_id", "session_id").join(_first_vectors(spark, d), "session_id")
    near = dense.knn_topk(_task_vectors(spark, d), "trajectory_id", "embedding", own, "trajectory_id", "embedding", VEC, 8).filter("cosine >= 0.75")
    hits = near.join(t.select(F.col("trajectory_id").alias("id"), "task"), "id")
    return fusion.seeded_mmr(hits, "cosine", "task", 0.7, 4).join(t.select(F.col("trajectory_id").alias("id"), "outcome"), "id").select("query", "id", "pick", "outcome")


_ASCII = r"[a-zA-Z][a-zA-Z0-9_]*"
RULES = f"""(SELECT trajectory_id, task AS condition, coalesce(task, '') || ' ' || reflection AS rule, CAST(floor(utility*5) AS INT) AS helpful, CAST(floor((1-utility)*3) AS INT) AS harmful, created_at FROM {T} WHERE reflection IS NOT NULL AND utility IS NOT NULL)"""
RULE_Q = f"""(SELECT trajectory_id, array_to_string(list_distinct_in_order[1:12], ' ') AS terms FROM (SELECT trajectory_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM
 (SELECT trajectory_id, list_filter(list_transform(regexp_extract_all(substr(task, 1, 500), '{_ASCII}'), lambda x: lower(x)), lambda x: length(x) >= 4) AS w FROM {TASKS})))"""


@query(f"""WITH {bm25_sql(RULES, 'trajectory_id', 'rule', RULE_Q, 'trajectory_id', 'terms', 9)},
 sc AS (SELECT query, doc, bm.rank AS lexical_rank, round(helpful - harmful + CASE WHEN created_at IS NULL OR created_at >= {NOW} THEN 1 ELSE pow(0.5, ({NOW} - created_at)/86400.0/30) END, 6) AS value FROM bm JOIN {RULES} r ON r.trajectory_id = doc)
 SELECT * FROM (SELECT query, doc, value, row_number() OVER (PARTITION BY query ORDER BY value DESC, lexical_rank) AS rank FROM sc) WHERE rank <= 3""")
def rt16_principle_retrieval(spark, d):
    """Rules whose words fit the task: three times as many as wanted, then by proven worth and age."""
    t = trajectories(spark, d).filter("reflection is not null and utility is not null")
    count = lambda c: F.floor(c).cast("int")
    rules = t.select("trajectory_id", F.concat(F.coalesce("task", F.lit("")), F.lit(" "), "reflection").alias("rule"), count(F.col("utility") * 5).alias("helpful"), count((1 - F.col("utility")) * 3).alias("harmful"), "created_at")
    words = F.filter(F.transform(F.regexp_extract_all(F.substring("task", 1, 500), F.lit(_ASCII), 0), F.lower), lambda x: F.char_length(x) >= 4)
    asked = tasks(spark, d).select("trajectory_id", F.array_join(F.slice(F.array_distinct(words), 1, 12), " ").alias("terms"))
    hit = lexical.bm25_topk(rules, "trajectory_id", "rule", asked, "trajectory_id", "terms", 9).withColumnRenamed("rank", "lexical_rank")
    j = hit.join(rules.withColumnRenamed("trajectory_id", "doc"), "doc")
    age = F.coalesce((F.lit(NOW) - F.col("created_at")) / 86400, F.lit(0.0))
    s = j.select("query", "doc", F.round(F.col("helpful") - F.col("harmful") + ranking.recency(age, 30), 6).alias("value"), "lexical_rank")
    w = Window.partitionBy("query").orderBy(F.desc("value"), "lexical_rank")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("query", "doc", "value", "rank")


@query(f"""WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 64, own=FACT_V, vid='fact_id', skip_self=False)}, sc AS (SELECT query, id, round(greatest(0, cosine), 6) AS relevance, (1 - cosine) / greatest(trust, 0.01) AS adjusted FROM kn JOIN {FACTS} f ON f.fact_id = id
 WHERE fact_type IN ('cheatsheet','expel') AND invalid_at IS NULL AND trust >= 0.3)
 SELECT query, id, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(adjusted, 9), id) AS rank FROM sc) WHERE rank <= 5""")
def rt17_lesson_retrieval(spark, d):
    """The k nearest come first, the filter after, so a query may keep fewer; least distance for its trust first."""
    v = vectors(spark, d).filter("chunk_id % 100 = 0")
    near = dense.knn_topk(v, "chunk_id", "embedding", fact_vectors(spark, d), "fact_id", "embedding", VEC, 64)
    live = facts(spark, d).filter("fact_type in ('cheatsheet','expel') and invalid_at is null and trust >= 0.3").select(F.col("fact_id").alias("id"), "trust")
    far = 1 - F.col("cosine")
    s = near.join(live, "id").select("query", "id", F.round(F.greatest(F.lit(0.0), F.col("cosine")), 6).alias("relevance"), F.round(far / F.greatest("trust", F.lit(0.01)), 9).alias("adjusted"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("adjusted", "id"))).filter("rank <= 5").drop("adjusted")


_NAME_WORDS = "list_distinct(regexp_extract_all(lower(skill_name), '[\\p{L}\\p{N}]+'))"
SKILL_HITS = f"""{knn_sql(TASK_V, 'trajectory_id', 'v', 15, own=SKILL_V, vid='skill_id', skip_self=False)}, tot AS (SELECT sum(use_count) AS total FROM {K} WHERE skill_status <> 'deprecated'),
 adj AS (SELECT query, id, round(1 - cosine - 0.05*(success_count/greatest(use_count,1) + sqrt(2*ln(total+1)/greatest(use_count,1))) - CASE WHEN len({_NAME_WORDS}) > 0 THEN 0.1*len(list_intersect({_NAME_WORDS}, list_distinct({terms_sql('task')})))/len({_NAME_WORDS}) ELSE 0 END, 6) AS adjusted
  FROM kn JOIN {K} s ON s.skill_id = id JOIN {TASKS} t ON t.trajectory_id = query, tot WHERE skill_status <> 'deprecated')"""


def _skill_hits(spark, d):
    k = skills(spark, d).filter("skill_status <> 'deprecated'")
    total = k.agg(F.sum("use_count").alias("total"))
    near = dense.knn_topk(_task_vectors(spark, d), "trajectory_id", "embedding", skill_vectors(spark, d), "skill_id", "embedding", VEC, 15)
    j = near.join(k.select(F.col("skill_id").alias("id"), "skill_name", "use_count", "success_count"), "id").join(F.broadcast(total))
    j = j.join(tasks(spark, d).select(F.col("trajectory_id").alias("query"), "task"), "query")
    words = lambda c: F.array_distinct(text.terms(F.col(c)))
    score = ranking.ucb1(1 - F.col("cosine"), F.col("use_count"), F.col("success_count"), F.col("total"), 0.05)
    return j.select("query", "id", F.round(ranking.name_overlap(score, words("skill_name"), words("task"), 0.1), 6).alias("adjusted"))


@query(f"WITH {SKILL_HITS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY adjusted, id) AS rank FROM adj) WHERE rank <= 5")
def rt18_skill_search(spark, d):
    """Nearest skills by vector, deprecated ones dropped, distances less an optimistic success rate and words of the name."""
    return _skill_hits(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("adjusted", "id"))).filter("rank <= 5")


@query()
def rt18_skill_siblings(spark, d):
    """The same hits with like ones under the first (held against brute force in the tests)."""
    ranked = _skill_hits(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("adjusted", "id")))
    return cluster.siblings(ranked.join(skill_vectors(spark, d).select(F.col("skill_id").alias("id"), "embedding"), "id"), "embedding", 0.82, 5)


@query(f"""WITH {knn_sql(TASK_V, 'trajectory_id', 'v', 15, own=SKILL_V, vid='skill_id', skip_self=False)}, adj AS (SELECT query, id, round(CASE WHEN use_count >= 3 THEN 1 - cosine - 0.003*success_count/use_count ELSE 1 - cosine END, 6) AS adjusted FROM kn JOIN {K} s ON s.skill_id = id WHERE skill_status <> 'deprecated')
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY adjusted, id) AS rank FROM adj) WHERE rank <= 5""")
def rk2_success_weighted(spark, d):
    k = skills(spark, d).filter("skill_status <> 'deprecated'").select(F.col("skill_id").alias("id"), "use_count", "success_count")
    near = dense.knn_topk(_task_vectors(spark, d), "trajectory_id", "embedding", skill_vectors(spark, d), "skill_id", "embedding", VEC, 15).join(k, "id")
    s = near.select("query", "id", F.round(ranking.success_weighted(1 - F.col("cosine"), F.col("use_count"), F.col("success_count"), 0.3, 3), 6).alias("adjusted"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("adjusted", "id"))).filter("rank <= 5")


SKILL_DOCS = f"(SELECT skill_id, skill_name || ' ' || coalesce(description, '') AS words FROM {K} k LEFT JOIN {DESCRIBED} x ON x.name = k.skill_name)"


@query(f"WITH {bm25_sql(SKILL_DOCS, 'skill_id', 'words', TASKS, 'trajectory_id', 'task', 5)} SELECT query, doc, round(1/(1+score), 6) AS distance, rank FROM bm")
def rt19_skill_lexical(spark, d):
    """Skills by the words of their name and description, without stems."""
    k = skills(spark, d).join(described(spark, d), F.col("skill_name") == F.col("name"), "left")
    docs = k.select("skill_id", F.concat_ws(" ", "skill_name", F.coalesce("description", F.lit(""))).alias("words"))
    hit = lexical.bm25_topk(docs, "skill_id", "words", tasks(spark, d), "trajectory_id", "task", 5)
    return hit.select("query", "doc", F.round(1 / (1 + F.col("score")), 6).alias("distance"), "rank")


@query(f"WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 1)} SELECT query, id, cosine FROM kn WHERE cosine >= 0.85")
def rt20_nearest_duplicate(spark, d):
    v = vectors(spark, d)
    near = dense.knn_topk(v.filter("chunk_id % 100 = 0"), "chunk_id", "embedding", v, "chunk_id", "embedding", VEC, 1, exclude_self=True)
    return near.filter("cosine >= 0.85").select("query", "id", "cosine")


@query(f"""SELECT session_id, trajectory_id, row_number() OVER (PARTITION BY session_id ORDER BY trajectory_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY trajectory_id DESC) AS r
 FROM {T} WHERE reflection IS NOT NULL AND session_id IS NOT NULL AND trajectory_id > 100) WHERE r <= 5""")
def rt21_since_watermark(spark, d):
    t = trajectories(spark, d).filter("reflection is not null and session_id is not null and trajectory_id > 100")
    new = t.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("trajectory_id")))).filter("r <= 5")
    return new.select("session_id", "trajectory_id", F.row_number().over(Window.partitionBy("session_id").orderBy("trajectory_id")).alias("place"))


@query(f"SELECT task AS text, count(*) AS n FROM {T} WHERE task IS NOT NULL GROUP BY task")
def rt22_distinct_query_texts(spark, d):
    return trajectories(spark, d).filter("task is not null").groupBy(F.col("task").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, skill_name, round(CASE WHEN len(n) > 0 THEN 0.5 - 0.2 * len(list_intersect(n, q)) / len(n) ELSE 0.5 END, 6) AS distance FROM
 (SELECT doc_id, skill_name, list_distinct(regexp_extract_all(lower(skill_name), '[\\p{{L}}\\p{{N}}_]+')) AS n, list_distinct(regexp_extract_all(lower(coalesce(text,'')), '[\\p{{L}}\\p{{N}}_]+')) AS q FROM documents WHERE skill_name IS NOT NULL)""")
def rk3_name_overlap(spark, d):
    x = documents(spark, d).filter("skill_name is not null")
    return x.select("doc_id", "skill_name", F.round(ranking.name_overlap(F.lit(0.5), text.word_set(F.col("skill_name")), text.word_set(F.col("text")), 0.2), 6).alias("distance"))


@query(f"SELECT chunk_id, reply_id, share, cited FROM {CITED}")
def rk5_citation(spark, d):
    return citations(spark, d).drop("session_id")


@query(f"SELECT chunk_id, round(sqrt(list_sum(list_transform(v[1:64], lambda x: x*x))), 5) AS head_norm FROM {V}")
def rk11_truncated_norm(spark, d):
    v = vectors(spark, d).filter(usable(F.col("embedding"), VEC))
    return v.select("chunk_id", F.round(norm(as_double(F.slice("embedding", 1, 64))), 5).alias("head_norm"))
