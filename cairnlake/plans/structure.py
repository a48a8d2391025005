"""Queries over structure: sessions, joins, aggregates, windows, graphs, clusters, folds, retention, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import usable
from ..operators import browse, bulk, cluster, dense, evaluate, folds, graph, retention
from ..runtime import stage
from .base import C, K, NOW, S, T, V, VEC, bm25_sql, chunks, documents, knn_sql, query, raw_chunks, sessions, skill_vectors, skills, strip_sql, trajectories, vectors
from .retrieval import ASKED_V, FIRST_V, NUM, _all_bm25, _bm25, _first_vectors, tasks


@query(f"SELECT session_id, pos, chunk_id FROM {NUM}")
def wn1_turn_numbers(spark, d):
    return browse.numbered(chunks(spark, d)).select("session_id", "pos", "chunk_id")


@query(f"WITH p AS {NUM}, n AS (SELECT session_id, count(*) AS n FROM p GROUP BY session_id) SELECT p.session_id, chunk_id, pos, n - pos + 1 AS from_end FROM p JOIN n ON n.session_id = p.session_id WHERE pos <= 3 OR n - pos < 3")
def wn2_bookends(spark, d):
    return browse.bookends(chunks(spark, d), 3).select("session_id", "chunk_id", "pos", "from_end")


@query(f"SELECT session_id, min_by(chunk_id, (coalesce(turn_index, -1), chunk_id)) AS first_chunk, count(*) AS messages FROM {C} WHERE session_id IS NOT NULL GROUP BY session_id")
def wn3_first_chunk(spark, d):
    c = chunks(spark, d).filter("session_id is not null")
    return c.groupBy("session_id").agg(F.min_by("chunk_id", F.struct(F.coalesce("turn_index", F.lit(-1)), "chunk_id")).alias("first_chunk"), F.count(F.lit(1)).alias("messages"))


@query(f"""SELECT session_id, chunk_id, substr(content, 1, 400) AS clipped, r FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC NULLS LAST, chunk_id DESC) AS r FROM {C} WHERE session_id IN (SELECT session_id FROM {T} WHERE outcome = 'fail')) WHERE r <= 6""")
def wn4_failing_tails(spark, d):
    bad = trajectories(spark, d).filter("outcome = 'fail' and session_id is not null").select("session_id").distinct()
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc_nulls_last(), F.desc("chunk_id"))
    c = chunks(spark, d).join(bad, "session_id", "left_semi").withColumn("r", F.row_number().over(w)).filter("r <= 6")
    return c.select("session_id", "chunk_id", F.substring("content", 1, 400).alias("clipped"), "r")


@query(f"""SELECT session_id, chunk_id, tokens, running FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn_index DESC NULLS LAST, chunk_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM
 (SELECT *, CASE WHEN content IS NULL THEN 0 ELSE CAST(greatest(1, octet_length(encode(content)) // 3) AS INT) END AS tokens FROM {C} WHERE session_id IS NOT NULL)) WHERE running <= 500""")
def sf25_token_budget_tail(spark, d):
    t = F.when(F.col("content").isNotNull(), text.token_estimate(F.col("content")))
    return browse.tail_under_budget(chunks(spark, d), t, 500).select("session_id", "chunk_id", "tokens", "running")


@query(f"SELECT DISTINCT chunk_id FROM chunks_vec WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)")
def jn14_orphan_vectors(spark, d):
    """Vectors whose message is gone."""
    c = chunks(spark, d).select("chunk_id")
    return vectors(spark, d).select("chunk_id").join(c, "chunk_id", "left_anti").distinct()


@query(f"SELECT chunk_id, session_id FROM {C} WHERE session_id IN (SELECT session_id FROM {T} WHERE outcome = 'ok')")
def jn7_ok_session_chunks(spark, d):
    ok = trajectories(spark, d).filter("outcome = 'ok' and session_id is not null").select("session_id").distinct()
    return chunks(spark, d).join(ok, "session_id", "left_semi").select("chunk_id", "session_id")


USES = f"(SELECT trajectory_id, session_id, task, outcome, created_at, unnest(skills) AS skill FROM {T})"


def uses(spark, d):
    return trajectories(spark, d).select("trajectory_id", "session_id", "task", "outcome", "created_at", F.explode("skills").alias("skill"))


@query(f"""SELECT skill, c.chunk_id, role FROM (SELECT DISTINCT skill, session_id FROM {USES} WHERE outcome IN ('fail','partial') AND session_id IS NOT NULL) u JOIN {C} c ON c.session_id = u.session_id""")
def jn5_failure_context(spark, d):
    u = uses(spark, d).filter(F.col("outcome").isin("fail", "partial") & F.col("session_id").isNotNull()).select("skill", "session_id").distinct()
    return chunks(spark, d).join(u, "session_id").select("skill", "chunk_id", "role")


@query(f"SELECT skill, count(DISTINCT session_id) AS sessions, count(*) AS uses, count(*) FILTER (WHERE outcome = 'ok') AS wins, max(created_at) AS last_used FROM {USES} GROUP BY skill")
def ag2_skill_rollup(spark, d):
    win = F.sum((F.col("outcome") == "ok").cast("int"))
    return uses(spark, d).groupBy("skill").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("uses"), win.alias("wins"), F.max("created_at").alias("last_used"))


@query(f"SELECT skill, session_id, task, outcome, max(created_at) AS created_at FROM {USES} WHERE outcome = 'ok' AND session_id IS NOT NULL GROUP BY ALL")
def sk23_training_export(spark, d):
    u = uses(spark, d).filter("outcome = 'ok' and session_id is not null")
    return u.groupBy("skill", "session_id", "task", "outcome").agg(F.max("created_at").alias("created_at"))


@query(f"SELECT s.skill_status, coalesce(n, 0) AS n FROM (VALUES ('draft'),('active'),('stale'),('deprecated')) s(skill_status) LEFT JOIN (SELECT skill_status, count(*) AS n FROM {K} GROUP BY skill_status) k ON k.skill_status = s.skill_status")
def ag1_status_counts(spark, d):
    names = spark.createDataFrame([(x,) for x in ("draft", "active", "stale", "deprecated")], "skill_status string")
    n = skills(spark, d).groupBy("skill_status").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "skill_status", "left").select("skill_status", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT session_id, max(turn_index) AS last_turn FROM {C} WHERE session_id IS NOT NULL GROUP BY session_id")
def ag5_last_turn(spark, d):
    return chunks(spark, d).filter("session_id is not null").groupBy("session_id").agg(F.max("turn_index").alias("last_turn"))


@query(f"SELECT 'sessions' AS name, count(*) AS n FROM {S} UNION ALL SELECT 'open_sessions', count(*) FILTER (WHERE ended_at IS NULL) FROM {S} UNION ALL SELECT 'chunks', count(*) FROM {C} UNION ALL SELECT 'skills', count(*) FROM skill_stats UNION ALL SELECT 'trajectories', count(*) FROM {T}")
def pj12_status_snapshot(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    s = sessions(spark, d)
    out = n(s, "sessions").unionByName(n(s.filter("ended_at is null"), "open_sessions"))
    return out.unionByName(n(chunks(spark, d), "chunks")).unionByName(n(skills(spark, d), "skills")).unionByName(n(trajectories(spark, d), "trajectories"))


@query(f"SELECT outcome, CAST(round(avg(utility), 6) AS DOUBLE) AS mean, CAST(round(quantile_cont(utility, 0.5), 6) AS DOUBLE) AS median FROM {T} WHERE utility IS NOT NULL GROUP BY outcome")
def ag9_mean_median(spark, d):
    t = trajectories(spark, d).filter("utility is not null")
    return t.groupBy("outcome").agg(F.round(F.avg("utility"), 6).alias("mean"), F.round(F.percentile("utility", 0.5), 6).alias("median"))


@query("SELECT coalesce(doc_kind, 'all') AS doc_kind, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((doc_kind, source), (doc_kind), ())")
def ag11_grouping_sets(spark, d):
    x = documents(spark, d)
    g = x.groupingSets([["doc_kind", "source"], ["doc_kind"], []], "doc_kind", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("doc_kind", F.lit("all")).alias("doc_kind"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query("SELECT skill_id, skill_name, use_count FROM skill_stats ORDER BY use_count DESC, skill_id LIMIT 20")
def tk8_most_used(spark, d):
    return skills(spark, d).orderBy(F.desc("use_count"), "skill_id").limit(20).select("skill_id", "skill_name", "use_count")


@query("SELECT skill_name, doc_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY skill_name ORDER BY updated_at DESC, doc_id DESC) AS r FROM documents WHERE skill_name IS NOT NULL AND updated_at IS NOT NULL) WHERE r = 1")
def wn11_latest_per_key(spark, d):
    log = documents(spark, d).filter("skill_name is not null and updated_at is not null").withColumn("tie", F.col("doc_id"))
    return folds.last_value(log, "skill_name", "doc_id", "updated_at", "tie").select("skill_name", "doc_id", "updated_at")


@query(f"SELECT key FROM (SELECT lower(trim(session_key)) AS key, max(coalesce(ended_at, started_at)) AS seen FROM {S} WHERE trim(coalesce(session_key, '')) <> '' GROUP BY 1) ORDER BY seen DESC NULLS LAST, key LIMIT 32")
def wn10_recent_keys(spark, d):
    s = sessions(spark, d).filter(F.trim(F.coalesce("session_key", F.lit(""))) != "")
    k = s.groupBy(F.lower(F.trim("session_key")).alias("key")).agg(F.max(F.coalesce("ended_at", "started_at")).alias("at"))
    return k.orderBy(F.desc_nulls_last("at"), "key").limit(32).select("key")


@query(f"SELECT session_id, min(ended_at) AS ended_at FROM {S} WHERE ended_at IS NOT NULL GROUP BY session_id")
def sk6_first_end(spark, d):
    return sessions(spark, d).filter("ended_at is not null").groupBy("session_id").agg(F.min("ended_at").alias("ended_at"))


@query(f"""SELECT session_id, substr(min_by({strip_sql('content')}, (coalesce(turn_index, 2147483647), chunk_id)), 1, 500) AS task, max(created_at) AS last_at FROM {C} WHERE session_id IS NOT NULL AND lower(trim(role)) IN ('user','human') AND {strip_sql('content')} <> '' GROUP BY session_id""")
def sk4_trajectory_build(spark, d):
    u = chunks(spark, d).filter("session_id is not null and lower(trim(role)) in ('user','human')").filter(text.strip(F.col("content")) != "")
    key = F.struct(F.coalesce("turn_index", F.lit(2147483647)), "chunk_id")
    return u.groupBy("session_id").agg(F.substring(F.min_by(text.strip(F.col("content")), key), 1, 500).alias("task"), F.max("created_at").alias("last_at"))


@query(f"""SELECT coalesce(k.skill_name, n.skill) AS skill_name, CASE WHEN k.skill_name IS NULL THEN 'draft' ELSE k.skill_status END AS skill_status, CASE WHEN n.skill IS NULL THEN k.use_count ELSE n.uses END AS use_count
 FROM {K} k FULL JOIN (SELECT skill, count(*) AS uses FROM {USES} GROUP BY skill) n ON n.skill = k.skill_name""")
def sk8_merged_skills(spark, d):
    old = skills(spark, d).select("skill_name", "skill_status", "use_count")
    new = uses(spark, d).groupBy(F.col("skill").alias("skill_name")).agg(F.count(F.lit(1)).alias("use_count")).withColumn("skill_status", F.lit("draft"))
    return retention.merge_snapshot(old, new, "skill_name", keep=["skill_status"])


@query("SELECT skill_id, skill_name FROM skill_stats WHERE skill_name NOT IN (SELECT skill_name FROM documents WHERE skill_name IS NOT NULL)")
def sk9_vanished_skills(spark, d):
    here = documents(spark, d).filter("skill_name is not null").select("skill_name").distinct()
    return skills(spark, d).join(here, "skill_name", "left_anti").select("skill_id", "skill_name")


@query("SELECT a.doc_id FROM documents a WHERE a.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.text = a.text AND b.doc_id < a.doc_id)")
def jn15_unseen_content(spark, d):
    x = documents(spark, d).filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return x.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"WITH k AS (SELECT skill_name AS name, 1 AS p, skill_id AS id FROM skill_stats WHERE origin = 'agent' UNION ALL SELECT skill_name, 2, skill_id FROM skill_stats WHERE origin <> 'agent' UNION ALL SELECT skill_name, 3, doc_id FROM documents WHERE skill_name IS NOT NULL) SELECT name, p AS source, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p, id) AS r FROM k) WHERE r = 1")
def sc9_skill_precedence(spark, d):
    k = skills(spark, d).select(F.col("skill_name").alias("name"), F.when(F.col("origin") == "agent", 1).otherwise(2).alias("source"), F.col("skill_id").alias("id"))
    x = documents(spark, d).filter("skill_name is not null").select(F.col("skill_name").alias("name"), F.lit(3).alias("source"), F.col("doc_id").alias("id"))
    return k.unionByName(x).groupBy("name").agg(F.min(F.struct("source", "id")).alias("m")).select("name", "m.source", "m.id")


# ---------------------------------------------------------------- graphs

PAIRS = f"(SELECT a.skill AS a, b.skill AS b, count(*) AS n, max(a.created_at) AS last_at FROM (SELECT DISTINCT trajectory_id, skill, max(created_at) OVER (PARTITION BY trajectory_id) AS created_at FROM {USES}) a JOIN (SELECT DISTINCT trajectory_id, skill FROM {USES}) b ON a.trajectory_id = b.trajectory_id AND a.skill < b.skill GROUP BY ALL)"


def _pairs(spark, d):
    return graph.pair_counts(uses(spark, d), "trajectory_id", "skill", "created_at")


@query(f"SELECT a, b, n, last_at FROM {PAIRS}")
def gr4_co_use(spark, d):
    return _pairs(spark, d)


@query(f"SELECT node, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other) AS rank FROM (SELECT a AS node, b AS other, n FROM {PAIRS} UNION ALL SELECT b, a, n FROM {PAIRS}) WHERE n >= 2) WHERE rank <= 3")
def jn11_partners(spark, d):
    return graph.partners(_pairs(spark, d), 2, 3)


def _near(spark, d, k):
    v = vectors(spark, d)
    return dense.knn_topk(v.filter("chunk_id % 100 = 0"), "chunk_id", "embedding", v, "chunk_id", "embedding", VEC, k, exclude_self=True)


@query(f"WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 3)} SELECT least(query, id) AS a, greatest(query, id) AS b, max(cosine) AS cosine FROM kn WHERE cosine >= 0.78 GROUP BY ALL")
def gr1_links(spark, d):
    return graph.links(_near(spark, d, 3), 0.78)


@query(f"WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 8)}, e AS (SELECT DISTINCT least(query, id) AS a, greatest(query, id) AS b, cosine FROM kn WHERE cosine >= 0.78) SELECT node, other, rank FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, other) AS rank FROM (SELECT a AS node, b AS other, cosine FROM e UNION ALL SELECT b, a, cosine FROM e)) WHERE rank <= 5")
def gr3_neighbours_of(spark, d):
    e = graph.both_ways(graph.links(_near(spark, d, 8), 0.78))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))).filter("rank <= 5").select("node", "other", "rank")


@query(f"""WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 8)}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS nth FROM kn WHERE cosine >= 0.84) WHERE nth <= 4)
 SELECT query AS newer, f.id AS older, cosine FROM f JOIN {C} a ON a.chunk_id = query JOIN {C} b ON b.chunk_id = f.id WHERE b.created_at < a.created_at""")
def gr6_superseded(spark, d):
    times = chunks(spark, d).select(F.col("chunk_id").alias("id"), F.col("created_at").alias("at"))
    return graph.older_near(_near(spark, d, 8), times, 0.84, 4)


@query(f"""WITH x AS (SELECT skill, list(DISTINCT outcome ORDER BY outcome) AS o FROM {USES} GROUP BY skill), e AS (SELECT a, b FROM {PAIRS} WHERE n >= 2) SELECT a, b, array_to_string(list_concat(p.o, list_filter(q.o, lambda z: NOT list_contains(p.o, z)))[1:3], ',') AS tags FROM e JOIN x p ON p.skill = a JOIN x q ON q.skill = b""")
def gr2_merged_tags(spark, d):
    tags = uses(spark, d).groupBy("skill").agg(F.array_sort(F.collect_set("outcome")).alias("o"))
    e = _pairs(spark, d).filter("n >= 2").select("a", "b")
    j = e.join(tags.select(F.col("skill").alias("a"), F.col("o").alias("p")), "a").join(tags.select(F.col("skill").alias("b"), F.col("o").alias("q")), "b")
    return j.select("a", "b", F.array_join(graph.merged_tags(F.col("p"), F.col("q"), 3), ",").alias("tags"))


# A user's purchases stand for what was active together: sessions of the table have one reflection at most.
@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'purchase'), x AS (SELECT user_id, event_id % 97 AS item FROM r WHERE k <= 20 GROUP BY ALL)
 SELECT a.item AS a, b.item AS b, count(*) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND a.item < b.item GROUP BY ALL""")
def gr5_coactivation(spark, d):
    """Pairs among the 20 highest ids of each key."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'purchase'")
    top = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).filter("k <= 20")
    return graph.pair_counts(top.select("user_id", (F.col("event_id") % 97).alias("item"), "ts"), "user_id", "item", "ts").select("a", "b", "n")


CONTRAST = f"(SELECT trajectory_id, outcome, created_at, v FROM {T} t JOIN {FIRST_V} f ON f.session_id = t.session_id WHERE outcome IN ('ok','fail','partial') AND created_at >= {NOW} - 90*86400)"


@query(f"""WITH x AS {CONTRAST}, o AS (SELECT * FROM x WHERE outcome = 'ok' ORDER BY created_at DESC, trajectory_id LIMIT 50)
 SELECT trajectory_id, other, cosine FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY cosine DESC, other) AS r FROM (SELECT a.trajectory_id, b.trajectory_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
  FROM x a JOIN o b ON a.outcome <> 'ok')) WHERE r = 1""")
def jn16_contrast_pairs(spark, d):
    """Every failure's most similar success, among the newest 50 of the last 90 days."""
    t = trajectories(spark, d).filter(F.col("outcome").isin("ok", "fail", "partial") & (F.col("created_at") >= NOW - 90 * 86400)).select("trajectory_id", "session_id", "outcome", "created_at")
    x = t.join(_first_vectors(spark, d), "session_id")
    good = x.filter(text.outcome_class(F.col("outcome")) == "success").orderBy(F.desc("created_at"), "trajectory_id").limit(50)
    bad = x.filter(text.outcome_class(F.col("outcome")) == "failure")
    # the bounded side is the block of queries; every failure keeps its best of them
    near = dense.knn_topk(good, "trajectory_id", "embedding", bad, "trajectory_id", "embedding", VEC, None)
    best = near.groupBy(F.col("id").alias("trajectory_id")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("query").alias("other"))).alias("b"))
    return best.select("trajectory_id", "b.other", (-F.col("b.c")).alias("cosine"))


@query(f"WITH {knn_sql(ASKED_V, 'chunk_id', 'v', 64)} SELECT chunk_id FROM {ASKED_V} WHERE chunk_id NOT IN (SELECT query FROM kn WHERE cosine >= 0.92 AND id < query)")
def sk14_novel_vectors(spark, d):
    v = vectors(spark, d).filter((F.col("chunk_id") % 100 == 0) & usable(F.col("embedding"), VEC))
    old = _near(spark, d, 64).filter("cosine >= 0.92 and id < query").select(F.col("query").alias("chunk_id"))
    return v.select("chunk_id").join(old, "chunk_id", "left_anti")


# -------------------------------------------------------------- clusters


def _newest(spark, d, n):
    """The newest n messages of successful sessions that have a vector, as one bounded group."""
    v = vectors(spark, d).filter(usable(F.col("embedding"), VEC))
    ok = trajectories(spark, d).filter("outcome = 'ok' and session_id is not null").select("session_id").distinct()
    c = chunks(spark, d).join(ok, "session_id", "left_semi").join(v, "chunk_id").filter("created_at is not null")
    top = c.orderBy(F.desc("created_at"), "chunk_id").limit(n)
    return top.select(F.lit(0).alias("g"), "chunk_id", "session_id", "created_at", (-F.col("created_at")).alias("age"), "embedding")


@query()
def cl1_greedy_clusters(spark, d):
    """Feature: the newest 150 messages only."""
    return cluster.clustered(_newest(spark, d, 150), "g", "chunk_id", ["age", "chunk_id"], "embedding", lambda x: cluster.greedy(x, 0.8)).select("chunk_id", "cluster")


@query()
def cl2_hub_clusters(spark, d):
    """Clusters over at least two sessions, with their sessions, three samples and all ids."""
    rows = _newest(spark, d, 150)
    m = cluster.clustered(rows, "g", "chunk_id", ["age", "chunk_id"], "embedding", lambda x: cluster.greedy(x, 0.8))
    body = chunks(spark, d).select("chunk_id", F.substring("content", 1, 500).alias("sample"))
    j = m.join(rows.select("chunk_id", "session_id", "age"), "chunk_id").join(body, "chunk_id")
    first = F.slice(F.array_sort(F.collect_list(F.struct("age", "chunk_id", "sample"))), 1, 3)  # at most 150 rows in all
    g = j.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("session_id")).alias("sessions"), F.transform(first, lambda x: x["sample"]).alias("samples"), F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    return g.filter((F.col("size") >= 2) & (F.size("sessions") >= 2))


@query()
def cl4_workflow_clusters(spark, d):
    t = trajectories(spark, d).filter("outcome = 'ok' and session_id is not null and created_at is not null").join(_first_vectors(spark, d), "session_id")
    top = t.orderBy(F.desc("created_at"), "trajectory_id").limit(100).select(F.lit(0).alias("g"), "trajectory_id", "session_id", (-F.col("created_at")).alias("age"), "embedding")
    m = cluster.clustered(top, "g", "trajectory_id", ["age", "trajectory_id"], "embedding", lambda x: cluster.greedy(x, 0.8))
    return cluster.cluster_summary(m.join(top.select("trajectory_id", "session_id"), "trajectory_id"), "session_id", 3, 1)


@query()
def cl5_gap_clusters(spark, d):
    t = trajectories(spark, d).filter(F.col("outcome").isin("fail", "partial") & (F.coalesce(F.size("skills"), F.lit(0)) <= 0) & F.col("created_at").isNotNull())
    top = t.join(_first_vectors(spark, d), "session_id").orderBy(F.desc("created_at"), "trajectory_id").limit(50).select(F.lit(0).alias("g"), "trajectory_id", (-F.col("created_at")).alias("age"), "embedding")
    return cluster.clustered(top, "g", "trajectory_id", ["age", "trajectory_id"], "embedding", lambda x: cluster.greedy(x, 0.75)).select("trajectory_id", "cluster")


@query()
def cl6_anchor_clusters(spark, d):
    """Groups of like active skills, each gathered around a skill without a group: a table of fixed size."""
    active = skills(spark, d).filter("skill_status = 'active'").select("skill_id")
    v = skill_vectors(spark, d).join(active, "skill_id", "left_semi").withColumn("g", F.lit(0))
    return cluster.clustered(v, "g", "skill_id", ["skill_id"], "embedding", lambda x: cluster.anchored(x, 0.3, 5)).select("skill_id", "cluster")


@query()
def cl7_siblings(spark, d):
    v = vectors(spark, d)
    hits = _near(spark, d, 15).join(v.select(F.col("chunk_id").alias("id"), "embedding"), "id")
    return cluster.siblings(hits, "embedding", 0.82, 5)


# ----------------------------------------------------------------- folds


@query(f"""WITH r AS (SELECT skill, list(CASE outcome WHEN 'ok' THEN 1.0 WHEN 'fail' THEN 0.0 END ORDER BY created_at, trajectory_id) AS l FROM {USES} WHERE created_at IS NOT NULL AND outcome IN ('ok','fail') GROUP BY skill)
 SELECT skill, round(list_reduce(list_concat([0.5::DOUBLE], l::DOUBLE[]), lambda u, x: u + 0.1*(x - u)), 9) AS utility FROM r""")
def rk6_utility_fold(spark, d):
    u = uses(spark, d).filter("created_at is not null and outcome in ('ok','fail')")
    f = folds.utility(u, "skill", ["created_at", "trajectory_id"], F.when(F.col("outcome") == "ok", 1.0).otherwise(0.0))
    return f.select("skill", F.round("utility", 9).alias("utility"))


@query(f"""WITH r AS (SELECT skill, list(CASE outcome WHEN 'ok' THEN 0.05 ELSE -0.1 END ORDER BY created_at, trajectory_id) AS l FROM {USES} WHERE created_at IS NOT NULL AND outcome IN ('ok','fail') GROUP BY skill)
 SELECT skill, round(list_reduce(list_concat([1.0::DOUBLE], l::DOUBLE[]), lambda t, x: least(greatest(t + x, 0), 2)), 9) AS trust FROM r""")
def rk7_trust_fold(spark, d):
    u = uses(spark, d).filter("created_at is not null and outcome in ('ok','fail')")
    f = folds.clamped_sum(u, "skill", ["created_at", "trajectory_id"], F.when(F.col("outcome") == "ok", 0.05).otherwise(-0.1), 1.0, 0.0, 2.0)
    return f.select("skill", F.round("total", 9).alias("trust"))


@query("""WITH e AS (SELECT user_id, list(CASE event_type WHEN 'error' THEN 3.0 WHEN 'purchase' THEN 2.0 ELSE 1.0 END ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
 SELECT user_id, CAST(list_reduce(list_concat([0.0::DOUBLE], l::DOUBLE[]), lambda s, x: CASE WHEN s - floor(s/1000)*1000 + x >= 5 THEN (floor(s/1000) + 1)*1000 ELSE s + x END) // 1000 AS INT) AS nudges FROM e""")
def rk10_salience_resets(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.when(F.col("event_type") == "error", 3.0).when(F.col("event_type") == "purchase", 2.0).otherwise(1.0)
    return folds.resets(e, "user_id", ["ts", "event_id"], v, 5.0)


@query("""SELECT event_id, user_id FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM
 (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events)) WHERE event_type = 'view' AND n % 8 = 0""")
def wn8_save_cadence(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return folds.every_nth(e, "user_id", ["ts", "event_id"], F.col("event_type") == "view", 8, F.col("event_type") == "purchase").select("event_id", "user_id")


@query("SELECT event_id, user_id, ts, CAST(new_session AS INT) AS opens, sum(CAST(new_session AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600, true) AS new_session FROM events)")
def st3_session_boundaries(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = sec - F.lag(sec).over(w)
    e = e.withColumn("opens", F.coalesce(gap > 21600, F.lit(True)).cast("int"))
    return e.select("event_id", "user_id", "ts", "opens", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session_no"))


# ------------------------------------------------------------- retention

CUT = NOW - 60 * 86400


@query(f"""WITH g AS (SELECT session_id FROM {S} WHERE ended_at IS NOT NULL AND ended_at < {CUT}) SELECT 'sessions' AS name, count(*) AS n FROM {S} WHERE session_id NOT IN (SELECT session_id FROM g)
 UNION ALL SELECT 'chunks', count(*) FROM {C} WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM g) UNION ALL SELECT 'detached', count(*) FROM {T} WHERE session_id IS NULL OR session_id IN (SELECT session_id FROM g)""")
def sk16_retention_purge(spark, d):
    s, c, t = sessions(spark, d), chunks(spark, d), trajectories(spark, d)
    kept, rest = retention.purge(s, {"chunks": c}, NOW, 60)
    gone = s.join(kept.select("session_id"), "session_id", "left_anti").select("session_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    detached = retention.detach(t, gone, "session_id").filter("session_id is null")
    return n(kept, "sessions").unionByName(n(rest["chunks"], "chunks")).unionByName(n(detached, "detached"))


@query("SELECT skill_id FROM skill_stats ORDER BY 2*success_count - use_count DESC, last_used_at DESC NULLS LAST, skill_id LIMIT 50")
def sk18_keep_best(spark, d):
    return retention.keep_best(skills(spark, d), "skill_id", [F.desc(2 * F.col("success_count") - F.col("use_count")), F.desc_nulls_last("last_used_at")], 50).select("skill_id")


# ------------------------------------------------------------ evaluation

GOLD = f"(SELECT t.trajectory_id AS query, chunk_id AS id FROM {T} t JOIN {C} c ON c.session_id = t.session_id WHERE trajectory_id % 100 = 0)"


ALL_GOLD = GOLD.replace(" WHERE trajectory_id % 100 = 0", "")


def _all_gold(spark, d):
    """The messages of every task's own session."""
    c = raw_chunks(spark, d).filter("session_id is not null").select("session_id", F.col("chunk_id").alias("id"))
    return stage(trajectories(spark, d).select(F.col("trajectory_id").alias("query"), "session_id").join(c, "session_id").select("query", "id").distinct(), "gold")


def _gold(spark, d):
    return tasks(spark, d).filter("session_id is not null").select(F.col("trajectory_id").alias("query"), "session_id").join(chunks(spark, d), "session_id").select("query", F.col("chunk_id").alias("id"))


@query(f"""WITH {bm25_sql(C, 'chunk_id', 'content', f"(SELECT * FROM {T} WHERE trajectory_id % 100 = 0)", 'trajectory_id', 'task', 10)}, g AS (SELECT DISTINCT * FROM {GOLD}), n AS (SELECT query, count(*) AS n_gold FROM g GROUP BY query),
 h AS (SELECT bm.query, count(*) AS hits, min(rank) AS first, sum(1/log2(rank+1)) AS dcg FROM bm JOIN g ON g.query = bm.query AND g.id = doc GROUP BY bm.query)
 SELECT n.query, n_gold, round(coalesce(hits/n_gold, 0), 6) AS recall, round(coalesce(1.0/first, 0), 6) AS rr, round(coalesce(dcg/list_sum(list_transform(range(1, least(n_gold, 10)+1), lambda i: 1/log2(i+1))), 0), 6) AS ndcg FROM n LEFT JOIN h ON h.query = n.query""")
def ev1_retrieval_scores(spark, d):
    ranked = _bm25(spark, d, 10).withColumnRenamed("doc", "id")
    return evaluate.ranking_scores(ranked, _gold(spark, d), 10)


SAME_SKILL = f"(SELECT DISTINCT t.trajectory_id AS query, o.session_id AS id FROM (SELECT trajectory_id, session_id, unnest(skills) AS skill FROM {T}) t JOIN (SELECT session_id, unnest(skills) AS skill FROM {T} WHERE outcome = 'ok') o ON o.skill = t.skill WHERE o.session_id IS NOT NULL UNION SELECT trajectory_id, session_id FROM {T} WHERE session_id IS NOT NULL)"


@query(f"""WITH {bm25_sql(C, 'chunk_id', 'content', T, 'trajectory_id', 'task', 25)}, s AS (SELECT query, session_id AS id, min(rank) AS best FROM bm JOIN {C} c ON c.chunk_id = doc WHERE session_id IS NOT NULL GROUP BY ALL),
 r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY best, id) AS rank FROM s), g AS (SELECT query, id FROM {SAME_SKILL}), n AS (SELECT query, count(*) AS n_gold FROM g GROUP BY query)
 SELECT g.query, CAST(max(CASE WHEN r.rank <= 5 THEN 1 ELSE 0 END) AS INT) AS any_at, CAST(min(CASE WHEN r.rank <= 5 THEN 1 ELSE 0 END) AS INT) AS all_at,
  round(coalesce(sum(CASE WHEN r.rank <= 10 THEN 1/log2(r.rank+1) END), 0) / any_value(list_sum(list_transform(range(1, least(n_gold, 10)+1), lambda i: 1/log2(i+1)))), 6) AS ndcg
  FROM g JOIN n ON n.query = g.query LEFT JOIN r ON r.query = g.query AND r.id = g.id GROUP BY g.query""")
def ev3_session_scores(spark, d):
    """Sessions by their first hit, against the task's own and all that used one of its skills with success; those are counted by sets of skills, not listed."""
    c = raw_chunks(spark, d).filter("session_id is not null").select(F.col("chunk_id").alias("doc"), "session_id")
    best = _all_bm25(spark, d, 25).join(c, "doc").groupBy("query", F.col("session_id").alias("id")).agg(F.min("rank").alias("best"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("best", "id"))).filter("rank <= 10")
    good = stage(uses(spark, d).filter("outcome = 'ok' and session_id is not null and skill is not null").groupBy(F.col("session_id").alias("id")).agg(F.collect_set("skill").alias("good")), "good")
    tags = F.coalesce(F.array_sort(F.array_distinct(F.filter("skills", lambda s: s.isNotNull()))), F.array().cast("array<string>"))
    own = trajectories(spark, d).select(F.col("trajectory_id").alias("query"), F.col("session_id").alias("own"), tags.alias("tags"))
    shares = lambda side: F.coalesce(F.arrays_overlap("tags", side), F.lit(False))
    more = (F.col("own").isNotNull() & ~shares("own_good")).cast("long")
    asked = own.join(bulk.union_sizes(own, "tags", good, "good"), "tags").join(good.select(F.col("id").alias("own"), F.col("good").alias("own_good")), "own", "left")
    asked = stage(asked.select("query", "own", "tags", (F.col("n") + more).alias("n_gold")).filter("n_gold > 0"), "asked")
    hit = ranked.join(asked, "query").join(good, "id", "left").filter(shares("good") | (F.col("id") == F.col("own")))
    return evaluate.counted_session_scores(hit.select("query", "rank"), asked.select("query", "n_gold"), 5, 10)


@query(f"""WITH x AS (SELECT 'utility' AS source, outcome AS truth, CASE WHEN utility >= 0.7 THEN 'ok' WHEN utility < 0.3 THEN 'fail' END AS guess FROM {T} WHERE outcome <> 'unknown'), l AS (SELECT unnest(['ok','fail','partial']) AS label),
 a AS (SELECT source, label, count(*) FILTER (WHERE truth = label AND guess = label) AS tp, count(*) FILTER (WHERE guess = label AND truth <> label) AS fp, count(*) FILTER (WHERE truth = label AND coalesce(guess, '') <> label) AS fn FROM x, l GROUP BY ALL)
 SELECT source, label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp/nullif(tp+fp, 0), 6) AS precision, round(tp/nullif(tp+fn, 0), 6) AS recall FROM a""")
def ag10_precision_recall(spark, d):
    t = trajectories(spark, d).filter("outcome <> 'unknown'")
    guess = F.when(F.col("utility") >= 0.7, "ok").when(F.col("utility") < 0.3, "fail")
    return evaluate.precision_recall(t.select(F.lit("utility").alias("source"), F.col("outcome").alias("truth"), guess.alias("guess")), "truth", "guess", "source")
