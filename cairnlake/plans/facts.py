"""Queries over stored facts and skills: validity, eviction, merging, sweeping, listing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import models, ranking, text
from ..operators import dense, retention, upkeep
from .base import C, DESCRIBED, FACT_V, FACTS, K, NOW, S, SKILL_V, T, V, VEC, bm25_sql, chunks, described, documents, fact_vectors, facts, knn_sql, query, sessions, skill_vectors, skills, strip_sql, trajectories
from .retrieval import TASKS, _first_vectors, tasks
from .structure import USES, uses

LIVE = "invalid_at IS NULL AND fact_type IN ('cheatsheet','expel') AND trust >= 0.3"


@query(f"SELECT fact_id FROM {FACTS} WHERE {LIVE}")
def fl2_live_facts(spark, d):
    return facts(spark, d).filter(LIVE).select("fact_id")


@query(f"SELECT fact_id, round(sqrt(list_sum(list_transform(v, lambda x: x*x))), 5) AS norm, trust FROM {FACT_V} JOIN {FACTS} USING (fact_id) WHERE {LIVE}")
def jn3_fact_vectors(spark, d):
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return fact_vectors(spark, d).join(facts(spark, d).filter(LIVE), "fact_id").select("fact_id", F.round(n, 5).alias("norm"), "trust")


_GRACE, _OLD = NOW - 30 * 86400, NOW - 60 * 86400


@query(f"""WITH x AS (SELECT *, CASE WHEN invalid_at IS NOT NULL AND invalid_at < {_GRACE} THEN 1 WHEN invalid_at IS NULL AND created_at < {_OLD} AND (importance < 3 OR trust < 0.3) THEN 2 END AS tier FROM {FACTS})
 SELECT fact_id, tier FROM x WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN tier = 1 THEN invalid_at END NULLS FIRST, CASE WHEN tier = 2 THEN trust END NULLS FIRST, CASE WHEN tier = 2 THEN importance END NULLS FIRST, created_at, fact_id LIMIT 60""")
def sk17_ranked_eviction(spark, d):
    """Superseded facts past their grace first, oldest ones first; what is left of the budget goes to old facts of little trust or weight."""
    f = facts(spark, d)
    one = F.col("invalid_at").isNotNull() & (F.col("invalid_at") < _GRACE)
    two = F.col("invalid_at").isNull() & (F.col("created_at") < _OLD) & ((F.col("importance") < 3) | (F.col("trust") < 0.3))
    return retention.evict(f, "fact_id", [(one, [F.col("invalid_at"), F.col("created_at")]), (two, [F.col("trust"), F.col("importance"), F.col("created_at")])], 60)


@query(f"SELECT fact_id, CASE WHEN invalid_at IS NULL THEN 'live' WHEN invalid_at >= {_GRACE} THEN 'superseded' ELSE 'evicted' END AS state, created_at AS valid_from, coalesce(invalid_at, 9e15) AS valid_to FROM {FACTS}")
def lc7_fact_states(spark, d):
    """The life of each fact as an interval, and what it is now."""
    state = F.when(F.col("invalid_at").isNull(), "live").when(F.col("invalid_at") >= _GRACE, "superseded").otherwise("evicted")
    return facts(spark, d).select("fact_id", state.alias("state"), F.col("created_at").alias("valid_from"), F.coalesce("invalid_at", F.lit(9e15)).alias("valid_to"))


_OLDER = f"(SELECT v.fact_id, v.v, f.created_at, f.invalid_at FROM {FACT_V} v JOIN {FACTS} f ON f.fact_id = v.fact_id)"
_NEWER = f"(SELECT * FROM {_OLDER} WHERE fact_id % 4 = 0)"


def _fact_near(spark, d, k, asked=4):
    v = fact_vectors(spark, d)
    return dense.knn_topk(v.filter(F.col("fact_id") % asked == 0), "fact_id", "embedding", v, "fact_id", "embedding", VEC, k, exclude_self=True)


@query(f"""WITH {knn_sql(_NEWER, 'fact_id', 'v', 8, own=_OLDER, vid='fact_id')}, e AS (SELECT kn.id AS fact_id, min(a.created_at) AS stamped FROM kn JOIN {FACTS} a ON a.fact_id = query JOIN {FACTS} b ON b.fact_id = kn.id WHERE cosine >= 0.5 AND b.created_at < a.created_at GROUP BY kn.id)
 SELECT f.fact_id, coalesce(invalid_at, stamped) AS invalid_at FROM {FACTS} f LEFT JOIN e ON e.fact_id = f.fact_id""")
def sk15_invalidated_facts(spark, d):
    """A fact is stamped by the first newer one near it, unless it is stamped already."""
    f = facts(spark, d)
    at = f.select(F.col("fact_id").alias("id"), "created_at")
    near = _fact_near(spark, d, 8).filter("cosine >= 0.5").join(at.select(F.col("id").alias("query"), F.col("created_at").alias("t1")), "query").join(at.withColumnRenamed("created_at", "t2"), "id").filter("t2 < t1")
    return upkeep.first_stamp(f, near.select(F.col("id").alias("fact_id"), F.col("t1").alias("at")), "fact_id", "invalid_at").select("fact_id", "invalid_at")


@query()
def gr7_contradiction_sweep(spark, d):
    """The newest 20 live facts, one after the other, against older ones like them (brute force in the tests)."""
    v = fact_vectors(spark, d)
    f = facts(spark, d).join(v.select("fact_id"), "fact_id", "left_semi").select(F.col("fact_id").alias("id"), F.col("created_at").alias("at"), F.col("invalid_at").isNull().alias("live"), "text")
    newest = f.filter("live").orderBy(F.desc("at"), "id").limit(20).select(F.col("id").alias("fact_id"))
    near = dense.knn_topk(v.join(newest, "fact_id", "left_semi"), "fact_id", "embedding", v, "fact_id", "embedding", VEC, 12, exclude_self=True)
    return upkeep.sweep(near, f, 20, 0.15, 8, lambda newer, older: True)


@query(f"""WITH {knn_sql(f"(SELECT * FROM {FACT_V} WHERE fact_id % 10 = 0)", 'fact_id', 'v', 3, own=f"(SELECT * FROM {FACT_V} WHERE fact_id % 10 <> 0)", vid='fact_id', skip_self=False)}
 SELECT n.fact_id AS id, CASE WHEN kn.id IS NULL THEN 'inserted' WHEN importance >= 8 THEN 'skipped' ELSE 'merged' END AS action, kn.id AS "into" FROM (SELECT fact_id FROM {FACT_V} WHERE fact_id % 10 = 0) n LEFT JOIN (SELECT * FROM kn WHERE rank = 1 AND cosine >= 0.5) kn ON kn.query = n.fact_id LEFT JOIN {FACTS} f ON f.fact_id = kn.id""")
def sk11_merged_principles(spark, d):
    """New rows are merged into the nearest stored one, skipped if that is guarded, inserted if none is near."""
    v = fact_vectors(spark, d)
    new, old = v.filter("fact_id % 10 = 0"), v.filter("fact_id % 10 <> 0")
    near = dense.knn_topk(new, "fact_id", "embedding", old, "fact_id", "embedding", VEC, 3)
    stored = facts(spark, d).withColumnRenamed("fact_id", "id")
    return upkeep.merge_or_insert(near, new.withColumnRenamed("fact_id", "id"), stored, 0.5, F.col("importance") >= 8)


OPS = """(SELECT skill_id AS op_no, CASE skill_id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'prune' ELSE 'add' END AS op, CASE WHEN skill_id % 3 = 2 THEN skill_id + 100000 ELSE skill_id END AS id, 'new ' || skill_name AS skill_name FROM skill_stats ORDER BY skill_id LIMIT 8)"""


@query(f"""WITH o AS {OPS} SELECT k.skill_id, CASE WHEN o.op = 'update' AND origin = 'agent' AND pinned = 0 THEN o.skill_name ELSE k.skill_name END AS skill_name FROM {K} k LEFT JOIN o ON o.id = k.skill_id WHERE NOT (coalesce(o.op, '') = 'prune' AND origin = 'agent' AND pinned = 0)
 UNION ALL SELECT id, skill_name FROM o WHERE op = 'add'""")
def sk12_curated_rows(spark, d):
    """At most eight operations of a curator, on rows of agents that are not pinned."""
    k = skills(spark, d)
    i = F.col("skill_id")
    ops = k.select(i.alias("op_no"), F.when(i % 3 == 0, "update").when(i % 3 == 1, "prune").otherwise("add").alias("op"), F.when(i % 3 == 2, i + 100000).otherwise(i).alias("id"), F.concat(F.lit("new "), "skill_name").alias("skill_name"))
    return upkeep.apply_operations(k, ops, "skill_id", ["skill_name"], (F.col("origin") == "agent") & (F.col("pinned") == 0), 8).select("skill_id", "skill_name")


@query(f"SELECT trajectory_id AS source_id, reflection AS text, CASE outcome WHEN 'ok' THEN 'cheatsheet' ELSE 'expel' END AS fact_type, CASE outcome WHEN 'ok' THEN 5 ELSE 6 END AS importance FROM {T} WHERE reflection IS NOT NULL AND outcome IN ('ok','fail') AND length({strip_sql('reflection')}) >= 20")
def sk13_new_lessons(spark, d):
    """Lessons of successes and insights of failures, as they are appended."""
    t = trajectories(spark, d).filter(F.col("outcome").isin("ok", "fail") & (F.char_length(text.strip(F.col("reflection"))) >= 20))
    good = F.col("outcome") == "ok"
    return t.select(F.col("trajectory_id").alias("source_id"), F.col("reflection").alias("text"), F.when(good, "cheatsheet").otherwise("expel").alias("fact_type"), F.when(good, 5).otherwise(6).alias("importance"))


@query(f"SELECT skill_id FROM (SELECT *, row_number() OVER (ORDER BY 2*success_count - use_count, last_used_at NULLS FIRST, skill_id) AS r, count(*) OVER () AS n FROM {K} WHERE origin = 'agent' AND pinned = 0) WHERE r <= n - 40")
def sk18_pruned_over_budget(spark, d):
    """The rows over a budget of 40: the least useful of those that may go."""
    free = skills(spark, d).filter("origin = 'agent' and pinned = 0")
    best = retention.keep_best(free, "skill_id", [F.desc(2 * F.col("success_count") - F.col("use_count")), F.desc_nulls_last("last_used_at"), F.desc("skill_id")], 40)
    return free.select("skill_id").join(best.select("skill_id"), "skill_id", "left_anti")


@query("SELECT skill_name, doc_id, row_number() OVER (PARTITION BY skill_name ORDER BY updated_at, doc_id) AS version, sha256(coalesce(text, '')) AS digest FROM documents WHERE skill_name IS NOT NULL AND updated_at IS NOT NULL")
def sk20_versions(spark, d):
    x = documents(spark, d).filter("skill_name is not null and updated_at is not null")
    w = Window.partitionBy("skill_name").orderBy("updated_at", "doc_id")
    return x.select("skill_name", "doc_id", F.row_number().over(w).alias("version"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(f"""SELECT session_id, CASE WHEN ended_at IS NULL AND later IS NOT NULL THEN later ELSE ended_at END AS ended_at, ended_at IS NULL AND later IS NOT NULL AS closed FROM
 (SELECT *, lead(started_at) OVER (PARTITION BY session_key ORDER BY started_at, session_id) AS later FROM {S} WHERE started_at IS NOT NULL AND session_key IS NOT NULL)""")
def sk5_stale_sessions(spark, d):
    """A session that is still open when the next one of its key starts ends there."""
    s = sessions(spark, d).filter("started_at is not null and session_key is not null")
    later = F.lead("started_at").over(Window.partitionBy("session_key").orderBy("started_at", "session_id"))
    stale = F.col("ended_at").isNull() & F.col("later").isNotNull()
    return s.withColumn("later", later).select("session_id", F.when(stale, F.col("later")).otherwise(F.col("ended_at")).alias("ended_at"), stale.alias("closed"))


# ----------------------------------------------------------- projections


@query(f"SELECT skill_id, skill_name || CASE WHEN coalesce(description, '') = '' THEN '' ELSE ': ' || description END AS text FROM {K} k LEFT JOIN {DESCRIBED} x ON x.name = k.skill_name")
def pj2_skill_texts(spark, d):
    k = skills(spark, d).join(described(spark, d), F.col("skill_name") == F.col("name"), "left")
    return k.select("skill_id", F.concat_ws(": ", "skill_name", F.nullif("description", F.lit(""))).alias("text"))


@query(f"SELECT trajectory_id, trim(coalesce(task, '') || ' ' || coalesce(reflection, '')) AS text FROM {T}")
def pj3_principle_texts(spark, d):
    return trajectories(spark, d).select("trajectory_id", F.trim(F.concat_ws(" ", F.coalesce("task", F.lit("")), F.coalesce("reflection", F.lit("")))).alias("text"))


_FIVE = f"(SELECT session_id, content, turn_index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index NULLS FIRST, chunk_id) AS r FROM {C} WHERE session_id IS NOT NULL) WHERE r <= 5)"


def _first_chunks(spark, d, n):
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").asc_nulls_first(), "chunk_id")
    return chunks(spark, d).filter("session_id is not null").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)


@query(f"SELECT session_id, substr(string_agg(coalesce(content, ''), ' ' ORDER BY turn_index NULLS FIRST, chunk_id), 1, 400) AS text FROM {_FIVE} GROUP BY session_id")
def pj5_session_openings(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"])
    return _first_chunks(spark, d, 5).groupBy("session_id").agg(F.substring(F.array_join(lines, " "), 1, 400).alias("text"))


@query(f"SELECT c.session_id, c.chunk_id, c.r, c.role, substr(c.content, 1, 400) AS clipped FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index NULLS FIRST, chunk_id) AS r FROM {C} WHERE session_id IN (SELECT session_id FROM {T} WHERE outcome = 'ok')) c WHERE r <= 8")
def wn5_export_openings(spark, d):
    """The first eight messages of sessions that succeeded."""
    ok = trajectories(spark, d).filter("outcome = 'ok' and session_id is not null").select("session_id").distinct()
    return _first_chunks(spark, d, 8).join(ok, "session_id", "left_semi").select("session_id", "chunk_id", "r", "role", F.substring("content", 1, 400).alias("clipped"))


@query(f"SELECT trajectory_id, printf('[%s] %s (%s) skills: %s', outcome, substr(coalesce(task, ''), 1, 80), CASE WHEN created_at IS NULL THEN 'never' ELSE CAST(floor(greatest(0, {NOW} - created_at) / 86400) AS INT) || 'd ago' END, CASE WHEN coalesce(len(skills), 0) = 0 THEN 'none' ELSE array_to_string(skills, ', ') END) AS line FROM {T}")
def pj8_result_lines(spark, d):
    age = F.when(F.col("created_at").isNull(), "never").otherwise(F.concat(F.floor(F.greatest(F.lit(0.0), NOW - F.col("created_at")) / 86400).cast("int").cast("string"), F.lit("d ago")))
    names = F.when(F.coalesce(F.size("skills"), F.lit(0)) <= 0, "none").otherwise(F.array_join("skills", ", "))
    return trajectories(spark, d).select("trajectory_id", F.format_string("[%s] %s (%s) skills: %s", "outcome", F.substring(F.coalesce("task", F.lit("")), 1, 80), age, names).alias("line"))


@query("SELECT doc_id, printf(E'---\\nname: %s\\ndescription: %s\\n---\\n\\n%s\\n', skill_name, substr(regexp_extract(text, '([^\\n]+)', 1), 1, 60), trim(text)) AS rendered FROM documents WHERE skill_name IS NOT NULL AND text IS NOT NULL")
def pj13_rendered_skills(spark, d):
    x = documents(spark, d).filter("skill_name is not null and text is not null")
    return x.select("doc_id", F.format_string("---\nname: %s\ndescription: %s\n---\n\n%s\n", "skill_name", F.substring(F.regexp_extract("text", r"([^\n]+)", 1), 1, 60), F.trim("text")).alias("rendered"))


# ------------------------------------------------------ joins and top-k


@query(f"WITH {bm25_sql(f'(SELECT * FROM {T} WHERE reflection IS NOT NULL)', 'trajectory_id', 'reflection', TASKS, 'trajectory_id', 'task', 3)} SELECT query, doc, rank, task AS condition, reflection AS action FROM bm JOIN {T} t ON t.trajectory_id = doc")
def jn2_matching_principles(spark, d):
    from ..operators import lexical

    t = trajectories(spark, d).filter("reflection is not null")
    hit = lexical.bm25_topk(t, "trajectory_id", "reflection", tasks(spark, d), "trajectory_id", "task", 3)
    return hit.join(t.select(F.col("trajectory_id").alias("doc"), F.col("task").alias("condition"), F.col("reflection").alias("action")), "doc").select("query", "doc", "rank", "condition", "action")


@query(f"SELECT s.skill_id, skill_status, use_count, round(list_sum(v), 5) AS total FROM {K} s JOIN {SKILL_V} v ON v.skill_id = s.skill_id WHERE skill_status = 'active'")
def jn4_active_skill_vectors(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double"))
    return skills(spark, d).filter("skill_status = 'active'").join(skill_vectors(spark, d), "skill_id").select("skill_id", "skill_status", "use_count", F.round(total, 5).alias("total"))


@query(f"SELECT a.skill_id AS a, b.skill_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM {SKILL_V} a JOIN {SKILL_V} b ON a.skill_id < b.skill_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.3")
def jn13_like_skills(spark, d):
    """All pairs of skills of cosine 0.3 and more: a table of fixed size."""
    return upkeep.like_pairs(skill_vectors(spark, d), "skill_id", "embedding", 0.3)


@query(f"SELECT fact_id, round((1 - 0.4) / greatest(trust, 0.01), 6) AS adjusted FROM {FACTS} ORDER BY adjusted, fact_id LIMIT 25")
def tk3_by_trust(spark, d):
    """Equally distant facts: the more trusted ones first."""
    return facts(spark, d).select("fact_id", F.round(0.6 / F.greatest("trust", F.lit(0.01)), 6).alias("adjusted")).orderBy("adjusted", "fact_id").limit(25)


@query(f"""SELECT skill, chunk_id, created_at, turn_index FROM (SELECT u.skill, c.chunk_id, t.created_at, c.turn_index, row_number() OVER (PARTITION BY u.skill ORDER BY t.created_at DESC NULLS LAST, c.turn_index NULLS FIRST, c.chunk_id, t.trajectory_id) AS r
 FROM (SELECT DISTINCT skill, trajectory_id FROM {USES} WHERE outcome IN ('fail','partial')) u JOIN {T} t ON t.trajectory_id = u.trajectory_id JOIN {C} c ON c.session_id = t.session_id) WHERE r <= 10""")
def tk6_failure_lines(spark, d):
    """Of each skill the messages of its newest failures, in order of their turns."""
    u = uses(spark, d).filter(F.col("outcome").isin("fail", "partial")).select("skill", "trajectory_id", "session_id", "created_at").distinct()
    j = chunks(spark, d).select("session_id", "chunk_id", "turn_index").join(u, "session_id")
    w = Window.partitionBy("skill").orderBy(F.desc_nulls_last("created_at"), F.col("turn_index").asc_nulls_first(), "chunk_id", "trajectory_id")
    return j.withColumn("r", F.row_number().over(w)).filter("r <= 10").select("skill", "chunk_id", "created_at", "turn_index")


@query(f"SELECT skill_id, round((2*success_count - use_count) / nullif(use_count, 0), 6) AS worth FROM {K} WHERE pinned = 0 ORDER BY worth NULLS FIRST, skill_id LIMIT 30")
def tk10_least_worth(spark, d):
    """Never used skills come first, then those of the least worth."""
    worth = F.round(F.try_divide(2 * F.col("success_count") - F.col("use_count"), F.nullif("use_count", F.lit(0))), 6)
    return skills(spark, d).filter("pinned = 0").select("skill_id", worth.alias("worth")).orderBy(F.col("worth").asc_nulls_first(), "skill_id").limit(30)


@query(f"SELECT * FROM (SELECT 'worst' AS list, trajectory_id, utility FROM {T} WHERE utility IS NOT NULL ORDER BY utility, trajectory_id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'best', trajectory_id, utility FROM {T} WHERE utility IS NOT NULL ORDER BY utility DESC, trajectory_id LIMIT 1)")
def tk11_worst_and_best(spark, d):
    t = trajectories(spark, d).filter("utility is not null").select("trajectory_id", "utility")
    take = lambda name, order, n: t.orderBy(order, "trajectory_id").limit(n).select(F.lit(name).alias("list"), "*")
    return take("worst", F.asc("utility"), 8).unionByName(take("best", F.desc("utility"), 1))


@query(f"SELECT skill, trajectory_id, uses, chars FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY uses DESC, chars, trajectory_id) AS r FROM (SELECT skill, trajectory_id, length(coalesce(reflection, '')) AS chars, len(skills) AS uses FROM (SELECT *, unnest(skills) AS skill FROM {T}))) WHERE r = 1")
def rk8_best_variant(spark, d):
    """More improvements first; fewer tokens only break ties."""
    t = trajectories(spark, d).select(F.explode("skills").alias("skill"), "trajectory_id", F.char_length(F.coalesce("reflection", F.lit(""))).alias("chars"), F.size("skills").alias("uses"))
    g = t.groupBy("skill").agg(F.min(F.struct((-F.col("uses")).alias("u"), "chars", "trajectory_id")).alias("b"))
    return g.select("skill", "b.trajectory_id", (-F.col("b.u")).alias("uses"), "b.chars")


_WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"
NEEDLE = "deploy index error"


@query(f"""SELECT doc_id, place, line, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM (SELECT doc_id, place, trim(line) AS line, len(list_intersect({_WORDS('line')}, ['deploy','index','error','the'])) AS score FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL)) WHERE score > 0) WHERE r <= 2""")
def rk9_closest_lines(spark, d):
    """The two lines of each document that share most words with the needle."""
    x = documents(spark, d).filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    words = F.array_distinct(F.array_remove(F.split(F.lower("line"), r"\s+"), ""))
    s = x.withColumn("score", F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ("deploy", "index", "error", "the")])))).filter("score > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "place")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("doc_id", "place", F.trim("line").alias("line"), "score")


@query(f"""WITH o AS (SELECT skill, count(*) AS n, min(created_at) AS first FROM {USES} WHERE outcome = 'ok' GROUP BY skill) SELECT skill, n FROM o ORDER BY n DESC, first NULLS LAST, skill LIMIT 5""")
def ag6_frequent_skills(spark, d):
    g = uses(spark, d).filter("outcome = 'ok'").groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"))
    return g.orderBy(F.desc("n"), F.asc_nulls_last("first"), "skill").limit(5).select("skill", "n")


@query()
def cl3_consolidated_entries(spark, d):
    """Memory slots with like entries folded into the longest (vectors by the offline embedder; brute force in the tests)."""
    x = documents(spark, d).filter("doc_kind = 'memory' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "entry")).filter("trim(entry) <> ''")
    return upkeep.keep_longest(models.embedded(x, "entry", models.HashEmbedder(32)), "doc_id", "place", "entry", "embedding", 0.92)


@query(f"SELECT digest, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL) GROUP BY digest")
def ix4_scanned_once(spark, d):
    """Texts of one digest are scanned once; the verdict holds for all."""
    x = documents(spark, d).filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return x.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(f"SELECT count(*) AS stale FROM (SELECT skill_id FROM {K} WHERE last_used_at < {NOW} - 7*86400)")
def fl20_cooled_down(spark, d):
    """Skills whose last use is more than a week ago."""
    return skills(spark, d).filter(F.col("last_used_at") < NOW - 7 * 86400).agg(F.count(F.lit(1)).alias("stale"))
