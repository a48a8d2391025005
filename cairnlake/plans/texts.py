"""Queries of the text family: projections, filters, scans of text, folds of labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranking, text
from ..operators import lexical
from .base import C, K, NOW, S, T, chunks, documents, query, sessions, skills, strip_sql, raw_chunks, terms_sql, trajectories


@query(f"SELECT chunk_id, lower(trim(role)) AS role, length({strip_sql('content')}) AS chars FROM {C} WHERE lower(trim(role)) IN ('user','assistant','tool') AND {strip_sql('content')} <> ''")
def fl1_archivable(spark, d):
    r, t = F.lower(F.trim("role")), text.strip(F.col("content"))
    return raw_chunks(spark, d).filter(r.isin("user", "assistant", "tool") & (t != "")).select("chunk_id", r.alias("role"), F.char_length(t).alias("chars")).distinct()


@query(f"SELECT trajectory_id FROM {T} WHERE outcome IN ('fail','partial') AND coalesce(len(skills), 0) = 0 AND created_at >= {NOW} - 90*86400")
def fl12_no_skill_failures(spark, d):
    t = trajectories(spark, d).filter(F.col("outcome").isin("fail", "partial") & (F.coalesce(F.size("skills"), F.lit(0)) <= 0) & (F.col("created_at") >= NOW - 90 * 86400))
    return t.select("trajectory_id")


@query(f"SELECT trajectory_id, created_at FROM {T} WHERE outcome IN ('fail','partial') AND created_at IS NOT NULL ORDER BY created_at DESC, trajectory_id LIMIT 8")
def fl13_recent_failures(spark, d):
    t = trajectories(spark, d).filter(F.col("outcome").isin("fail", "partial") & F.col("created_at").isNotNull())
    return t.orderBy(F.desc("created_at"), "trajectory_id").limit(8).select("trajectory_id", "created_at")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[\\x{2E80}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{AC00}-\\x{D7AF}\\x{20000}-\\x{2FFFF}]')")
def fl15_cjk_documents(spark, d):
    return documents(spark, d).filter(text.has_cjk(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), lower('_HELPER'))")
def fl16_literal_substring(spark, d):
    return documents(spark, d).filter(text.contains_literal(F.col("text"), F.lit("_HELPER"))).select("doc_id")


@query(f"""SELECT query, doc FROM (SELECT q.trajectory_id AS query, t.trajectory_id AS doc, row_number() OVER (PARTITION BY q.trajectory_id ORDER BY t.created_at DESC NULLS LAST, t.trajectory_id) AS r
 FROM (SELECT trajectory_id, list_filter(regexp_extract_all(lower(task), '[\\p{{L}}\\p{{N}}]+')[1:3], lambda x: length(x) > 3) AS w FROM {T} WHERE trajectory_id % 100 = 0) q
 JOIN {T} t ON len(w) > 0 AND regexp_matches(lower(t.task), '(?s)' || w[1] || '.*' || coalesce(w[2], '')) ) WHERE r <= 5""")
def fl17_like_fallback(spark, d):
    """Tasks that hold the first two long words of a query in order: candidates by a 3-gram of the first, then the pattern."""
    t = trajectories(spark, d).select(F.col("trajectory_id").alias("doc"), "created_at", F.lower("task").alias("t")).filter("t <> ''")
    w = F.filter(F.slice(text.terms(F.col("task")), 1, 3), lambda x: F.char_length(x) > 3)
    asked = trajectories(spark, d).filter("trajectory_id % 100 = 0").select(F.col("trajectory_id").alias("query"), w.alias("w")).filter(F.size("w") > 0)
    pattern = F.concat(F.lit("%"), F.col("w")[0], F.lit("%"), F.coalesce(F.get("w", F.lit(1)), F.lit("")), F.lit("%"))
    asked = asked.select("query", pattern.alias("p"), F.substring(F.col("w")[0], 1, 3).alias("g"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("t") - 2, F.lit(1))), lambda i: F.substring("t", i, 3)))
    near = t.select("doc", F.explode(grams).alias("g")).join(asked, "g").select("doc", "query", "p").join(t, "doc").filter(F.expr("t like p"))
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("created_at"), "doc"))
    return near.withColumn("r", r).filter("r <= 5").select("query", "doc")


@query(f"SELECT session_id FROM {S} WHERE coalesce(lower(trim(session_key)), '') <> 'heartbeat' AND NOT starts_with(coalesce(lower(trim(session_key)), ''), 'cron:')")
def fl18_labelled_sessions(spark, d):
    k = F.coalesce(F.lower(F.trim("session_key")), F.lit(""))
    return sessions(spark, d).filter((k != "heartbeat") & ~k.startswith("cron:")).select("session_id")


@query("SELECT skill_name, regexp_matches(skill_name, '^[a-z0-9][a-z0-9_-]{0,63}$') AS valid FROM skill_stats")
def fl23_valid_names(spark, d):
    return skills(spark, d).select("skill_name", F.col("skill_name").rlike("^[a-z0-9][a-z0-9_-]{0,63}$").alias("valid"))


@query(f"""SELECT chunk_id, CASE WHEN t = '' THEN content ELSE 'Task: ' || t || chr(10) || chr(10) || content END AS embedded FROM (SELECT chunk_id, content, trim(substr(coalesce(task, ''), 1, 200)) AS t FROM {C} c
 LEFT JOIN (SELECT session_id, min_by(task, trajectory_id) AS task FROM {T} WHERE session_id IS NOT NULL GROUP BY session_id) t ON t.session_id = c.session_id)""")
def pj1_context_preamble(spark, d):
    t = trajectories(spark, d).filter("session_id is not null").groupBy("session_id").agg(F.min_by("task", "trajectory_id").alias("task"))
    return chunks(spark, d).join(t, "session_id", "left").select("chunk_id", text.preamble(F.col("task"), F.col("content")).alias("embedded"))


@query(f"SELECT session_id, substr({strip_sql('substr(min_by(content, (coalesce(turn_index, 2147483647), chunk_id)), 1, 400)')}, 1, 120) AS category FROM {C} WHERE session_id IS NOT NULL AND lower(trim(role)) IN ('user','human') AND {strip_sql('content')} <> '' GROUP BY session_id")
def pj4_task_category(spark, d):
    u = chunks(spark, d).filter("session_id is not null and lower(trim(role)) in ('user','human')").filter(text.strip(F.col("content")) != "")
    first = u.groupBy("session_id").agg(F.min_by("content", F.struct(F.coalesce("turn_index", F.lit(2147483647)), "chunk_id")).alias("c"))
    return first.select("session_id", F.substring(text.strip(F.substring("c", 1, 400)), 1, 120).alias("category"))


@query(f"SELECT skill_id, CASE WHEN last_used_at IS NULL THEN 'never' WHEN a < 3600 THEN CAST(floor(a/60) AS INT) || 'm ago' WHEN a < 86400 THEN CAST(floor(a/3600) AS INT) || 'h ago' ELSE CAST(floor(a/86400) AS INT) || 'd ago' END AS age FROM (SELECT *, {NOW} - last_used_at AS a FROM skill_stats)")
def pj6_age_labels(spark, d):
    return skills(spark, d).select("skill_id", text.age_label(F.lit(NOW) - F.col("last_used_at")).alias("age"))


@query("SELECT skill_id, CASE WHEN use_count >= 3 THEN CAST(CAST(floor(100*success_count/use_count) AS BIGINT) AS VARCHAR) || '%' ELSE '-' END AS rate, round(CASE WHEN use_count > 0 THEN (2*success_count-use_count)/use_count ELSE 0 END, 6) AS contribution, round((use_count - success_count)/nullif(use_count, 0), 6) AS failure_rate FROM skill_stats")
def pj7_success_rates(spark, d):
    u, s = F.col("use_count"), F.col("success_count")
    return skills(spark, d).select("skill_id", ranking.rate_label(u, s, 3).alias("rate"), F.round(ranking.contribution(u, s), 6).alias("contribution"), F.round(F.try_divide(u - s, u), 6).alias("failure_rate"))


@query(f"""SELECT trajectory_id, CASE outcome WHEN 'ok' THEN 'WORKED: ' WHEN 'fail' THEN 'AVOID: ' ELSE 'PARTIAL: ' END || task || CASE WHEN reflection IS NULL THEN '' ELSE ' | ' || reflection END AS framed FROM {T} WHERE outcome <> 'unknown' AND task IS NOT NULL""")
def pj9_framed_cases(spark, d):
    t = trajectories(spark, d).filter("outcome <> 'unknown' and task is not null")
    head = F.when(F.col("outcome") == "ok", "WORKED: ").when(F.col("outcome") == "fail", "AVOID: ").otherwise("PARTIAL: ")
    return t.select("trajectory_id", F.concat_ws(" | ", F.concat(head, "task"), "reflection").alias("framed"))


@query(f"SELECT doc_id, octet_length(encode(text)) AS bytes, CAST(greatest(1, octet_length(encode(text)) // 3) AS INT) AS tokens, length(text) AS chars, coalesce(n_chars = length(text), false) AS fresh FROM documents WHERE text IS NOT NULL")
def sf20_token_estimates(spark, d):
    t = F.col("text")
    return documents(spark, d).filter("text is not null").select("doc_id", F.octet_length(t).alias("bytes"), text.token_estimate(t).alias("tokens"), F.char_length(t).alias("chars"), F.coalesce(F.col("n_chars") == F.char_length(t), F.lit(False)).alias("fresh"))


_VALUE = lambda key: "nullif(regexp_replace(" + strip_sql(f"regexp_extract(b, '(?m)^{key}[ \\t]*:[ \\t]*(.*)$', 1)") + """, '^["'']|["'']$', '', 'g'), '')"""


@query(f"SELECT doc_id, {_VALUE('name')} AS name, {_VALUE('description')} AS description FROM (SELECT doc_id, regexp_extract(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '\\A---[ \\t]*\\n((?s:.*?))\\n---[ \\t]*(?:\\n|\\z)', 1) AS b FROM documents) WHERE b <> ''")
def sc8_front_matter(spark, d):
    t = F.col("text")
    x = documents(spark, d).filter(F.regexp_replace(t, "\r\n?", "\n").rlike(r"\A---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|\z)"))
    b = F.regexp_extract(F.regexp_replace(t, "\r\n?", "\n"), r"\A---[ \t]*\n((?s:.*?))\n---[ \t]*(?:\n|\z)", 1)
    return x.filter(b != "").select("doc_id", text.front_matter(t, "name").alias("name"), text.front_matter(t, "description").alias("description"))


@query("SELECT doc_id, trim(regexp_replace(translate(text, '‘’“”–—…', '''''\"\"--.'), '[ \\t\\r\\n]+', ' ', 'g')) AS folded FROM documents WHERE text IS NOT NULL")
def sf5_folded_typography(spark, d):
    t = F.translate("text", "‘’“”–—…", "''\"\"--.")
    return documents(spark, d).filter("text is not null").select("doc_id", F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " ")).alias("folded"))


_RX = lambda p: p.replace("'", "''")
REACT = f"""CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '{_RX(text.CORRECTION)}') THEN 'correction'
 WHEN ((regexp_matches(t, '{_RX(text.POSITIVE)}') AND NOT regexp_matches(t, '{_RX(text.WORKED_BEFORE)}')) OR regexp_matches(t, '{_RX(text.NO_PROBLEM)}')) THEN CASE WHEN regexp_matches(t, '{_RX(text.BROKEN)}') THEN 'correction' WHEN regexp_matches(t, '{_RX(text.BUT)}') THEN 'neutral' ELSE 'positive' END ELSE 'neutral' END"""
USER = "lower(trim(role)) IN ('user','human')"


@query(f"SELECT chunk_id, {REACT} AS reaction FROM (SELECT chunk_id, {strip_sql('content')} AS t FROM {C} WHERE {USER} AND {strip_sql('content')} <> '')")
def sf11_reactions(spark, d):
    u = raw_chunks(spark, d).filter(F.expr(USER) & (text.strip(F.col("content")) != ""))
    return u.select("chunk_id", text.reaction(F.col("content")).alias("reaction")).distinct()


@query(f"""SELECT chunk_id, reaction, sum(CASE reaction WHEN 'positive' THEN 1 WHEN 'correction' THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index NULLS FIRST, chunk_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mood
 FROM (SELECT chunk_id, session_id, turn_index, {REACT} AS reaction FROM (SELECT *, {strip_sql('content')} AS t FROM {C} WHERE {USER} AND {strip_sql('content')} <> '' AND session_id IS NOT NULL))""")
def wn6_rolling_reactions(spark, d):
    u = chunks(spark, d).filter(F.expr(USER) & (text.strip(F.col("content")) != "") & F.col("session_id").isNotNull())
    u = u.select("chunk_id", "session_id", "turn_index", text.reaction(F.col("content")).alias("reaction"))
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").asc_nulls_first(), "chunk_id").rowsBetween(-2, 0)
    v = F.when(F.col("reaction") == "positive", 1).when(F.col("reaction") == "correction", -1).otherwise(0)
    return u.select("chunk_id", "reaction", F.sum(v).over(w).alias("mood"))


@query("SELECT doc_id, i AS place, trim(e) AS entry FROM (SELECT doc_id, unnest(p) AS e, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, CASE WHEN len(string_split(text, chr(10) || chr(10))) > 1 THEN string_split(text, chr(10) || chr(10)) ELSE string_split(text, chr(10)) END AS p FROM documents WHERE doc_kind = 'memory' AND text IS NOT NULL)) WHERE trim(e) <> ''")
def sf13_entries(spark, d):
    x = documents(spark, d).filter("doc_kind = 'memory' and text is not null")
    p = F.split("text", "\n\n")
    return x.select("doc_id", F.posexplode(F.when(F.size(p) > 1, p).otherwise(F.split("text", "\n"))).alias("i", "e")).select("doc_id", (F.col("i") + 1).alias("place"), F.trim("e").alias("entry")).filter("entry <> ''")


@query(f"SELECT trajectory_id, len(skills) AS n, coalesce(skills[1], '') AS first, CASE WHEN skills IS NULL THEN 'broken' WHEN len(skills) = 0 THEN 'none' ELSE 'some' END AS kind FROM {T}")
def sf17_json_lists(spark, d):
    s = F.col("skills")
    return trajectories(spark, d).select("trajectory_id", F.when(s.isNotNull(), F.size(s)).alias("n"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first"), F.when(s.isNull(), "broken").when(F.size(s) == 0, "none").otherwise("some").alias("kind"))


@query("SELECT doc_id, sha256(text) AS digest, md5(text) AS short FROM documents WHERE text IS NOT NULL")
def sf19_digests(spark, d):
    return documents(spark, d).filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.md5("text").alias("short"))


@query(f"""SELECT chunk_id, CASE WHEN s IN (401,403) THEN 'auth' WHEN s = 402 OR regexp_matches(t, 'billing|payment_required|insufficient_quota|credit') THEN 'billing' WHEN s = 429 OR regexp_matches(t, 'rate_limit|too many requests') THEN 'rate_limit' WHEN s IN (503,529) OR contains(t, 'overload') THEN 'overloaded'
 WHEN s IN (500,502) THEN 'server_error' WHEN regexp_matches(t, 'context_length_exceeded|context window|too many tokens|maximum context|context limit|input too long') THEN 'context_overflow' WHEN contains(t, 'timeout') THEN 'timeout' ELSE 'unknown' END AS class
 FROM (SELECT chunk_id, lower(content) AS t, coalesce(try_cast(nullif(regexp_extract(content, 'code (\\d+)', 1), '') AS INT), 0) AS s FROM {C} WHERE regexp_matches(content, 'code \\d+'))""")
def sf22_failure_classes(spark, d):
    x = raw_chunks(spark, d).filter(F.col("content").rlike(r"code \d+"))
    return x.select("chunk_id", text.failure_class(F.regexp_extract("content", r"code (\d+)", 1).try_cast("int"), F.col("content")).alias("class")).distinct()


@query(f"SELECT trajectory_id, bound, CASE WHEN p >= bound AND q <= 1-bound THEN 'yes' WHEN q >= bound AND p <= 1-bound THEN 'no' ELSE 'unsure' END AS verdict FROM (SELECT trajectory_id, utility AS p, (trajectory_id * 53 % 101) / 100.0::DOUBLE AS q FROM {T}), (SELECT unnest([0.6,0.7,0.8,0.9]::DOUBLE[]) AS bound) WHERE p IS NOT NULL")
def sf24_two_sided_verdicts(spark, d):
    """Two probabilities asked for separately, which need not add up to one."""
    t = trajectories(spark, d).filter("utility is not null").select("trajectory_id", F.col("utility").alias("p"), (F.col("trajectory_id") * 53 % 101 / 100.0).cast("double").alias("q"), F.explode(F.array(*[F.lit(x) for x in (0.6, 0.7, 0.8, 0.9)])).alias("bound"))
    return t.select("trajectory_id", F.col("bound").cast("double").alias("bound"), ranking.two_sided(F.col("p"), F.col("q"), F.col("bound")).alias("verdict"))


SKILL_PATHS = "['read skills/deploy-fix/SKILL.md now', '/home/a/skills/x_1/SKILL.md', 'skills//SKILL.md', 'skills/a/b/SKILL.md', 'see skills/late/SKILL.md and skills/other/SKILL.md', 'skills/none/README.md']"


@query(f"SELECT place, nullif(regexp_extract(x, 'skills/([^/\\s]+)/SKILL\\.md', 1), '') AS name FROM (SELECT unnest(range(1, 7)) AS place, unnest({SKILL_PATHS}) AS x) UNION ALL SELECT chunk_id + 100, regexp_extract(content, 'skills/([^/\\s]+)/SKILL\\.md', 1) FROM {C} WHERE regexp_matches(content, 'skills/([^/\\s]+)/SKILL\\.md')")
def sf26_names_from_paths(spark, d):
    p = r"skills/([^/\s]+)/SKILL\.md"
    own = spark.range(1, 7).select(F.col("id").alias("place"), F.get(F.expr(f"array({SKILL_PATHS[1:-1]})"), (F.col("id") - 1).cast("int")).alias("x"))
    c = chunks(spark, d).filter(F.col("content").rlike(p)).select((F.col("chunk_id") + 100).alias("place"), F.col("content").alias("x"))
    return own.unionByName(c).select("place", F.nullif(F.regexp_extract("x", p, 1), F.lit("")).alias("name"))


@query("SELECT skill_id, CAST(least(greatest(coalesce(try_cast(use_count AS INT), 5), 1), 10) AS INT) AS importance FROM skill_stats")
def sf27_clamped_importance(spark, d):
    return skills(spark, d).select("skill_id", ranking.clamp_int(F.col("use_count"), 1, 10, 5).alias("importance"))


@query(f"SELECT chunk_id, CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || '…' ELSE content END AS clipped FROM {C} WHERE content IS NOT NULL")
def sf2_clipped(spark, d):
    return raw_chunks(spark, d).filter("content is not null").select("chunk_id", text.clip(F.col("content"), 80).alias("clipped")).distinct()


@query(f"SELECT doc, term, tf FROM (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY ALL) WHERE tf >= 5")
def ix2_postings(spark, d):
    return lexical.postings(documents(spark, d), "doc_id", "text").filter("tf >= 5").select("doc", "term", "tf")


@query(f"WITH p AS (SELECT trajectory_id, {terms_sql('task')}[1:3] AS w FROM {T} WHERE trajectory_id % 100 = 0), x AS (SELECT trajectory_id AS phrase, array_to_string(w, ' ') AS s FROM p WHERE len(w) = 3), y AS (SELECT trajectory_id AS doc, {terms_sql('task')} AS t FROM {T}) SELECT phrase, doc, count(*) AS n FROM (SELECT doc, t, unnest(range(1, len(t) + 1)) AS i FROM y) z JOIN x ON array_to_string(t[i:i+2], ' ') = s GROUP BY ALL")
def rt2_phrase_matches(spark, d):
    t = trajectories(spark, d)
    p = t.filter("trajectory_id % 100 = 0").select("trajectory_id", F.slice(text.terms(F.col("task")), 1, 3).alias("w")).filter(F.size("w") == 3)
    return lexical.phrase_matches(t, "trajectory_id", "task", p.select("trajectory_id", F.array_join("w", " ").alias("p")), "trajectory_id", "p").select("phrase", "doc", "n")


@query()
def rt2_stemmed_vocabulary(spark, d):
    return lexical.stemmed_vocabulary(documents(spark, d), "text")
