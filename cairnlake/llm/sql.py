"""SQL twins of the pN_ queries that plain SQL can express.

The others are tested against brute force in tests/llm: pieces, ids and
containers (sequential), prose (back references).
"""

_BLANK = r"\s\p{Z}\p{Cf}\p{Cc}\x{FE00}-\x{FE0F}"
_STRIP = f"regexp_replace({{0}}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')".replace("{0}", "%s")

_P1 = f"""
WITH r AS (SELECT session_id, turn_index, lower({_STRIP % "coalesce(role, '')"}) AS said, coalesce({_STRIP % "content"}, '') AS t FROM chunks WHERE session_id IS NOT NULL),
 m AS (SELECT DISTINCT session_id, turn_index, t, CASE WHEN said IN ('user','human') THEN 'user' WHEN said IN ('assistant','ai') THEN 'assistant' WHEN said IN ('tool','function') THEN 'tool' WHEN said = 'system' THEN 'system' END AS role, said FROM r),
 d AS (SELECT DISTINCT session_id, turn_index, t, role, CASE WHEN role IS NULL THEN said END AS odd, regexp_matches(t, '[^{_BLANK}]') AS shown FROM m),
 s AS (SELECT session_id, bool_or(role IN ('user','assistant') AND shown) AS speaks, bool_or(turn_index IS NULL OR role IS NULL) OR count(*) <> count(DISTINCT turn_index) OR min(turn_index) <> 1 OR max(turn_index) <> count(*) AS torn,
  bool_or(role = 'assistant' AND NOT shown) AS blank, arg_max(role, turn_index) FILTER (WHERE role IN ('user','assistant')) AS last FROM d GROUP BY session_id),
 x AS (SELECT session_id, CASE WHEN NOT coalesce(speaks, false) THEN 'empty' WHEN torn THEN 'broken' WHEN coalesce(blank, false) OR last = 'user' THEN 'missing_reply' END AS reason FROM s)"""
P1_FOUND = f"{_P1} SELECT session_id, reason FROM x WHERE reason IS NOT NULL"
P1_CONVERSATIONS = f"{_P1} SELECT session_id, turn_index AS turn, role, t AS text FROM d WHERE session_id IN (SELECT session_id FROM x WHERE reason IS NULL)"

_PAIRS = r"""
 t AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}]+')) AS l FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id),
 w AS (SELECT chunk_id, len(l) AS n, unnest(l) AS word FROM t WHERE len(l) >= 22),
 p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.chunk_id < b.chunk_id AND 100 * least(a.n, b.n) >= 78 * greatest(a.n, b.n) GROUP BY ALL),
 e AS (SELECT a, b FROM p WHERE 100 * c >= 78 * greatest(na, nb))"""

P7_FOUND = f"WITH {_PAIRS} SELECT a AS chunk_a, b AS chunk_b FROM e"

P3_FOUND = f"""WITH {_PAIRS}, i AS (SELECT session_id, min(batch_no) AS no FROM intake GROUP BY session_id), k AS (SELECT chunk_id, min(no) AS no FROM (SELECT DISTINCT chunk_id, session_id FROM chunks) c JOIN i ON i.session_id = c.session_id GROUP BY chunk_id)
SELECT DISTINCT CASE WHEN x.no > y.no THEN a ELSE b END AS chunk_id FROM e JOIN k x ON x.chunk_id = a JOIN k y ON y.chunk_id = b WHERE x.no <> y.no"""

_UNIT = """
 u AS MATERIALIZED (SELECT chunk_id AS id, CAST(list_transform(v, lambda x: x / m) AS DOUBLE[128]) AS v FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS m FROM
  (SELECT DISTINCT chunk_id, embedding FROM chunks_vec WHERE chunk_id IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: isfinite(x))) = 128)) WHERE m > 0)"""

P2_FOUND = f"""WITH {_UNIT}, s AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s) WHERE r <= 10 AND c >= 0.95) SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM t"""

P6_FOUND = f"""WITH RECURSIVE {_UNIT}, l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.70),
 cc(id, label) USING KEY (id) AS (SELECT DISTINCT a, a FROM l UNION (SELECT l.b, min(cc.label) FROM cc JOIN l ON l.a = cc.id JOIN recurring.cc r ON r.id = l.b WHERE cc.label < r.label GROUP BY l.b)),
 k AS (SELECT label, count(*) AS n FROM cc GROUP BY label), s AS (SELECT label, count(DISTINCT session_id) AS n FROM cc JOIN chunks ON chunk_id = id WHERE session_id IS NOT NULL GROUP BY label)
SELECT id AS chunk_id, cc.label AS cluster_id FROM cc JOIN k ON k.label = cc.label JOIN s ON s.label = cc.label WHERE k.n >= 5 AND s.n >= 2"""
