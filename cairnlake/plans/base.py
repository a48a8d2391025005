"""Registration of queries and the clean views they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import usable
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Reference time of every query with an age in it (epoch seconds, after the data).
NOW = 1_712_500_000.0
VEC = 128


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def raw_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The messages as delivered, for queries that drop repeated rows after they have made them small."""
    return read_table(spark, d, "chunks")


# Rows delivered twice are equal, so the clean views keep one row of an id.
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sessions").dropDuplicates(["session_id"])


def outcome_of(c: Column) -> Column:
    """ok, partial, fail or unknown, from the spellings in the data."""
    o = F.lower(F.trim(c))
    return F.when(o.isin("ok", "partial", "unknown"), o).when(o.isin("fail", "failed"), "fail").otherwise("unknown")


def string_list(c: Column) -> Column:
    """A JSON list of strings; null for null and for cut-off text."""
    return F.when(c.rlike(r"^\s*\[.*\]\s*$"), F.from_json(c, "array<string>"))


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "trajectories").dropDuplicates(["trajectory_id"])
    return t.withColumn("outcome", outcome_of(F.col("outcome"))).withColumn("skills", string_list(F.col("skills_used")))


def skills(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "skill_stats").withColumn("skill_status", F.lower(F.trim("skill_status")))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks_vec").dropDuplicates(["chunk_id"])


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Stored facts: documents with a type, trust, importance and validity that follow from their numbers.

    The tables have no such relation; the rule is plain, so that its twin is.
    """
    x = documents(spark, d).filter("updated_at is not null")
    i, at = F.col("doc_id"), F.unix_micros(F.col("updated_at").cast("timestamp")) / 1e6
    kind = F.when(i % 3 == 0, "cheatsheet").when(i % 3 == 1, "expel").otherwise("note")
    return x.select(i.alias("fact_id"), "text", kind.alias("fact_type"), ((i * 37 % 200) / 100.0).cast("double").alias("trust"), (i * 17 % 10 + 1).cast("int").alias("importance"), at.alias("created_at"), F.when(i % 6 == 0, at + 30 * 86400).alias("invalid_at"))


def fact_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A fact's vector is that of the message whose id is five times its own."""
    v = vectors(spark, d).filter(usable(F.col("embedding"), VEC) & (F.col("chunk_id") % 5 == 0)).select((F.col("chunk_id") / 5).cast("long").alias("fact_id"), "embedding")
    return facts(spark, d).select("fact_id").join(v, "fact_id")


def skill_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A skill's vector is that of the message whose id is seven times its own."""
    v = vectors(spark, d).filter(usable(F.col("embedding"), VEC) & (F.col("chunk_id") % 7 == 0)).select((F.col("chunk_id") / 7).cast("long").alias("skill_id"), "embedding")
    return skills(spark, d).select("skill_id").join(v, "skill_id")


def described(spark: SparkSession, d: str) -> DataFrame:
    """(name, description): the longest first line of a skill's documents, for want of a description column."""
    x = documents(spark, d).filter("skill_name is not null and text is not null")
    return x.groupBy(F.col("skill_name").alias("name")).agg(F.min(F.substring(F.regexp_extract("text", r"([^\n]+)", 1), 1, 200)).alias("description"))


# The same views for SQL.
C = "(SELECT DISTINCT * FROM chunks)"
S = "(SELECT DISTINCT * FROM sessions)"
OUT = "CASE WHEN lower(trim(outcome)) IN ('ok','partial','unknown') THEN lower(trim(outcome)) WHEN lower(trim(outcome)) IN ('fail','failed') THEN 'fail' ELSE 'unknown' END"
T = f"(SELECT DISTINCT * REPLACE ({OUT} AS outcome), CASE WHEN json_valid(skills_used) THEN CAST(CAST(skills_used AS JSON) AS VARCHAR[]) END AS skills FROM trajectories)"
K = "(SELECT * REPLACE (lower(trim(skill_status)) AS skill_status) FROM skill_stats)"
V = f"""(SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT DISTINCT chunk_id, embedding FROM chunks_vec)
 WHERE len(embedding) = {VEC} AND len(list_filter(embedding, lambda x: isfinite(x))) = {VEC} AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


FACTS = """(SELECT doc_id AS fact_id, text, CASE doc_id % 3 WHEN 0 THEN 'cheatsheet' WHEN 1 THEN 'expel' ELSE 'note' END AS fact_type, (doc_id * 37 % 200) / 100.0::DOUBLE AS trust, CAST(doc_id * 17 % 10 + 1 AS INT) AS importance,
 epoch_us(updated_at) / 1e6 AS created_at, CASE WHEN doc_id % 6 = 0 THEN epoch_us(updated_at) / 1e6 + 30 * 86400 END AS invalid_at FROM documents WHERE updated_at IS NOT NULL)"""
FACT_V = f"(SELECT fact_id, v FROM {FACTS} f JOIN {V} w ON w.chunk_id = 5 * fact_id)"
SKILL_V = f"(SELECT skill_id, v FROM skill_stats s JOIN {V} w ON w.chunk_id = 7 * skill_id)"
DESCRIBED = "(SELECT skill_name AS name, min(substr(regexp_extract(text, '([^\\n]+)', 1), 1, 200)) AS description FROM documents WHERE skill_name IS NOT NULL AND text IS NOT NULL GROUP BY skill_name)"


def terms_sql(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"


STOP_SQL = "['a','an','and','are','as','at','be','but','by','for','from','in','is','it','of','on','or','that','the','this','to','was','were','will','with','what','how','why','when','who']"


def query_units_sql(c: str) -> str:
    """Units of a query: lists of terms, one per token."""
    t = f"list_filter(regexp_split_to_array(replace(coalesce({c}, ''), '\"', ''), '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))"
    kept = f"list_filter({t}, lambda x: NOT list_contains({STOP_SQL}, lower(x)))"
    terms = "lambda x: regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+')"
    return f"list_transform(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {t} END, {terms})"


def bm25_sql(docs: str, doc: str, text: str, asked: str, qid: str, qtext: str, k: int) -> str:
    """CTEs that end in ``bm(query, doc, score, rank)``."""
    return f"""
 bq AS (SELECT query, u, array_to_string(u, ' ') AS unit, count(*) AS times FROM (SELECT {qid} AS query, unnest({query_units_sql(qtext)}) AS u FROM {asked}) GROUP BY ALL),
 bu AS (SELECT DISTINCT unit, u FROM bq),
 bd AS (SELECT {doc} AS doc, {terms_sql(text)} AS t FROM {docs}),
 bt AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM bd),
 bo AS (SELECT doc, length, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc, len(t) AS length, t FROM bd)),
 be AS (SELECT unit, len(u) AS n, unnest(u) AS term, unnest(range(len(u))) AS i FROM bu),
 bp AS (SELECT unit, doc, length, count(*) AS tf FROM (SELECT unit, doc, length, n, pos - i AS start FROM bo JOIN be USING (term) GROUP BY ALL HAVING count(*) = n) GROUP BY ALL),
 bi AS (SELECT unit, count(*) AS df FROM bp GROUP BY unit),
 bs AS (SELECT q.query, p.doc, round(sum(times * CASE WHEN ln((n_docs-df+0.5)/(df+0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs-df+0.5)/(df+0.5)) END * tf * 2.2 / (tf + 1.2*(0.25+0.75*length/mean_length))), 6) AS score
  FROM bq q JOIN bp p ON p.unit = q.unit JOIN bi i ON i.unit = q.unit, bt GROUP BY q.query, p.doc),
 bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bs) WHERE rank <= {k})"""


def knn_sql(asked: str, qid: str, qv: str, k: int, own: str = V, vid: str = "chunk_id", vv: str = "v", skip_self: bool = True) -> str:
    """CTEs that end in ``kn(query, id, cosine, rank)``."""
    return f"""
 kq AS (SELECT {qid} AS query, {qv} AS qv FROM {asked}), kv AS MATERIALIZED (SELECT {vid} AS id, {vv} AS vv FROM {own}),
 kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM
  (SELECT query, id, round(list_cosine_similarity(qv, vv), 6) AS cosine FROM kq, kv {'WHERE query <> id' if skip_self else ''})) WHERE rank <= {k})"""


def strip_sql(c: str) -> str:
    space = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"
    return f"regexp_replace({c}, '^{space}+|{space}+$', '', 'g')"
