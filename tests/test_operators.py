import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.operators import browse, cluster, dense, evaluate, folds, fusion, graph, lexical, retention, upkeep

DOCS = [(1, "the deploy failed on the cache server"), (2, "cache the deploy deploy"), (3, "nothing here"), (4, None), (5, ""), (6, "deploy-fix applied to error_code")]


def test_bm25_equals_sqlite(spark):
    docs = spark.createDataFrame([d for d in DOCS if d[1]], "id long, body string")
    asked = spark.createDataFrame([(1, "deploy cache"), (2, "error"), (3, "?!"), (4, None)], "q long, text string")
    got = {(r.query, r.doc): r.score for r in lexical.bm25_topk(docs, "id", "body", asked, "q", "text", 10).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body)")
    db.executemany("insert into f(rowid, body) values (?, ?)", [d for d in DOCS if d[1]])
    want = {}
    for q, t in ((1, "deploy OR cache"), (2, "error")):
        want |= {(q, i): round(-s, 6) for i, s in db.execute("select rowid, rank from f where f match ?", (t,))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_bm25_edges(spark):
    docs = spark.createDataFrame(DOCS + [(7, "deploy")] * 2, "id long, body string")
    asked = spark.createDataFrame([(1, "deploy")], "q long, text string")
    assert lexical.bm25_topk(docs.limit(0), "id", "body", asked, "q", "text", 3).count() == 0
    assert lexical.bm25_topk(docs, "id", "body", asked.limit(0), "q", "text", 3).count() == 0
    assert lexical.bm25_topk(docs, "id", "body", asked, "q", "text", 2).count() == 2


def test_phrases_and_substrings(spark):
    docs = spark.createDataFrame([(1, "deploy-fix applied"), (2, "fix deploy later"), (3, "索引を保存"), (4, None)], "id long, body string")
    p = spark.createDataFrame([(1, "deploy fix")], "p long, t string")
    assert [(r.doc, r.n) for r in lexical.phrase_matches(docs, "id", "body", p, "p", "t").collect()] == [(1, 1)]
    n = spark.createDataFrame([(1, "保存"), (2, ""), (3, "100%")], "p long, t string")
    assert [(r.query, r.doc) for r in lexical.substring_topk(docs, "id", "body", n, "p", "t", 5).collect()] == [(1, 3)]


def test_stems_phrases_and_stored_index_equal_sqlite(spark, tmp_path):
    docs = spark.createDataFrame([d for d in DOCS if d[1]] + [(8, "fix deploy later"), (9, "deploying fixes, caches and errors")], "id long, body string")
    rows = [tuple(r) for r in docs.collect()]
    asked = spark.createDataFrame([(1, "deploy-fix caching"), (2, "errors"), (3, "deploy deploy")], "q long, text string")
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, body) values (?, ?)", rows)
    want = {}
    for q, t in ((1, '"deploy-fix" OR "caching"'), (2, '"errors"'), (3, '"deploy" OR "deploy"')):
        want |= {(q, i): -s for i, s in db.execute("select rowid, rank from f where f match ?", (t,))}
    index = lexical.StoredIndex(spark, f"file://{tmp_path}/i", stem=True)
    assert not index.usable()
    for hits in (lexical.bm25_topk(docs, "id", "body", asked, "q", "text", 10, stem=True), index.ensure(docs, "id", "body").search(asked, "q", "text", 10)):
        got = {(r.query, r.doc): r.score for r in hits.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)
    assert index.usable() and not lexical.StoredIndex(spark, f"file://{tmp_path}/i").usable()


def test_seeded_mmr_and_aged(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, "a b"), (1, 11, 0.89, "a b"), (1, 12, 0.8, "c d"), (1, 13, 0.7, None)], "query long, id long, cosine double, task string")
    assert [r.id for r in fusion.seeded_mmr(hits, "cosine", "task", 0.7, 3).orderBy("pick").collect()] == [10, 12, 13]
    fused = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.49, 2)], "query long, id long, score double, rank int")
    times = spark.createDataFrame([(10, 0.0), (11, None)], "id long, created_at double")
    assert [r.id for r in fusion.aged(fused, times, "created_at", 30 * 86400.0, 0.3, 30, 2).orderBy("rank").collect()] == [11, 10]


def test_pair_counts_of_large_keys(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(9)] + [(2, 3, 1.0), (2, 4, 2.0), (2, None, 1.0)], "k long, i long, at double")
    few = {tuple(r) for r in graph.pair_counts(rows, "k", "i", "at").collect()}
    assert few == {tuple(r) for r in graph.pair_counts(rows, "k", "i", "at", most=3).collect()} and len(few) == 36


def test_upkeep(spark):
    near = spark.createDataFrame([(1, 10, 0.95, 1), (2, 11, 0.95, 1), (3, 10, 0.5, 1)], "query long, id long, cosine double, rank int")
    new = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    stored = spark.createDataFrame([(10, 0), (11, 1)], "id long, pinned int")
    assert {r.id: (r.action, r["into"]) for r in upkeep.merge_or_insert(near, new, stored, 0.9, F.col("pinned") == 1).collect()} == {1: ("merged", 10), 2: ("skipped", 11), 3: ("inserted", None), 4: ("inserted", None)}
    rows = spark.createDataFrame([(1, 4.0, True, "a"), (2, 3.0, True, "b"), (3, 2.0, True, "c"), (4, 1.0, False, "d")], "id long, at double, live boolean, text string")
    pairs = spark.createDataFrame([(1, 2, 0.9, 1), (2, 3, 0.9, 1), (1, 4, 0.9, 2), (3, 1, 0.9, 1)], "query long, id long, cosine double, rank int")
    # 2 is outdated by 1, so it may not outdate 3
    assert [tuple(r) for r in upkeep.sweep(pairs, rows, 3, 0.8, 4, lambda a, b: True).collect()] == [(2, 1)]
    ops = spark.createDataFrame([(1, "update", 1, "x"), (2, "prune", 2, None), (3, "add", 9, "new"), (4, "prune", 3, None)], "op_no int, op string, id long, text string")
    done = upkeep.apply_operations(rows.select("id", "text"), ops, "id", ["text"], F.col("id") < 3, 3)
    assert sorted(tuple(r) for r in done.collect()) == [(1, "x"), (3, "c"), (4, "d"), (9, "new")]
    entries = spark.createDataFrame([(1, 0, "short", [1.0, 0.0]), (1, 1, "longer one", [1.0, 0.01]), (1, 2, "other", [0.0, 1.0])], "d long, place int, t string, v array<double>")
    assert sorted(r.t for r in upkeep.keep_longest(entries, "d", "place", "t", "v", 0.9).collect()) == ["longer one", "other"]


def test_porter_equals_sqlite():
    words = "caresses ponies cats feed agreed plastered motoring sing conflated hopping falling filing happy sky relational conditional rationalize digitizer vietnamization predication operator hopefulness formaliti triplicate formative electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body, tokenize='porter')")
    db.execute("create virtual table v using fts5vocab(f, instance)")
    db.executemany("insert into f(rowid, body) values (?, ?)", list(enumerate(words)))
    want = dict(db.execute("select doc, term from v"))
    assert {w: lexical.porter(w) for w in words} == {w: want[i] for i, w in enumerate(words)}


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (70, None), (71, [0.0] * 8), (72, [1.0]), (73, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    got = {(r["query"], r["rank"]): r["id"] for r in dense.knn_topk(df.filter("id % 10 = 0"), "id", "v", df, "id", "v", 8, 4, exclude_self=True).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    for q in range(0, 60, 10):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-s[q, i], i))[:4]
        assert [got[q, r] for r in range(1, 5)] == order
    assert dense.knn_topk(df.limit(0), "id", "v", df, "id", "v", 8, 4).count() == 0


def test_rrf_and_mmr(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query int, id int, rank int")
    r = {x.id: (x["rank"], x.score) for x in fusion.rrf([a, b]).collect()}
    assert r[11] == (1, pytest.approx(1 / 61 + 1 / 62, abs=1e-9)) and r[10][0] == 2 and r[12][0] == 3
    hits = spark.createDataFrame([(1, 1, 1.0, "a b c"), (1, 2, 0.9, "a b c"), (1, 3, 0.5, "x y"), (1, 4, 0.2, None)], "query int, id int, score double, t string")
    pick = lambda lam: [x.id for x in fusion.mmr(hits, "t", lam, 3).orderBy("pick").collect()]
    assert pick(1.0) == [1, 2, 3] and pick(0.5) == [1, 3, 4]


def test_browse(spark):
    rows = [(i, 1, i, "user", f"m{i}") for i in range(1, 11)] + [(20, None, 1, "user", "x"), (21, 2, None, "user", None), (22, 2, 1, "user", "y")]
    c = spark.createDataFrame(rows, "chunk_id long, session_id long, turn_index int, role string, content string")
    near = browse.around(c, c.filter("chunk_id in (1, 5, 20)"), 1).collect()
    assert sorted((r.anchor, r.offset, r.chunk_id) for r in near) == [(1, 0, 1), (1, 1, 2), (5, -1, 4), (5, 0, 5), (5, 1, 6)]
    hits = spark.createDataFrame([(7, 5, 1), (7, 6, 2), (7, 22, 3)], "query int, id long, rank int")
    arcs = browse.session_arcs(c, hits, 1, 1)
    assert sorted((r.part, r.chunk_id) for r in arcs.collect()) == [("anchor", 4), ("anchor", 5), ("anchor", 6), ("end", 8), ("end", 9), ("end", 10), ("start", 1), ("start", 2), ("start", 3)]
    tail = browse.tail_under_budget(c, F.lit(2), 5).filter("session_id = 1")
    assert sorted(r.chunk_id for r in tail.collect()) == [9, 10]


def test_graph(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 3.0), (2, "c", 4.0), (3, None, 1.0), (4, "z", 1.0)], "k int, i string, at double")
    p = graph.pair_counts(s, "k", "i", "at")
    assert sorted(tuple(r) for r in p.collect()) == [("a", "b", 2, 4.0), ("a", "c", 1, 4.0), ("b", "c", 1, 4.0)]
    assert sorted((r.node, r.other) for r in graph.partners(p, 2, 3).collect()) == [("a", "b"), ("b", "a")]
    big = spark.range(70).selectExpr("1 as k", "cast(id as string) as i", "1.0 as at")
    assert graph.pair_counts(big, "k", "i", "at").count() == 70 * 69 // 2


def test_clusters():
    x = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.1, 0.99], [-1, 0]])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    assert cluster.greedy(x, 0.9).tolist() == [0, 0, 1, 1, 2]
    assert cluster.anchored(x, 0.9, 5).tolist() == [0, 0, 1, 1, -1]
    assert cluster.greedy(np.zeros((0, 2)), 0.5).tolist() == []


def test_folds(spark):
    e = spark.createDataFrame([(1, 3, 0.0), (1, 1, 1.0), (1, 2, None), (2, 1, 3.0), (2, 2, 3.0), (2, 3, 5.0)], "k int, t int, v double")
    u = {r.k: r.utility for r in folds.utility(e, "k", ["t"], F.col("v")).collect()}
    assert u[1] == pytest.approx(0.55 * 0.9)
    rng = np.random.default_rng(2)
    steps = rng.choice([0.3, -0.4, 0.7], 300).tolist()
    x = 1.0
    for v in steps:
        x = min(max(x + v, 0.0), 2.0)
    many = spark.createDataFrame([(7, i, v) for i, v in enumerate(steps)], "k int, t int, v double").repartition(4)
    for block in (1, 7, 4096):
        assert folds.clamped_sum(many, "k", ["t"], F.col("v"), 1.0, 0.0, 2.0, block).first().total == pytest.approx(x)
    assert {r.k: r.nudges for r in folds.resets(e, "k", ["t"], F.col("v"), 5.0).collect()} == {1: 0, 2: 2}
    assert folds.resets(e.limit(0), "k", ["t"], F.col("v"), 5.0).count() == 0
    log = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), ("b", 1, 1, "z")], "k string, tie int, at int, v string")
    assert sorted((r.k, r.v) for r in folds.last_value(log, "k", "v", "at", "tie").collect()) == [("a", "y"), ("b", "z")]


def test_retention(spark):
    s = spark.createDataFrame([(1, 10.0), (2, None), (3, 1e6)], "session_id long, ended_at double")
    c = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "chunk_id long, session_id long")
    kept, rest = retention.purge(s, {"c": c}, 200 * 86400.0, 100)
    assert sorted(r[0] for r in kept.collect()) == [2] and sorted(r.chunk_id for r in rest["c"].collect()) == [2, 3]
    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(9)], "id int, kind int, at double")
    got = retention.evict(rows, "id", [(F.col("kind") == 0, [F.desc("at")]), (F.col("kind") == 1, [F.col("at")])], 5).collect()
    assert [(r.id, r.tier) for r in got] == [(6, 1), (3, 1), (0, 1), (1, 2), (4, 2)]
    old = spark.createDataFrame([("a", "active", 1), ("b", "stale", 2)], "name string, status string, n int")
    new = spark.createDataFrame([("a", "draft", 9), ("c", "draft", 3)], "name string, status string, n int")
    assert sorted(tuple(r) for r in retention.merge_snapshot(old, new, "name", ["status"]).collect()) == [("a", "active", 9), ("b", "stale", 2), ("c", "draft", 3)]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query int, id int, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 12), (2, 5)], "query int, id int")
    r = {x["query"]: x for x in evaluate.ranking_scores(ranked, gold, 2).collect()}
    assert r[1].recall == 0.5 and r[1].rr == 0.5 and r[1].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)), abs=1e-6)
    assert r[2].recall == r[2].rr == r[2].ndcg == 0
    a = {x["query"]: (x.any_at, x.all_at) for x in evaluate.any_all_at(ranked, gold, 3).collect()}
    assert a == {1: (1, 1), 2: (0, 0)}
    labels = spark.createDataFrame([("s", "ok", "ok"), ("s", "ok", "fail"), ("s", "fail", None), ("s", None, "ok")], "source string, truth string, guess string")
    p = {x.label: (x.tp, x.fp, x.fn) for x in evaluate.precision_recall(labels, "truth", "guess", "source").collect()}
    assert p == {"ok": (1, 0, 1), "fail": (0, 1, 1)}
