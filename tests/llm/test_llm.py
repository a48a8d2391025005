"""The training-data operators against brute force, and their defined edge cases."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import clusters, components, conversations, history, neardup, neighbours, packing, personal, reading, signatures, splitting, tokens
from cairnlake.llm.wordsets import word_sets
from cairnlake.runtime import stage

CLASH = ("id", "h", "n", "keys", "node", "size")


def with_clash(df, *but):
    for name in CLASH:
        if name not in df.columns and name not in but:
            df = df.withColumn(name, F.lit(1))
    return df


# ------------------------------------------------------------- problem 1

ROWS = [
    # session, turn, role, content
    (1, 1, "user", "a"), (1, 2, " AI ", "b"), (1, 2, "assistant", " b "), (1, 3, "system", None),
    (2, 1, "human", "​ "), (2, 2, "assistant", None),
    (3, 1, "user", "a"), (3, 3, "assistant", "b"),
    (4, 1, "user", "a"), (4, 1, "user", "other"), (4, 2, "assistant", "b"),
    (5, 1, "user", "a"), (5, 2, "assistant", "b"), (5, 3, "user", "c"),
    (6, 1, "user", "a"), (6, 2, "assistant", " "), (6, 3, "assistant", "c"),
    (7, 1, "user", "a"), (7, 2, "???", "b"), (7, 3, "assistant", "b"),
    (8, 1, "user", "a"), (8, None, "assistant", "b"),
    (9, 2, "user", "a"), (9, 3, "assistant", "b"),
    (10, 1, "user", "a"), (10, 2, "user", "b"), (10, 3, "function", ""), (10, 4, "Assistant", "c"),
    (None, 1, "user", "a"),
]


def test_session_verdicts(spark):
    df = with_clash(spark.createDataFrame(ROWS, "session_id long, turn_index int, role string, content string").withColumn("chunk_id", F.monotonically_increasing_id()))
    got = {r.session_id: r.reason for r in conversations.session_verdicts(df.union(df)).collect()}
    assert got == {1: None, 2: "empty", 3: "broken", 4: "broken", 5: "missing_reply", 6: "missing_reply", 7: "broken", 8: "broken", 9: "broken", 10: None}
    turns = sorted((r.session_id, r.turn, r.role, r.text) for r in conversations.conversation_turns(df).collect())
    assert turns == [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "system", ""), (10, 1, "user", "a"), (10, 2, "user", "b"), (10, 3, "tool", ""), (10, 4, "assistant", "c")]
    assert conversations.session_verdicts(df.limit(0)).count() == 0


def test_every_turn_is_resolved(spark):
    turns = {1: [*range(1, 601)], 2: [1, 2, 4, 5, *range(300, 700)], 3: [0, 1, 2], 4: [2**31 - 1, -(2**31)]}
    rows = spark.createDataFrame([(s, t) for s, ts in turns.items() for t in ts], "session_id long, turn_index int")
    want = set()
    for s, ts in turns.items():
        for t in ts:
            root = t
            while root != 1 and root in ts:
                root -= 1
            want.add((s, t, root, t - root, "ok" if root in ts else "orphan"))
    assert {tuple(r) for r in conversations.resolve_turns(rows).collect()} == want
    chunks = rows.select("session_id", "turn_index", F.lit("assistant").alias("role"), F.lit("a").alias("content"))
    assert {(r.session_id, r.reason) for r in conversations.session_verdicts(chunks).collect()} == {(1, None), (2, "broken"), (3, "broken"), (4, "broken")}


def test_parents_orphans_cycles(spark):
    edges = [(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 7), (7, 6), (8, 7), (9, 9), (None, 1)] + [(100, None)] + [(100 + i, 99 + i) for i in range(1, 40)]
    got = {r.node: (r.root, r.depth, r.status) for r in conversations.resolve_parents(spark.createDataFrame(edges, "n int, p int"), "n", "p").collect()}
    assert got[3] == (1, 2, "ok") and got[5] == (99, 2, "orphan") and got[4] == (99, 1, "orphan") and got[139] == (100, 39, "ok")
    assert all(got[i] == (None, None, "cycle") for i in (6, 7, 8, 9)) and len(got) == 49


# --------------------------------------------------- problems 2 and 6


def family_vectors(rng, families=12, size=9, noise=60, dim=128):
    rows, k = [], 0
    for _ in range(families):
        base = rng.normal(size=dim)
        for _ in range(size):
            rows.append((k, (base + 0.35 * rng.normal(size=dim)) * rng.uniform(0.5, 3)))
            k += 1
    rows += [(k + i, rng.normal(size=dim)) for i in range(noise)]
    rows += [(1000, rows[0][1] + 0.01 * rng.normal(size=dim)), (1001, rows[0][1]), (1002, rows[0][1])]
    return rows


def as_table(spark, rows):
    bad = [(2000, None), (2001, [0.0] * 128), (2002, [1.0] * 64), (2003, [float("nan")] * 128), (2004, [float("inf")] + [0.0] * 127), (None, [1.0] * 128)]
    data = [(i, [float(x) for x in v]) for i, v in rows] + bad + [(rows[3][0], [float(x) for x in rows[3][1]])]
    return with_clash(spark.createDataFrame(data, "cid long, v array<float>")).repartition(3)


def cosines(rows):
    x = np.array([v for _, v in rows]).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.array([i for i, _ in rows]), x @ x.T


def test_similar_vectors(spark):
    rows = family_vectors(np.random.default_rng(2))
    ids, s = cosines(rows)
    want = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:10]
        want |= {tuple(sorted((int(ids[a]), int(ids[b])))) for b in order if s[a, b] >= 0.9}
    got = {(r.a, r.b) for r in neighbours.similar_vector_pairs(as_table(spark, rows), "cid", "v", 128, 0.9).collect()}
    assert got == want
    near = neighbours.neighbours(as_table(spark, rows), "cid", "v", 128, 5, every=10).collect()
    assert {r.id for r in near} == {int(i) for i in ids if i % 10 == 0} and max(r["rank"] for r in near) == 5
    hits = sum(r.other in {int(ids[b]) for b in np.argsort(-s[list(ids).index(r.id)])[:6]} for r in near)
    assert hits / len(near) >= 0.9
    assert neighbours.similar_vector_pairs(as_table(spark, rows).limit(0), "cid", "v", 128, 0.9).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, np.ones(128)) for i in range(300)] + [(300 + i, v) for i, (_, v) in enumerate(family_vectors(np.random.default_rng(4), 2, 4, 5))]
    near = neighbours.neighbours(as_table(spark, rows), "cid", "v", 128, 10).filter("id < 300").collect()
    per = defaultdict(list)
    for r in near:
        per[r.id].append(r)
    assert len(per) == 300 and all(len(v) == 10 and min(r.cosine for r in v) > 0.999 for v in per.values())


def test_vector_clusters(spark):
    rows = family_vectors(np.random.default_rng(3))
    ids, s = cosines(rows)
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        if s[a, b] >= 0.7:
            x, y = top(a), top(b)
            parent[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[int(ids[top(i)])].append(int(ids[i]))
    want = {(m, k) for k, ms in groups.items() if len(ms) > 1 for m in ms}
    members = clusters.vector_clusters(as_table(spark, rows), "cid", "v", 128, 0.7)
    assert {(r.id, r.cluster_id) for r in members.collect()} == want
    sessions = spark.createDataFrame([(int(i), int(i) % 2 if i < 50 else None) for i in ids], "cid long, sid long")
    counted = clusters.counted_clusters(members, sessions, "cid", "sid", 5, 2)
    assert {r.cluster_id for r in counted.collect()} == {k for k, ms in groups.items() if len(ms) >= 5 and len({m % 2 for m in ms if m < 50}) > 1}
    assert clusters.typical_members(counted).groupBy("cluster_id").count().filter("count <> 3").count() == 0


def test_density_peaks_join_touching_trees():
    # a chain of links is one cluster though it has several peaks
    angles = np.concatenate([np.linspace(0, 3, 10), [4.6]])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    label, _ = clusters.density_peaks(x, np.ones(11), 0.9)
    assert len(set(label[:10])) == 1 and label[10] == 10


def test_a_vector_joins_all_its_parts(spark):
    # 30 is in three clusters of its shards and is all that joins them
    rows = [(30, 10), (30, 20), (30, 25), (10, 10), (11, 10), (20, 20), (21, 20), (25, 25), (40, 40), (41, 40)]
    got = {r.id: r.cluster_id for r in clusters._joined(spark.createDataFrame([(i, p, 2.0) for i, p in rows], "id long, part long, density double")).collect()}
    assert got == {i: 10 for i in (10, 11, 20, 21, 25, 30)} | {40: 40, 41: 40}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7} | {100 + i: 100 for i in range(51)}


def test_components_raise_unless_settled(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a int, b int")
    with pytest.raises(RuntimeError):
        components.components(chain, "a", "b", max_rounds=2)


# --------------------------------------------------- problems 3 and 7


def edited_texts(rng, families=25, singles=60):
    common = [f"w{i}" for i in range(40)]
    out = []
    for f in range(families):
        base = rng.sample(common, rng.randint(12, 25)) + [f"r{f}x{i}" for i in range(rng.randint(3, 14))]
        for _ in range(rng.randint(2, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(common + [f"e{rng.randint(0, 500)}"])
            rng.shuffle(words)
            out.append(rng.choice([" ", ", ", "\n"]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    out += [" ".join(rng.sample(common, rng.randint(5, 39))) for _ in range(singles)]
    out += [out[0], out[0].upper(), out[1] + "!", "", None, "one two", "x " * 5000, " ".join(f"q{i}" for i in range(3000))]
    return out


def words_of(t):
    return frozenset(re.findall(r"[^\W_]+", (t or "").lower()))


def alike(a, b, least=22, share=78):
    return len(a) >= least and len(b) >= least and 100 * len(a & b) >= share * max(len(a), len(b))


def test_near_duplicates_equal_brute_force(spark):
    texts = edited_texts(random.Random(5))
    sets = [words_of(t) for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if alike(sets[a], sets[b])}
    df = with_clash(spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], "cid long, body string")).repartition(3)
    assert {(r.a, r.b) for r in neardup.similar_pairs(df, "cid", "body", 78, 22).collect()} == want
    assert neardup.similar_pairs(df.limit(0), "cid", "body", 78, 22).count() == 0


def test_many_records_that_share_frequent_words(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = ["please check this now " + " ".join(rng.sample(vocabulary, 22)) for _ in range(30_000)]
    planted = {}
    for i in range(0, 30_000, 300):
        words = texts[i].split()
        words[rng.randrange(4, 26)] = "edited"
        rng.shuffle(words)
        planted[(i, 100_000 + i)] = " ".join(words)
    rows = [*enumerate(texts), *((j, t) for (_, j), t in planted.items())]
    df = spark.createDataFrame(rows, "cid long, body string")
    assert {(r.a, r.b) for r in neardup.similar_pairs(df, "cid", "body", 78, 22).collect()} == set(planted)


def test_near_duplicate_groups(spark):
    texts = edited_texts(random.Random(6))
    sets = [words_of(t) for t in texts]
    links = {i: {sets[j] for j in range(len(texts)) if sets[j] != sets[i] and alike(sets[i], sets[j])} for i in range(len(texts))}
    df = spark.createDataFrame([*enumerate(texts)], "cid long, body string")
    got = {r.id: (r.group_id, r.links) for r in neardup.similar_groups(df, "cid", "body", 78, 22).collect()}
    assert {i: n for i, (_, n) in got.items() if n} == {i: len(v) for i, v in links.items() if v}
    for i, j in itertools.combinations(got, 2):
        if alike(sets[i], sets[j]):
            assert got[i][0] == got[j][0]


def test_large_copy_groups_by_star(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(i, text) for i in range(50)] + [(60, text.replace("a1 ", "b1 "))], "cid long, body string")
    got = {(r.a, r.b) for r in neardup.similar_pairs(df, "cid", "body", 78, 22, expand=10).collect()}
    assert got == {(0, i) for i in range(1, 50)} | {(0, 60)}


def test_only_exact_copies_are_shortened(spark):
    words = [f"a{i}" for i in range(30)]
    texts = [" ".join(words[i:] + words[:i]) for i in range(20)] + [" ".join(words)] * 15 + [" ".join(words).replace("a1 ", "b1 ")]
    df = spark.createDataFrame([*enumerate(texts)], "cid long, body string")
    got = {(r.a, r.b) for r in neardup.similar_pairs(df, "cid", "body", 78, 22, expand=10).collect()}
    shown = [*range(20), 35]  # 0 stands for its 15 copies
    assert got == set(itertools.combinations(shown, 2)) | {(0, i) for i in range(20, 35)}


@pytest.mark.parametrize("most", [8192, 4])
def test_crowded_signatures_are_compared_in_blocks(spark, most):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(36)]
    texts = [" ".join(rng.sample(words, 28)) for _ in range(150)]
    sets = [words_of(t) for t in texts]
    staged = stage(word_sets(spark.createDataFrame([*enumerate(texts)], "cid long, body string"), "body", 22, "cid"))
    names = {r.h: r.cid for r in staged.collect()}
    got = {tuple(sorted((names[r.a], names[r.b]))) for r in neardup.candidates(staged, 78, most).collect()}
    assert {(a, b) for a, b in itertools.combinations(range(150), 2) if alike(sets[a], sets[b])} <= got


@pytest.mark.parametrize("mean", [24, 60, 200])
def test_alike_sets_share_signatures_and_coverage(mean):
    rng = random.Random(mean)
    vocabulary = [rng.randrange(-(2**31), 2**31) for _ in range(500)]
    base = [sorted(rng.sample(vocabulary, rng.randint(22, 2 * mean - 22))) for _ in range(60)]
    sets = list(base)
    for b in base:
        lose = len(b) - -(-78 * len(b) // 100)
        kept = rng.sample(b, len(b) - rng.randint(0, lose))
        sets.append(sorted({*kept, *rng.sample(vocabulary, rng.randint(0, max(0, len(b) - len(kept))))}))
    keys = pa.array(sets, pa.list_(pa.int32()))
    counts = np.bincount(np.concatenate(sets) & (signatures.BUCKETS - 1), minlength=signatures.BUCKETS)
    n = np.array([len(s) for s in sets])
    plan = signatures.plan_for(counts, len(sets), float(n.mean()), 78)
    other = signatures.Plan(counts, [signatures.Tier(8, 1, 1), signatures.Tier(20, 7, 2), signatures.Tier(float("inf"), 40, 4)], 1, [[signatures.Tier(float("inf"), 60, 3)]])
    for p in (plan, other):
        rec, sig, cover = signatures.signatures(signatures.Words(keys, counts), p, 78)
        own = [set(sig[rec == i].tolist()) for i in range(len(sets))]
        for i, j in itertools.combinations(range(len(sets)), 2):
            if alike(set(sets[i]), set(sets[j])):
                assert len(own[i] & own[j]) >= min(cover[i], cover[j]) >= 1


def test_allocation_prefers_rare_words():
    occurrences = np.array([6.0, 0, 0, 0, 0, 0, 4, 10, 10, 10])
    tiers, rows = signatures.allocate(occurrences, 2.0 ** (np.arange(10) + 1) - 1, 1000, 5)
    assert tiers[0].common == 1 and rows <= 6
    tiers, _ = signatures.allocate(occurrences, 1000 * (2.0 ** (np.arange(10) + 1) - 1), 1_000_000, 9)
    assert max(t.common for t in tiers) > 1  # more of frequent words must be shared


def test_allocation_counts_on_words_that_occur_together():
    rng = np.random.default_rng(3)
    sizes = np.where(rng.random(400) < 0.5, 8, 56)  # of frequent words
    sets = [rng.choice(2000, 28, replace=False).tolist() + (2000 + rng.choice(300, size, replace=False)).tolist() for size in sizes]
    counts = np.bincount(np.concatenate(sets), minlength=signatures.BUCKETS) * 50_000
    n = np.array([len(s) for s in sets])
    plan = signatures.plan_for(counts, 400 * 50_000, float(n.mean()), 78)
    rec, _, _ = signatures.signatures(signatures.Words(pa.array(sets, pa.list_(pa.int32())), counts), plan, 78)
    assert len(rec) < 60 * len(sets)


def test_wide_sketches_are_not_carried_by_signatures(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(260)]
    texts = [" ".join(rng.sample(words, 150)) for _ in range(40)]
    texts += [" ".join(t.split()[:140]) for t in texts[:10]]
    staged = stage(word_sets(spark.createDataFrame([*enumerate(texts)], "cid long, body string"), "body", 22, "cid"))
    plan, _ = neardup.plan_of(staged, 78)
    assert neardup._signed(staged, spark.sparkContext.broadcast(plan), 78).columns == ["sig", "id", "s0", "s1"]
    names = {r.h: r.cid for r in staged.collect()}
    every = spark.createDataFrame(list(itertools.combinations(sorted(names), 2)), "a long, b long")
    left = {tuple(sorted((names[r.a], names[r.b]))) for r in neardup._not_ruled_out(every, staged, 78).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(50), 2) if alike(words_of(texts[a]), words_of(texts[b]))}
    assert want <= left and len(want) >= 10 and len(left) < every.count() / 2


def test_batches_against_history(spark):
    rng = random.Random(7)
    texts = edited_texts(rng)
    batch = {s: rng.randint(1, 6) for s in range(30)}
    session = [rng.choice([*range(30), None, 99]) for _ in texts]
    sets = [words_of(t) for t in texts]
    at = [batch.get(s) for s in session]
    want = {i for i in range(len(texts)) for j in range(len(texts)) if at[i] and at[j] and at[j] < at[i] and alike(sets[i], sets[j])}
    rows = with_clash(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(session, texts, strict=True))] * 2, "cid long, sid long, body string"))
    intake = spark.createDataFrame([*batch.items(), (0, batch[0]), (None, 1)], "sid long, no int")
    assert {r.id for r in history.repeated_messages(rows, intake, "cid", "sid", "body", "no", 78, 22).collect()} == want
    assert history.repeated_messages(rows.limit(0), intake, "cid", "sid", "body", "no", 78, 22).count() == 0


def test_history_where_every_word_is_frequent_and_shuffled(spark, tmp_path):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 30)) for _ in range(600)]
    edited = []
    for t in texts[:200]:
        w = t.split()
        w[rng.randrange(30)] = "other"
        rng.shuffle(w)
        edited.append(" ".join(w))
    h = history.History(spark, f"file://{tmp_path}/index", 78, 22)
    frame = lambda ts, start: spark.createDataFrame([(start + i, t) for i, t in enumerate(ts)], "cid long, body string")
    assert h.add(frame(texts, 0), "cid", "body", 1).count() == 0
    got = {r.id: r.earliest for r in h.add(frame(edited, 1000), "cid", "body", 2).collect()}
    assert got == dict.fromkeys(range(1000, 1200), 1)


def test_history_is_kept_in_files_and_merged(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    text = lambda n: " ".join(f"t{n}x{i}" for i in range(30))
    for b in range(7):
        rows = spark.createDataFrame([(10 * b + i, text(5 * b + i)) for i in range(5)] + [(10 * b + 7, text(0) + " more")], "cid long, body string")
        h = history.History(spark, folder, 78, 22)  # each batch opens the written index
        got = {r.id: r.earliest for r in h.add(rows, "cid", "body", b).collect()}
        assert got == ({10 * b + 7: 0} if b else {})
    assert [a["weight"] for a in h.arrays] == [4, 2, 1]
    assert len(list((tmp_path / "index").glob("part-*"))) == 3


def test_history_merges_arrays_that_fall_together_in_one_pass(spark, tmp_path, monkeypatch):
    merged, merge = [], history.History._merge
    monkeypatch.setattr(history.History, "_merge", lambda self, *arrays: merged.append(len(arrays[0])) or merge(self, *arrays))
    h = history.History(spark, f"file://{tmp_path}/index", 78, 22)
    for b in range(5):
        text = lambda n: " ".join(f"t{n}x{i}" for i in range(30))
        rows = spark.createDataFrame([(2 * b, text(b)), (2 * b + 1, text(0) + " more")], "cid long, body string")
        got = {r.id: r.earliest for r in h.add(rows, "cid", "body", b).collect()}
        assert got == ({2 * b + 1: 0} if b else {})
    assert merged == [2, 3] and [a["weight"] for a in h.arrays] == [4, 1]
    assert h.arrays[0]["batches"] == [0, 1, 2, 3] and len(list((tmp_path / "index").glob("part-*"))) == 2


def test_lookup_reads_only_the_row_groups_asked_for(tmp_path):
    store, root = history._files(f"file://{tmp_path}")
    sig = np.arange(100_000, dtype=np.int64) << 20
    table = pa.table({"sig": sig, "id": sig, "s0": sig, "s1": sig, "need": np.ones(len(sig), np.int8)}, schema=history._ARRAY)
    history._write(store, f"{root}/a.parquet", history._ARRAY, iter([table]), 1000)
    file = history.SortedFile(store, f"{root}/a.parquet")
    asked = np.array([5, 1500, 1700, 99_999], np.int64) << 20
    assert [(g, some.tolist()) for g, some in file.touched(asked, asked)] == [(0, [0]), (1, [1, 2]), (99, [3])]


# ------------------------------------------------------------- problem 4


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to jo.doe+x@mail.example.org now", {"email": "jo.doe+x@mail.example.org"}),
        ("jo [at] mail [dot] example [dot] com, please", {"email": "jo [at] mail [dot] example [dot] com"}),
        ("jo AT example DOT net here", {"email": "jo AT example DOT net"}),
        ("@retry(times=1) and pkg@5.3.1", {}),
        ("Call me on +49 (0)30 23125 104 today", {"phone": "+49 (0)30 23125 104"}),
        ("My number is (555) 010-4012 if", {"phone": "(555) 010-4012"}),
        ("Order 1137-79-5605 left on 2024-06-16, node 192.0.2.27, ts=1766812046823", {}),
        ("my SSN 925-15-3915, DNI 00001249R", {"id_number": "925-15-3915|00001249R"}),
        ('{"ssn": "904189885"}', {"id_number": "904189885"}),
        ("Ship to Flat 9, 293 Nakpel Road, Ristador soon", {"address": "Flat 9, 293 Nakpel Road, Ristador"}),
        ("at 24 STASTA Ave\nApt 35\nNISCAS 28945.", {"address": "24 STASTA Ave\nApt 35\nNISCAS 28945"}),
        ("Druvenstraße 44, 48025 Tari", {"address": "Druvenstraße 44, 48025 Tari"}),
        ("P.O. Box 2236, Nisjarkel 39835", {"address": "P.O. Box 2236, Nisjarkel 39835"}),
        ("Road map 3152 shows 14 lanes and 77 rooms. Box 142 holds blank P.O. forms and address labels.", {}),
        ("My name is fengar fenithven and I own it", {"name": "fengar fenithven"}),
        ("Ask Fenjar, not me. The Slow Loom project renamed its Main Branch to Old Harbour.", {}),
        ("Regards,\nG. Ithmar (team)", {"name": "G. Ithmar"}),
        ("Cc: Nisdruquin, Ulgar, re: x", {"name": "Nisdruquin, Ulgar"}),
        ("Herr Penlo called", {"name": "Herr Penlo"}),
        ("seen tari solek there", {"name": "tari solek"}),
    ],
)
def test_personal_spans(text, want):
    got = defaultdict(list)
    for a, b, k in personal.find_personal(text, frozenset({("tari", "solek")})):
        got[k].append(text[a:b])
    assert {k: "|".join(v) for k, v in got.items()} == want


@pytest.mark.parametrize(
    "text, kind",
    [
        ("jane { at } example.org", "email"),
        ("jane [  at ] example.org", "email"),
        ("jane (\tat) example.org", "email"),
        ("jane < at > example.org", "email"),
        ("jane at\n\nexample dot org", "email"),
        ("POBox 12, Ristador", "address"),
        ("BP123 Ristador", "address"),
        ("BP #12 Ristador", "address"),
        ("Postfach12 Ristador", "address"),
        ("avda. Nakpel 12, Ristador", "address"),
        ("driverslicense: 12345678", "id_number"),
        ("Smith,\nJ. wrote", "name"),
        ("Smith,  J. wrote", "name"),
        ("seen tari solek.", "name"),
        ("(tari solek)", "name"),
        ("tari solek!", "name"),
        ("seen anne-li o'brien there", "name"),
        ("seen ali ali there", "name"),
    ],
)
def test_gates_only_save_work(monkeypatch, text, kind):
    people = frozenset({("tari", "solek"), ("anne-li", "o'brien"), ("ali", "ali")})
    got = personal.find_personal(text, people)
    assert [k for _, _, k in got] == [kind]
    monkeypatch.setattr(personal, "worth_a_look", lambda t, people: (True,) * 5)
    for gate in ("_MAY_MAIL", "_MAY_ADDRESS", "_MAY_GERMAN"):
        monkeypatch.setattr(personal, gate, re.compile(""))
    assert personal.find_personal(text, people) == got


def test_validators():
    assert personal.luhn("79927398713") and not personal.luhn("79927398710")
    assert personal.check_letter("12345678Z") and not personal.check_letter("12345678A")
    assert personal.iso_check("86095742719") and not personal.iso_check("86095742710")
    assert personal.mod97("255081416802538") and not personal.mod97("255081416802539")


def test_redacted_messages(spark):
    rows = [(1, "mail a@b.example now"), (1, "mail a@b.example now"), (2, None), (3, ""), (4, "nothing"), (5, "x " * 60000 + "Tel. 030/23125-922"), (None, "a@b.example")]
    df = with_clash(spark.createDataFrame(rows, "cid long, body string"), "id")
    people = spark.createDataFrame([("A", None), (" Tari ", "SOLEK")], "given_name string, family_name string")
    got = {r.cid: r.body for r in personal.redacted_messages(df, "cid", "body", people).collect()}
    assert got[1] == "mail [EMAIL] now" and got[2] is None and got[3] == "" and got[4] == "nothing" and got[5].endswith("Tel. [PHONE]") and len(got) == 5
    assert sorted((r.id, r.kind) for r in personal.personal_kinds(df, "cid", "body").collect()) == [(1, "email"), (5, "phone")]
    assert personal.personal_kinds(df.limit(0), "cid", "body").count() == 0


# ------------------------------------------------------------- problem 5


def texts_to_cut(rng):
    alphabet = ["a", "bc", "é", "日本", " ", " ", "\n", "\r\n", "\n\n", "\n \t\n", "\t", "x" * 30, "\r"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 260))) for _ in range(120)] + ["", "a" * 500, " " * 300, "é" * 200]


@pytest.mark.parametrize("size", [40, 64, 1 << 20])
def test_pieces_cover_the_text(spark, size):
    texts = texts_to_cut(random.Random(8))
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "cid long, body string")
    ranges = splitting.item_ranges(splitting.oversized(df, "body", 0), "cid", "body", size)
    per = defaultdict(list)
    for r in splitting.pieces(ranges, "bigint", 32, 8, size).collect():
        per[r.id].append(r)
    for i, t in enumerate(texts):
        raw, at = t.encode(), 0
        for no, p in enumerate(sorted(per[i], key=lambda p: p.piece_no)):
            assert p.piece_no == no and at - 8 <= p.start <= at < p.stop <= p.start + 32
            assert raw[p.start : p.stop].decode() == p.text
            at = p.stop
        assert at == len(raw)


@pytest.mark.parametrize("unit, kind", [(["ab"] * 3, "word"), (["ab cd\n"], "line"), (["ab cd\nef\n\n"], "paragraph")])
def test_pieces_keep_boundaries_and_overlap_over_ranges(spark, unit, kind):
    rng = random.Random(18)
    text = "".join("x" * rng.randint(1, 9) + (" " if kind == "word" else "") + rng.choice(unit) + (" " if kind == "word" else "") for _ in range(900))
    raw = text.encode()
    df = spark.createDataFrame([(1, text)], "cid long, body string")
    for size in (300, 1000, 1 << 20):
        got = splitting.pieces(splitting.item_ranges(df, "cid", "body", size), "bigint", 80, 20, size).orderBy("piece_no").collect()
        assert [p.piece_no for p in got] == list(range(len(got))) and got[-1].stop == len(raw)
        assert {p.boundary for p in got[:-1]} == {kind} and got[-1].boundary == "end"
        for a, b in itertools.pairwise(got):
            assert a.stop - 20 <= b.start < a.stop < b.stop and raw[a.stop - 1 : a.stop].isspace()
            assert raw[b.start - 1 : b.start].isspace() and raw[b.start : b.stop].decode() == b.text


@pytest.mark.parametrize("size", [40, 64, 1 << 20])
def test_boundary_kinds_do_not_depend_on_ranges(spark, size):
    texts = texts_to_cut(random.Random(9))
    df = spark.createDataFrame([*enumerate(texts)], "cid long, body string")
    ranges = splitting.item_ranges(splitting.oversized(df, "body", 0), "cid", "body", size)
    got = {r.id: (r.paragraph, r.line, r.word) for r in splitting.boundary_kinds(ranges, "bigint", 32, size).collect()}
    for i, t in enumerate(texts):
        if t:
            lines = re.split(r"\r\n|\r|\n", t)
            para, cur, best = [], 0, 0
            for line, end in zip(lines, [*re.findall(r"\r\n|\r|\n", t), ""], strict=True):
                if line.strip():
                    cur = (cur + para[-1] if cur else 0) + len(line.encode())
                    para.append(len(end))
                else:
                    cur = 0
                best = max(best, cur)
            want = (best, max(len(x.encode()) for x in lines), max(len(x.encode()) for x in re.split(r"[ \t\r\n]+", t)))
            assert got[i] == want, (i, t)


def test_files_are_read_by_ranges(spark, tmp_path):
    body = "\n\n".join(f"paragraph {i} " + "word " * (i % 30) for i in range(400))
    path = tmp_path / "big.txt"
    path.write_text(body)
    files = spark.createDataFrame([(str(path), len(body.encode()))], "path string, size long")
    got = splitting.pieces(splitting.file_ranges(spark, files, 1000), "string", 300, 0, 1000).orderBy("piece_no").collect()
    assert "".join(r.text for r in got) == body and max(len(r.text.encode()) for r in got) <= 300


# ------------------------------------------------------- problems 8 and 9


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pt = pytest.importorskip("public_tokenizers")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(pt.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference(spark, reference):
    rng = random.Random(10)
    signs = list("abcdefghe the ing ions aaa     \n\n\t\r.,!?'`-=0123456789éüß日本​　") + ["<|endoftext|>", "'ll", "```", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["a" * 5000, "=" * 3000, " " * 700, "ab" * 2000]
    df = with_clash(spark.createDataFrame([*enumerate(texts), (-1, ""), (-2, None)], "did long, body string"))
    got = {r.did: r.ids for r in tokens.encode_documents(df, "did", "body").collect()}
    assert got.pop(-1) == [] and got.pop(-2) == []
    assert all(got[i] == reference.encode_ordinary(t) for i, t in enumerate(texts))
    n = {r.did: r.tokens for r in tokens.count_tokens(df, "did", "body").collect()}
    assert all(n[i] == len(got[i]) for i in got) and n[-1] == n[-2] == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 40), rng.randint(1, 600), 512, rng.randint(1, 5000), 2048, 4096]) for _ in range(1500)]
    df = with_clash(spark.createDataFrame([*enumerate(sizes), (-1, 0), (-2, None)], "did long, tokens int"), "size")
    got = packing.pack_items(df, "did", "tokens", 2048).collect()
    load, per = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container_id] += r.n_tokens
        per[r.did].append(r)
    assert max(load.values()) <= 2048 and sorted(load) == list(range(len(load)))
    assert {i: sum(r.n_tokens for r in rs) for i, rs in per.items()} == dict(enumerate(sizes))
    assert all(len(rs) == -(-sizes[i] // 2048) and sorted(r.piece_no for r in rs) == list(range(len(rs))) for i, rs in per.items())
    assert len(load) <= 1.02 * -(-sum(sizes) // 2048) + 1
    assert packing.pack_items(df.limit(0), "did", "tokens", 2048).count() == 0


# ------------------------------------------------------------ problem 10


def test_reading_bands(spark):
    easy = "The cat sat on it. " * 12
    hard = "Notwithstanding considerable classification practitioners frequently underestimate intermediate serialisation requirements. " * 6
    texts = [
        easy, hard, "---\nname: considerable classification\n---\n# Extraordinary heading\n" + easy + "\n```\nconsiderable classification here\n```\n| table considerable |\n- " + easy,
        easy + "\n~~~\nunclosed considerable classification", "few words.", "", None, easy.replace(".", ""), hard.replace("\n", "\r\n"),
    ]
    df = with_clash(spark.createDataFrame([*enumerate(texts)], "did long, body string"))
    got = {r.did: r for r in reading.reading_profile(df, "did", "body").collect()}
    assert {i: r.reading_band for i, r in got.items()} == {0: "easy", 1: "hard", 2: "easy", 3: "easy", 7: "hard", 8: "hard"}
    assert got[0].words_per_sentence == 5 and got[2].words == 120 and got[2].difficult == 0 and got[7].sentences == 1
    own = {r.did: r.difficult for r in reading.reading_profile(df, "did", "body", familiar=0.3).collect()}
    assert own[0] == 0 and own[1] > 30
    assert reading.reading_profile(df.limit(0), "did", "body").count() == 0

@pytest.mark.parametrize(
    "text, found",
    [
        ("Please hand it over to Anna Schmidt.", ["name"]), ("(Anna Schmidt) knows", ["name"]), ("anna schmidt!", ["name"]), ("go to Anna Schmidt today", ["name"]),
        ("ssn 99999", []), ("ssn 123-45-6789", ["id_number"]), ("Steuer-ID 12345678901", ["id_number"]), ("here 1 85 05 78 006 084 91 it is", ["id_number"]), ("here 1 85 05 78 006 084 92 it is", []),
    ],
)
def test_personal_checks_and_known_people(text, found):
    people = frozenset({("anna", "schmidt"), ("schmidt", "anna")})
    assert [k for _, _, k in personal.find_personal(text, people)] == found


def test_checks_move_the_score():
    assert personal.id_score("steuer-id", "02476291358") > personal.id_score("steuer-id", "12345678901") >= personal.ACCEPT
    assert personal.id_score("dni", "12345678Z") > personal.id_score("dni", "12345678A") >= personal.ACCEPT > personal.id_score("ssn", "99999")
    assert personal.id_score("tax id", "79927398713") > personal.id_score("tax id", "79927398710")
