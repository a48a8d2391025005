"""The engine's public functions: a memory over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ranking, text
from .operators import browse, cluster, dense, fusion, graph, lexical, retention, upkeep
from .plans import base
from .sources.files import slot_edit
from .sources.sinks import export_json_lines


class Memory:
    """Search, browse, rank and maintain one folder of memory tables.

    Searches take a table of queries (query, text, and for dense search a
    vector) and answer all of them in one job.
    """

    def __init__(self, spark: SparkSession, folder: str, dims: int = base.VEC, now: float = base.NOW):
        self.spark, self.folder, self.dims, self.now = spark, folder, dims, now

    # ---------------------------------------------------------- tables
    def chunks(self) -> DataFrame:
        return base.chunks(self.spark, self.folder)

    def sessions(self) -> DataFrame:
        return base.sessions(self.spark, self.folder)

    def trajectories(self) -> DataFrame:
        return base.trajectories(self.spark, self.folder)

    def skills(self) -> DataFrame:
        return base.skills(self.spark, self.folder)

    # ---------------------------------------------------------- search
    def session_search(self, queries: DataFrame, k: int = 8, pool: int = 25, balance: float = 0.7, vec: str | None = None, stem: bool = True) -> DataFrame:
        """(query, id, pick, snippet): lexical and, if ``vec`` names a column, dense hits, fused and diversified.

        Words match by their stems; queries of scripts without word spaces that no
        word answers are looked for as literals. Without vectors (the embedder is
        down) the lexical channel answers alone.
        """
        c = self.chunks()
        lists = [lexical.lexical_channel(c, "chunk_id", "content", queries, "query", "text", pool, stem).withColumnRenamed("doc", "id")]
        if vec:
            v = base.vectors(self.spark, self.folder)
            lists.append(dense.knn_topk(queries, "query", vec, v, "chunk_id", "embedding", self.dims, pool))
        body = c.select(F.col("chunk_id").alias("id"), "content")
        picked = fusion.mmr(fusion.rrf(lists).join(body, "id"), "content", balance, k)
        out = picked.join(body, "id").join(queries.select("query", "text"), "query")
        return out.select("query", "id", "pick", text.snippet("content", "text").alias("snippet"))

    def session_browse(self, mode: str, queries: DataFrame | None = None, limit: int = 3, width: int = 5) -> DataFrame:
        """discover (arcs around hits), expand (around chunk ids), recent (latest sessions)."""
        c = self.chunks()
        if mode == "discover":
            hits = lexical.bm25_topk(c, "chunk_id", "content", queries, "query", "text", 10 * limit).withColumnRenamed("doc", "id")
            return browse.session_arcs(c, hits, limit, width)
        if mode == "expand":
            return browse.around(c, queries, width)
        if mode == "recent":
            return browse.recent_sessions(self.sessions(), c, limit)
        raise ValueError(f"no such mode: {mode}")

    def trajectory_search(self, queries: DataFrame, k: int = 3, weight: float = 0.3, half_life: float = 30, vec: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """(query, id, score, rank): past tasks by words and, with ``vectors`` (trajectory_id, embedding), by likeness; younger ones first."""
        t, pool = self.trajectories(), max(4 * k, 20)
        lists = [lexical.lexical_channel(t, "trajectory_id", "task", queries, "query", "text", pool, stem=True).withColumnRenamed("doc", "id")]
        if vec and vectors is not None:
            lists.append(dense.knn_topk(queries, "query", vec, vectors, "trajectory_id", "embedding", self.dims, pool))
        return fusion.aged(fusion.rrf(lists), t.select(F.col("trajectory_id").alias("id"), "created_at"), "created_at", self.now, weight, half_life, k)

    def skill_search(self, queries: DataFrame, k: int = 5, mode: str = "ucb1", weight: float = 0.05, vec: str | None = None, vectors: DataFrame | None = None, like: float = 0.82) -> DataFrame:
        """(query, id, adjusted, rank, head): skills adjusted by their record and the words of their names.

        With ``vectors`` (skill_id, embedding) by likeness, like hits standing under
        the first of them (``head``); without, by words alone.
        """
        s = self.skills().filter("skill_status <> 'deprecated'").withColumn("words", F.translate("skill_name", "-_", "  "))
        if vec and vectors is not None:
            hit = dense.knn_topk(queries, "query", vec, vectors.join(s.select("skill_id"), "skill_id", "left_semi"), "skill_id", "embedding", self.dims, 3 * k)
            hit = hit.select("query", "id", (1 - F.col("cosine")).alias("far"))
        else:
            hit = lexical.bm25_topk(s, "skill_id", "words", queries, "query", "text", 3 * k).select("query", F.col("doc").alias("id"), (1 / (1 + F.col("score"))).alias("far"))
        j = hit.join(s.select(F.col("skill_id").alias("id"), "words", "use_count", "success_count"), "id").join(F.broadcast(s.agg(F.sum("use_count").alias("total")))).join(queries.select("query", "text"), "query")
        d, u, w = F.col("far"), F.col("use_count"), F.col("success_count")
        adjusted = {"ucb1": ranking.ucb1(d, u, w, F.col("total"), weight), "success": ranking.success_weighted(d, u, w, 0.3, 3), "plain": d}[mode]
        words = lambda c: F.array_distinct(text.terms(F.col(c)))
        out = j.select("query", "id", F.round(ranking.name_overlap(adjusted, words("words"), words("text"), 0.1), 6).alias("adjusted"))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("adjusted", "id")))
        if vec and vectors is not None:
            heads = cluster.siblings(out.join(vectors.select(F.col("skill_id").alias("id"), "embedding"), "id"), "embedding", like, k)
            return out.join(heads.select("query", "id", "head"), ["query", "id"])
        return out.filter(F.col("rank") <= k).withColumn("head", F.col("id"))

    # ---------------------------------------------------- skills, status
    def skill_stats(self, least_uses: int = 3) -> DataFrame:
        u, w = F.col("use_count"), F.col("success_count")
        return self.skills().select("skill_id", "skill_name", "skill_status", u, ranking.rate_label(u, w, least_uses).alias("rate"), text.age_label(F.lit(self.now) - F.col("last_used_at")).alias("age"))

    def skill_partners(self, least: int = 2, k: int = 3) -> DataFrame:
        used = self.trajectories().select("trajectory_id", "created_at", F.explode("skills").alias("skill"))
        return graph.partners(graph.pair_counts(used, "trajectory_id", "skill", "created_at"), least, k)

    def skill_export(self, folder: str, least_sessions: int = 1) -> None:
        """JSON lines of successful uses, a folder per skill with enough sessions."""
        used = self.trajectories().filter("outcome = 'ok' and session_id is not null").select(F.explode("skills").alias("skill"), "session_id", "task", "created_at")
        enough = used.groupBy("skill").agg(F.countDistinct("session_id").alias("n")).filter(F.col("n") >= least_sessions).select("skill")
        export_json_lines(used.join(enough, "skill", "left_semi"), folder, "skill")

    def workflow_suggest(self, vectors: DataFrame, id_col: str, vec: str, most: int = 100, least: float = 0.85, fewest: int = 3) -> DataFrame:
        """(cluster, size): recurring tasks among the newest ``most`` rows, for vectors (id, at, vec)."""
        top = vectors.orderBy(F.desc("at"), id_col).limit(most).withColumn("g", F.lit(0)).withColumn("age", -F.col("at"))
        m = cluster.clustered(top, "g", id_col, ["age", id_col], vec, lambda x: cluster.greedy(x, least))
        return m.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= fewest)

    def workflow_skills(self, clusters: DataFrame, id_col: str, k: int = 5) -> DataFrame:
        """(cluster, skill, n, rank): the most used skills of each cluster of trajectories (cluster, id)."""
        used = self.trajectories().select(F.col("trajectory_id").alias(id_col), F.explode("skills").alias("skill"))
        n = clusters.join(used, id_col).groupBy("cluster", "skill").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"))
        w = Window.partitionBy("cluster").orderBy(F.desc("n"), "first", "skill")
        return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("cluster", "skill", "n", "rank")

    def status(self) -> DataFrame:
        """(name, n): rows of each table, open sessions, skills by status, the last turn, stale skills."""
        s, c, k = self.sessions(), self.chunks(), self.skills()
        one = lambda df, name, n=F.count(F.lit(1)): df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("name"), "n")  # noqa: E731, B008
        parts = [one(s, "sessions"), one(s.filter("ended_at is null"), "open_sessions"), one(c, "chunks"), one(self.trajectories(), "trajectories"), one(k, "skills")]
        parts += [one(c, "last_turn", F.coalesce(F.max("turn_index"), F.lit(0))), one(k.filter(F.col("last_used_at") < self.now - 30 * 86400), "stale_skills")]
        parts += [one(k.filter(F.col("skill_status") == x), f"skills_{x}") for x in ("draft", "active", "stale", "deprecated")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # ------------------------------------------------------------- writes
    def memory_patch(self, slots: DataFrame, slot: str, action: str, content: str = "", needle: str = "", budget: int | None = None) -> DataFrame:
        """The slots (slot, text) after an edit of one of them; secrets of the content are blotted, unsafe content raises."""
        clean = text.redact_secrets(content)[0]
        new = self.spark.createDataFrame([(clean,)], "t string").select(text.threat(F.col("t")).alias("label")).first().label
        if new:
            raise ValueError(f"content rejected: {new}")
        have = slots.filter(F.col("slot") == slot).select("text").first()
        after = slot_edit(have.text if have else "", action, clean, needle, budget)
        return slots.filter(F.col("slot") != slot).unionByName(self.spark.createDataFrame([(slot, after)], "slot string, text string"))

    def record_principle(self, new: DataFrame, stored: DataFrame, least: float = 0.9) -> DataFrame:
        """(id, action, into) for new principles (id, text, embedding) against stored ones (id, embedding, pinned): merged, skipped or inserted."""
        fit = new.filter(text.threat(F.col("text")).isNull())
        near = dense.knn_topk(fit, "id", "embedding", stored, "id", "embedding", self.dims, 3)
        return upkeep.merge_or_insert(near, fit, stored, least, F.col("pinned") == 1)

    def skill_rate(self, ratings: DataFrame) -> DataFrame:
        """The skills after ratings (skill_name, ok, session_id, at): counts, last use, the sessions that rated."""
        g = ratings.groupBy("skill_name").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("ok").cast("int")).alias("_w"), F.max("at").alias("_at"), F.array_sort(F.collect_set("session_id")).alias("sessions"))
        j = self.skills().join(g, "skill_name", "left")
        return j.withColumn("use_count", F.col("use_count") + F.coalesce("_n", F.lit(0))).withColumn("success_count", F.col("success_count") + F.coalesce("_w", F.lit(0))).withColumn("last_used_at", F.greatest("last_used_at", "_at")).drop("_n", "_w", "_at")

    def propose_skill(self, proposals: DataFrame) -> DataFrame:
        """(name, body, path, refused): proposals (name, path, body) with secrets blotted, and why one is refused: its name, or unsafe content."""
        bad = ~F.col("name").rlike("^[a-z0-9][a-z0-9_-]{0,63}$")
        label = text.skill_threat(F.col("body"), F.col("path"))
        return proposals.select("name", text.redacted("body")["text"].alias("body"), "path", F.when(F.coalesce(bad, F.lit(True)), "invalid name").otherwise(label).alias("refused"))

    # ------------------------------------------------------ maintenance
    def reflect(self, notes: DataFrame, note: str, folder: str | None = None) -> DataFrame:
        """Notes fit to be kept: secrets blotted, unsafe ones dropped; appended to ``folder`` if one is named."""
        r = text.redacted(note)
        kept = notes.filter(text.threat(F.col(note)).isNull()).withColumn("_r", r).withColumn(note, F.col("_r.text")).withColumn("secrets", F.col("_r.secrets")).drop("_r")
        if folder:
            kept.write.mode("append").parquet(folder)
        return kept

    def purge(self, days: float) -> tuple[DataFrame, dict[str, DataFrame]]:
        return retention.purge(self.sessions(), {"chunks": self.chunks()}, self.now, days)
