"""Rebuilding conversations from message rows (problem 1).

Every message points to its parent, the message one turn earlier in its
session. Runs of turns within a block are contracted to one node, so only these
are left to be resolved, and every message gets what its run got. Pointer jumping resolves
all chains in log2(length) joins: each round an unfinished node adopts its
ancestor's pointer, so the distance covered doubles. Orphans (parent id without a
row) and cycles come out by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage, unstage
from .text import strip, visible

# Spellings of the four roles.
ROLES = {
    "user": "user", "human": "user",
    "assistant": "assistant", "ai": "assistant",
    "tool": "tool", "function": "tool",
    "system": "system",
}


#: Turns of a session that are contracted to one node.
BLOCK = 256


def read_role(c):
    """The role by meaning, in any case and padding; null if it can't be read."""
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.element_at(names, F.lower(strip(c)))


def resolve_parents(nodes: DataFrame, node: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """Root, depth and status of every node of a parent-pointer table.

    ``nodes`` has one row per distinct ``node`` (rows with a null node are left
    out). Result: (node, root, depth, status); status is ``ok`` when the chain
    ends at a node with null parent, ``orphan`` when it ends at a parent that
    has no row (root is then that missing id), ``cycle`` when it never ends
    (root null, depth null). An empty table gives an empty result.

    Rounds shrink: a node whose chain has ended leaves the active set and only
    serves as a signpost. A chain of n nodes takes log2(n) rounds; what is still
    open when the jumped distance exceeds the row count is on or behind a cycle.
    """
    up_type = nodes.schema[parent].dataType
    nothing = F.lit(None).cast(up_type)
    at = stage(
        nodes.filter(F.col(node).isNotNull()).select(
            F.col(node).alias("node"),
            F.coalesce(F.col(parent), F.col(node).cast(up_type)).alias("up"),
            F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("hop"),
            F.when(F.col(parent).isNull(), "ok").alias("status"),
        ),
        "hop",
    )
    total, covered = at.count(), 1
    ended, active = [at.filter("status is not null")], at.filter("status is null")
    for _ in range(max_rounds):
        if covered > total or active.isEmpty():
            break
        signs = active
        for part in ended:
            signs = signs.unionByName(part)
        signs = signs.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("hop").alias("_hop"), F.col("status").alias("_status"))
        lost = F.col("_n").isNull()
        step = stage(
            active.join(signs, active.up == signs._n, "left").select(
                "node",
                F.when(lost, F.col("up")).otherwise(F.col("_up")).alias("up"),
                F.when(lost, F.col("hop")).otherwise(F.col("hop") + F.col("_hop")).alias("hop"),
                F.when(lost, "orphan").otherwise(F.col("_status")).alias("status"),
            ),
            "hop",
        )
        ended.append(step.filter("status is not null"))
        active = step.filter("status is null")
        covered *= 2
    out = active.select("node", nothing.alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("status"))
    for part in ended:
        out = out.unionByName(part.select("node", F.col("up").alias("root"), F.col("hop").alias("depth"), "status"))
    return out


def distinct_messages(chunks: DataFrame) -> DataFrame:
    """One row per message: same session, turn, role by meaning and stripped text.

    Rows without session_id are left out. A null text counts as the empty text.
    """
    return (
        chunks.filter("session_id is not null")
        .select(
            F.col("session_id").cast("long").alias("session_id"),
            F.col("turn_index").cast("int").alias("turn_index"),
            read_role(F.col("role")).alias("role"),
            # an unreadable role is kept apart by its spelling
            F.when(read_role(F.col("role")).isNull(), F.lower(strip(F.coalesce(F.col("role"), F.lit(""))))).alias("odd_role"),
            F.coalesce(strip(F.col("content")), F.lit("")).alias("text"),
        )
        .groupBy("session_id", "turn_index", "role", "odd_role", F.xxhash64("text").alias("h1"), F.sha2("text", 256).alias("h2"))
        .agg(F.first("text").alias("text"))
        .drop("odd_role", "h1", "h2")
        .withColumn("shown", visible(F.col("text")))
    )


def resolve_turns(turns: DataFrame) -> DataFrame:
    """(session_id, turn_index, root, depth, status) of every message; its parent is the one a turn earlier, turn 1 has none.

    ``turns``: distinct (session_id, turn_index). Runs of turns within a block are
    contracted to one node, pointers are jumped over these, and what comes out is
    handed back to each message of the run: root is the turn at the end of its
    chain (the missing turn of an orphan), depth its distance from there.
    """
    turn = F.col("turn_index").cast("long")
    held = turns.select("session_id", "turn_index", turn.alias("t"), F.floor((turn - 1) / BLOCK).alias("b"))
    # turns less their rank are equal within a run; turn 1 starts one, as it has no parent
    at = F.row_number().over(Window.partitionBy("session_id", "b").orderBy("t"))
    held = stage(held.withColumn("run", F.col("t") - at), "runs")
    runs = held.groupBy("session_id", "b", "run").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    # a run is named after the turn that would follow it and points to its own first
    # turn, which is the name of the run that ends just before
    name = lambda t: F.struct(F.col("session_id").alias("s"), t.alias("t"))
    nodes = runs.select(name(F.col("hi") + 1).alias("node"), F.when(F.col("lo") != 1, name(F.col("lo"))).alias("parent"))
    ends = resolve_parents(nodes, "node", "parent").select(F.col("node.s").alias("session_id"), (F.col("node.t") - 1).alias("hi"), F.col("root.t").alias("end"), "status")
    ends = runs.join(ends, ["session_id", "hi"]).select("session_id", "b", "run", "end", "status")
    # the end of a chain is a run of turn 1, or the first turn of a run whose parent is missing
    root = F.when(F.col("status") == "ok", F.lit(1).cast("long")).otherwise(F.col("end") - 1)
    return held.join(ends, ["session_id", "b", "run"]).select("session_id", "turn_index", root.alias("root"), (F.col("t") - root).alias("depth"), "status")


def session_verdicts(chunks: DataFrame) -> DataFrame:
    """(session_id, n_messages, reason): reason is null for a whole conversation.

    ``empty``: no user or assistant message has visible text. ``broken``: a
    message without turn_index or readable role, two messages at one turn, or a
    message whose chain of parents does not reach the message of turn 1 (orphan). ``missing_reply``: the last user
    or assistant message is the user's, or an assistant message is blank. The
    first that holds counts. A session without rows has no row.
    """
    slim = (
        chunks.filter("session_id is not null")
        .select(
            F.col("session_id").cast("long").alias("session_id"),
            F.col("turn_index").cast("int").alias("turn_index"),
            read_role(F.col("role")).alias("role"),
            F.when(read_role(F.col("role")).isNull(), F.lower(strip(F.coalesce(F.col("role"), F.lit(""))))).alias("odd_role"),
            F.coalesce(strip(F.col("content")), F.lit("")).alias("_t"),
        )
        .withColumn("shown", visible(F.col("_t")))
        .select("session_id", "turn_index", "role", "odd_role", "shown", F.xxhash64("_t").alias("h1"), F.hash("_t").alias("h2"))
        .distinct()
    )
    slim = stage(slim, "messages")
    # one node per (session, turn); several messages at one turn are counted
    turns = slim.groupBy("session_id", "turn_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("role").isNull()).alias("unread"),
        F.max(F.col("role").isin("user", "assistant") & F.col("shown")).alias("speaks"),
        F.max(F.col("role") == "user").alias("user"),
        F.max(F.col("role") == "assistant").alias("assistant"),
        F.max((F.col("role") == "assistant") & ~F.col("shown")).alias("blank_reply"),
    )
    turns = stage(turns, "turns")
    unstage(slim)
    chains = resolve_turns(turns.filter("turn_index is not null").select("session_id", "turn_index"))
    whole = chains.groupBy("session_id").agg(F.max(F.col("status") != "ok").alias("torn"))
    talk = F.coalesce(F.col("user"), F.lit(False)) | F.coalesce(F.col("assistant"), F.lit(False))
    per = turns.groupBy("session_id").agg(
        F.sum("n").alias("n_messages"),
        F.max(F.coalesce("speaks", F.lit(False))).alias("speaks"),
        F.max(F.col("turn_index").isNull() | F.col("unread") | (F.col("n") > 1)).alias("unfit"),
        F.max(F.coalesce("blank_reply", F.lit(False))).alias("blank_reply"),
        F.max_by(F.col("assistant"), F.when(talk, F.col("turn_index"))).alias("last_reply"),
    )
    reason = (
        F.when(~F.col("speaks"), "empty")
        .when(F.col("unfit") | F.coalesce("torn", F.lit(True)), "broken")
        .when(F.col("blank_reply") | ~F.coalesce("last_reply", F.lit(False)), "missing_reply")
    )
    return per.join(whole, "session_id", "left").select("session_id", "n_messages", reason.alias("reason"))


def conversation_turns(chunks: DataFrame) -> DataFrame:
    """(session_id, turn, role, text) of whole conversations, one row per turn.

    The root-to-leaf path of a session is its rows by ``turn``. Sessions with a
    reason to be dropped (see ``session_verdicts``) have no rows. One row per
    turn, not one array per session: a session may hold a tenth of all messages.
    """
    keep = session_verdicts(chunks).filter("reason is null").select("session_id")
    return (
        distinct_messages(chunks).join(keep, "session_id", "left_semi")
        .select("session_id", F.col("turn_index").alias("turn"), "role", "text")
    )
