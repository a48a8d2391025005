"""Exactly-once ingest of overlapping message windows, and event-time sessions.

A client hands over its last messages again and again. Each key keeps the
fingerprints of what is archived; a window's overlap with them is the longest
stretch from the window's first message on that reaches the end of the archive
or of the window, and only what lies past it is new. No overlap with something
archived begins a new session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact_secrets

#: Fingerprints kept per key.
REMEMBERED = 512
ARCHIVED = ("user", "assistant", "tool")


def fingerprint(role: str, text: str) -> str:
    return hashlib.blake2b(f"{role}\0{text}".encode(), digest_size=16).hexdigest()


def overlap(archive: list[str], window: list[str]) -> int:
    """How many of the window's first messages are archived already.

    All, if the window stands anywhere in the archive; else the longest beginning
    of the window that ends the archive. Found by the window's borders, in one pass.
    """
    if not window:
        return 0
    borders, k = [0] * len(window), 0
    for i in range(1, len(window)):
        while k and window[i] != window[k]:
            k = borders[k - 1]
        k += window[i] == window[k]
        borders[i] = k
    held = 0
    for mark in archive:
        while held and window[held] != mark:
            held = borders[held - 1]
        held += window[held] == mark
        if held == len(window):
            break
    return held


class Conversation:
    """State of one key: marks of archived messages, session number, next turn.

    Secrets are blotted before a message goes out; its mark is that of the text as
    it came, so that the same message is known again.
    """

    def __init__(self, marks: list[str] | None = None, session: int = 0, turn: int = 0):
        self.marks, self.session, self.turn = marks or [], session, turn

    def take(self, messages: list[tuple[str, str]]) -> Iterator[tuple[int, int, str, str]]:
        """(session, turn, role, text) of the window's new messages."""
        kept = [(r, t.strip()) for r, t in messages if r in ARCHIVED and t and t.strip()]
        window = [fingerprint(r, t) for r, t in kept]
        old = overlap(self.marks, window)
        if window and not old:
            self.session, self.turn, self.marks = self.session + 1, 0, []
        for r, t in kept[old:]:
            self.turn += 1
            yield self.session, self.turn, r, redact_secrets(t)[0]
        self.marks = (self.marks + window[old:])[-max(REMEMBERED, 2 * len(window)) :]


OUT = "session_key string, session_no long, turn_index long, role string, content string"
STATE = "marks array<string>, session long, turn long"


def archive_windows(windows: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """New messages of a stream of (session_key, window_no, messages array<struct<role,content>>).

    Keyless conversations share the empty key. With ``idle_minutes`` a key that
    long without data (processing time) starts a new session when it comes back;
    such a query has to run continuously, since a timeout keeps a run-once
    trigger waiting.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update(([], int(state.get[1]), 0))
            return
        c = Conversation(list(state.get[0]), int(state.get[1]), int(state.get[2])) if state.exists else Conversation()
        rows = []
        for f in frames:
            for _, row in f.sort_values("window_no").iterrows():
                for session, turn, role, text in c.take([(m["role"], m["content"]) for m in row["messages"]]):
                    rows.append((key[0], session, turn, role, text))
        state.update((c.marks, c.session, c.turn))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame(rows, columns=["session_key", "session_no", "turn_index", "role", "content"])

    keyed = windows.select(F.coalesce("session_key", F.lit("")).alias("session_key"), "window_no", "messages")
    return keyed.groupBy("session_key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)


def archive_batch(windows: DataFrame) -> DataFrame:
    """As ``archive_windows``, over a table of windows, for replays and tests.

    A key's windows are read in order from a sort that spills, a batch at a time;
    what a task holds is the state of one key, however many windows it has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, c = None, Conversation()
        for f in frames:
            rows = []
            for own, messages in zip(f["session_key"], f["messages"], strict=True):
                if own != key:
                    key, c = own, Conversation()
                rows += [(key, *x) for x in c.take([(m["role"], m["content"]) for m in messages])]
            yield pd.DataFrame(rows, columns=["session_key", "session_no", "turn_index", "role", "content"])

    keyed = windows.select(F.coalesce("session_key", F.lit("")).alias("session_key"), "window_no", "messages")
    return keyed.repartition("session_key").sortWithinPartitions("session_key", "window_no").mapInPandas(run, OUT)


def session_counts(events: DataFrame, key: str, at: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(key, start, stop, n): event-time sessions of a stream or table, late rows dropped past the watermark."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = e.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_deliveries(events: DataFrame, id_col: str, at: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream without repeated deliveries within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def adopt_pending(messages: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(key, first, last, n): runs of messages that were stored raw, each adopted by the next replayed message of its key.

    ``messages``: key, order columns, role, text, live (seen in its raw form only).
    A live message is skipped by its role when the history is replayed; it counts
    as archived with the replayed message that follows it. A run at the end of a
    key is still pending: it has no ``last``. Each key is read in order from a
    sort that spills; a task holds one run.
    """
    kind = dict(messages.dtypes)[key]
    order = by[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, start, n = None, None, 0
        for f in frames:
            rows = []
            for k, at, live, role in zip(f[key], f[order], f["live"], f["role"], strict=True):
                if k != own:
                    if n:
                        rows.append((own, start, None, n))
                    own, start, n = k, None, 0
                if role not in ARCHIVED:
                    continue
                if live:
                    start, n = (at if not n else start), n + 1
                elif n:
                    rows.append((own, start, at, n))
                    start, n = None, 0
            yield pd.DataFrame(rows, columns=[key, "first", "last", "n"]).astype({"last": "Int64"})
        if n:
            yield pd.DataFrame([(own, start, None, n)], columns=[key, "first", "last", "n"]).astype({"last": "Int64"})

    return messages.repartition(key).sortWithinPartitions(key, *by).select(key, order, "live", "role").mapInPandas(run, f"{key} {kind}, first long, last long, n long")
