"""Sinks: versioned snapshots, append-only logs, JSON lines."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotTable:
    """A table of immutable versions with a pointer file.

    ``write`` makes a new version and moves the pointer in one rename, so a
    reader sees the old rows or the new ones; ``rollback`` moves it back. The
    newest ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._options = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def versions(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n[len("version=") :] for n in names if n.startswith("version="))

    def current(self) -> str | None:
        pointer = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        return self.spark.read.text(f"{self.folder}/CURRENT").first()[0]

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise ValueError(f"{self.folder} has no version yet")
        return self.spark.read.parquet(f"{self.folder}/version={version}")

    def write(self, df: DataFrame) -> str:
        version = f"{time.time_ns():020d}"
        df.write.parquet(f"{self.folder}/version={version}")
        self._point(version)
        for old in self.versions()[: -self.keep]:
            if old != version:
                self._fs.delete(self._path(f"{self.folder}/version={old}"), True)
        return version

    def rollback(self) -> str:
        """To the version before the current one."""
        older = [v for v in self.versions() if v < (self.current() or "")]
        if not older:
            raise ValueError("there is no older version")
        self._point(older[-1])
        return older[-1]

    def _point(self, version: str) -> None:
        new = self._path(f"{self.folder}/.CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(version.encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        how = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._overwrite
        self._options.rename(new, self._path(f"{self.folder}/CURRENT"), how)


def append_batch(folder: str):
    """A foreachBatch function that appends exactly once: a batch is a folder of its own, written anew on retry."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def append_vectors(folder: str, text: str, embedder):
    """A foreachBatch function that embeds a batch's texts and appends the vectors; exactly once, as ``append_batch``."""
    from ..functions.models import embedded

    write = append_batch(folder)
    return lambda df, batch: write(embedded(df, text, embedder).drop(text), batch)


def write_result(df: DataFrame, path: str) -> None:
    """A small result (scores of an evaluation) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_json_lines(df: DataFrame, folder: str, by: str) -> None:
    """JSON lines, one folder per value of ``by``; a value's rows may be in several files."""
    df.write.mode("overwrite").partitionBy(by).json(folder)


def transcript_tails(chunks: DataFrame, most: int = 3000) -> DataFrame:
    """(session_id, tail): the last ``most`` signs of each session's transcript.

    Only the messages that reach into the tail are gathered, at most ``most``.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc_nulls_last(), F.desc("chunk_id"))
    line = F.concat_ws(": ", F.coalesce("role", F.lit("?")), F.coalesce("content", F.lit("")))
    c = chunks.filter("session_id is not null").withColumn("_line", line)
    before = F.coalesce(F.sum(F.char_length("_line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = c.withColumn("_before", before).filter(F.col("_before") < most)
    near = near.withColumn("_line", F.expr(f"right(_line, {most})"))
    g = near.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("_before")).alias("k"), "chunk_id", "_line"))).alias("m"))
    return g.select("session_id", F.expr(f"right(array_join(transform(m, x -> x._line), '\\n'), {most})").alias("tail"))


def local_bytes(path: str) -> int:
    """Size of a local table, for reports."""
    return sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(path) for f in fs)
