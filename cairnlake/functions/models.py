"""Interfaces to models, with offline stand-ins: nothing here needs a network."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dims: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Judge(Protocol):
    def answer(self, prompt: str) -> str: ...


class HashEmbedder:
    """Deterministic unit vectors: the text's digest seeds a normal draw; equal texts only are alike."""

    def __init__(self, dims: int = 128):
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).normal(size=self.dims)
            out[i] = v / np.linalg.norm(v)
        return out


class EmbedderChain:
    """Embedders in order of preference: the first that answers with vectors of the right width is taken.

    One that failed is passed over for ``rest`` seconds; if all fail, the last
    error is raised. Vectors are cut to ``dims`` and scaled to length one.
    """

    def __init__(self, embedders: Sequence[Embedder], dims: int, rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.embedders, self.dims, self.rest, self.clock = list(embedders), dims, rest, clock
        self.failed: dict[int, float] = {}

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        error: Exception = ValueError("no embedder is left")
        for i, e in enumerate(self.embedders):
            if i in self.failed and self.clock() - self.failed[i] < self.rest:
                continue
            try:
                x = np.asarray(e.embed(texts), np.float32)
                if x.ndim != 2 or len(x) != len(texts) or x.shape[1] < self.dims:
                    raise ValueError(f"vectors of shape {x.shape}")
            except Exception as now:  # noqa: BLE001 - whatever a source raises, the next one is asked
                error = now
                self.failed[i] = self.clock()
                continue
            self.failed.pop(i, None)
            x = x[:, : self.dims]
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        raise error


class FixedJudge:
    """Answers by the first pattern that the prompt matches."""

    def __init__(self, rules: Sequence[tuple[str, str]], default: str = ""):
        self.rules, self.default = [(re.compile(p, re.I | re.S), a) for p, a in rules], default

    def answer(self, prompt: str) -> str:
        return next((a for p, a in self.rules if p.search(prompt)), self.default)


def embedded(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """With a vector of each text; every distinct text is embedded once. Null and empty texts have none."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([v.tolist() for v in embedder.embed(t.tolist())])

    texts = df.filter(F.col(text) != "").select(F.col(text).alias("_t")).distinct().withColumn(out, run("_t"))
    return df.join(texts, df[text] == F.col("_t"), "left").drop("_t")


def parse_indexes(reply: str, n: int) -> list[int]:
    """Distinct list indexes 1..n named in a reply; ``none`` and an empty reply name none."""
    return [] if re.match(r"\s*(?:none|\[\s*\])\s*$", reply, re.I) else sorted({int(x) for x in re.findall(r"\d+", reply) if 1 <= int(x) <= n})


def parse_fenced(reply: str) -> str:
    """The first fenced block of a reply, else the reply without white space around it."""
    m = re.search(r"```[^\n]*\n(.*?)```", reply, re.S)
    return (m[1] if m else reply).strip()


def parse_json_object(reply: str) -> dict:
    """The outermost JSON object of a reply; {} if there is none that can be read."""
    a, b = reply.find("{"), reply.rfind("}")
    try:
        got = json.loads(reply[a : b + 1]) if 0 <= a < b else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def parse_sections(reply: str, names: Sequence[str]) -> dict[str, str]:
    """Texts after ``NAME:`` marks at line starts, up to the next mark; marks that are missing have ''."""
    mark = re.compile(rf"^\s*({'|'.join(map(re.escape, names))})\s*:[ \t]*", re.I | re.M)
    spots = list(mark.finditer(reply))
    out = dict.fromkeys(names, "")
    for m, nxt in zip(spots, [*spots[1:], None], strict=True):
        name = next(n for n in names if n.lower() == m[1].lower())
        out[name] = reply[m.end() : nxt.start() if nxt else len(reply)].strip()
    return out


def parse_yes_count(reply: str) -> tuple[int, int]:
    """(yes, answered): lines or words of a reply that say Y or N."""
    votes = re.findall(r"\b(y(?:es)?|n(?:o)?)\b", reply, re.I)
    return sum(v[0] in "yY" for v in votes), len(votes)


def parse_verdict(reply: str, words: Sequence[str] = ("BETTER", "SAME", "WORSE"), default: str = "SAME") -> str:
    """The first of the verdict words in a reply, in any case."""
    m = re.search(rf"\b({'|'.join(map(re.escape, words))})\b", reply, re.I)
    return m[1].upper() if m else default


def parse_operations(reply: str, most: int = 8) -> list[dict]:
    """The first ``most`` operations (add, update, prune) of a JSON list in a reply; what is no operation is left out."""
    a, b = reply.find("["), reply.rfind("]")
    try:
        got = json.loads(reply[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        return []
    named = [o for o in got if isinstance(o, dict) and o.get("op") in ("add", "update", "prune") and (o["op"] == "add" or isinstance(o.get("id"), int))]
    return named[:most]


def first_line(reply: str, most: int = 240) -> str:
    """The first line of a reply that is not blank, cut to ``most`` signs."""
    return next((x.strip()[:most] for x in reply.splitlines() if x.strip()), "")


def body_is_enough(body: str, least: int = 80) -> bool:
    """Whether a reconstructed skill has a body worth keeping."""
    return len(body.strip()) >= least


def better_variant(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether variant ``a`` (improvements, tokens) beats ``b``: more improvements, or as many with fewer tokens."""
    return (a[0], -a[1]) > (b[0], -b[1])


def corpus(seed: int, facts: int, sessions: int, superseded: float = 0.2, filler: int = 3) -> tuple[list[tuple], list[tuple]]:
    """(chunks, questions) of a generated memory: (chunk_id, session_id, turn_index, role, content) and
    (query_id, text, gold chunk_id, newest value). A superseded fact gets a later version with another value."""
    rng = np.random.default_rng(seed)
    things = ["editor", "timezone", "city", "database", "shell", "project", "diet", "printer"]
    said: list[tuple[int, str, int | None]] = []
    value: dict[int, str] = {}
    for f in range(facts):
        versions = 2 if rng.random() < superseded else 1
        for v in range(versions):
            value[f] = f"value{f}v{v}x{rng.integers(1000)}"
            at = int(sessions * (v + rng.random()) / versions)
            said.append((min(at, sessions - 1), f"My {things[f % len(things)]} number {f} is {value[f]}.", f))
    said += [(s, f"Filler {s}-{i}: nothing to keep here.", None) for s in range(sessions) for i in range(filler)]
    chunks, newest, turns = [], {}, {}
    for n, (s, text, f) in enumerate(sorted(said, key=lambda x: x[0]), 1):
        turns[s] = turns.get(s, 0) + 1
        chunks.append((n, s, turns[s], "user", text))
        if f is not None:
            newest[f] = n
    return chunks, [(f, f"What is my {things[f % len(things)]} number {f}?", newest[f], value[f]) for f in range(facts)]
