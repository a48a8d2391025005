"""Searches that ask as many queries as there are documents: stored blocks, read by tasks that each hold a share of the queries.

A table is written once, in blocks; a task takes its queries, reads block after
block and keeps the best k of each. So neither hits nor scores are shuffled, and
disk grows as the table. All results are exact: what is passed over has a bound
below the k-th best found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms, word_set
from ..functions.vectors import usable
from ..runtime import stage, unstage
from .lexical import K1, LEAST_IDF, B, asked_units

#: Characters of a task that stores texts; documents and tokens from which it begins another block; documents added to one at once; queries of a task.
CHARS, DOCS, TOKENS, PIECE, QUERIES = 24_000_000, 120_000, 2_000_000, 500, 8192
#: Vectors of a stored block; products held at once.
VECTORS, PRODUCTS = 16_384, 6_000_000
#: Members of a block whose tags are held as bits.
MEMBERS = 65_536
#: Cosines in half the precision are off by less than this, rounding to six digits included.
NEAR = 3e-5
#: Scores are rounded to six digits, so what could reach the k-th best is looked at from this much below it.
SLACK = 1.1e-6
#: A list of less than this share of what is added up is added too: that is cheaper than looking up in it.
SHORT = 0.7
#: Places of phrases that a task keeps for its second reading.
KEPT = 2_000_000


def _shares(queries: DataFrame, most: int | None = None) -> int:
    """Over how many tasks the queries are spread."""
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // (most or QUERIES)), min(cores, -(-n // 256)))


def _packed(**columns) -> bytes:
    """Arrays of any lengths as one compressed buffer."""
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in columns.values()]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(arrays, names=list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocks(folder: str) -> Iterator[dict[str, pa.Array]]:
    """The arrays of each block of a stored table."""
    store, root = fs.FileSystem.from_uri(folder)
    for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        file = pq.ParquetFile(store.open_input_file(path))
        for batch in file.iter_batches(batch_size=1, columns=["data"]):
            with pa.ipc.open_stream(batch.column(0)[0].as_buffer()) as stream:
                block = stream.read_next_batch()
            got = {name: block.column(name).values for name in block.schema.names}
            del batch, block
            yield got
            got.clear()  # one block at a time
            pa.default_memory_pool().release_unused()


def token_blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(docs, tokens, data), staged: the tokens of each block of documents in order, and their places by term; rows that repeat an id count once.

    Documents of like length share a block, so that a block's bounds are narrow.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.coalesce(F.char_length(text), F.lit(0)).alias("chars"))
    blocks = max(1, -(-(rows.agg(F.sum("chars")).first()[0] or 0) // CHARS))

    def block(held: list[tuple]) -> pa.RecordBatch:
        ids, size = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        coded = pa.concat_arrays([h[2].dictionary for h in held]).dictionary_encode()
        term, ends = coded.dictionary, np.cumsum([len(h[2].dictionary) for h in held])
        stream = np.concatenate([coded.indices.to_numpy()[e - len(h[2].dictionary) : e][h[2].indices.to_numpy()] for e, h in zip(ends.tolist(), held, strict=True)])
        data = _packed(id=ids, size=size.astype(np.int32), stream=stream, term=term, n=np.bincount(stream, minlength=len(term)).astype(np.int32), place=np.argsort(stream, kind="stable").astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([len(stream)], pa.int64()), pa.array([data], pa.binary())], names=["docs", "tokens", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_tokens, last = [], 0, 0, None
        for batch in (b.slice(low, PIECE) for b in batches for low in range(0, b.num_rows, PIECE)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            new = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])  # deliveries of a document stand side by side
            last = ids[-1]
            lists = batch.column(1) if new.all() else batch.column(1).filter(pa.array(new))
            held.append((ids[new], lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()))
            n_docs, n_tokens = n_docs + len(lists), n_tokens + len(held[-1][2])
            if n_docs >= DOCS or n_tokens >= TOKENS:
                yield block(held)
                held, n_docs, n_tokens = [], 0, 0
        if n_docs:
            yield block(held)

    spread = rows.repartitionByRange(blocks, "chars", "doc").sortWithinPartitions("chars", "doc").select("doc", terms(F.col("text")).alias("t"))
    return stage(spread.mapInArrow(run, "docs long, tokens long, data binary"), "tokens")


class _Postings:
    """Where the terms stand in a block."""

    def __init__(self, block: dict[str, pa.Array]):
        self.term = block["term"]
        self.size = block["size"].to_numpy().astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.stream, self.place = block["stream"].to_numpy(), block["place"].to_numpy()
        self.past_place = np.cumsum(block["n"].to_numpy().astype(np.int64))
        doc = self.owner[self.place]
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        new[self.past_place[:-1]] = True
        first = np.flatnonzero(new)
        self.doc, self.tf = doc[first].astype(np.int64), np.diff(first, append=len(doc)).astype(np.int32)
        self.past, self.norm = np.searchsorted(first, self.past_place), None

    def codes(self, words: pa.Array) -> np.ndarray:
        """The block's number of each term, -1 for those it lacks."""
        return pc.fill_null(pc.index_in(words, self.term), -1).to_numpy()

    def span(self, code: int, past: np.ndarray) -> tuple[int, int]:
        return (int(past[code - 1]) if code else 0), int(past[code])

    def weighed(self, mean: float, docs: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a term adds to a document's score, without the term's rarity."""
        if self.norm is None:
            self.norm = K1 * (1 - B + B * self.size / mean)
        out = self.norm[docs]
        out += tf
        np.divide(tf * (K1 + 1), out, out=out)
        return out

    def phrase(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, how often the terms stand side by side in each)."""
        spans = [self.span(c, self.past_place) for c in codes.tolist()]
        rare = min(range(len(codes)), key=lambda i: spans[i][1] - spans[i][0])
        at = self.place[slice(*spans[rare])] - rare
        at = at[(at >= 0) & (at + len(codes) <= len(self.stream))]
        for i, c in enumerate(codes.tolist()):
            if i != rare:
                at = at[self.stream[at + i] == c]
        owner = self.owner[at]
        owner = owner[owner == self.owner[at + len(codes) - 1]]
        return np.unique(owner, return_counts=True)


class _Best:
    """The best k (id, score) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.need = k, np.full(n, -np.inf)
        self.ids, self.scores = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # all that reach the k-th best, ties included
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[keep], scores[keep]
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.need[q] = self.scores[q][-1]

    def rows(self, names: np.ndarray, value: str, id_name: str) -> pa.RecordBatch:
        n = [len(i) for i in self.ids]
        columns = [np.repeat(names, n), np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0)]), np.concatenate([*(np.arange(1, x + 1) for x in n), np.zeros(0, int)]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", id_name, value, "rank"])


def _least(acc: np.ndarray, k: int) -> float:
    """A bound that at least ``k`` of the scores reach: the k-th best of the best of each run of them."""
    runs = max(1, len(acc) // 64)
    if runs < 2 * k:
        return -np.inf
    tops = acc[: runs * 64].reshape(runs, 64).max(axis=1)
    bound = np.partition(tops, runs - k)[runs - k]
    return float(bound) if bound > 0 else -np.inf


def _search(best: _Best, asked: list, lists: list, ids: np.ndarray) -> None:
    """Adds a block's documents to the best of each query.

    Lists are added up, the weightiest first, until the rest of them can't lift
    a document to the k-th best, and on while they are short; documents that may
    still reach it are looked up in the rest (MaxScore).
    """
    acc = np.zeros(len(ids))
    for q, units in enumerate(asked):
        parts = sorted(((times * lists[u][2], times, lists[u][0], lists[u][1]) for u, times in units if lists[u] is not None), key=lambda p: -p[0])
        rest = [0.0]
        for p in reversed(parts):
            rest.append(rest[-1] + p[0])
        rest.reverse()
        need = best.need[q] - SLACK
        if not parts or rest[0] < need:
            continue
        i = done = 0
        while i < len(parts) and (rest[i] >= need or len(parts[i][2]) < SHORT * done):
            done += len(parts[i][2])
            _, times, docs, weight = parts[i]
            acc[docs] += weight if times == 1 else times * weight
            i += 1
        if need == -np.inf:
            need = _least(acc, best.k) - SLACK
        found = np.flatnonzero(acc >= max(need - rest[i], 1e-300))
        score = acc[found]
        acc.fill(0)
        for j in range(i, len(parts)):
            if not len(found):
                break
            _, times, docs, weight = parts[j]
            at = np.searchsorted(docs, found)
            at[at == len(docs)] = 0
            hit = docs[at] == found
            score[hit] += times * weight[at[hit]]
            keep = score >= need - rest[j + 1]
            found, score = found[keep], score[keep]
        if len(found):
            best.add(q, ids[found], np.round(score, 6))


def bm25_topk(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int) -> DataFrame:
    """(query, doc, score, rank): as ``lexical.bm25_topk``, for as many queries as there are documents."""
    asked = asked_units(queries, query_id, query).select(F.col("query").cast("long").alias("query"), "terms", F.col("times").cast("int").alias("times"))
    stored = token_blocks(docs, doc_id, text)
    n_docs, n_tokens = stored.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    mean, folder = max(1, n_tokens) / max(1, n_docs), stored._staged_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        names, at = np.unique(table.column("query").to_numpy(), return_inverse=True)
        number: dict[tuple, int] = {}
        unit = [number.setdefault(tuple(t), len(number)) for t in table.column("terms").to_pylist()]
        units = list(number)
        words = {w: i for i, w in enumerate(dict.fromkeys(w for u in units for w in u))}
        coded, flat = [np.array([words[w] for w in u], np.int64) for u in units], pa.array(list(words), pa.string())
        kept: list[dict[int, tuple]] = []
        df, room = np.zeros(len(units), np.int64), KEPT
        for block in _blocks(folder):
            post, of = _Postings(block), {}
            codes = post.codes(flat)
            for u, c in enumerate(coded):
                own = codes[c]
                if own.min() < 0:
                    continue
                if len(own) == 1:
                    low, high = post.span(int(own[0]), post.past)
                    df[u] += high - low
                else:
                    hits = post.phrase(own)
                    df[u] += len(hits[0])
                    if room > 0:
                        of[u], room = hits, room - len(hits[0])
            kept.append(of)
            del post
        idf = np.log((n_docs - df + 0.5) / (df + 0.5))
        idf = np.where(idf <= 0, LEAST_IDF, idf)
        asks: list[list] = [[] for _ in names]
        for q, u, times in zip(at.tolist(), unit, table.column("times").to_pylist(), strict=True):
            asks[q].append((u, times))
        best = _Best(len(names), k)
        for b, block in enumerate(_blocks(folder)):
            post, lists, w = _Postings(block), [None] * len(units), None
            codes, weight = post.codes(flat), post.weighed(mean, post.doc, post.tf)
            for u, c in enumerate(coded):
                own = codes[c]
                if own.min() < 0 or not df[u]:
                    continue
                if len(own) == 1:
                    low, high = post.span(int(own[0]), post.past)
                    lists[u] = (post.doc[low:high], w := idf[u] * weight[low:high], float(w.max()))
                else:
                    d, tf = kept[b][u] if u in kept[b] else post.phrase(own)
                    if len(d):
                        lists[u] = (d, w := idf[u] * post.weighed(mean, d, tf), float(w.max()))
            weight = None
            _search(best, asks, lists, block["id"].to_numpy())
            del post, lists, w
        yield best.rows(names, "score", "doc")

    spread = asked.repartition(_shares(queries), "query")
    out = stage(spread.mapInArrow(run, "query long, doc long, score double, rank int"), "words")
    unstage(stored)
    return out


def vector_blocks(vectors: DataFrame, vec_id: str, vec: str, dims: int) -> DataFrame:
    """(data), staged: the usable vectors as they lie, in blocks; a repeated id may stand in several."""
    rows = vectors.filter(usable(F.col(vec), dims) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([_packed(id=pa.concat_arrays([b.column(0) for b in held]), v=pa.concat_arrays([b.column(1).flatten() for b in held]))], pa.binary())], names=["data"])
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= VECTORS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return stage(rows.mapInArrow(run, "data binary"), "vectors")


class _Nearest:
    """The best k (id, cosine) of all queries so far, as matrices; free places have no score."""

    def __init__(self, n: int, k: int):
        self.ids, self.scores = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        met, k = np.unique(q), self.ids.shape[1]
        q, ids, scores = (np.concatenate(x) for x in ((q, np.repeat(met, k)), (ids, self.ids[met].ravel()), (scores, self.scores[met].ravel())))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        keep = np.isfinite(scores)
        keep[1:] &= (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, scores = q[keep], ids[keep], scores[keep]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        self.ids[q[keep], place[keep]], self.scores[q[keep], place[keep]] = ids[keep], scores[keep]


def knn_topk(queries: DataFrame, query_id: str, asked_id: str, vectors: DataFrame, vec_id: str, vec: str, dims: int, k: int) -> DataFrame:
    """(query, id, cosine, rank): as ``dense.knn_topk``, for as many queries as there are vectors; a query's vector is that of ``asked_id`` among the vectors.

    Products are of half the precision first; what comes near the k-th best is computed anew.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("query"), F.col(asked_id).cast("long").alias("asked")).dropna()
    stored = vector_blocks(vectors, vec_id, vec, dims)
    folder = stored._staged_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        names, first = np.unique(table.column("query").to_numpy(), return_index=True)
        wanted = table.column("asked").to_numpy()[first]
        m, there = np.zeros((len(names), dims)), np.zeros(len(names), bool)
        for block in _blocks(folder):
            ids, v = block["id"].to_numpy(), block["v"].to_numpy().reshape(-1, dims)
            order = np.argsort(ids)
            at = order[np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)]
            hit = ids[at] == wanted
            m[hit], there[hit] = v[at[hit]], True
        names, m = names[there], m[there]
        m /= np.linalg.norm(m, axis=1)[:, None]
        half, best = m.astype(np.float32), _Nearest(len(names), k)
        for block in _blocks(folder):
            ids, first = np.unique(block["id"].to_numpy(), return_index=True)
            v = block["v"].to_numpy().reshape(-1, dims)[first].astype(np.float64)
            v /= np.linalg.norm(v, axis=1)[:, None]
            other = v.astype(np.float32).T
            step = max(1, PRODUCTS // len(ids))
            for low in range(0, len(names), step):
                s = half[low : low + step] @ other
                need = best.scores[low : low + step, -1].copy()
                new = np.flatnonzero(need == -np.inf)
                runs = len(ids) // 64
                if len(new) and runs >= 2 * k:  # the k-th best of the best of each run is reached by k at least
                    need[new] = np.partition(s[new, : runs * 64].reshape(len(new), runs, 64).max(axis=2), runs - k, axis=1)[:, runs - k]
                at = np.flatnonzero(s >= (need - NEAR).astype(np.float32)[:, None])
                q, j = at // len(ids), at % len(ids)
                for part in range(0, len(q), 100_000):  # a query's places may be cut between parts
                    a, b = low + q[part : part + 100_000], j[part : part + 100_000]
                    best.add(a, ids[b], np.round(np.einsum("ij,ij->i", m[a], v[b]), 6))
        n = np.isfinite(best.scores).sum(axis=1)
        full = np.isfinite(best.scores).ravel()
        rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))[full]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(best.ids.ravel()[full]), pa.array(best.scores.ravel()[full]), pa.array(rank)], names=["query", "id", "cosine", "rank"])

    out = stage(asked.repartition(_shares(asked), "query").mapInArrow(run, "query long, id long, cosine double, rank int"), "near")
    unstage(stored)
    return out


def word_blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(data), staged: the word sets of documents as they lie, in blocks; a repeated id may stand in several."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), word_set(F.col(text)).alias("words")).filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = batch.column(1).flatten().dictionary_encode()
                data = _packed(id=batch.column(0), size=batch.column(1).value_lengths(), word=coded.indices, term=coded.dictionary)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return stage(rows.mapInArrow(run, "data binary"), "sets")


def _diverse(score: np.ndarray, sets: list[np.ndarray], balance: float, k: int) -> list[int]:
    """The greedy choice of ``fusion.mmr`` over hits in order of score, then id."""
    size = np.array([len(w) for w in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), len(words)), np.float32)
    has[np.repeat(np.arange(len(sets)), size), at] = 1
    both = np.rint((has @ has.T).astype(np.float64))
    either = size[:, None] + size[None, :] - both
    like = np.where(either > 0, both / np.maximum(either, 1), 1.0)
    rel = score / score[0] if score[0] > 0 else score * 0
    nearest, left, picked = np.zeros(len(sets)), np.ones(len(sets), bool), []
    while len(picked) < min(k, len(sets)):
        worth = np.where(left, np.round(balance * rel - (1 - balance) * nearest, 12), -np.inf)
        best = int(np.argmax(worth if picked and balance < 1 else left))
        picked.append(best)
        left[best] = False
        nearest = np.maximum(nearest, like[best])
    return picked


def mmr(hits: DataFrame, docs: DataFrame, doc_id: str, text: str, balance: float, k: int) -> DataFrame:
    """(query, id, pick): as ``fusion.mmr``, for hits (query, id, score) of very many queries, whose texts are those of ``docs``; no text is shuffled.

    Hits without a document are left out.
    """
    stored = word_blocks(docs, doc_id, text)
    asked = hits.select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"))
    folder = stored._staged_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        q, ids, score = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        wanted = np.unique(ids)
        sets: list[np.ndarray | None] = [None] * len(wanted)
        number: dict[str, int] = {}
        for block in _blocks(folder):
            own, size, word = (block[c].to_numpy() for c in ("id", "size", "word"))
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            rows = np.flatnonzero(wanted[at] == own)
            past = np.cumsum(size)
            lists = [word[past[r] - size[r] : past[r]] for r in rows.tolist()]
            used = np.unique(np.concatenate([*lists, np.zeros(0, np.int32)]))
            of = np.zeros(len(block["term"]), np.int32)
            of[used] = [number.setdefault(w, len(number)) for w in block["term"].take(pa.array(used)).to_pylist()]
            for r, w in zip(rows.tolist(), lists, strict=True):
                sets[at[r]] = of[w]
        at = np.searchsorted(wanted, ids)
        there = np.array([s is not None for s in sets])[at]
        q, ids, score, at = q[there], ids[there], score[there], at[there]
        order = np.lexsort((ids, -score, q))
        q, ids, score, at = q[order], ids[order], score[order], at[order]
        ends = np.append(np.flatnonzero(q[1:] != q[:-1]) + 1, len(q)) if len(q) else []
        out, low = [], 0
        for high in ends:
            out.append(low + np.array(_diverse(score[low:high], [sets[i] for i in at[low:high].tolist()], balance, k)))
            low = high
        flat = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
        pick = np.concatenate([*(np.arange(1, len(o) + 1, dtype=np.int32) for o in out), np.zeros(0, np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(q[flat]), pa.array(ids[flat]), pa.array(pick)], names=["query", "id", "pick"])

    out = stage(asked.repartition(_shares(asked.select("query").distinct(), QUERIES // 2), "query").mapInArrow(run, "query long, id long, pick int"), "picked")
    unstage(stored)
    return out


def union_sizes(sets: DataFrame, tags: str, members: DataFrame, has: str) -> DataFrame:
    """(tags, n): for each distinct array of tags, how many members have one of them; no pair is written.

    ``members``: a row per member, with its tags.
    """
    asked, stored = sets.select(F.col(tags).alias("tags")).distinct(), stage(members.select(F.col(has).alias("has")), "members")
    folder = stored._staged_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = [t for b in batches for t in b.column(0).to_pylist()]
        n = np.zeros(len(asks), np.int64)
        store, root = fs.FileSystem.from_uri(folder)
        for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")) if asks else ():
            for batch in pq.ParquetFile(store.open_input_file(path)).iter_batches(batch_size=MEMBERS):
                lists = batch.column(0)
                coded = lists.flatten().dictionary_encode()
                bits = np.zeros((len(coded.dictionary), len(lists)), bool)
                bits[coded.indices.to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))] = True
                bits, number = np.packbits(bits, axis=1), {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
                for i, t in enumerate(asks):
                    rows = [number[w] for w in t if w in number]
                    if rows:
                        n[i] += int(np.bitwise_count(np.bitwise_or.reduce(bits[rows], axis=0)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(asks, pa.list_(pa.string())), pa.array(n)], names=["tags", "n"])

    out = stage(asked.repartition(_shares(asked), "tags").mapInArrow(run, "tags array<string>, n long"), "unions")
    unstage(stored)
    return out
