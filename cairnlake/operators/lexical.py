"""Lexical search: postings, phrases, stems, BM25 and its stored index."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, STOP_WORDS, has_cjk, terms

# BM25 saturation and length weight, least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Needles of a block, sent to every task.
NEEDLES = 100_000


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, length, term, tf): one row per document and distinct term."""
    t = docs.select(F.col(doc_id).alias("doc"), terms(F.col(text)).alias("t"))
    return t.select("doc", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def units(c: Column) -> Column:
    """Query units, each an array of terms: the tokens between white space, stop words only if nothing else is left.

    A token with inner punctuation is a phrase: its terms must stand side by side.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), '"', "")
    tokens = F.filter(F.split(bare, f"{SPACE}+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    kept = F.filter(tokens, lambda t: ~F.lower(t).isin(*STOP_WORDS))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(tokens), terms)


def asked_units(queries: DataFrame, query_id: str, query: str, stem: bool = False) -> DataFrame:
    """(query, unit, terms, times): the units of each query and how often it names them."""
    each = queries.select(F.col(query_id).alias("query"), F.explode(units(F.col(query))).alias("terms"))
    if stem:
        each = each.withColumn("terms", stem_lists("terms"))
    return each.groupBy("query", "terms").agg(F.count(F.lit(1)).alias("times")).select("query", F.array_join("terms", " ").alias("unit"), "terms", "times")


def tokens(docs: DataFrame, doc_id: str, text: str, stem: bool = False) -> DataFrame:
    """(doc, length, pos, term): one row per token; with ``stem`` by its Porter stem."""
    t = docs.select(F.col(doc_id).alias("doc"), terms(F.col(text)).alias("t"))
    t = t.withColumn("t", stem_lists("t")) if stem else t
    return t.select("doc", F.size("t").alias("length"), F.posexplode("t").alias("pos", "term"))


def unit_hits(found: DataFrame, asked: DataFrame, repeated: bool = False) -> DataFrame:
    """(unit, doc, length, tf): how often each asked unit stands in a document.

    ``repeated``: documents may be delivered more than once.
    Tokens meet the terms of the units by join; a phrase stands where as many of
    its terms as it has point to the same start. No row carries a document.
    """
    elements = asked.select("unit", "terms").distinct().select("unit", F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term"))
    start = F.when(F.col("n") > 1, F.col("pos") - F.col("i")).otherwise(0)
    met = found.join(elements, "term")
    met = met.dropDuplicates(["unit", "doc", "pos", "i"]) if repeated else met
    at = met.groupBy("unit", "doc", "length", "n", start.alias("start")).agg(F.count(F.lit(1)).alias("c"))
    whole = F.when(F.col("n") == 1, F.col("c")).when(F.col("c") == F.col("n"), 1).otherwise(0)
    return at.groupBy("unit", "doc", "length").agg(F.sum(whole).alias("tf")).filter("tf > 0")


def scored(hit: DataFrame, total: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank) from unit hits and one row of totals (n_docs, mean_length)."""
    df = hit.groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    # one row of totals goes along with every unit
    idf = df.join(F.broadcast(total)).withColumn("idf", F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    idf = idf.withColumn("idf", F.when(F.col("idf") <= 0, LEAST_IDF).otherwise(F.col("idf"))).select("unit", "idf", "mean_length")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    parts = hit.join(idf, "unit").select("unit", "doc", part.alias("part")).join(asked.select("query", "unit", "times"), "unit")
    scores = parts.groupBy("query", "doc").agg(F.round(F.sum(F.col("part") * F.col("times")), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_topk(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, stem: bool = False, repeated: bool = False) -> DataFrame:
    """(query, doc, score, rank): best ``k`` documents of each query, larger is better.

    A document matches if it has any unit of the query (see ``units``); a unit
    named twice counts twice. With ``stem`` words match by their Porter stem.
    Only tokens of asked units are kept, before any aggregation. Ties go to the
    smaller document id. A query without terms, and null texts, give no row; an
    empty corpus gives none. ``repeated``: rows of one id are deliveries of the same
    document, told apart by id and place after the join, so that no text is
    shuffled. ``StoredIndex`` answers without reading the texts.
    """
    asked = asked_units(queries, query_id, query, stem)
    sizes = docs.select(F.col(doc_id).alias("doc"), F.size(terms(F.col(text))).alias("length"))
    total = (sizes.dropDuplicates(["doc"]) if repeated else sizes).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    return scored(unit_hits(tokens(docs, doc_id, text, stem), asked, repeated), total, asked, k)


class StoredIndex:
    """Tokens of a corpus, written once and read by term: ``folder/bucket=<b>`` holds the terms of a hash.

    The index is derived: it can be rebuilt from the documents at any time, and
    is, when it is missing, unreadable or of another version or stemming.
    """

    VERSION, BUCKETS = 1, 64

    def __init__(self, spark: SparkSession, folder: str, stem: bool = False):
        self.spark, self.folder, self.stem = spark, folder.rstrip("/"), stem

    def usable(self) -> bool:
        """Whether a whole index of this version lies in the folder."""
        try:
            m = self.spark.read.json(f"{self.folder}/made").first()
            return (m.version, m.stem) == (self.VERSION, self.stem) and bool(self.spark.read.parquet(f"{self.folder}/tokens").columns)
        except Exception as e:  # noqa: BLE001 - whatever is wrong with a derived table, it is built anew
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or isinstance(e, (AttributeError, AnalysisException, PySparkException)):
                return False
            raise

    def build(self, docs: DataFrame, doc_id: str, text: str) -> StoredIndex:
        """Writes the index; the mark that makes it usable comes last."""
        t = tokens(docs, doc_id, text, self.stem).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int"))
        t.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc", "pos").write.mode("overwrite").parquet(f"{self.folder}/tokens", partitionBy=["bucket"])
        total = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(terms(F.col(text)))).alias("mean_length"))
        total.select("*", F.lit(self.VERSION).alias("version"), F.lit(self.stem).alias("stem")).write.mode("overwrite").json(f"{self.folder}/made")
        return self

    def ensure(self, docs: DataFrame, doc_id: str, text: str) -> StoredIndex:
        return self if self.usable() else self.build(docs, doc_id, text)

    def search(self, queries: DataFrame, query_id: str, query: str, k: int) -> DataFrame:
        """As ``bm25_topk``; reads the buckets and, by their statistics, the row groups of asked terms."""
        asked = asked_units(queries, query_id, query, self.stem)
        total = self.spark.read.json(f"{self.folder}/made").select(F.col("n_docs").cast("long").alias("n_docs"), F.col("mean_length").cast("double").alias("mean_length"))
        wanted = asked.select(F.explode("terms").alias("term")).distinct()
        few = [r.term for r in wanted.limit(201).collect()]
        found = self.spark.read.parquet(f"{self.folder}/tokens")
        if len(few) <= 200:  # as literals, so that partitions and row groups are pruned at the scan
            found = found.filter(F.col("bucket").isin([r.b for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int").alias("b")).distinct().collect()])).filter(F.col("term").isin(few))
        return scored(unit_hits(found.drop("bucket"), asked), total, asked, k)


def substring_topk(docs: DataFrame, doc_id: str, text: str, needles: DataFrame, needle_id: str, needle: str, k: int) -> DataFrame:
    """(query, doc, rank): documents that contain a literal in any case, newest id first.

    For scripts without word spaces, when the term index finds nothing. The
    needles are a stated query set; they go to the tasks in blocks of NEEDLES, as
    one automaton that finds all of them in a single pass over a text.
    """
    asked = needles.select(F.col(needle_id).alias("query"), F.lower(needle).alias("needle")).filter(F.col("needle") != "")
    blocks = max(1, -(-asked.count() // NEEDLES))
    kind = {c: dict(t.dtypes)[n] for c, t, n in (("doc", docs, doc_id), ("query", needles, needle_id))}
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) if blocks > 1 else asked
        share = docs.sparkSession.sparkContext.broadcast([(r.query, r.needle) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            by_needle: dict[str, list] = {}
            for q, w in share.value:
                by_needle.setdefault(w, []).append(q)
            machine = ahocorasick.Automaton()
            for w, qs in by_needle.items():
                machine.add_word(w, qs)
            machine.make_automaton()
            for batch in batches if by_needle else ():
                at, asks = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    hits = {q for _, qs in machine.iter(t) for q in qs}
                    at += [i] * len(hits)
                    asks += hits
                yield pa.RecordBatch.from_arrays([pa.array(asks, from_arrow), batch.column(0).take(pa.array(at, pa.int64()))], names=["query", "doc"])

        from_arrow = pa.int64() if kind["query"] == "bigint" else pa.int32() if kind["query"] == "int" else pa.string()
        got = docs.select(F.col(doc_id).alias("doc"), F.lower(text).alias("t")).filter("t <> ''").mapInArrow(run, f"query {kind['query']}, doc {kind['doc']}")
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query").orderBy(F.desc("doc"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "doc", "rank")


def phrase_matches(docs: DataFrame, doc_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str) -> DataFrame:
    """(phrase, doc, n): how often the phrase's terms stand side by side in a document."""
    p = phrases.select(F.col(phrase_id).alias("phrase"), terms(F.col(phrase)).alias("terms")).filter(F.size("terms") > 0)
    asked = p.withColumn("unit", F.array_join("terms", " "))
    return unit_hits(tokens(docs, doc_id, text), asked).join(asked.select("phrase", "unit"), "unit").select("phrase", "doc", F.col("tf").alias("n"))


def lexical_channel(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, stem: bool = False) -> DataFrame:
    """(query, doc, rank, channel): BM25; a query without any match and with signs of a script without word spaces is looked for as a literal.

    channel is ``terms`` or ``literal``.
    """
    lex = bm25_topk(docs, doc_id, text, queries, query_id, query, k, stem)
    rest = queries.filter(has_cjk(F.col(query))).join(lex.select(F.col("query").alias("_q")).distinct(), F.col(query_id) == F.col("_q"), "left_anti")
    literal = substring_topk(docs, doc_id, text, rest, query_id, query, k)
    return lex.select("query", "doc", "rank", F.lit("terms").alias("channel")).unionByName(literal.select("query", "doc", "rank", F.lit("literal").alias("channel")))


# ---------------------------------------------------------------- stemming

_VOWELS = frozenset("aeiou")


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    kind = ""
    for i, c in enumerate(stem):
        v = c in _VOWELS or (c == "y" and i > 0 and kind[-1] == "c")
        kind += "v" if v else "c"
    runs = "".join(k for i, k in enumerate(kind) if i == 0 or kind[i - 1] != k)
    return runs.lstrip("c").count("vc")


def _has_vowel(stem: str) -> bool:
    return any(c in _VOWELS or (c == "y" and i > 0 and stem[i - 1] not in _VOWELS) for i, c in enumerate(stem))


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and s[-1] not in _VOWELS


def _short_end(s: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    if len(s) < 3:
        return False
    cons = [not (c in _VOWELS or (c == "y" and i > 0 and s[i - 1] not in _VOWELS)) for i, c in enumerate(s)]
    return cons[-1] and not cons[-2] and cons[-3] and s[-1] not in "wxy"


# Suffixes of the published Porter algorithm, steps 2 to 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def porter(word: str) -> str:
    """The Porter stem of a lower-case word."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        for end, new in sorted(steps, key=lambda p: -len(p[0])):
            if w.endswith(end):
                w = w[: len(w) - len(end)] + new if _measure(w[: len(w) - len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_lists(lists: pd.Series) -> pd.Series:
    """Stems of arrays of terms; every distinct word of a batch is stemmed once."""
    known: dict[str, str] = {}
    return lists.map(lambda ws: [known[w] if w in known else known.setdefault(w, porter(w)) for w in ws], na_action="ignore")


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")


def stemmed_vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(term, stem): every distinct term is stemmed once, to be joined back."""
    return docs.select(F.explode(terms(F.col(text))).alias("term")).distinct().withColumn("stem", stem_words("term"))
