"""Reading level of each document (problem 10).

Familiar-word formula: the share of difficult words and the sentence length.
What counts as difficult is a choice of the caller: words outside a list of
familiar words derived from the corpus' document frequencies, or words of more
than six letters, which is the statement of this project's data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of the reading bands and the least words of prose.
EASY_BELOW, HARD_ABOVE, LEAST_WORDS, LONG_OVER = 28, 52, 40, 6
# Weights of the published familiar-word formula (per cent of
# difficult words, words per sentence, what is added from which share on).
PER_CENT, PER_WORD, RAISED_OVER, RAISE = 0.1579, 0.0496, 0.05, 3.6365
#: Bounds of its bands: 7 is what pupils of 13 to 15 years read, 9 what students read.
FAMILIAR_EASY, FAMILIAR_HARD = 7.0, 9.0


def prose(c):
    """Text without front-matter, fenced code, headings and table lines."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"^\x{FEFF}?---[ \t]*\n(?:(?!---[ \t]*(?:\n|\z))[^\n]*\n)*---[ \t]*(?:\n|\z)", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(`{3,}|~{3,})[^\n]*\n(?:(?![ \t]*\1)[^\n]*\n)*(?:[ \t]*\1[^\n]*(?:\n|\z)|[^\n]*\z)", "")
    return F.regexp_replace(t, r"(?m)^[#|][^\n]*$", "")


def familiar_words(docs: DataFrame, text: str, least_share: float) -> list[str]:
    """The words found in at least ``least_share`` of all documents, sorted.

    At most average-words / least_share of them, however large the corpus, so the
    list may be sent to every task.
    """
    w = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(prose(F.col(text)), F.lit(r"\p{L}+"), 0), F.lower))).alias("word"))
    n = docs.count()
    often = w.groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least_share * max(n, 1)).select("word")
    return sorted(r.word for r in often.collect())


def _outside(words: DataFrame, known: list[str]) -> DataFrame:
    """With ``difficult``: how many of the words in ``_w`` are not among the known ones, in any case; ``_w`` is dropped."""
    share = words.sparkSession.sparkContext.broadcast(known)
    rest = [f for f in words.schema.fields if f.name != "_w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(share.value, pa.string())
        for batch in batches:
            lists = batch.column("_w")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            new = pc.invert(pc.is_in(lists.flatten(), known)).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(new)])
            past = np.cumsum(size)
            n = upto[past] - upto[past - size]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(n.astype(np.int32))], names=[*(f.name for f in rest), "difficult"])

    return words.mapInArrow(run, T.StructType([*rest, T.StructField("difficult", T.IntegerType())]))


def reading_profile(docs: DataFrame, id_col: str = "doc_id", text: str = "text", familiar: float | None = None) -> DataFrame:
    """(id, words, sentences, difficult, words_per_sentence, difficult_share, score, reading_band).

    ``familiar``: least share of the documents that makes a word familiar;
    difficult words are then those outside that list, and the score is that of
    the familiar-word formula. None: difficult are words of more than six letters,
    the score is their percentage and the words per sentence. Documents of fewer
    than 40 words of prose, null and empty texts among them, have no row.
    Repeated ids give repeated rows. A tail without end mark is a sentence if it
    has a word. Words are counted where the document is; nothing is shuffled.
    """
    p = docs.select(F.col(id_col), prose(F.col(text)).alias("_p"))
    sentences = F.size(F.filter(F.split("_p", r"(?<=[.!?])(?=\s|\z)"), lambda s: s.rlike(r"\p{L}")))
    base = p.select(id_col, F.regexp_extract_all("_p", F.lit(r"\p{L}+"), 0).alias("_w"), sentences.alias("sentences")).filter(F.size("_w") >= LEAST_WORDS)
    base = base.withColumn("words", F.size("_w"))
    wps, share = F.col("words") / F.col("sentences"), F.col("difficult") / F.col("words")
    if familiar is None:
        base = base.withColumn("difficult", F.size(F.filter("_w", lambda w: F.char_length(w) > LONG_OVER)))
        score, easy, hard = wps + 100 * share, EASY_BELOW, HARD_ABOVE
    else:
        base = _outside(base.withColumn("_w", F.transform("_w", F.lower)), familiar_words(docs, text, familiar))
        score = PER_CENT * 100 * share + PER_WORD * wps + F.when(share > RAISED_OVER, RAISE).otherwise(0.0)
        easy, hard = FAMILIAR_EASY, FAMILIAR_HARD
    band = F.when(score < easy, "easy").when(score > hard, "hard").otherwise("middle")
    return base.select(id_col, "words", "sentences", "difficult", wps.alias("words_per_sentence"), share.alias("difficult_share"), score.alias("score"), band.alias("reading_band"))


def within_bands(docs: DataFrame, bands: list[str], id_col: str = "doc_id", text: str = "text", familiar: float | None = None) -> DataFrame:
    """The documents whose reading band is one of ``bands``; those without a band are left out."""
    keep = reading_profile(docs, id_col, text, familiar).filter(F.col("reading_band").isin(bands)).select(id_col).distinct()
    return docs.join(keep, id_col, "left_semi")
