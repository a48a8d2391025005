"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Per-prefix dynamic programming: for every prefix of a piece there is exactly
one token that can end its encoding. Among the vocabulary entries that are a
suffix of the prefix it is the one that fits the last token of what lies before
it, that is, whose pair with it no merge would join or split otherwise. Back
pointers then give the ids, without replaying the merges.

Pieces (the tokenizer's own word pattern) are independent, so each distinct one
is solved once per worker and looked up afterwards.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: the word pattern of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Solved pieces kept per worker; beyond it the table is emptied, not the result.
KEPT = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder(dict):
    """Maps a piece (str) to its ids; a missing piece is solved by prefixes."""

    def __init__(self, vocabulary: str):
        super().__init__()
        import regex

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        raw = _bytes_of_signs()
        spell = lambda sign: bytes(raw[c] for c in sign)
        self.find = regex.compile(PATTERN).findall
        self.uneven = regex.compile(r" (?=\s)").search
        self.cut = regex.compile(r" (?=\S)").split
        self.spaced = _Spaced(self)
        self.ids = {spell(s): i for s, i in model["vocab"].items() if all(c in raw for c in s)}
        self.ids = {k: v for k, v in self.ids.items() if v != model["vocab"].get("<|endoftext|>")}
        self.longest = max(map(len, self.ids))
        # the order of the merges is the order in which they apply
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.age: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.ids[spell(left)], self.ids[spell(right)]
            t = self.ids[spell(left) + spell(right)]
            self.joined[a, b] = rank
            if t not in self.parts:
                self.parts[t], self.age[t] = (a, b), rank
        self.fits_known: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """True if the encoding of the two tokens' bytes is just these two.

        Walks back in time: the seam between a and b must be joined by no merge
        older than the merges that formed the parts touching it.
        """
        known = self.fits_known.get((a, b))
        if known is not None:
            return known
        left, right, limit, good = a, b, len(self.joined) + 1, True
        age, parts, joined = self.age, self.parts, self.joined
        while True:
            seam = joined.get((left, right))
            if seam is not None and seam < limit:
                good = False
                break
            x, y = age.get(left, -1), age.get(right, -1)
            if x < 0 and y < 0:
                break
            # undo the younger of the two merges next to the seam; of equal merges
            # the leftmost comes first, so a tie counts against the right token
            if x > y:
                limit, left = x, parts[left][1]
            else:
                limit, right = y + 1, parts[right][0]
        if len(self.fits_known) > KEPT:
            self.fits_known.clear()
        self.fits_known[a, b] = good
        return good

    def __missing__(self, piece: str) -> tuple[int, ...]:
        text = piece.encode("utf-8", "replace")
        ids, longest, fits = self.ids, self.longest, self.fits
        whole = ids.get(text)
        if whole is not None and (len(text) == 1 or whole in self.parts):
            out = (whole,)
        else:
            last = [-1] * (len(text) + 1)
            size = [0] * (len(text) + 1)
            for end in range(1, len(text) + 1):
                for start in range(max(0, end - longest), end):
                    t = ids.get(text[start:end])
                    if t is not None and (start == 0 or fits(last[start], t)):
                        last[end], size[end] = t, end - start
                        break
            back, end = [], len(text)
            while end:
                back.append(last[end])
                end -= size[end]
            out = tuple(reversed(back))
        if len(self) > KEPT:
            self.clear()
        if len(text) <= 256:
            self[piece] = out
        return out

    def runs(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of the text, in tuples.

        A piece always begins at a space before other than white space, so the
        text is cut there, and the stretches, which recur, are looked up whole.
        """
        first, *rest = self.cut(text) if self.uneven(text) else text.split(" ")
        head = map(self.__getitem__, self.find(first))
        if rest and not rest[-1]:  # the text ends with a single space
            rest.pop()
            return chain(head, map(self.spaced.__getitem__, rest), [self[" "]])
        return chain(head, map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> Iterator[int]:
        return chain.from_iterable(self.runs(text))

    def count(self, text: str) -> int:
        return sum(map(len, self.runs(text)))


class _Spaced(dict):
    """Maps a stretch to the ids of it with one space before."""

    def __init__(self, pieces: PrefixEncoder):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        out = tuple(chain.from_iterable(map(self.pieces.__getitem__, self.pieces.find(" " + stretch))))
        if len(self) > KEPT:
            self.clear()
        if len(stretch) <= 64:
            self[stretch] = out
        return out


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(vocabulary: str) -> PrefixEncoder:
    """One encoder per Python worker and vocabulary file."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = PrefixEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>): one row per input row, in Arrow batches.

    The null text and the empty text have the empty list; white space only is
    encoded as any other text; strings of special tokens are ordinary text.
    A very long text is one Python string of its own, never cut.
    """
    vocabulary = vocabulary or default_vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            # small slices: ids of a batch take several times the memory of its text
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, ends = array("i"), array("i", [0])
                for t in part.column(1).to_pylist():
                    if t:
                        flat.extend(enc.encode(t))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    out = docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, tokens int): lengths only, so the ids never leave the worker."""
    vocabulary = vocabulary or default_vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            n = [enc.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["id", "tokens"])

    out = docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, f"id {id_type}, tokens int")
    return out.withColumnRenamed("id", id_col)
