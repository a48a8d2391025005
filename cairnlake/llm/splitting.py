"""Splitting oversized items at natural boundaries (problem 5).

An item is read as byte ranges. Each range, with a halo that shows the last
boundary before it and tears no character and no line end, reports its boundaries as a small summary:
what lies before its first boundary, after its last one, and the longest stretch
between. Summaries are stitched in order, prefix sums of the range lengths give
offsets, and pieces are emitted by offset. A giant file is never in one worker:
its ranges are first moved to natural boundaries and then cut independently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range; larger ones cost memory, smaller ones cost rows.
RANGE = 1 << 20
#: Bytes of a range's halo before it: a piece, its overlap and 8 bytes must fit in; behind it are 4.
HALO = 8192
_LINE_END = re.compile(rb"\r\n|\r|\n")
_SPACE = re.compile(rb"[ \t\r\n]+")
_NOT_SPACE = re.compile(rb"[^ \t\r\n]+")


def _aligned(buf: bytes, at: int) -> int:
    """The next offset from ``at`` on that tears neither a character nor \\r\\n."""
    while 0 < at < len(buf) and ((buf[at] & 0xC0) == 0x80 or (buf[at] == 10 and buf[at - 1] == 13)):
        at += 1
    return at


def _blank(line: bytes) -> bool:
    return not line.strip() or not line.decode("utf-8", "replace").strip()


class Stretches:
    """Longest stretch between boundaries of a sequence that comes in parts.

    State of the open stretch and the longest closed one, for lines, for words
    and for paragraphs (lines between blank lines). Feeding ranges in order and
    feeding the whole text give the same result.
    """

    def __init__(self) -> None:
        self.word = self.line = self.para = 0  # longest closed stretches, bytes
        self.word_open = self.line_open = 0
        self.line_blank = True
        self.para_open = 0  # bytes up to the end of the last line that is not blank
        self.para_tail = 0  # line end after it

    def feed(self, buf: bytes) -> None:
        at = 0
        for m in _SPACE.finditer(buf):
            self.word = max(self.word, self.word_open + m.start() - at)
            self.word_open, at = 0, m.end()
        self.word_open += len(buf) - at
        at = 0
        for m in _LINE_END.finditer(buf):
            self._line(buf[at : m.start()])
            self._close(m.end() - m.start())
            at = m.end()
        self._line(buf[at:])

    def _line(self, part: bytes) -> None:
        self.line_open += len(part)
        self.line_blank = self.line_blank and _blank(part)

    def _close(self, ending: int) -> None:
        self.line = max(self.line, self.line_open)
        if self.line_blank:
            self.para = max(self.para, self.para_open)
            self.para_open = self.para_tail = 0
        else:
            self.para_open += self.para_tail + self.line_open
            self.para_tail = ending
        self.line_open, self.line_blank = 0, True

    def longest(self) -> tuple[int, int, int]:
        """(paragraph, line, word) with the open ends closed."""
        word, line = max(self.word, self.word_open), max(self.line, self.line_open)
        para = max(self.para, self.para_open if self.line_blank else self.para_open + self.para_tail + self.line_open)
        return para, line, word


def cut_at(longest: tuple[int, int, int], limit: int) -> str:
    """The first of paragraph, line, word that no stretch over the limit forbids."""
    for name, n in zip(("paragraph", "line", "word"), longest, strict=True):
        if n <= limit:
            return name
    return "none"


_PARA_END = re.compile(rb"(?:\r\n|\r|\n)[ \t\x0b\x0c]*(?:\r\n|\r|\n)(?:[ \t\x0b\x0c]*(?:\r\n|\r|\n))*")


def _last_boundary(window: bytes, low: int, torn: bool) -> tuple[int, str]:
    """(end, boundary): where a piece ends in the window, after ``low``; 0 if nowhere.

    ``torn``: the window's last byte is the first half of a \\r\\n.
    """
    kinds = ((_PARA_END, "paragraph"), (_LINE_END, "line"), (_SPACE, "word"))
    # first a boundary that fills half of the piece, then any
    for pattern, name, least in [(*k, max(low, len(window) // 2)) for k in kinds] + [(*k, low) for k in kinds]:
        last = 0
        for m in pattern.finditer(window):
            if m.end() > least and not (torn and m.end() == len(window)):
                last = m.end()
        if last:
            return last, name
    return 0, "none"


def _overlap_start(buf: bytes, fresh: int, least: int, overlap: int) -> int:
    """Where the piece begins that brings the bytes from ``fresh`` on: at a word's start, from ``least`` on."""
    at = _aligned(buf, max(fresh - overlap, least)) if overlap else fresh
    space = _SPACE.search(buf, at, fresh)
    return space.end() if space and space.end() < fresh else min(at, fresh)


def cut_offsets(buf: bytes, limit: int, overlap: int, fresh: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces: each at most ``limit`` bytes.

    A piece ends after the last blank line in its second half, else after the last
    line end there, else after the last white space there; with none of them, after
    such a boundary in its first half, else at the last whole character. The
    next one begins at most ``overlap`` bytes before, at a word's start (with no
    white space there: at a character's start); together they cover every byte.
    Bytes before ``fresh`` are already in a piece before the first one.
    """
    if not 0 <= overlap < limit - 4:
        raise ValueError("overlap must be at least 0 and less than limit - 4")
    out: list[tuple[int, int, str]] = []
    start = 0  # fresh: first byte that no piece has yet
    while fresh < len(buf):
        if len(buf) - start <= limit:
            out.append((start, len(buf), "end"))
            break
        window = buf[start : start + limit]
        low = fresh - start  # a cut must bring something new
        after = start + limit
        end, kind = _last_boundary(window, low, buf[after - 1] == 13 and buf[after : after + 1] == b"\n")
        if not end:
            end = len(window)
            while end > low + 1 and (buf[start + end] & 0xC0) == 0x80:
                end -= 1
            if buf[start + end] == 10 and buf[start + end - 1] == 13 and end > low + 1:
                end -= 1
        out.append((start, start + end, kind))
        fresh = start + end
        start = _overlap_start(buf, fresh, start + 1, overlap)
    return out


def oversized(items: DataFrame, text: str, limit: int) -> DataFrame:
    """Items of more than ``limit`` UTF-8 bytes; null texts are none."""
    return items.filter(F.octet_length(F.col(text)) > limit)


def item_ranges(items: DataFrame, id_col: str, text: str, range_bytes: int = RANGE) -> DataFrame:
    """(id, range_no, size, buf): the items as byte ranges, buf with a halo of HALO bytes before and 4 after it."""
    raw = F.encode(F.col(text), "UTF-8")
    # the ranges are cut out before they become rows, so no row carries the item beside its range
    begin = lambda i: i * range_bytes
    first = lambda i: F.greatest(begin(i) - HALO, F.lit(0))
    cut = lambda i: F.struct(i.alias("range_no"), F.substring("raw", first(i) + 1, begin(i) + range_bytes + 4 - first(i)).alias("buf"))
    last = F.ceil(F.octet_length("raw") / range_bytes).cast("int") - 1
    cuts = items.select(F.col(id_col).alias("id"), raw.alias("raw")).select("id", F.octet_length("raw").alias("size"), F.transform(F.sequence(F.lit(0), last), cut).alias("c"))
    return cuts.select("id", "size", F.explode("c").alias("c")).select("id", "c.range_no", "size", "c.buf")


def file_ranges(spark: SparkSession, paths: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """As ``item_ranges`` for files (path, size) that every worker can open: each range is read by seek."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, no, size in zip(f["id"], f["range_no"], f["size"], strict=True):
                with open(path, "rb") as file:
                    begin = max(no * range_bytes - HALO, 0)
                    file.seek(begin)
                    rows.append((path, no, size, file.read((no + 1) * range_bytes + 4 - begin)))
            yield pd.DataFrame(rows, columns=["id", "range_no", "size", "buf"])

    n = F.ceil(F.col("size") / range_bytes).cast("int")
    plan = paths.filter("size > 0").select(F.col("path").alias("id"), "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("range_no"))
    return plan.repartition("id", "range_no").mapInPandas(read, "id string, range_no int, size long, buf binary")


def _own(buf: bytes, no: int, size: int, range_bytes: int) -> bytes:
    """The bytes of a range after moving both ends to whole characters and line ends."""
    lead = min(HALO, no * range_bytes)
    begin = _aligned(buf, lead) if no else 0
    end = lead + range_bytes
    return buf[begin:] if no * range_bytes + range_bytes >= size else buf[begin : _aligned(buf, end)]


def _seam(buf: bytes, at: int, limit: int, range_bytes: int) -> tuple[int, str]:
    """(offset, boundary): where the ranges that meet at ``at`` part, as a piece that ends there would.

    Both ranges see the same bytes, at most a piece before ``at`` and 4 after it.
    """
    reach = max(min(limit, range_bytes - 4), 0)
    end, kind = _last_boundary(buf[at - reach : at], 0, buf[at - 1] == 13 and buf[at : at + 1] == b"\n")
    return (at - reach + end, kind) if end else (_aligned(buf[: at + 4], at), kind)


def boundary_kinds(ranges: DataFrame, id_type: str, limit: int, range_bytes: int = RANGE) -> DataFrame:
    """(id, cut_at, paragraph, line, word): the coarsest boundary that suffices, and the longest stretches.

    Items of one range are decided where they are; only those of several ranges
    send their summaries' input to one worker, in order.
    """
    schema = f"id {id_type}, cut_at string, paragraph long, line long, word long"

    def single(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, buf in zip(f["id"], f["buf"], strict=True):
                s = Stretches()
                s.feed(buf)
                rows.append((i, cut_at(s.longest(), limit), *s.longest()))
            yield pd.DataFrame(rows, columns=["id", "cut_at", "paragraph", "line", "word"])

    def summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, no, size, buf in zip(f["id"], f["range_no"], f["size"], f["buf"], strict=True):
                rows.append((i, no, _summary(_own(buf, no, size, range_bytes))))
            yield pd.DataFrame(rows, columns=["id", "range_no", "s"])

    def stitch(f: pd.DataFrame) -> pd.DataFrame:
        s = Stretches()
        for part in f.sort_values("range_no")["s"]:
            _append(s, part)
        return pd.DataFrame([(f["id"].iloc[0], cut_at(s.longest(), limit), *s.longest())], columns=["id", "cut_at", "paragraph", "line", "word"])

    one = ranges.filter(F.col("size") <= range_bytes).mapInPandas(single, schema)
    many = ranges.filter(F.col("size") > range_bytes).mapInPandas(summary, f"id {id_type}, range_no int, s array<long>")
    return one.unionByName(many.groupBy("id").applyInPandas(stitch, schema))


def _summary(buf: bytes) -> list[int]:
    """A range as 13 numbers that can be appended to the state of what lies before.

    Words: first, inner, last stretch, any space. Lines: length and blankness of
    the first and last partial line, longest inner line, any line end. Inner
    paragraphs: leading stretch, longest inner, trailing stretch and its line end.
    """
    spaces = [m.span() for m in _SPACE.finditer(buf)]
    if spaces:
        inner = max([b - a for (_, a), (b, _) in zip(spaces, spaces[1:], strict=False)], default=0)
        word = [spaces[0][0], inner, len(buf) - spaces[-1][1], 1]
    else:
        word = [len(buf), 0, 0, 0]
    ends = [m.span() for m in _LINE_END.finditer(buf)]
    if not ends:
        return [*word, len(buf), int(_blank(buf)), 0, 0, 0, 0, 0, 0, 0, 1, 0]
    head, tail = buf[: ends[0][0]], buf[ends[-1][1] :]
    s = Stretches()
    s.para_open, s.para_tail = 0, 0
    lead, split, longest_line = 0, 0, 0
    for (_, a), (b, e) in zip(ends, ends[1:], strict=False):
        line = buf[a:b]
        longest_line = max(longest_line, len(line))
        if _blank(line):
            if not split:
                lead, split = s.para_open, 1
            else:
                s.para = max(s.para, s.para_open)
            s.para_open = s.para_tail = 0
        else:
            s.para_open += s.para_tail + len(line)
            s.para_tail = e - b
    if not split:
        lead = s.para_open
    return [*word, len(head), int(_blank(head)), longest_line, 1, ends[0][1] - ends[0][0], lead, split, s.para, len(tail), int(_blank(tail)), s.para_open * 4 + s.para_tail]


def _append(s: Stretches, p: list[int]) -> None:
    w0, w_in, w1, spaced, head, head_blank, line_in, ended, ending, lead, split, para_in, tail, tail_blank, trail = (int(x) for x in p)
    if spaced:
        s.word = max(s.word, s.word_open + w0, w_in)
        s.word_open = w1
    else:
        s.word_open += w0
    s.line_open += head
    s.line_blank = s.line_blank and bool(head_blank)
    if not ended:
        return
    s._close(ending)
    s.line = max(s.line, line_in)
    trail_len, trail_end = divmod(trail, 4)
    if split:
        s.para = max(s.para, s.para_open + s.para_tail + lead if lead else s.para_open, para_in)
        s.para_open, s.para_tail = trail_len, trail_end
    elif lead:
        s.para_open, s.para_tail = s.para_open + s.para_tail + lead, trail_end
    s.line_open, s.line_blank = tail, bool(tail_blank)


def pieces(ranges: DataFrame, id_type: str, limit: int, overlap: int, range_bytes: int = RANGE) -> DataFrame:
    """(id, piece_no, start, stop, boundary, text): pieces of at most ``limit`` bytes.

    Where ranges meet, their ends are moved to the last blank line, line end or
    white space before, as if a piece ended there, and the later one begins up
    to ``overlap`` bytes earlier. Then they are cut independently; starts come from prefix sums of the
    range lengths and piece numbers from prefix sums of the piece counts, so no
    worker holds an item of several ranges. Bytes that are not UTF-8 (files) are
    shown as U+FFFD in text; start and stop count the bytes of the original.
    """
    from pyspark.sql import Window

    if limit + overlap + 8 > HALO:
        raise ValueError("limit and overlap must fit into HALO")
    schema = f"id {id_type}, range_no int, k int, n int, start long, stop long, boundary string, text string"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, no, size, buf in zip(f["id"], f["range_no"], f["size"], f["buf"], strict=True):
                lead = min(HALO, no * range_bytes)
                begin = _seam(buf, lead, limit, range_bytes)[0] if no else 0
                end, last = (len(buf), "end") if (no + 1) * range_bytes >= size else _seam(buf, lead + range_bytes, limit, range_bytes)
                if end == len(buf) and no * range_bytes - lead + end == size:
                    last = "end"
                start = _overlap_start(buf, begin, 0, overlap) if no else 0
                base, own = no * range_bytes - lead + start, buf[start:end]
                cuts = cut_offsets(own, limit, overlap, begin - start)
                if cuts:
                    cuts[-1] = (*cuts[-1][:2], last)
                rows += [(i, no, k, len(cuts), base + a, base + b, kind, own[a:b].decode("utf-8", "replace")) for k, (a, b, kind) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["id", "range_no", "k", "n", "start", "stop", "boundary", "text"])

    made = ranges.mapInPandas(cut, schema)
    # several ranges: pieces before this range = sum of the counts of earlier ones
    before = F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).over(Window.partitionBy("id").orderBy("range_no", "k").rowsBetween(Window.unboundedPreceding, 0))
    return made.select("id", (before - F.col("n") + F.col("k")).cast("int").alias("piece_no"), "start", "stop", "boundary", "text")
