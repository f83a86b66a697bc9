"""Oversized texts into overlapping pieces, by agglomerative merging of atomic segments.

Atoms are the segments between natural boundaries, each boundary with a strength; adjacent segments are merged over
the weakest boundary first (a heap), smallest pair first, while their size plus the overlap fits the limit. A segment
that fits as a whole is never cut: all its inner boundaries are weaker, so they are merged before; hence only
segments beyond the limit are refined to the next finer boundaries, down to single characters.

Pieces partition the text but for the overlap: each piece after the first starts exactly ``overlap`` characters
before the end of the one before. Lengths are in Unicode characters.

Defined results: null texts have no pieces, texts up to the limit (empty and blank ones too) are one piece; exact
copies of a row give their pieces once."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries of prose from strong to weak; each matches what stands before the cut.
PROSE = [
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),
    re.compile(r"\r\n|\r|\n| | "),
    re.compile(r"[.!?…][\"')\]’”»]*\s+|[。！？]"),
    re.compile(r"[;:—–]\s+|,\s+|[、，；]"),
    re.compile(r"\s+"),
]
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_WORDS = [re.compile(r"[;{},]\s*"), re.compile(r"\s+"), re.compile(r"\W")]


def _cuts(text: str, a: int, b: int, boundary: re.Pattern[str]) -> list[int]:
    return [p for p in (m.end() for m in boundary.finditer(text, a, b)) if a < p < b]


def _refine(text: str, a: int, b: int, levels: list[re.Pattern[str]], at: int, room: int, out: list[tuple[int, int]]) -> None:
    """Append the (end, strength) of atoms of [a, b) for boundaries weaker than the one at b."""
    if b - a <= room:
        return
    if at == len(levels):
        out.extend((p, -1) for p in range(a + room, b, room))
        return
    last = a
    for p in [*_cuts(text, a, b, levels[at]), b]:
        _refine(text, last, p, levels, at + 1, room, out)
        if p < b:
            out.append((p, len(levels) - at))
        last = p


def _prose(text: str, room: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    _refine(text, 0, len(text), PROSE, 0, room, out)
    return out


def _code(text: str, room: int) -> list[tuple[int, int]]:
    """Line ends, the stronger the less the next line is indented; a blank line before it adds to that."""
    out: list[tuple[int, int]] = []
    lines = [m.span() for m in _LINE.finditer(text) if m.end() > m.start()]
    depth, blank = [], []
    for a, b in lines:
        line = text[a:b]
        body = line.lstrip(" \t")
        blank.append(not body.strip())
        depth.append(len(line[: len(line) - len(body)].expandtabs(4)))
    following = 0
    strengths = [0] * len(lines)
    for i in range(len(lines) - 1, -1, -1):
        strengths[i] = 1000 - 2 * min(following, 400) + (i + 1 < len(lines) and blank[i])
        if not blank[i]:
            closing = text[lines[i][0] : lines[i][1]].lstrip(" \t")[:1] in ")}]"
            following = depth[i] + (8 if closing else 0)
    for (a, b), s in zip(lines, strengths, strict=True):
        _refine(text, a, b, _WORDS, 0, room, out)
        if b < len(text):
            out.append((b, s))
    return out


def split_text(text: str, limit: int, overlap: int, code: bool = False) -> list[tuple[int, int]]:
    """(start, end) of each piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    room = limit - overlap
    if room <= 0:
        raise ValueError("the overlap leaves no room")
    marks = (_code if code else _prose)(text, room)
    n = len(marks) + 1
    start = [0, *(p for p, _ in marks)]
    end = [*(p for p, _ in marks), len(text)]
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(marks[i][1], end[i + 1] - start[i], i, end[i + 1]) for i in range(n - 1) if end[i + 1] - start[i] <= room]
    heapq.heapify(heap)
    strength = [s for _, s in marks]
    while heap:
        s, size, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or end[j] != stop or stop - start[i] != size:
            continue
        end[i], after[i], strength_next = end[j], after[j], strength[j] if j < n - 1 else 0
        alive[j] = False
        if after[i] >= 0:
            before[after[i]] = i
            strength[i] = strength_next
            if end[after[i]] - start[i] <= room:
                heapq.heappush(heap, (strength[i], end[after[i]] - start[i], i, end[after[i]]))
        h = before[i]
        if h >= 0 and end[i] - start[h] <= room:
            heapq.heappush(heap, (strength[h], end[i] - start[h], h, end[i]))
    pieces = [(max(0, start[i] - overlap) if k else 0, end[i]) for k, i in enumerate(i for i in range(n) if alive[i])]
    # A first piece within the overlap is part of the next one.
    return pieces[next(k for k in range(len(pieces)) if k + 1 == len(pieces) or pieces[k + 1][0]) :]


def split_items(df: DataFrame, key: str, text: str, limit: int, overlap: int, code: bool = False, with_text: bool = True) -> DataFrame:
    """``(key, piece, start, end[, content])`` of every row; only texts beyond the limit go through Python."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(k, i, a, b, t[a:b] if with_text else None) for k, t in zip(x["_key"], x["_text"], strict=True) for i, (a, b) in enumerate(split_text(t, limit, overlap, code))]
            yield pd.DataFrame(out, columns=["_key", "piece", "start", "end", "content"]).astype({"_key": x["_key"].dtype})

    long = rows.filter(F.length("_text") > limit).mapInPandas(run, f"_key {kind}, piece int, start int, end int, content string")
    short = rows.filter(F.length("_text") <= limit).select("_key", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length("_text").alias("end"), (F.col("_text") if with_text else F.lit(None).cast("string")).alias("content"))
    pieces = long.unionByName(short).withColumnRenamed("_key", key)
    # Copies of a row are dropped by their pieces; without texts no text is shuffled.
    return (pieces if with_text else pieces.drop("content")).distinct()
