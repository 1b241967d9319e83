"""Oversized texts cut into overlapping pieces at natural boundaries.

Boundaries are those of paragraphs (a line that is empty or of blanks only), sentences (a closing mark
followed by a blank, inside a paragraph) and words (blanks), where a blank is a space, tab, carriage
return or line feed. The cuts of a text are chosen together by dynamic programming.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\r\n"
# Marks that end a sentence if a blank follows.
SENTENCE_MARKS = ".;!?\u2026\u00b7\u0387\u037e"
_PARAGRAPH = re.compile(r"\n(?:[ \t\r]*\n)+[ \t\r]*")
_SENTENCE = re.compile(rf"(?<=[{re.escape(SENTENCE_MARKS)}])[{BLANKS}]+")
_WORD = re.compile(rf"[{BLANKS}]+")
LEVELS = ("paragraph", "sentence", "word", "none")
#: What a cut costs at each level.
PENALTY = (0.0, 1.0, 6.0, 40.0)


def _units(text: str, spans: list[tuple[int, int]], at: re.Pattern) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        begin = a
        for m in at.finditer(text, a, b):
            out.append((begin, m.start()))
            begin = m.end()
        out.append((begin, b))
    trimmed = []
    for a, b in out:
        while a < b and text[a] in BLANKS:
            a += 1
        while b > a and text[b - 1] in BLANKS:
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


def levels(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of the paragraphs, sentences and words of text, blanks at their ends left out."""
    paragraphs = _units(text, [(0, len(text))], _PARAGRAPH)
    sentences = _units(text, paragraphs, _SENTENCE)
    return paragraphs, sentences, _units(text, sentences, _WORD)


def coarsest(spans: tuple, limit: int) -> str:
    """The coarsest level at which every unit has at most limit characters."""
    for name, units in zip(LEVELS, spans):
        if all(b - a <= limit for a, b in units):
            return name
    return "none"


def _candidates(n: int, spans: tuple, room: int) -> tuple[list[int], list[int]]:
    """Places where text may be cut, each with its level, such that neighbours are at most room apart."""
    level = {0: 0, n: 0}
    for k, units in enumerate(spans[:2]):
        for a, _ in units:
            level.setdefault(a, k)
    def fill(places: list[int], finer: list[int], k: int) -> None:
        """Adds places of a finer level where two coarser ones are too far apart."""
        j = 0
        for a, b in zip(places, places[1:]):
            if b - a > room:
                while j < len(finer) and finer[j] <= a:
                    j += 1
                while j < len(finer) and finer[j] < b:
                    level.setdefault(finer[j], k)
                    j += 1
    fill(sorted(level), [a for a, _ in spans[2]], 2)
    for a, b in zip(places := sorted(level), places[1:]):
        if b - a > room:
            for c in range(a + room // 2, b, max(1, room // 2)):
                level.setdefault(c, 3)
    at = sorted(level)
    return at, [level[a] for a in at]


def _overlap_start(text: str, cut: int, overlap: int) -> int:
    """Where the piece after cut begins: at the first word start within the last overlap characters.

    If no word begins there, inside a long word, exactly overlap characters before the cut.
    """
    low = max(0, cut - overlap)
    if low == 0 or text[low - 1] in BLANKS:
        return low
    for i in range(low, cut):
        if text[i] in BLANKS:
            while i < cut and text[i] in BLANKS:
                i += 1
            if i < cut:
                return i
            break
    return low


def split(text: str, limit: int = 1200, overlap: int = 120) -> tuple[str, list[tuple[int, int, int]]]:
    """The level of text, and its pieces (start, first new character, end); pieces cover text wholly.

    Minimises the sum over pieces of the penalty of the cut at the end and of the square of the share
    by which the piece falls short of the limit, subject to every piece having at most limit characters.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    spans = levels(text)
    if n <= limit:
        return coarsest(spans, limit), [(0, 0, n)]
    at, level = _candidates(n, spans, limit - overlap)
    starts = [_overlap_start(text, c, overlap) for c in at]
    m = len(at)
    best, back = [float("inf")] * m, [0] * m
    best[0] = 0.0
    low = 0
    aim = n / -(-(n - overlap) // (limit - overlap))
    for j in range(1, m):
        end, price = at[j], PENALTY[level[j]] if j < m - 1 else 0.0
        while end - starts[low] > limit:
            low += 1
        for i in range(low, j):
            if end - starts[i] <= limit:
                off = (end - at[i] - aim) / aim
                cost = best[i] + price + off * off
                if cost < best[j]:
                    best[j], back[j] = cost, i
    pieces, j = [], m - 1
    while j:
        i = back[j]
        pieces.append((starts[i], at[i], at[j]))
        j = i
    return coarsest(spans, limit), pieces[::-1]


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """One row per piece: keys.., piece_no (from 0), pieces, start, new_from, boundary, piece.

    piece is text[start:end] with at most limit characters; the characters before new_from repeat the end
    of the piece before, so the pieces from new_from on joined give the text back. boundary is the coarsest
    level at which all units of the whole text fit the limit. Null texts give no row, texts within the limit
    (empty ones too) one piece. Lengths are in characters (code points). Rows are taken as they come: drop
    repeated ones before. Extra columns are not read. Each text is held by one task, by itself.
    """
    taken = {"piece_no", "pieces", "start", "new_from", "boundary", "piece"} & set(keys)
    if taken:
        raise ValueError(f"rename the key columns {sorted(taken)}")
    fields = [df.schema[k] for k in keys]
    out = T.StructType([*fields, *(T.StructField(n, T.IntegerType()) for n in ("piece_no", "pieces", "start", "new_from")), T.StructField("boundary", T.StringType()), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, body in batch.itertuples(index=False, name=None):
                boundary, pieces = split(body, limit, overlap)
                rows += [(*key, k, len(pieces), a, new, boundary, body[a:b]) for k, (a, new, b) in enumerate(pieces)]
            if rows:
                yield pd.DataFrame(rows, columns=out.names)

    at = lambda c: F.col(f"`{c}`")
    narrow = df.where(at(text).isNotNull()).select(*map(at, keys), at(text).alias("__text"))
    return narrow.mapInPandas(cut, out)
