"""Unicode work that Spark has no built-in function for, on Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def per_distinct(values: pd.Series, fn: Callable[[str], object]) -> pd.Series:
    """fn over each distinct non-null value of a batch once; null stays null."""
    codes, distinct = pd.factorize(values)
    out = pd.Series([fn(v) for v in distinct], dtype=object)
    return pd.Series([out.iat[c] if c >= 0 else None for c in codes], index=values.index, dtype=object)


def char_class(keep: Callable[[str], bool], ranges: list[tuple[int, int]]) -> str:
    """The inside of a Java/Python regex class with every character of ranges that keep() accepts."""
    spans: list[list[int]] = []
    for lo, hi in ranges:
        for cp in range(lo, hi + 1):
            if keep(chr(cp)):
                if spans and spans[-1][1] == cp - 1:
                    spans[-1][1] = cp
                else:
                    spans.append([cp, cp])
    return "".join(f"\\u{a:04X}-\\u{b:04X}" if b > a else f"\\u{a:04X}" for a, b in spans)


def _stable(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "L" and unicodedata.normalize("NFC", ch) == ch


#: Text of these characters only is its own canonical composition, so no Python need look at it.
NFC_SAFE = r"^[\u0001-˿" + char_class(_stable, [(0x370, 0x3FF), (0x400, 0x45F), (0x1F00, 0x1FFF)]) + "]*$"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return per_distinct(values, lambda v: unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _nfd(values: pd.Series) -> pd.Series:
    return per_distinct(values, lambda v: unicodedata.normalize("NFD", v))


def nfc(value: Column) -> Column:
    """Canonical composition; null stays null."""
    return _nfc(value)


def nfd(value: Column) -> Column:
    """Canonical decomposition; null stays null."""
    return _nfd(value)
