"""Keys under which two spellings count as one word of a list."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode import per_distinct

# Combining macron and breve, which mark quantity and do not tell words apart.
QUANTITY = "̄̆"
_QUANTITY = str.maketrans("", "", QUANTITY)
_HOMOGRAPH = re.compile(r"\d+$")
# Spellings of one sound by dialect.
_GIGN = re.compile("γ(ι[̀-ͯ]*)γν")
_DOUBLED = (("ττ", "σσ"), ("ρρ", "ρσ"))


def match_key_of(lemma: str) -> str:
    """Form, quantity marks, homograph digits and case aside."""
    bare = unicodedata.normalize("NFC", unicodedata.normalize("NFD", lemma.strip()).translate(_QUANTITY))
    return _HOMOGRAPH.sub("", bare).strip().lower()


def fold_key_of(lemma: str) -> str:
    """match_key with the regular alternations of dialect; accents and breathings stay."""
    key = unicodedata.normalize("NFC", _GIGN.sub(r"γ\1ν", unicodedata.normalize("NFD", match_key_of(lemma))))
    for a, b in _DOUBLED:
        key = key.replace(a, b)
    return key


def search_fold_of(text: str) -> str:
    """Without any combining mark, in lower case: how a reader types a search."""
    return re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", text)).lower()


@F.pandas_udf(T.StringType())
def _match_key(values: pd.Series) -> pd.Series:
    return per_distinct(values, match_key_of)


@F.pandas_udf(T.StringType())
def _fold_key(values: pd.Series) -> pd.Series:
    return per_distinct(values, fold_key_of)


@F.pandas_udf(T.StringType())
def _search_fold(values: pd.Series) -> pd.Series:
    return per_distinct(values, search_fold_of)


def match_key(lemma: Column) -> Column:
    return _match_key(lemma)


def fold_key(lemma: Column) -> Column:
    return _fold_key(lemma)


def search_fold(text: Column) -> Column:
    return _search_fold(text)


def is_proper(lemma: Column) -> Column:
    """Whether the first character is a letter that is not lower case; false for ''."""
    first = F.substring(lemma, 1, 1)
    return first.rlike(r"^\p{L}") & (first != F.lower(first))


def safe_share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
