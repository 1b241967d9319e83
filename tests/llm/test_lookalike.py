import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tokenweave.llm.lookalike import CLEAN, SECOND_GREEK, consistent, look, readings, unify_values


@pytest.mark.parametrize(
    "value, form",
    [
        ("λόγος", "λόγος"),
        ("λόγος", "λόγος"),  # a combining accent
        ("λό​γος", "λόγος"),
        ("­λό⁠γος﻿", "λόγος"),
        ("　λόγος ", "λόγος"),
        (" λόγος ", "λόγος"),
        ("λόγος", "λόγος"),
        ("λόγος", "λόγος"),  # the other code point of an accented letter
        ("λόγoς", "λόγος"),  # Latin o
        ("λόγоς", "λόγος"),  # Cyrillic o
        ("ϑεόϲ", "θεός"),  # symbol letters
        ("ϲοφόϲ", "σοφός"),
        ("µήτηϱ", "μήτηρ"),
        ("ｖｏｘ１", "vox1"),
        ("λόγος２", "λόγος2"),
        ("vox", "vox"),
        ("VOX", "VOX"),
        ("Υ̓", "Υ̓"),  # no composed form: the accent is seen and stays
        ("λόγος,", "λόγος,"),
        ("", ""),
        ("​‍", ""),
        ("дом", "дом"),
    ],
)
def test_forms(value, form):
    assert look(value) == form


def test_majority_decides_the_script():
    assert look("voxα") == "voxa"
    assert consistent("λόγoς")[1] and not consistent("λόγος")[1]


@given(st.text(alphabet=st.sampled_from("λόγοςaboеρ ϑ́​ ｖＶ1２'"), max_size=12))
def test_consistent_forms_stay_and_the_filter_clears_only_those(value):
    form = look(value)
    assert look(form) == form
    assert unicodedata.normalize("NFC", form) == form and form == form.strip()
    if re.match(CLEAN, value):
        assert form == value


def test_operator(spark):
    rows = [("lemma", "1", "λόγоς", "x"), ("lemma", "1", "λόγоς", "x"), ("lemma", "2", "λόγος", "x"), ("lemma", "3", None, "x"), ("form", "4", "θо", "x"), ("form", "5", "", "x"), ("form", "6", "λόγος ", "x"), ("form", "7", "z" * 30000 + "​", "x")]
    df = spark.createDataFrame(rows, "field string, row_key string, value string, __w string")
    got = sorted((r.row_key, r.consistent[:9], r.status) for r in unify_values(df, df.select("value")).collect())
    assert got == [("1", "λόγος", "script"), ("1", "λόγος", "script"), ("4", "θο", "script_unattested"), ("6", "λόγος", "form"), ("7", "z" * 9, "form")]
    assert unify_values(df.limit(0), df.select("value")).count() == 0
    assert unify_values(df, df.select("value").limit(0)).count() == 5


def test_line_breaks_at_the_end_are_found(spark):
    ends = ["\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029"]
    rows = [(f"{w}{i}", w + e) for w in ("λόγος", "abc") for i, e in enumerate(ends)] + [("clean", "λόγος"), ("clean", "abc")]
    df = spark.createDataFrame(rows, "row_key string, value string")
    got = sorted((r.row_key, r.consistent) for r in unify_values(df, df.select("value")).collect())
    assert got == sorted((k, k[:-1]) for k, _ in rows if k != "clean")
    mixed = spark.createDataFrame([("m", "λόγoς")], "row_key string, value string")  # a word with a line break attests nothing
    assert [r.status for r in unify_values(mixed, df.where("value like 'λόγος_'").select("value")).collect()] == ["script_unattested"]


def test_letters_that_look_like_two_are_read_by_the_vocabulary(spark):
    assert readings("λόγος") == [] and readings("λόγοс") == ["λόγος"] and readings("φyσις") == ["φγσις", "φυσις"]
    assert len(readings("αβγδεζηθικ" * 3 + "".join(SECOND_GREEK) * 2)) == 2 ** len(SECOND_GREEK)
    rows = [("φyσις", 1), ("φyσις", 2), ("nνευμα", 3), ("vόμος", 4), ("vlx", 5), ("ξyστις", 6)]
    words = spark.createDataFrame([("φυσις",), ("πνευμα",), ("νόμος",), ("υόμος",), ("ξyστις",)], "value string")
    got = {r.n: (r.consistent, r.status) for r in unify_values(spark.createDataFrame(rows, "value string, n int"), words).collect()}
    assert got == {1: ("φυσις", "script"), 2: ("φυσις", "script"), 3: ("πνευμα", "script"), 4: ("νόμος", "script"), 6: ("ξγστις", "script_unattested")}
