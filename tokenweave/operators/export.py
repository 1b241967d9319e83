"""Flat tables for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import RUN

JOIN = " · "
# The columns of the two sheets.
ROW_COLUMNS = ["file", "chapter_index", "chapter_id", "chapter_title", "type", "lemma", "form", "parse", "lemma_occ", "parse_occ", "form_occ", "first_occ_lemma", "first_occ_parse", "last_occ_lemma", "last_occ_parse", "lemma_first_chapter", "lemma_last_chapter", "parse_first_chapter", "parse_last_chapter"]
NEW_LEMMA_COLUMNS = ["file", "chapter_index", "chapter_id", "chapter_title", "type", "lemma", "lemma_occ", "form_count", "forms", "parse_count", "parses", "lemma_last_chapter", "chapter_span"]


def _placed(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    names = chapters.select(RUN, "chapter_index", F.col("filename").alias("file"), F.col("id").alias("chapter_id"), F.col("title").alias("chapter_title"))
    return rows.join(names, [RUN, "chapter_index"])


def row_sheet(chapter_rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """run_id, row_no and ROW_COLUMNS; in order of (chapter_index, row_no) within a run."""
    return _placed(chapter_rows, chapters).select(RUN, "row_no", *ROW_COLUMNS)


def new_lemma_sheet(chapter_rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """run_id, row_no and NEW_LEMMA_COLUMNS: each lemma once, in the chapter that introduces it.

    forms and parses stand in the order they are met in, each once, empty ones left out.
    """
    new = chapter_rows.where("lemma_first_chapter = chapter_index")
    sorted_rows = F.array_sort(F.collect_list(F.struct("row_no", "parse", F.transform("forms", lambda f: f["form"]).alias("forms"))))
    some = lambda a: F.array_distinct(F.filter(a, lambda x: x != ""))
    lemmas = new.groupBy(RUN, "chapter_index", "lemma").agg(F.min("row_no").alias("row_no"), F.min_by("type", "row_no").alias("type"), F.min_by("lemma_occ", "row_no").alias("lemma_occ"), F.max("lemma_last_chapter").alias("lemma_last_chapter"), sorted_rows.alias("r"))
    listed = lemmas.select("*", some(F.flatten(F.transform("r", lambda x: x["forms"]))).alias("fs"), some(F.transform("r", lambda x: x["parse"])).alias("ps"))
    out = listed.select(
        RUN, "chapter_index", "row_no", "type", "lemma", "lemma_occ", F.size("fs").alias("form_count"), F.array_join("fs", JOIN).alias("forms"), F.size("ps").alias("parse_count"), F.array_join("ps", JOIN).alias("parses"),
        "lemma_last_chapter", (F.col("lemma_last_chapter") - F.col("chapter_index") + 1).alias("chapter_span"),
    )
    return _placed(out, chapters).select(RUN, "row_no", *NEW_LEMMA_COLUMNS)


def counts(row_sheet_: DataFrame, new_sheet: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run the rows of both sheets, and whether there is anything to export."""
    a = row_sheet_.groupBy(RUN).agg(F.count("*").alias("row_count"))
    b = new_sheet.groupBy(RUN).agg(F.count("*").alias("new_lemma_count"))
    return runs.select(RUN).join(a, RUN, "left").join(b, RUN, "left").fillna(0).withColumn("exportable", F.col("row_count") > 0)


def reading_order(df: DataFrame) -> DataFrame:
    return df.orderBy(RUN, "chapter_index", "row_no")


