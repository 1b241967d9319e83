"""Appearance histories: how often a key occurs in each chapter, and the analytic functions over that.

Every function takes `keys`, the columns that make the key within a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import DIMENSIONS

RUN = "run_id"


def by_chapter(facts: DataFrame, keys: list[str]) -> DataFrame:
    """run_id, keys.., chapter_index, occ."""
    return facts.groupBy(RUN, *keys, "chapter_index").agg(F.count("*").alias("occ"))


def span(track: DataFrame, keys: list[str]) -> DataFrame:
    """run_id, keys.., total, first_chapter, last_chapter, chapter_count, chapters."""
    return track.groupBy(RUN, *keys).agg(
        F.sum("occ").alias("total"),
        F.min("chapter_index").alias("first_chapter"),
        F.max("chapter_index").alias("last_chapter"),
        F.count("*").alias("chapter_count"),
        F.sort_array(F.collect_list("chapter_index")).alias("chapters"),
    )


def running(track: DataFrame, keys: list[str]) -> DataFrame:
    """track with cumulative, previous_chapter, next_chapter and gap_before, over chapters where the key occurs."""
    w = Window.partitionBy(RUN, *keys).orderBy("chapter_index")
    lag = F.lag("chapter_index").over(w)
    return track.select(
        "*",
        F.sum("occ").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        lag.alias("previous_chapter"),
        F.lead("chapter_index").over(w).alias("next_chapter"),
        (F.col("chapter_index") - lag).alias("gap_before"),
    )


def dense(track: DataFrame, keys: list[str], chapters: DataFrame) -> DataFrame:
    """Every key in every chapter of its run: occ (0 where absent), cumulative, previous_chapter, next_chapter.

    previous and next are the nearest chapters with the key strictly before and after. The result has keys x
    chapters rows, so give it a coarse key.
    """
    grid = track.select(RUN, *keys).distinct().join(chapters.select(RUN, "chapter_index"), RUN)
    filled = grid.join(track, [RUN, *keys, "chapter_index"], "left")
    w = Window.partitionBy(RUN, *keys).orderBy("chapter_index")
    here = F.when(F.col("occ").isNotNull(), F.col("chapter_index"))
    return filled.select(
        RUN, *keys, "chapter_index",
        F.coalesce("occ", F.lit(0)).alias("occ"),
        F.coalesce(F.sum("occ").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("cumulative"),
        F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_chapter"),
        F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_chapter"),
    )


def stated(decoded: DataFrame, *keep: str) -> DataFrame:
    """One row per token and dimension it states: run_id, chapter_index, keep.., dimension, value."""
    pairs = F.explode(F.filter(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS)), lambda p: p["value"].isNotNull()))
    return decoded.select(RUN, "chapter_index", *keep, pairs.alias("p")).select(RUN, "chapter_index", *keep, "p.dimension", "p.value")


def readings(pairs: DataFrame) -> DataFrame:
    """stated() with a row for each reading of a value."""
    return pairs.withColumn("value", F.explode(F.split("value", r"\|")))


def chapter_stats(facts: DataFrame) -> DataFrame:
    """run_id, chapter_index, token_count, unique_lemmas, unique_forms (lemma and form)."""
    counts = facts.groupBy(RUN, "chapter_index", "lemma", "form").agg(F.count("*").alias("n"))
    lemmas = counts.groupBy(RUN, "chapter_index", "lemma").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
    return lemmas.groupBy(RUN, "chapter_index").agg(F.sum("n").alias("token_count"), F.count("*").alias("unique_lemmas"), F.sum("forms").alias("unique_forms"))


def totals(facts: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per run: tokens, lemmas, forms (lemma and form), parses (lemma and parse), chapters."""
    pairs = facts.groupBy(RUN, "lemma", "form", "parse").agg(F.count("*").alias("n"))
    per_run = pairs.groupBy(RUN).agg(F.sum("n").alias("tokens"), F.count_distinct("lemma").alias("lemmas"), F.count_distinct("lemma", "form").alias("forms"), F.count_distinct("lemma", "parse").alias("parses"))
    return per_run.join(chapters.groupBy(RUN).agg(F.count("*").alias("chapters")), RUN)
