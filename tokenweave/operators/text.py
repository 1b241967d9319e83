"""The text lens: the vocabulary of a whole run, and how much of each chapter is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import RUN, by_chapter

SEEN = ["chapter_index", "position"]


def vocabulary(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per run and key (lemma, or lemma and parse): type, form, total, form_count, first and last chapter, chapter_count.

    type is the first that is not empty in reading order; form the most frequent, on ties the one seen first.
    """
    at = F.struct(*SEEN)
    forms = facts.groupBy(RUN, *keys, "form").agg(F.count("*").alias("n"), F.min(at).alias("seen"), F.min(F.when(F.col("type") != "", F.struct(*SEEN, "type"))).alias("typed"))
    words = forms.groupBy(RUN, *keys).agg(F.sum("n").alias("total"), F.min_by("form", F.struct(-F.col("n"), "seen")).alias("form"), F.count("*").alias("form_count"), F.coalesce(F.min("typed")["type"], F.lit("")).alias("type"))
    spans = facts.groupBy(RUN, *keys, "chapter_index").agg(F.lit(1)).groupBy(RUN, *keys).agg(F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), F.count("*").alias("chapter_count"))
    return words.join(spans, [RUN, *keys]).select(RUN, *keys, "type", "form", "total", "form_count", "first_chapter", "last_chapter", "chapter_count")


def progress(facts: DataFrame, chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Per chapter, those without words too: new and repeated types and tokens at the grain of keys."""
    track = by_chapter(facts, keys)
    first = track.groupBy(RUN, *keys).agg(F.min("chapter_index").alias("first_chapter"))
    new = F.col("chapter_index") == F.col("first_chapter")
    counts = track.join(first, [RUN, *keys]).groupBy(RUN, "chapter_index").agg(
        F.count_if(new).alias("new_types"), F.count_if(~new).alias("repeated_types"),
        F.sum(F.when(new, F.col("occ")).otherwise(0)).alias("new_tokens"), F.sum(F.when(~new, F.col("occ")).otherwise(0)).alias("repeated_tokens"),
    )
    filled = chapters.select(RUN, "chapter_index").join(counts, [RUN, "chapter_index"], "left")
    return filled.fillna(0, ["new_types", "repeated_types", "new_tokens", "repeated_tokens"])
