"""The lemma lens: everything about one word, for every word of a run or for chosen ones.

All functions take facts that may be narrowed to some lemmas first, except `concordance`, which needs the
neighbours of a word as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small
from .facts import BLOCK
from .tracks import RUN, by_chapter, running

WORD = [RUN, "lemma"]


def _first() -> Column:
    return F.struct("chapter_index", "position")


def dominant_type(facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., type: the most frequent type, on ties the one seen first."""
    counts = facts.groupBy(*keys, "type").agg(F.count("*").alias("n"), F.min(_first()).alias("seen"))
    return counts.groupBy(*keys).agg(F.min_by("type", F.struct(-F.col("n"), "seen")).alias("type"))


def summary(facts: DataFrame) -> DataFrame:
    """type, total, parse, form and chapter counts, first and last chapter, longest gap (null with one chapter)."""
    counts = facts.groupBy(*WORD, "parse", "form").agg(F.count("*").alias("n"))
    sums = counts.groupBy(*WORD).agg(F.sum("n").alias("total"), F.count_distinct("parse").alias("parse_count"), F.count_distinct("form").alias("form_count"))
    track = running(by_chapter(facts, ["lemma"]), ["lemma"]).groupBy(*WORD).agg(F.count("*").alias("chapter_count"), F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), F.max("gap_before").alias("longest_gap"))
    return dominant_type(facts, WORD).join(sums, WORD).join(track, WORD)


def parses(facts: DataFrame) -> DataFrame:
    """Per parse of a lemma: type, occ, form, form_count, first and last chapter, and its place (-occ, parse)."""
    at = [*WORD, "parse"]
    forms = facts.groupBy(*at, "form").agg(F.count("*").alias("n"), F.min(_first()).alias("seen"), F.min("chapter_index").alias("a"), F.max("chapter_index").alias("b"))
    rows = forms.groupBy(*at).agg(F.sum("n").alias("occ"), F.min_by("form", F.struct(-F.col("n"), "seen")).alias("form"), F.count("*").alias("form_count"), F.min("a").alias("first_chapter"), F.max("b").alias("last_chapter"))
    place = F.row_number().over(Window.partitionBy(*WORD).orderBy(F.desc("occ"), "parse"))
    return rows.join(dominant_type(facts, at), at).withColumn("place", place)


def forms(facts: DataFrame) -> DataFrame:
    """Per form of a lemma: occ, its parses from the most frequent on, first and last chapter, and its place (-occ, form)."""
    counts = facts.groupBy(*WORD, "form", "parse").agg(F.count("*").alias("n"), F.min(_first()).alias("seen"), F.min("chapter_index").alias("a"), F.max("chapter_index").alias("b"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "seen", "parse"))), lambda x: x["parse"])
    rows = counts.groupBy(*WORD, "form").agg(F.sum("n").alias("occ"), listed.alias("parses"), F.min("a").alias("first_chapter"), F.max("b").alias("last_chapter"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*WORD).orderBy(F.desc("occ"), "form")))


def in_chapters(facts: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every chapter of the run for every lemma in facts: occ, cumulative, gap_before, parses by count.

    gap_before is null where the lemma is absent or new. lemmas x chapters rows: narrow facts to the lemmas asked for.
    """
    counts = facts.groupBy(*WORD, "chapter_index", "parse").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p", "parse"))), lambda x: F.struct(x["parse"].alias("parse"), (-x["n"]).alias("occ")))
    here = counts.groupBy(*WORD, "chapter_index").agg(F.sum("n").alias("occ"), listed.alias("parses"))
    w = Window.partitionBy(*WORD).orderBy("chapter_index")
    here = here.withColumn("gap_before", F.col("chapter_index") - F.lag("chapter_index").over(w))
    grid = here.select(*WORD).distinct().join(chapters.select(RUN, "chapter_index"), RUN)
    filled = grid.join(here, [*WORD, "chapter_index"], "left")
    total = F.coalesce(F.sum("occ").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    none = F.expr("cast(array() as array<struct<parse:string,occ:bigint>>)")
    return filled.select(*WORD, "chapter_index", F.coalesce("occ", F.lit(0)).alias("occ"), total.alias("cumulative"), "gap_before", F.coalesce("parses", none).alias("parses"))


def concordance(facts: DataFrame, wanted: DataFrame, context: int = 6, limit: int | None = 400, chapter_index: int | None = None, by_chapter: bool = False) -> DataFrame:
    """The places of the wanted words (run_id, lemma) in reading order, with up to `context` forms before and after.

    line counts from 1 within a word; total is the number of places in scope, beside the first `limit`. Places are numbered and
    limited first, so contexts are made in chapters that hold one of those only: in blocks of positions, so that no chapter is
    too long for a task; what a block lacks at its ends comes from the blocks around it. Contexts end with the chapter; with
    none (0) nothing is sorted but the places. chapter_index narrows the places, not the contexts. by_chapter gives what that
    gives for every chapter: line, total and limit count within a word and chapter.
    """
    at, whole, place = [RUN, "chapter_index", "block"], [RUN, "chapter_index"], [RUN, "chapter_index", "position"]
    scoped = facts if chapter_index is None else facts.where(F.col("chapter_index") == chapter_index)
    scope = [*WORD, *["chapter_index"] * by_chapter]
    found = scoped.join(wanted.select(*WORD), WORD, "left_semi").select(*place, "lemma", "form", "parse")
    totals_ = found.groupBy(*scope).agg(F.count("*").alias("total"))
    lines = found.withColumn("line", F.row_number().over(Window.partitionBy(*scope).orderBy("chapter_index", "position")))
    kept = (lines if limit is None else lines.where(F.col("line") <= limit)).join(totals_, scope)
    columns = [*place, "lemma", "form", "parse", "before", "after", "line", "total"]
    if context == 0:
        none = F.array().cast("array<string>")
        return kept.select("*", none.alias("before"), none.alias("after")).select(*columns)
    kept = cut(kept, "places")
    w = Window.partitionBy(*at).orderBy("position")
    forms = lambda a, b: F.collect_list("form").over(w.rowsBetween(a, b))
    wide = scoped.withColumn("block", F.floor(F.col("position") / BLOCK)).join(small(kept.select(*whole).distinct()), whole, "left_semi")
    around = wide.select(*at, "position", "form", forms(-context, -1).alias("before"), forms(1, context).alias("after"))
    tail, head = F.concat("before", F.array("form")), F.concat(F.array("form"), "after")
    edges = around.groupBy(*at).agg(F.max_by(tail, "position").alias("tail"), F.min_by(head, "position").alias("head"))
    blocks = Window.partitionBy(*whole).orderBy("block")
    carried = edges.select(*at, F.flatten(F.collect_list("tail").over(blocks.rowsBetween(-context, -1))).alias("left"), F.flatten(F.collect_list("head").over(blocks.rowsBetween(1, context))).alias("right"))
    last = lambda a: F.slice(a, F.greatest(F.size(a) - context, F.lit(0)) + 1, context)
    shown = small(kept.withColumn("block", F.floor(F.col("position") / BLOCK))).join(around.drop("form"), [*at, "position"]).join(carried, at)
    return shown.withColumns({"before": last(F.concat("left", "before")), "after": F.slice(F.concat("after", "right"), 1, context)}).select(*columns)


def totals(facts: DataFrame, wanted: DataFrame, chapter_index: int | None = None) -> DataFrame:
    """Places of each wanted word in scope, 0 where there is none."""
    scoped = facts if chapter_index is None else facts.where(F.col("chapter_index") == chapter_index)
    counts = scoped.join(wanted.select(*WORD), WORD, "left_semi").groupBy(*WORD).agg(F.count("*").alias("total"))
    return wanted.select(*WORD).join(counts, WORD, "left").fillna(0, ["total"])


def chapter_totals(facts: DataFrame, wanted: DataFrame, chapters: DataFrame) -> DataFrame:
    """Places of each wanted word in every chapter of its run, 0 where there is none."""
    counts = facts.join(wanted.select(*WORD), WORD, "left_semi").groupBy(*WORD, "chapter_index").agg(F.count("*").alias("total"))
    asked = wanted.select(*WORD).join(chapters.select(RUN, "chapter_index"), RUN)
    return asked.join(counts, [*WORD, "chapter_index"], "left").fillna(0, ["total"])
