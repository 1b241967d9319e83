"""The chapter lens: what each chapter holds, word by word, with running totals over the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracks import RUN, chapter_stats


def form_counts(facts: DataFrame) -> DataFrame:
    """run, chapter, lemma, parse, form with occ, first position and the type met there. The grain that all else sums."""
    return facts.groupBy(RUN, "chapter_index", "lemma", "parse", "form").agg(F.count("*").alias("occ"), F.min("position").alias("first_position"), F.min_by("type", "position").alias("type"))


def rows(facts: DataFrame) -> DataFrame:
    """One row per chapter, lemma and parse, in order of first position (column row_no, from 0).

    type of the first token; forms ranked by count, then first position; the first of them is `form`, whose
    span covers every parse of (lemma, form).
    """
    # one exchange by lemma serves every window and group but the last; the counts before it are combined within tasks
    forms = form_counts(facts).repartition(RUN, "lemma")
    in_form = Window.partitionBy(RUN, "lemma", "form")
    spanned = forms.select("*", F.min("chapter_index").over(in_form).alias("a"), F.max("chapter_index").over(in_form).alias("b"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("occ")).alias("n"), "first_position", "form", "a", "b")))
    grouped = spanned.groupBy(RUN, "chapter_index", "lemma", "parse").agg(F.sum("occ").alias("parse_occ"), F.min("first_position").alias("first_position"), F.min_by("type", "first_position").alias("type"), ranked.alias("r"))
    in_lemma = Window.partitionBy(RUN, "lemma").orderBy("chapter_index")
    in_parse = Window.partitionBy(RUN, "lemma", "parse").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, 0)
    whole_lemma, whole_parse = Window.partitionBy(RUN, "lemma"), Window.partitionBy(RUN, "lemma", "parse")
    here = Window.partitionBy(RUN, "lemma", "chapter_index")
    first = F.col("r")[0]
    joined = grouped.select(
        "*",
        first["form"].alias("form"),
        (-first["n"]).alias("form_occ"),
        first["a"].alias("form_first_chapter"),
        first["b"].alias("form_last_chapter"),
        F.sum("parse_occ").over(here).alias("lemma_occ"),
        F.sum("parse_occ").over(in_lemma.rangeBetween(Window.unboundedPreceding, 0)).alias("lemma_cum"),
        F.sum("parse_occ").over(in_parse).alias("parse_cum"),
        F.min("chapter_index").over(whole_lemma).alias("lemma_first_chapter"),
        F.max("chapter_index").over(whole_lemma).alias("lemma_last_chapter"),
        F.min("chapter_index").over(whole_parse).alias("parse_first_chapter"),
        F.max("chapter_index").over(whole_parse).alias("parse_last_chapter"),
    )
    chapter = F.col("chapter_index")
    return joined.select(
        RUN, "chapter_index", (F.row_number().over(Window.partitionBy(RUN, "chapter_index").orderBy("first_position")) - 1).alias("row_no"),
        "type", "lemma", "form", "parse", "lemma_occ", "parse_occ", "form_occ", "lemma_cum", "parse_cum",
        F.transform("r", lambda x: F.struct(x["form"].alias("form"), (-x["n"]).alias("occ"), x["first_position"].alias("first_position"))).alias("forms"),
        "lemma_first_chapter", "lemma_last_chapter", "parse_first_chapter", "parse_last_chapter", "form_first_chapter", "form_last_chapter",
        (F.col("lemma_first_chapter") == chapter).alias("first_occ_lemma"), (F.col("parse_first_chapter") == chapter).alias("first_occ_parse"),
        (F.col("lemma_last_chapter") == chapter).alias("last_occ_lemma"), (F.col("parse_last_chapter") == chapter).alias("last_occ_parse"),
    )


def summaries(facts: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every chapter with its labels and counts; zeros for those without words, labels made up for those without a name."""
    joined = chapters.join(chapter_stats(facts), [RUN, "chapter_index"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    made_up = F.concat(F.lit("ch-"), (F.col("chapter_index") + 1).cast("string"))
    return joined.select(RUN, "chapter_index", F.coalesce("id", made_up).alias("id"), F.coalesce("title", F.lit("")).alias("title"), zero("token_count"), zero("unique_lemmas"), zero("unique_forms"))


def files(chapters: DataFrame) -> DataFrame:
    """Stretches of chapters from one file: a file that comes back later makes a new stretch."""
    w = Window.partitionBy(RUN).orderBy("chapter_index")
    turn = ~F.col("filename").eqNullSafe(F.lag("filename").over(w)) | (F.row_number().over(w) == 1)
    island = F.sum(turn.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return chapters.withColumn("file_no", island).groupBy(RUN, "file_no", "filename").agg(F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), F.count("*").alias("chapters"))
