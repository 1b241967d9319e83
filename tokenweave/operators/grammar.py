"""Grammar: feature profiles filled against the vocabulary, the paradigm inventory, and the decode audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import DIMENSIONS, FORM_CLASSES, VALUES
from ..session import cut
from .tracks import RUN, dense, readings, span, stated


def vocabulary(like: DataFrame) -> DataFrame:
    """dimension, value, dimension_order, value_order: all values a label may state."""
    rows = [(d, v, i, k) for i, d in enumerate(DIMENSIONS) for k, v in enumerate(VALUES[d])]
    return like.sparkSession.createDataFrame(rows, "dimension string, value string, dimension_order int, value_order int")


def profile(decoded: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Each value of each dimension that the run states at all, with zeros for values it never has.

    Without chapters: per run value: occ = cumulative, first_chapter, last_chapter, chapter_count. With
    chapters: for every chapter, the count there and up to there; first, last and chapter_count are the run's.
    `stated` and `stated_cumulative` count tokens that state the dimension, which is not the sum of its rows.
    """
    # facts are grouped once, by all dimensions together; what follows reads that small table
    combined = cut(decoded.groupBy(RUN, "chapter_index", *DIMENSIONS).agg(F.count("*").alias("n")), "profile")
    said = stated(combined, "n")
    dims = said.groupBy(RUN, "dimension", "chapter_index").agg(F.sum("n").alias("occ"))
    values = readings(said).groupBy(RUN, "dimension", "value", "chapter_index").agg(F.sum("n").alias("occ"))
    whole = span(values, ["dimension", "value"]).drop("chapters")
    total = dims.groupBy(RUN, "dimension").agg(F.sum("occ").alias("stated"))
    grid = total.join(F.broadcast(vocabulary(decoded)), "dimension").join(whole, [RUN, "dimension", "value"], "left")
    zero = lambda c, name=None: F.coalesce(c, F.lit(0)).alias(name or c)
    if chapters is None:
        return grid.select(RUN, "dimension", "value", "dimension_order", "value_order", zero("total", "occ"), zero("total", "cumulative"), "first_chapter", "last_chapter", zero("chapter_count"), "stated", F.col("stated").alias("stated_cumulative"))
    per_value = dense(values, ["dimension", "value"], chapters).select(RUN, "dimension", "value", "chapter_index", "occ", "cumulative")
    per_dim = dense(dims, ["dimension"], chapters).select(RUN, "dimension", "chapter_index", F.col("occ").alias("stated"), F.col("cumulative").alias("stated_cumulative"))
    rows = grid.drop("stated", "total").join(per_dim, [RUN, "dimension"]).join(per_value, [RUN, "dimension", "value", "chapter_index"], "left")
    return rows.select(RUN, "chapter_index", "dimension", "value", "dimension_order", "value_order", zero("occ"), zero("cumulative"), "first_chapter", "last_chapter", zero("chapter_count"), "stated", "stated_cumulative")


def combinations(decoded: DataFrame) -> DataFrame:
    """Each combination of features per chapter: run_id, signature, form_class, sort_key, chapter_index, occ, p (the first position)."""
    return decoded.where("signature <> ''").groupBy(RUN, "signature", "form_class", "sort_key", "chapter_index").agg(F.count("*").alias("occ"), F.min("position").alias("p"))


def inventory(decoded: DataFrame) -> DataFrame:
    """Each combination of features of a run: form_class, signature, order (from 0), occ, first and last chapter, chapter_count.

    Paradigm order; combinations that tie stand in order of first appearance.
    """
    return inventory_of(combinations(decoded))


def inventory_of(track: DataFrame) -> DataFrame:
    """inventory() from combinations()."""
    whole = track.groupBy(RUN, "signature", "form_class", "sort_key").agg(F.sum("occ").alias("occ"), F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), F.count("*").alias("chapter_count"), F.min(F.struct("chapter_index", "p")).alias("seen"))
    place = F.row_number().over(Window.partitionBy(RUN).orderBy("sort_key", "seen")) - 1
    return whole.select(RUN, "form_class", "signature", place.alias("order"), "occ", F.col("occ").alias("cumulative"), "first_chapter", "last_chapter", "chapter_count")


def inventory_tables(decoded: DataFrame) -> DataFrame:
    """Per run and form class (in display order), and per run in all: forms and tokens. Empty classes are absent."""
    counts = inventory(decoded)
    rolled = counts.rollup(RUN, "form_class").agg(F.count("*").alias("forms"), F.sum("occ").alias("tokens")).where(F.col(RUN).isNotNull())
    shown = F.array_position(F.array(*map(F.lit, FORM_CLASSES)), F.col("form_class")).cast("int")
    return rolled.select(RUN, F.coalesce("form_class", F.lit("all")).alias("form_class"), F.coalesce(shown, F.lit(0)).alias("class_order"), "forms", "tokens")


def inventory_counts(decoded: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per chapter: order, occ and cumulative of the combinations met so far."""
    return counts_of(cut(combinations(decoded), "combinations"), chapters)


def counts_of(track: DataFrame, chapters: DataFrame) -> DataFrame:
    """inventory_counts() from combinations(): each combination in its chapters from the first on, no others."""
    listed = inventory_of(track).select(RUN, "signature", "order", "first_chapter")
    later = listed.join(chapters.select(RUN, "chapter_index"), RUN).where("chapter_index >= first_chapter")
    here = later.join(track.select(RUN, "signature", "chapter_index", "occ"), [RUN, "signature", "chapter_index"], "left").fillna(0, ["occ"])
    so_far = F.sum("occ").over(Window.partitionBy(RUN, "order").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, 0))
    return here.select(RUN, "chapter_index", "order", "occ", so_far.alias("cumulative"))


def coverage(decoded: DataFrame, by: list[str]) -> DataFrame:
    """How well labels were read, per run or chapter: eight counts and what follows from them."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    s = lambda v: F.col("status") == v
    counts = decoded.groupBy(*by).agg(
        F.count("*").alias("total"), n(s("ok"), "ok"), n(s("partial"), "partial"), n(s("descriptive"), "descriptive"), n(s("not_applicable"), "not_applicable"), n(s("unparsed"), "unparsed"),
        n(F.col("is_verb_form"), "verb_forms"), n(F.col("missing_voice"), "missing_voice"), n(F.col("is_deponent"), "deponents"),
    )
    understood, claimed = F.col("ok") + F.col("descriptive"), F.col("total") - F.col("not_applicable")
    return counts.select(
        "*",
        understood.alias("understood"),
        (F.col("partial") + F.col("unparsed")).alias("needs_attention"),
        claimed.alias("morphological"),
        F.when(claimed == 0, 1.0).otherwise(understood / claimed).alias("understood_share"),
        F.when(F.col("verb_forms") == 0, 0.0).otherwise(F.col("missing_voice") / F.col("verb_forms")).alias("voice_gap_share"),
    )
