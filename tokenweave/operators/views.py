"""Re-scoped and re-shaped views over the reports: sorting, search, grouping, shares, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import safe_share, search_fold_of, search_fold
from .tracks import RUN

WINDOWS = {"500": 500, "1000": 1000, "2000": 2000, "all": None}


def sort_rows(df: DataFrame, column: str, kind: str, descending: bool = False) -> DataFrame:
    """df sorted by one column: num (null as 0), bool (null as false) or text (base letters: case and accents aside)."""
    c = F.col(f"`{column}`")
    key = {"num": F.coalesce(c, F.lit(0)), "bool": F.coalesce(c, F.lit(False)), "text": F.collate(F.coalesce(c.cast("string"), F.lit("")), "UNICODE_CI_AI")}[kind]
    return df.orderBy(key.desc() if descending else key.asc())


def percent(share: Column) -> Column:
    """A share as text with one decimal, none for 0 and 1."""
    whole = (share == 0) | (share == 1)
    return F.concat(F.when(whole, F.format_string("%.0f", share * 100)).otherwise(F.format_string("%.1f", share * 100)), F.lit("%"))


def chapter_combinations(inventory: DataFrame, counts: DataFrame, chapters: DataFrame) -> DataFrame:
    """The inventory in every chapter: occ and cumulative (0 before it is met), is_new, and the tokens of its class there."""
    grid = chapters.select(RUN, "chapter_index").join(inventory.select(RUN, "form_class", "signature", "order", "first_chapter"), RUN)
    rows = grid.join(counts, [RUN, "chapter_index", "order"], "left").fillna(0, ["occ", "cumulative"])
    w = Window.partitionBy(RUN, "chapter_index", "form_class")
    return rows.select(
        RUN, "chapter_index", "form_class", "order", "signature", "occ", "cumulative",
        is_new(F.col("first_chapter"), F.col("chapter_index"), F.col("occ")).alias("is_new"), F.sum("occ").over(w).alias("class_tokens"), F.sum("cumulative").over(w).alias("class_tokens_cumulative"),
    )


def is_new(first_chapter: Column, chapter_index: Column, occ: Column) -> Column:
    return F.coalesce((first_chapter == chapter_index) & (occ > 0), F.lit(False))


def present(rows: DataFrame, show_absent: bool = False) -> DataFrame:
    return rows if show_absent else rows.where("occ > 0")


def coverage_warning(coverage: DataFrame) -> DataFrame:
    """coverage with warn: labels need attention, or more than 5 % of verb forms lack a voice."""
    return coverage.withColumn("warn", (F.col("needs_attention") > 0) | (F.col("voice_gap_share") > 0.05))


def match_warning(audit: DataFrame) -> DataFrame:
    """audit with warn: less than 80 % of the tokens are on the list."""
    return audit.withColumn("warn", safe_share(F.col("tokens_on_list"), F.col("tokens")) < 0.8)


def progress_columns(progress: DataFrame) -> DataFrame:
    new = safe_share(F.col("new_types"), F.col("new_types") + F.col("repeated_types"))
    return progress.select("*", (F.col("new_tokens") + F.col("repeated_tokens")).alias("tokens"), new.alias("new_share"), percent(new).alias("new_percent"))


def search(rows: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """The first rows of each run whose lemma holds query, accents and case aside; total counts all that do.

    rows: run_id, lemma, total (its number of occurrences, the order of rows with the lemma).
    """
    sought = search_fold_of(query.strip())
    words = rows.select("lemma").distinct().withColumn("__f", search_fold(F.col("lemma")))
    hits = rows.join(words.where(F.contains("__f", F.lit(sought))), "lemma").drop("__f")
    w = Window.partitionBy(RUN)
    return hits.select("*", F.row_number().over(w.orderBy(F.desc("total"), "lemma")).alias("place"), F.count("*").over(w).alias("matches")).where(F.col("place") <= limit)


def group_concordance(lines: DataFrame, by: str) -> DataFrame:
    """Concordance lines with their group and its place: chapter and none by key, parse and form by size.

    by is chapter, parse, form or none; groups of one size stand in order of first appearance, lines in reading order.
    """
    key = {"chapter": F.col("chapter_index").cast("string"), "parse": F.col("parse"), "form": F.col("form"), "none": F.lit("")}[by]
    word, group = [RUN, "lemma"], [RUN, "lemma", "group_key"]
    keyed = lines.withColumn("group_key", key)
    sized = keyed.select("*", F.count("*").over(Window.partitionBy(*group)).alias("group_size"), F.min("line").over(Window.partitionBy(*group)).alias("group_first"))
    order = F.col("chapter_index") if by == "chapter" else F.struct(-F.col("group_size"), "group_first") if by in ("parse", "form") else F.lit(0)
    return sized.select("*", F.dense_rank().over(Window.partitionBy(*word).orderBy(order)).alias("group_place")).drop("group_first")


def scope_entries(entries: DataFrame, scope: int | Column | None) -> DataFrame:
    """Entries through chapter `scope` (None: the whole run; a column: that of the row): scope_occ, scope_here, scope_first, scope_chapters."""
    if scope is None:
        return entries.select("*", F.col("occ").alias("scope_occ"), F.lit(0).cast("long").alias("scope_here"), F.col("first_chapter").alias("scope_first"), F.col("chapter_count").alias("scope_chapters"))
    inside = F.filter("chapters", lambda c: c["chapter_index"] <= scope)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, c: n + c["occ"])
    return entries.withColumn("__in", inside).select(
        *entries.columns, total(F.col("__in")).alias("scope_occ"), total(F.filter("__in", lambda c: c["chapter_index"] == scope)).alias("scope_here"),
        F.get("__in", F.lit(0))["chapter_index"].alias("scope_first"), F.size("__in").cast("long").alias("scope_chapters"),
    )


def scope_summary(scoped: DataFrame, progress: DataFrame, scope: int | None) -> DataFrame:
    """Per run: entries, covered, max_occ in scope, and the tokens of the chapters in scope by lot."""
    rows = scoped.groupBy(RUN).agg(F.count("*").alias("entries"), F.count_if(F.col("scope_occ") > 0).alias("covered"), F.max("scope_occ").alias("max_occ"))
    inside = progress if scope is None else progress.where(F.col("chapter_index") <= scope)
    sums = inside.groupBy(RUN).agg(F.count("*").alias("chapters"), *(F.sum(c).alias(c) for c in ("tokens", "tokens_on_list", "tokens_off_list", "tokens_proper")))
    return rows.join(sums, RUN, "left").fillna(0)


def growth(progress: DataFrame, unit: str) -> DataFrame:
    """Per chapter the words on and off the list so far, by `types` or `tokens`, new against repeated.

    New types are those of the chapter itself; new tokens, like all totals, add up over the chapters.
    """
    w = Window.partitionBy(RUN).orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, 0)
    add = lambda c: F.sum(c).over(w)
    if unit == "types":
        on_new, off_new = F.col("new_on_list_types"), F.col("new_off_list_types")
        on_all, off_all = add("new_on_list_types"), add("new_off_list_types")
    else:
        on_new, off_new = add("new_on_list_tokens"), add("new_off_list_tokens")
        on_all, off_all = add("tokens_on_list"), add("tokens_off_list_with_names")
    return progress.select(
        RUN, "chapter_index", on_new.alias("on_new"), (on_all - on_new).alias("on_repeated"), off_new.alias("off_new"), (off_all - off_new).alias("off_repeated"),
        on_all.alias("on_all"), off_all.alias("off_all"), (on_all + off_all).alias("total"),
    )


def window_entries(scoped: DataFrame, window: str = "1000", show: str = "all") -> DataFrame:
    """The entries of a rank window (500, 1000, 2000, all), all of them or those met or unmet in scope."""
    rows = scoped if WINDOWS[window] is None else scoped.where(F.col("rank") <= WINDOWS[window])
    return {"all": rows, "met": rows.where("scope_occ > 0"), "unmet": rows.where("scope_occ = 0")}[show]


def match_label(rows: DataFrame) -> DataFrame:
    """rows with match_label: what is to be known of a match, '' for exact ones and entries not met in scope."""
    note = lambda cond, text: F.when(cond, F.lit(text))
    notes = F.concat_ws(" · ", note(F.col("ambiguous"), "ambiguous"), note(F.col("matched_by") == "alias", "alias"), note(F.col("matched_by") == "folded", "folded"))
    return rows.withColumn("match_label", F.when(F.col("scope_occ") == 0, "").otherwise(notes))


def bar_width(occ: Column, most: Column) -> Column:
    """Width in percent of a bar on a square-root scale, at least 2; null for 0."""
    return F.when(occ > 0, F.greatest(F.lit(2), F.floor(100 * F.sqrt(occ / most) + 0.5).cast("int")))


def chapter_labels(chapters: DataFrame) -> DataFrame:
    """short_label (from 1) and long_label, `n. title (file)`."""
    number = (F.col("chapter_index") + 1).cast("string")
    file = F.when(F.coalesce("filename", F.lit("")) != "", F.concat(F.lit(" ("), "filename", F.lit(")"))).otherwise("")
    return chapters.select(RUN, "chapter_index", number.alias("short_label"), F.concat(number, F.lit(". "), F.coalesce("title", F.lit("")), file).alias("long_label"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int = 10) -> DataFrame:
    """limit rows from offset on, in the given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_range(total: Column, offset: int, limit: int = 10) -> tuple[Column, Column, Column, Column]:
    """first, last (from 1; 0 for an empty list), whether there is a page before and after."""
    last = F.least(F.lit(offset + limit), total)
    return F.when(total > 0, offset + 1).otherwise(0), last, F.lit(offset > 0), last < total
