"""The lexicon lens: a run measured against a ranked word list.

The list and its aliases are small beside the facts and are joined to the distinct lemmas, never to the facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import fold_key, is_proper, match_key, safe_share
from ..functions.vocab import MATCHES
from ..session import cut, small
from .lemma import dominant_type
from .tracks import RUN, by_chapter

Key = Callable[[Column], Column]
BAND, GAPS, OFF_LIST = 500, 200, 200


def keyed(entries: DataFrame, reference_tokens: int | Column, match: Key = match_key, fold: Key = fold_key) -> DataFrame:
    """entries with match_key, fold_key and ref_share; null glosses and counts read as '' and 0, null lemmas are left out."""
    some = entries.where(F.col("lemma").isNotNull()).select("rank", "lemma", F.coalesce("gloss", F.lit("")).alias("gloss"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("ref_count", F.lit(0)).alias("ref_count"))
    whole = reference_tokens if isinstance(reference_tokens, Column) else F.lit(reference_tokens)
    return some.select("*", match(F.col("lemma")).alias("match_key"), fold(F.col("lemma")).alias("fold_key"), safe_share(F.col("ref_count"), whole).alias("ref_share"))


def resolve_aliases(aliases: DataFrame, entries: DataFrame, match: Key = match_key) -> DataFrame:
    """match_key (of the variant), rank: aliases whose headword is on the list, each pair once; others are dropped."""
    heads = aliases.dropna(subset=["variant", "lemma"]).select(match(F.col("variant")).alias("k"), match(F.col("lemma")).alias("h"))
    listed = entries.select(F.col("match_key").alias("h"), "rank")
    return heads.join(listed, "h").select(F.col("k").alias("match_key"), "rank").distinct()


def lookup(lemmas: DataFrame, entries: DataFrame, aliases: DataFrame, match: Key = match_key, fold: Key = fold_key) -> DataFrame:
    """lemma, rank, how (exact, alias, folded), ambiguous: all entries of the first layer that has any.

    lemmas: one distinct column; lemmas without a match are absent. ambiguous: the key has more than one entry.
    """
    words = cut(lemmas.select("lemma", match(F.col("lemma")).alias("m"), fold(F.col("lemma")).alias("f")), "keys")  # once, not in each layer
    listed = entries.select("rank", "match_key", "fold_key")
    aliased = cut(resolve_aliases(aliases, entries, match).withColumnRenamed("match_key", "m"), "aliases")
    layers = (
        words.join(small(listed.select(F.col("match_key").alias("m"), "rank")), "m").select("lemma", "rank", F.lit(0).alias("layer"))
        .unionByName(words.join(small(aliased), "m").select("lemma", "rank", F.lit(1).alias("layer")))
        .unionByName(words.join(small(listed.select(F.col("fold_key").alias("f"), "rank")), "f").select("lemma", "rank", F.lit(2).alias("layer")))
    )
    best = F.min("layer").over(Window.partitionBy("lemma"))
    first = layers.withColumn("best", best).where("layer = best")
    how = F.array(*map(F.lit, MATCHES))[F.col("layer")]
    return first.select("lemma", "rank", how.alias("how"), (F.count("*").over(Window.partitionBy("lemma")) > 1).alias("ambiguous"))


def place(facts: DataFrame, matches: DataFrame) -> DataFrame:
    """Each run's lemmas per chapter with their lot: run_id, lemma, chapter_index, occ, lot (on, off, proper).

    A lemma is tested for being a name only after the list does not have it.
    """
    track = by_chapter(facts, ["lemma"])
    hit = matches.select("lemma").distinct().withColumn("on", F.lit(True))
    lot = F.when(F.col("on"), "on").when(is_proper(F.col("lemma")), "proper").otherwise("off")
    return track.join(hit, "lemma", "left").select(RUN, "lemma", "chapter_index", "occ", lot.alias("lot"))


def entry_rows(placed: DataFrame, matches: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Every entry for every run, by rank: occ, first_chapter, chapter_count, chapters, matched_by, ambiguous, source_lemma.

    A lemma credits every entry of its key. chapters lists (chapter_index, occ) where the entry occurs.
    """
    used = placed.where("lot = 'on'").join(matches, "lemma")
    strength = F.array_position(F.array(*map(F.lit, MATCHES)), F.col("how")).cast("int")
    per_chapter = used.groupBy(RUN, "rank", "chapter_index").agg(F.sum("occ").alias("occ"))
    spans = per_chapter.groupBy(RUN, "rank").agg(F.sum("occ").alias("occ"), F.min("chapter_index").alias("first_chapter"), F.count("*").alias("chapter_count"), F.sort_array(F.collect_list(F.struct("chapter_index", "occ"))).alias("chapters"))
    sources = used.groupBy(RUN, "rank", "lemma").agg(F.sum("occ").alias("n"), F.min(strength).alias("strength"), F.bool_or("ambiguous").alias("ambiguous"))
    credit = sources.groupBy(RUN, "rank").agg(F.array(*map(F.lit, MATCHES))[F.min("strength") - 1].alias("matched_by"), F.bool_or("ambiguous").alias("ambiguous"), F.min_by("lemma", F.struct(-F.col("n"), "lemma")).alias("source_lemma"))
    # only ranks go through the exchange; what an entry is comes last
    few = small(entries)
    listed = few.select("rank", F.col("lemma").alias("entry"), "gloss", "kind", "ref_share")
    grid = runs.select(RUN).crossJoin(few.select("rank"))
    none = F.expr("cast(array() as array<struct<chapter_index:int,occ:bigint>>)")
    return grid.join(spans.join(credit, [RUN, "rank"]), [RUN, "rank"], "left").join(listed, "rank").select(
        RUN, "rank", F.col("entry").alias("lemma"), "gloss", "kind", "ref_share", F.coalesce("occ", F.lit(0)).alias("occ"), "first_chapter", F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
        F.coalesce("chapters", none).alias("chapters"), F.coalesce("matched_by", F.lit("")).alias("matched_by"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("source_lemma", F.lit("")).alias("source_lemma"),
    )


def summary(placed: DataFrame, rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per run: entries, covered, shares of the reference, tokens on the list, off it and names."""
    hit = F.col("occ") > 0
    listed = rows.groupBy(RUN).agg(F.count("*").alias("entries"), F.count_if(hit).alias("covered"), F.sum(F.when(hit, F.col("ref_share")).otherwise(0.0)).alias("ref_share_covered"), F.sum("ref_share").alias("ref_share_total"))
    lots = placed.groupBy(RUN).agg(F.sum("occ").alias("tokens"), *(F.sum(F.when(F.col("lot") == k, F.col("occ")).otherwise(0)).alias(n) for k, n in (("on", "tokens_on_list"), ("off", "tokens_off_list"), ("proper", "tokens_proper"))))
    out = listed.join(lots, RUN).join(chapters.groupBy(RUN).agg(F.count("*").alias("chapter_count")), RUN)
    return out.withColumn("covered_share", safe_share(F.col("covered"), F.col("entries"))).withColumn("on_list_share", safe_share(F.col("tokens_on_list"), F.col("tokens")))


def bands(rows: DataFrame, size: int = BAND) -> DataFrame:
    """Per run and band of ranks that has entries: start, end (the last one cut at the highest rank), entries, covered, shares."""
    hit, band = F.col("occ") > 0, F.floor((F.col("rank") - 1) / size)
    sums = rows.groupBy(RUN, band.cast("int").alias("band")).agg(F.count("*").alias("entries"), F.count_if(hit).alias("covered"), F.sum("ref_share").alias("ref_share"), F.sum(F.when(hit, F.col("ref_share")).otherwise(0.0)).alias("ref_share_covered"), F.max("rank").alias("top"))
    highest = F.max("top").over(Window.partitionBy(RUN))
    return sums.select(RUN, (F.col("band") * size + 1).alias("start"), F.least((F.col("band") + 1) * size, highest).alias("end"), "entries", "covered", "ref_share", "ref_share_covered")


def progress(placed: DataFrame, rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per chapter, all of them: entries and reference share that it teaches first and so far; tokens and new types by lot."""
    taught = rows.where("occ > 0").groupBy(RUN, F.col("first_chapter").alias("chapter_index")).agg(F.count("*").alias("new_entries"), F.sum("ref_share").alias("new_ref_share"))
    first = placed.withColumn("new", F.col("chapter_index") == F.min("chapter_index").over(Window.partitionBy(RUN, "lemma")))
    occ = lambda cond, name: F.sum(F.when(cond, F.col("occ")).otherwise(0)).alias(name)
    on, new = F.col("lot") == "on", F.col("new")
    lots = first.groupBy(RUN, "chapter_index").agg(
        F.sum("occ").alias("tokens"), occ(on, "tokens_on_list"), occ(F.col("lot") == "off", "tokens_off_list"), occ(F.col("lot") == "proper", "tokens_proper"),
        F.count_if(on & new).alias("new_on_list_types"), F.count_if(~on & new).alias("new_off_list_types"), occ(on & new, "new_on_list_tokens"), occ(~on & new, "new_off_list_tokens"),
    )
    w = Window.partitionBy(RUN).orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, 0)
    filled = chapters.select(RUN, "chapter_index").join(taught, [RUN, "chapter_index"], "left").join(lots, [RUN, "chapter_index"], "left").fillna(0)
    return filled.select("*", F.sum("new_entries").over(w).alias("cumulative_entries"), F.sum("new_ref_share").over(w).alias("cumulative_ref_share"), (F.col("tokens_off_list") + F.col("tokens_proper")).alias("tokens_off_list_with_names"))


def gaps(rows: DataFrame, limit: int = GAPS) -> DataFrame:
    """Per run the first entries by rank that it never uses, and their total."""
    w = Window.partitionBy(RUN).orderBy("rank")
    missing = rows.where("occ = 0").select(RUN, "rank", "lemma", "gloss", "kind", "ref_share", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy(RUN)).alias("total"))
    return missing.where(F.col("place") <= limit)


def off_list(facts: DataFrame, placed: DataFrame, limit: int = OFF_LIST) -> DataFrame:
    """Per run the most frequent lemmas off the list, names too: occ, type, proper, first chapter, place, total."""
    rest = placed.where("lot <> 'on'").groupBy(RUN, "lemma").agg(F.sum("occ").alias("occ"), F.min("chapter_index").alias("first_chapter"), F.count("*").alias("chapter_count"), F.max(F.col("lot") == "proper").alias("proper"))
    w = Window.partitionBy(RUN).orderBy(F.desc("occ"), "lemma")
    top = rest.select("*", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy(RUN)).alias("total")).where(F.col("place") <= limit)
    return top.join(dominant_type(facts.join(top.select(RUN, "lemma"), [RUN, "lemma"], "left_semi"), [RUN, "lemma"]), [RUN, "lemma"])


def match_audit(placed: DataFrame, matches: DataFrame) -> DataFrame:
    """Per run how its lemmas found the list: counts by layer, ambiguous ones, and what stayed out."""
    words = placed.groupBy(RUN, "lemma", "lot").agg(F.sum("occ").alias("occ"))
    how = matches.groupBy("lemma").agg(F.first("how").alias("how"), F.bool_or("ambiguous").alias("ambiguous"))
    joined = words.join(how, "lemma", "left")
    n = lambda cond, name: F.count_if(cond).alias(name)
    lot, is_ = F.col("lot"), F.col("how")
    tokens = lambda k, name: F.sum(F.when(lot == k, F.col("occ")).otherwise(0)).alias(name)
    return joined.groupBy(RUN).agg(
        F.count("*").alias("text_lemmas"), n(lot == "on", "matched_lemmas"), *(n(is_ == m, m) for m in MATCHES), n(F.coalesce("ambiguous", F.lit(False)), "ambiguous"),
        n(lot == "off", "unmatched_lemmas"), tokens("off", "unmatched_tokens"), n(lot == "proper", "proper_lemmas"), tokens("proper", "proper_tokens"), tokens("on", "tokens_on_list"), F.sum("occ").alias("tokens"),
    )


def core_list(entries: DataFrame, kinds: tuple[str, ...] = ("L", "F")) -> DataFrame:
    """The entries of known kind with the columns a list has. Raises, once it is run, if ranks of entries have holes or lemmas repeat."""
    some = entries.where(F.col("lemma").isNotNull())
    sound = some.agg(F.count("*").alias("n"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("lemma").alias("lemmas"))
    fault = F.when((F.col("ranks") != F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n")), "the ranks have holes").when(F.col("lemmas") != F.col("n"), "a lemma is listed twice")
    checked = some.crossJoin(F.broadcast(sound.select(fault.alias("fault"))))
    rank = F.when(F.col("fault").isNull(), F.col("rank")).otherwise(F.raise_error(F.col("fault")).cast("int"))
    return checked.where(F.col("kind").isin(*kinds)).select(rank.alias("rank"), "lemma", F.coalesce("gloss", F.lit("")).alias("gloss"), "kind", "ref_count", "ref_coverage")


def frequency_list(facts: DataFrame, kinds: dict[str, str], glosses: DataFrame, match: Key = match_key) -> DataFrame:
    """A ranked list from a token stream: rank, lemma, gloss, kind, ref_count, ref_coverage (cumulative percent).

    `x(y)` is listed as xy. Ranked by count, then lemma; kind follows from the dominant type; the gloss is that of
    the best ranked entry of glosses (rank, match_key, gloss) under the same key.
    """
    full = F.regexp_replace("lemma", r"\(([^)]*)\)", "$1")
    words = facts.withColumn("lemma", full).groupBy("lemma", "type").agg(F.count("*").alias("n"), F.min(F.struct(RUN, "chapter_index", "position")).alias("seen"))
    counts = words.groupBy("lemma").agg(F.sum("n").alias("ref_count"), F.min_by("type", F.struct(-F.col("n"), "seen")).alias("type"))
    named = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    best = glosses.where("gloss is not null and gloss <> ''").groupBy("match_key").agg(F.min_by("gloss", "rank").alias("gloss"))
    glossed = counts.withColumn("match_key", match(F.col("lemma"))).join(small(best), "match_key", "left")
    ranked = _ranks(glossed)
    return ranked.select("rank", "lemma", F.coalesce("gloss", F.lit("")).alias("gloss"), F.coalesce(F.try_element_at(named, F.col("type")), F.lit("")).alias("kind"), "ref_count", F.round(100 * F.col("running") / F.col("everything"), 4).alias("ref_coverage"))


def _ranks(counts: DataFrame) -> DataFrame:
    """rank and running by (-ref_count, lemma), without a window over many words: words are put into ranges of that order,
    each range is numbered by itself, and what precedes a range comes from a table of ranges."""
    ranged = counts.repartitionByRange(F.desc("ref_count"), "lemma").sortWithinPartitions(F.desc("ref_count"), "lemma")
    # an id is the number of its range, then that of its row in it; written, since a range is no longer one when it is made again
    stored = cut(ranged.withColumn("id", F.monotonically_increasing_id()), "ranked").withColumn("range", F.shiftright("id", 33))
    per = stored.groupBy("range").agg(F.count("*").alias("words"), F.sum("ref_count").alias("tokens"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("range", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("words_before"), F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("tokens_before"))
    total = per.agg(F.sum("tokens").alias("everything"))
    so_far = F.sum("ref_count").over(Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    placed = stored.withColumn("so_far", so_far).join(small(before), "range").crossJoin(F.broadcast(total))
    at = F.col("id") - F.shiftleft("range", 33) + 1
    return placed.withColumn("rank", (F.col("words_before") + at).cast("int")).withColumn("running", F.col("tokens_before") + F.col("so_far"))
