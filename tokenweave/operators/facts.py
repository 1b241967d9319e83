"""The base tables: facts (one row per word occurrence) and chapters (with those that have no words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .repeats import thin_repeats

KEY = ["run_id", "chapter_index", "position"]
PLACE = ["filename", "chapter_id", "chapter_title"]
WORD = ["type", "lemma", "form", "parse"]
#: Positions of one chapter that share a partition; longer chapters are spread over several.
BLOCK = 1 << 16


def unique(rows: DataFrame) -> DataFrame:
    """Rows that repeat a key once. One shuffle, by blocks of chapters: it keeps neighbours together and
    splits a chapter of any size. Which of several unlike rows of a key stays is not settled."""
    blocked = thin_repeats(rows, KEY)[0].withColumn("__block", F.floor(F.col("position") / BLOCK))
    return blocked.repartition("run_id", "chapter_index", "__block").dropDuplicates([*KEY, "__block"]).drop("__block")


def clean_facts(rows: DataFrame, *columns: str) -> DataFrame:
    """Unique facts with the key and `columns` (all, if none is named); a null word column reads as ''."""
    wanted = list(columns) or [*PLACE, *WORD]
    once = unique(rows.select(*KEY, *wanted))
    return once.select(*KEY, *(F.coalesce(c, F.lit("")).alias(c) if c in WORD else F.col(c) for c in wanted))


def load_facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return clean_facts(table(spark, sf_dir, "token_facts"), *columns)


def chapter_refs(facts_rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """run_id, chapter_index, id, title, filename: the chapters of texts, and those that only facts know.

    A chapter known from facts takes the labels of its first word.
    """
    known = facts_rows.groupBy("run_id", "chapter_index").agg(F.min_by(F.struct(F.col("chapter_id").alias("id"), F.col("chapter_title").alias("title"), "filename"), "position").alias("r")).select("run_id", "chapter_index", "r.*")
    if texts is None:
        return known
    named = texts.select("run_id", "chapter_index", F.col("chapter_id").alias("id"), "title", "filename").dropDuplicates(["run_id", "chapter_index"])
    return named.unionByName(known.join(named, ["run_id", "chapter_index"], "left_anti"))


def load_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapter_refs(table(spark, sf_dir, "token_facts").select(*KEY, *PLACE), table(spark, sf_dir, "text_chapters"))
