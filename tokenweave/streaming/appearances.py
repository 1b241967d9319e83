"""Facts as they arrive: decoded on the way, deliveries of the same fact dropped, first appearances told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.morphology import with_morph

KEY = ["run_id", "chapter_index", "position"]


def read_facts(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(facts: DataFrame, time: str = "loaded_at", lateness: str = "7 days") -> DataFrame:
    """Each key once. A fact delivered again within `lateness` of the newest time is dropped; state older than that is let go."""
    return facts.withWatermark(time, lateness).dropDuplicatesWithinWatermark(KEY)


def first_appearances(facts: DataFrame, keys: tuple[str, ...] = ("lemma",)) -> DataFrame:
    """The fact with which each key of a run arrived first. Told at once and once; the state is the keys of all runs, which
    are far fewer than facts and are kept for good, since a key may come back after any time."""
    return facts.dropDuplicates(["run_id", *keys])


def decoded(facts: DataFrame) -> DataFrame:
    """Stateless decoding; labels are decoded per row, as a stream has no distinct."""
    return with_morph(facts)


def arrivals(facts: DataFrame, time: str = "loaded_at", window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """Facts per run and window of arrival; a window is told once nothing can come for it any more."""
    timed = facts.withWatermark(time, lateness)
    return timed.groupBy(F.window(time, window).alias("w"), "run_id").agg(F.count("*").alias("facts")).select(F.col("w.start").alias("window_start"), "run_id", "facts")
