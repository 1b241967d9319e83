"""How often every distinct term occurs, in how many records, and whether that makes it useful."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_counts(rows: DataFrame, record: list[str], fields: list[str]) -> DataFrame:
    """One row per field and distinct non-null term: field, term, occurrences, records.

    Counts terms per record first; Spark combines those by hash within each task before the shuffle, so
    that a term found in a third of all rows reaches a reducer as one row per task and record, and then as
    one row per task. A null record part makes a record of its own; the empty string is a term. Extra
    columns are not read. Every row counts: drop repeated ones before.
    """
    ids = [F.col(f"`{c}`").alias(f"__r{i}") for i, c in enumerate(record)]
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("term")) for f in fields)))
    emitted = rows.select(*ids, pairs.alias("t")).select(*(f"__r{i}" for i in range(len(record))), "t.field", "t.term").where(F.col("term").isNotNull())
    per_record = emitted.groupBy("field", "term", *(f"__r{i}" for i in range(len(record)))).agg(F.count("*").alias("n"))
    return per_record.groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))


def mark_terms(counts: DataFrame, records: DataFrame, rare_records: int = 2, common_share: float = 0.4) -> DataFrame:
    """counts with `mark`: `rare` if a term is in at most rare_records records, `common` if it is in more than
    common_share of all records, else `kept`. records: one row, one column: the number of records.
    A term that is both is `rare`.
    """
    total = records.toDF("__total")
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share) * F.col("__total"), "common").otherwise("kept")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("__total")
