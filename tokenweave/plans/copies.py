"""Queries of the two-copies comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import diff_copies
from ..session import table

KEYS = ["run_id", "chapter_index", "position"]
FIELDS = ["type", "lemma", "form", "parse"]


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, mirror = table(spark, sf_dir, "token_facts"), table(spark, sf_dir, "token_facts_mirror")
    return diff_copies(facts, mirror, KEYS, FIELDS, "missing_in_mirror", "missing_in_facts")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select(*KEYS, "diff")


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences with both values."""
    return _diff(spark, sf_dir)


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences by run and kind."""
    return _diff(spark, sf_dir).groupBy("run_id", "diff").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_changes": p5_changes, "p5_summary": p5_summary}

_CTE = """
WITH a AS (SELECT DISTINCT run_id, chapter_index, position, type, lemma, form, parse FROM token_facts),
b AS (SELECT DISTINCT run_id, chapter_index, position, type, lemma, form, parse FROM token_facts_mirror),
j AS (SELECT a.*, b.type AS bt, b.lemma AS bl, b.form AS bf, b.parse AS bp FROM a JOIN b USING (run_id, chapter_index, position)),
d AS (
SELECT run_id, chapter_index, position, 'missing_in_mirror' AS diff, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM a ANTI JOIN b USING (run_id, chapter_index, position)
UNION ALL SELECT run_id, chapter_index, position, 'missing_in_facts', NULL, NULL FROM b ANTI JOIN a USING (run_id, chapter_index, position)
UNION ALL SELECT run_id, chapter_index, position, 'type', type, bt FROM j WHERE nfc_normalize(type) IS DISTINCT FROM nfc_normalize(bt)
UNION ALL SELECT run_id, chapter_index, position, 'lemma', lemma, bl FROM j WHERE nfc_normalize(lemma) IS DISTINCT FROM nfc_normalize(bl)
UNION ALL SELECT run_id, chapter_index, position, 'form', form, bf FROM j WHERE nfc_normalize(form) IS DISTINCT FROM nfc_normalize(bf)
UNION ALL SELECT run_id, chapter_index, position, 'parse', parse, bp FROM j WHERE nfc_normalize(parse) IS DISTINCT FROM nfc_normalize(bp))
"""

ORACLES = {
    "p5_found": _CTE + "SELECT run_id, chapter_index, position, diff FROM d",
    "p5_changes": _CTE + "SELECT * FROM d",
    "p5_summary": _CTE + "SELECT run_id, diff, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1, 2",
}
