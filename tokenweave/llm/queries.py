"""Queries of this subpackage and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import KEY, unique
from ..session import cut, small, table
from .blocks import spread
from .canonical import FeatureList, WordList, blocks, list_candidates, map_values
from .leakage import cleaned, leaks
from .lookalike import unify_values
from .mixing import mix, rates, reached, with_tokens
from .splitting import split_oversized
from .termstats import mark_terms, term_counts
from .topn import top_per_group
from .truncation import score_truncation

#: Rows of a reference list (entries, alias variants, labels) in one block; every worker holds one block at a time.
BLOCK_ENTRIES = 50_000
#: p6_candidates: shortest length in letters and most slips from there on. p6_found has one slip at any length, by its definition.
CANDIDATE_SLIPS = ((1, 1), (8, 2))


def unique_facts(spark: SparkSession, sf_dir: str, *columns: str, whole: bool = False) -> DataFrame:
    """Key and columns of token_facts, repeated rows once; whole leaves out rows with a null in columns."""
    rows = table(spark, sf_dir, "token_facts").select(*KEY, *columns)
    return unique(rows.dropna(subset=list(columns)) if whole else rows)


# 1. Oversized chapters


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "text_chapters").select("run_id", "chapter_index", "text")
    once = chapters.where(F.length("text") > 1200).dropDuplicates(["run_id", "chapter_index"])
    return split_oversized(once, ["run_id", "chapter_index"], "text", limit=1200, overlap=120)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir).where("piece_no = 0").select("run_id", "chapter_index", "boundary")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chapter."""
    return _oversized(spark, sf_dir)


_P1 = r"""
WITH c AS (SELECT DISTINCT run_id, chapter_index, replace(text, chr(1), ' ') AS text FROM text_chapters WHERE length(text) > 1200),
p AS (SELECT run_id, chapter_index, unnest(string_split(regexp_replace(text, '\n([ \t\r]*\n)+', chr(1), 'g'), chr(1))) AS u FROM c),
s AS (SELECT run_id, chapter_index, unnest(string_split(regexp_replace(u, '([.;!?\x{2026}\x{00B7}\x{0387}\x{037E}])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))) AS u FROM p),
w AS (SELECT run_id, chapter_index, unnest(string_split(regexp_replace(u, '[ \t\r\n]+', chr(1), 'g'), chr(1))) AS u FROM s),
m AS (SELECT run_id, chapter_index, 1 AS k, max(length(trim(u, E' \t\r\n'))) AS n FROM p GROUP BY 1, 2
UNION ALL SELECT run_id, chapter_index, 2, max(length(trim(u, E' \t\r\n'))) FROM s GROUP BY 1, 2
UNION ALL SELECT run_id, chapter_index, 3, max(length(trim(u, E' \t\r\n'))) FROM w GROUP BY 1, 2)
SELECT run_id, chapter_index, CASE min(k) FILTER (WHERE n <= 1200) WHEN 1 THEN 'paragraph' WHEN 2 THEN 'sentence' WHEN 3 THEN 'word' ELSE 'none' END AS boundary
FROM m GROUP BY 1, 2
"""

# 2. Term frequencies


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique_facts(spark, sf_dir, "lemma", "form")
    chapters = table(spark, sf_dir, "token_facts").agg(F.count_distinct("run_id", "chapter_index"))
    return mark_terms(term_counts(rows, ["run_id", "chapter_index"], ["lemma", "form"]), chapters)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).where("mark <> 'kept'").select("field", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its counts and mark."""
    return _terms(spark, sf_dir)


_P2 = """
WITH u AS (SELECT DISTINCT run_id, chapter_index, position, lemma, form FROM token_facts),
t AS (SELECT 'lemma' AS field, lemma AS term, run_id, chapter_index FROM u UNION ALL SELECT 'form', form, run_id, chapter_index FROM u),
n AS (SELECT count(*) AS total FROM (SELECT DISTINCT run_id, chapter_index FROM u)),
r AS (SELECT field, term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT (run_id, chapter_index)) AS BIGINT) AS records FROM t WHERE term IS NOT NULL GROUP BY 1, 2),
m AS (SELECT field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.4 * total THEN 'common' ELSE 'kept' END AS mark FROM r, n)
"""

# 3. Visually identical text


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = table(spark, sf_dir, "token_facts")
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in KEY))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("lemma", "form"))))
    cells = facts.select(key.alias("row_key"), pairs.alias("c")).select("c.field", "row_key", "c.value")
    variants = table(spark, sf_dir, "greek_core_5k_aliases").select(F.lit("variant").alias("field"), F.col("variant").alias("row_key"), F.col("variant").alias("value"))
    cells = cells.unionByName(variants)
    return cells, cells.select("value")


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_values(*_values(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir).where("consistent <> value").select("field", "row_key").distinct()


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value that was not in its consistent form, with that form and its number of rows."""
    rows = _unified(spark, sf_dir).distinct()
    return rows.groupBy("field", "value", "consistent", "status").agg(F.count("*").alias("rows"))


_WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNSEEN = r"[\p{Cf}\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"
_STYLED = r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{1D400}-\x{1D7FF}\x{00B5}\x{017F}\x{03D0}-\x{03D2}\x{03D5}\x{03D6}\x{03F0}-\x{03F2}\x{03F4}\x{03F5}\x{03F9}]"
_P3 = rf"""
WITH cells AS (SELECT 'lemma' AS field, run_id || '/' || chapter_index || '/' || position AS row_key, lemma AS value FROM token_facts
UNION SELECT 'form', run_id || '/' || chapter_index || '/' || position, form FROM token_facts UNION SELECT 'variant', variant, variant FROM greek_core_5k_aliases)
SELECT DISTINCT field, row_key FROM cells WHERE value <> nfc_normalize(value) OR regexp_matches(value, '{_UNSEEN}') OR regexp_matches(value, '{_STYLED}') OR regexp_matches(value, '^{_WS}|{_WS}$')
OR len(list_filter(string_split_regex(value, '{_WS}+'), lambda w: regexp_matches(w, '\p{{Greek}}')::INT + regexp_matches(w, '\p{{Latin}}')::INT + regexp_matches(w, '\p{{Cyrillic}}')::INT > 1)) > 0
"""

# 4. The most frequent pairs of every run and lemma


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_top_pairs(spark, sf_dir).drop("n")


def p4_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent (parse, form) of every run and lemma, with their counts."""
    rows = unique_facts(spark, sf_dir, "lemma", "parse", "form", whole=True)
    pairs = rows.groupBy("run_id", "lemma", "parse", "form").agg(F.count("*").alias("n"))
    return top_per_group(pairs, ["run_id", "lemma"], "n", ["parse", "form"], 3)


_P4 = """
WITH u AS (SELECT DISTINCT run_id, chapter_index, position, lemma, parse, form FROM token_facts),
c AS (SELECT run_id, lemma, parse, form, CAST(count(*) AS BIGINT) AS n FROM u WHERE lemma IS NOT NULL AND parse IS NOT NULL AND form IS NOT NULL GROUP BY 1, 2, 3, 4),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, lemma ORDER BY n DESC, parse, form) AS INTEGER) AS place FROM c)
"""

# 6. Entered values and the lists


def _entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, field, entered: each value outside its list once per run."""
    facts = table(spark, sf_dir, "token_facts")
    lemmas = table(spark, sf_dir, "lexicon_entries").select(F.lit("lemma").alias("field"), F.col("lemma").alias("entered"))
    labels = table(spark, sf_dir, "parse_labels").select(F.lit("parse"), F.col("label"))
    listed = small(lemmas.union(labels).dropna().distinct())
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("entered")) for f in ("lemma", "parse"))))
    cells = facts.select("run_id", pairs.alias("c")).select("run_id", "c.field", "c.entered").where(F.col("entered").isNotNull())
    unsaid = (F.col("field") == "parse") & F.col("entered").rlike(r"^(?:[\s\u0085\u00a0\u2028\u2029]*|-|n/a)\z")
    return cells.where(~unsaid).join(listed, ["field", "entered"], "left_anti").distinct()


def _word_lists(spark: SparkSession, sf_dir: str, slips: tuple[tuple[int, int], ...] = ((1, 1),)) -> Iterator[WordList]:
    """The entries and their alias variants, in blocks by rank."""
    entries = table(spark, sf_dir, "lexicon_entries").select("rank", "lemma").dropna()
    aliases = table(spark, sf_dir, "greek_core_5k_aliases").select("variant", "lemma").dropna().distinct()
    ways = entries.withColumn("variant", F.lit(None).cast("string")).union(entries.join(aliases, "lemma").select("rank", "lemma", "variant"))
    return (WordList.of(block, slips) for block in blocks(ways.orderBy("rank", "lemma", "variant"), BLOCK_ENTRIES))


def _feature_lists(spark: SparkSession, sf_dir: str) -> Iterator[FeatureList]:
    labels = table(spark, sf_dir, "parse_labels").where("label is not null").orderBy("label_id").select("label")
    return (FeatureList([label for label, in block]) for block in blocks(labels, BLOCK_ENTRIES))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entered = cut(_entered(spark, sf_dir), "entered")
    both = zip_longest(_word_lists(spark, sf_dir), _feature_lists(spark, sf_dir))
    finders = ({f: x for f, x in (("lemma", words), ("parse", labels)) if x is not None} for words, labels in both)
    found = map_values(spread(entered.select("field", "entered").distinct(), "values"), finders)
    return entered.join(found, ["field", "entered"]).select("run_id", "field", "entered", "canonical")


def p6_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lexicon entry that itself or by an alias is within the distance of each distinct entered lemma."""
    values = spread(_entered(spark, sf_dir).where("field = 'lemma'").select("entered").distinct(), "values")
    return list_candidates(values, _word_lists(spark, sf_dir, CANDIDATE_SLIPS))

# 7. Test items in documents


def _leaks(spark: SparkSession, sf_dir: str, op) -> DataFrame:
    return op(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, leaks)


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of test items."""
    return _leaks(spark, sf_dir, cleaned)


def p7_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each document loses, and whether it is dropped."""
    return p7_cleaned(spark, sf_dir).select("doc_id", "removed_words", "dropped")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents it leaked into."""
    found = _leaks(spark, sf_dir, leaks).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, sf_dir, "eval_items").select("item_id").join(found, "item_id", "left").fillna(0, ["documents"])


_P7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, lower(array_to_string(w[k:k + 11], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT item_id, lower(array_to_string(w[k:k + 11], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
_P7_REMOVED = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
i AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM eval_items),
ig AS (SELECT DISTINCT lower(array_to_string(w[k:k + 11], ' ')) AS g FROM (SELECT w, unnest(range(1, len(w) - 10)) AS k FROM i)),
h AS (SELECT doc_id, k FROM (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)) SEMI JOIN ig USING (g)),
n AS (SELECT doc_id, count(DISTINCT p) AS removed FROM (SELECT doc_id, unnest(range(k, k + 12)) AS p FROM h) GROUP BY 1)
SELECT doc_id, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words, coalesce(removed > 0.5 * len(w), false) AS dropped FROM d LEFT JOIN n USING (doc_id)
"""

# 8. Mixing sources


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return cut(with_tokens(documents, "text"), "tokens")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: every use of every document."""
    counted = _counted(spark, sf_dir)
    return mix(counted, rates(counted, table(spark, sf_dir, "mix_targets")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has, should give and gave."""
    counted = _counted(spark, sf_dir)
    rated = rates(counted, table(spark, sf_dir, "mix_targets"))
    return reached(mix(counted, rated), rated)

def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted mixture and the documents there are for it."""
    counted = table(spark, sf_dir, "documents").select("source", F.lit(0).alias("tokens"))
    return rates(counted, table(spark, sf_dir, "mix_targets")).select("source", "target_share", "max_repeats", "documents")


# 9. Texts that break off


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_truncation(table(spark, sf_dir, "documents"), "doc_id", "source", "text", "title")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("truncated").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the share of its reviews that break off."""
    cut_off = F.sum(F.col("truncated").cast("long"))
    return _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), cut_off.alias("truncated"), (cut_off / F.count("*")).alias("share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_values": p3_values,
    "p4_found": p4_found,
    "p4_top_pairs": p4_top_pairs,
    "p6_found": p6_found,
    "p6_candidates": p6_candidates,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p7_removed": p7_removed,
    "p7_items": p7_items,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_sources": p8_sources,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

ORACLES = {
    "p1_found": _P1,
    "p2_found": _P2 + "SELECT field, term, mark FROM m WHERE mark <> 'kept'",
    "p2_terms": _P2 + "SELECT * FROM m",
    "p7_found": _P7 + "SELECT doc_id, item_id FROM f",
    "p3_found": _P3,
    "p7_removed": _P7_REMOVED,
    "p7_items": _P7 + "SELECT item_id, CAST(count(doc_id) AS BIGINT) AS documents FROM eval_items LEFT JOIN f USING (item_id) GROUP BY 1",
    "p8_sources": "SELECT m.source, target_share, coalesce(max_repeats, 1) AS max_repeats, CAST(count(d.source) AS BIGINT) AS documents FROM mix_targets AS m LEFT JOIN documents AS d USING (source) GROUP BY 1, 2, 3",
    "p4_found": _P4 + "SELECT run_id, lemma, place, parse, form FROM r WHERE place <= 3",
    "p4_top_pairs": _P4 + "SELECT run_id, lemma, place, parse, form, n FROM r WHERE place <= 3",
}
