"""Queries of the operators over facts, each over the whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as mo
from ..functions.vocab import DIMENSIONS
from ..operators import chapters as chap
from ..operators import export, grammar, lemma, text, tracks, views
from ..operators.facts import load_chapters, load_facts
from ..session import cut, table
from .base import DECODED, WITH, rank_sql

RUN = "run_id"
BAR = "¦"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return load_facts(spark, d, "type", "lemma", "form", "parse")


def _kept_facts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Facts that a query reads more than once: made unique once, and written to the shared folder."""
    return cut(load_facts(spark, d, *columns), "facts")


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    return mo.decode(load_facts(spark, d, "type", "parse"), table(spark, d, "token_facts"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct label and part of speech, decoded; no facts need be made unique for that."""
    raw = table(spark, d, "token_facts").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("parse", "type")))
    return mo.decode_labels(raw.distinct())


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = WITH):
    """Registers a query, with its SQL after the common table expressions of base."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = base + sql
        return fn

    return register


def add(name: str, fn, sql: str | None = None, base: str = WITH) -> None:
    query(name, sql, base)(fn)


# Labels


@query("m_decode", f"""SELECT parse, type, {", ".join(f'"{d}"' for d in DIMENSIONS)}, status, is_deponent, descriptors, unparsed, signature, form_class, is_verb_form, missing_voice,
CAST(array_to_string(sort_key, ' ') AS VARCHAR) AS sort_key FROM m""", DECODED)
def m_decode(spark, d):
    """Every distinct label and part of speech, decoded."""
    labels = _labels(spark, d)
    return labels.select("parse", "type", *DIMENSIONS, "status", "is_deponent", F.array_join("descriptors", BAR).alias("descriptors"), F.array_join("unparsed", BAR).alias("unparsed"), "signature", "form_class", "is_verb_form", "missing_voice", F.array_join("sort_key", " ").alias("sort_key"))


_NAMED = {"tense": "present imperfect future aorist perfect pluperfect", "case": "nominative genitive dative accusative vocative"}


def _label_sql() -> str:
    from ..functions.vocab import LABELS

    rows = ", ".join(f"('{d}', '{v}', '{n}')" for d in DIMENSIONS for v, n in LABELS[d].items())
    return f""", names(dimension, value, name) AS (VALUES {rows}),
s AS ({" UNION ALL ".join(f"SELECT DISTINCT '{d}' AS dimension, \"{d}\" AS value FROM m WHERE \"{d}\" IS NOT NULL" for d in DIMENSIONS)}),
u AS (SELECT dimension, value, unnest(range(1, len(string_split(value, '|')) + 1)) AS i FROM s)
SELECT u.dimension, u.value, string_agg(name, '/' ORDER BY i) AS label FROM u JOIN names n ON n.dimension = u.dimension AND n.value = string_split(u.value, '|')[i] GROUP BY 1, 2"""


@query("m_feature_label", _label_sql(), DECODED)
def m_feature_label(spark, d):
    """Names of all values that occur, compound ones too."""
    labels = _labels(spark, d)
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value"), F.when(F.col(x).isNotNull(), mo.feature_label(x, F.col(x))).alias("label")) for x in DIMENSIONS)))
    return labels.select(pairs.alias("p")).select("p.*").where("value is not null").distinct()


@query("m_has", "SELECT parse, type, list_contains(string_split(coalesce(\"case\", ''), '|'), 'nom') AS nominative, list_contains(string_split(coalesce(voice, ''), '|'), 'pass') AS passive FROM m", DECODED)
def m_has(spark, d):
    """Labels that have a reading, alone or among others."""
    return _labels(spark, d).select("parse", "type", mo.has(F.col("case"), "nom").alias("nominative"), mo.has(F.col("voice"), "pass").alias("passive"))


@query("m_is_verbal", "SELECT parse, type, coalesce(tense, mood, voice) IS NOT NULL AS verbal FROM m", DECODED)
def m_is_verbal(spark, d):
    return _labels(spark, d).select("parse", "type", mo.is_verbal({x: F.col(x) for x in DIMENSIONS}).alias("verbal"))


@query("m_is_nominal", 'SELECT parse, type, "case" IS NOT NULL AS nominal FROM m', DECODED)
def m_is_nominal(spark, d):
    return _labels(spark, d).select("parse", "type", mo.is_nominal({x: F.col(x) for x in DIMENSIONS}).alias("nominal"))


def _abbr_sql(d: str, dot: str) -> str:
    values = ", ".join(f"'{v}'" for v in grammar.VALUES[d])
    return f"array_to_string(list_transform(list_filter([{values}], lambda v: list_contains(string_split(\"{d}\", '|'), v)), lambda v: v || '{dot}'), '/')"


@query("m_feature_abbr", f'SELECT DISTINCT "case", {_abbr_sql("case", ".")} AS case_abbr, gender, {_abbr_sql("gender", ".")} AS gender_abbr FROM m WHERE "case" IS NOT NULL AND gender IS NOT NULL', DECODED)
def m_feature_abbr(spark, d):
    rows = _labels(spark, d).where("`case` is not null and gender is not null")
    return rows.select("case", mo.feature_abbr("case", F.col("case")).alias("case_abbr"), "gender", mo.feature_abbr("gender", F.col("gender")).alias("gender_abbr")).distinct()


@query("m_person_abbr", f"SELECT DISTINCT person, {_abbr_sql('person', '')} AS person_abbr FROM m WHERE person IS NOT NULL", DECODED)
def m_person_abbr(spark, d):
    return _labels(spark, d).where("person is not null").select("person", mo.person_abbr(F.col("person")).alias("person_abbr")).distinct()


@query("m_paradigm_rank", " UNION ".join(f"SELECT '{x}' AS dimension, \"{x}\" AS value, CAST({rank_sql(x)} AS INTEGER) AS rank FROM m WHERE \"{x}\" IS NOT NULL" for x in DIMENSIONS), DECODED)
def m_paradigm_rank(spark, d):
    """The place of each value in its paradigm; of a compound one that of its first reading there."""
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value"), mo.paradigm_rank(x, F.col(x)).alias("rank")) for x in DIMENSIONS)))
    return _labels(spark, d).select(pairs.alias("p")).select("p.*").where("value is not null").distinct()


# Grouped dimensions

for _name, _keys in {"ix_lemma": ["lemma"], "ix_parse": ["lemma", "parse"], "ix_form": ["lemma", "form"], "ix_form_parse": ["lemma", "parse", "form"], "ix_type": ["type"]}.items():
    _cols = ", ".join(_keys)
    add(_name, partial(lambda keys, spark, d: tracks.by_chapter(load_facts(spark, d, *keys), keys), _keys), f"SELECT run_id, {_cols}, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM f GROUP BY ALL")

for _name in ("signature", "status"):
    add(f"ix_{_name}", partial(lambda key, spark, d: tracks.by_chapter(_decoded(spark, d).where(F.col(key) != ""), [key]), _name), f"SELECT run_id, {_name}, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM fm WHERE {_name} <> '' GROUP BY ALL", DECODED)

_STATED = ", st AS (" + " UNION ALL ".join(f"SELECT run_id, chapter_index, '{d}' AS dimension, \"{d}\" AS value FROM fm WHERE \"{d}\" IS NOT NULL" for d in DIMENSIONS) + ")"
_READ = _STATED + ", rd AS (SELECT run_id, chapter_index, dimension, unnest(string_split(value, '|')) AS value FROM st)"


@query("ix_feature", _STATED + " SELECT run_id, dimension, value, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM st GROUP BY ALL", DECODED)
def ix_feature(spark, d):
    return tracks.by_chapter(tracks.stated(_decoded(spark, d)), ["dimension", "value"])


@query("ix_feature_any", _READ + " SELECT run_id, dimension, value, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM rd GROUP BY ALL", DECODED)
def ix_feature_any(spark, d):
    return tracks.by_chapter(tracks.readings(tracks.stated(_decoded(spark, d))), ["dimension", "value"])


@query("ix_feature_values", _READ + " SELECT DISTINCT run_id, dimension, value FROM rd", DECODED)
def ix_feature_values(spark, d):
    return tracks.readings(tracks.stated(_decoded(spark, d))).select(RUN, "dimension", "value").distinct()


@query("ix_dimension", _STATED + " SELECT run_id, dimension, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM st GROUP BY ALL", DECODED)
def ix_dimension(spark, d):
    return tracks.by_chapter(tracks.stated(_decoded(spark, d)), ["dimension"])


@query("ix_descriptor", ", x AS (SELECT run_id, chapter_index, unnest(string_split(descriptors, '¦')) AS descriptor FROM fm WHERE descriptors <> '') SELECT run_id, descriptor, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM x GROUP BY ALL", DECODED)
def ix_descriptor(spark, d):
    return tracks.by_chapter(_decoded(spark, d).withColumn("descriptor", F.explode("descriptors")), ["descriptor"])


_FLAGS = "CAST(count(*) FILTER (is_verb_form) AS BIGINT) AS verb_forms, CAST(count(*) FILTER (missing_voice) AS BIGINT) AS voice_gaps, CAST(count(*) FILTER (is_deponent) AS BIGINT) AS deponents"


@query("ix_verb_forms", f"SELECT run_id, chapter_index, {_FLAGS} FROM fm GROUP BY ALL", DECODED)
def ix_verb_forms(spark, d):
    """Words that should state a voice, those that do not, and deponents, per chapter."""
    return _decoded(spark, d).groupBy(RUN, "chapter_index").agg(F.count_if("is_verb_form").alias("verb_forms"), F.count_if("missing_voice").alias("voice_gaps"), F.count_if("is_deponent").alias("deponents"))


_STATS = "CAST(count(*) AS BIGINT) AS token_count, CAST(count(DISTINCT lemma) AS BIGINT) AS unique_lemmas, CAST(count(DISTINCT (lemma, form)) AS BIGINT) AS unique_forms"


@query("ix_chapter_stats", f"SELECT run_id, chapter_index, {_STATS} FROM f GROUP BY 1, 2")
def ix_chapter_stats(spark, d):
    return tracks.chapter_stats(load_facts(spark, d, "lemma", "form"))


_TOTALS = """, t AS (SELECT run_id, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT lemma) AS BIGINT) AS lemmas, CAST(count(DISTINCT (lemma, form)) AS BIGINT) AS forms,
CAST(count(DISTINCT (lemma, parse)) AS BIGINT) AS parses FROM f GROUP BY 1), c AS (SELECT run_id, CAST(count(*) AS BIGINT) AS chapters FROM ch GROUP BY 1) SELECT * FROM t JOIN c USING (run_id)"""


def _totals(spark, d):
    return tracks.totals(load_facts(spark, d, "lemma", "form", "parse"), load_chapters(spark, d))


add("ix_totals", _totals, _TOTALS)
add("tx_summary", _totals, _TOTALS)

_COVERAGE = """SELECT {by}, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'partial') AS BIGINT) AS partial,
CAST(count(*) FILTER (status = 'descriptive') AS BIGINT) AS descriptive, CAST(count(*) FILTER (status = 'not_applicable') AS BIGINT) AS not_applicable, CAST(count(*) FILTER (status = 'unparsed') AS BIGINT) AS unparsed,
CAST(count(*) FILTER (is_verb_form) AS BIGINT) AS verb_forms, CAST(count(*) FILTER (missing_voice) AS BIGINT) AS missing_voice, CAST(count(*) FILTER (is_deponent) AS BIGINT) AS deponents FROM fm GROUP BY ALL"""
_SHARES = """SELECT *, ok + descriptive AS understood, partial + unparsed AS needs_attention, total - not_applicable AS morphological,
CASE WHEN total = not_applicable THEN 1.0 ELSE (ok + descriptive) / (total - not_applicable)::DOUBLE END AS understood_share, CASE WHEN verb_forms = 0 THEN 0.0 ELSE missing_voice / verb_forms::DOUBLE END AS voice_gap_share FROM cov"""


def _cov(*by: str) -> str:
    return f", cov AS ({_COVERAGE.format(by=', '.join(by))}) "


@query("ix_coverage", _cov(RUN, "chapter_index") + _SHARES, DECODED)
def ix_coverage(spark, d):
    return grammar.coverage(_decoded(spark, d), [RUN, "chapter_index"])


@query("cov_report", _cov(RUN) + _SHARES, DECODED)
def cov_report(spark, d):
    return grammar.coverage(_decoded(spark, d), [RUN])


@query("ui_warn", _cov(RUN) + f", s AS ({_SHARES}) SELECT *, needs_attention > 0 OR voice_gap_share > 0.05 AS warn FROM s", DECODED)
def ui_warn(spark, d):
    return views.coverage_warning(cov_report(spark, d))


@query("ix_iter", "SELECT run_id, chapter_index, position, type, lemma, form, parse FROM f")
def ix_iter(spark, d):
    """The facts in reading order."""
    return _facts(spark, d).orderBy(RUN, "chapter_index", "position")


# Tracks

_T = ", t AS (SELECT run_id, lemma, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM f GROUP BY 1, 2, 3)"


@query("w_span", _T + " SELECT run_id, lemma, CAST(sum(occ) AS BIGINT) AS total, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, CAST(count(*) AS BIGINT) AS chapter_count, string_agg(chapter_index, ' ' ORDER BY chapter_index) AS chapters FROM t GROUP BY 1, 2")
def w_span(spark, d):
    """Total, first and last chapter, number and list of chapters of each lemma."""
    return tracks.span(tracks.by_chapter(load_facts(spark, d, "lemma"), ["lemma"]), ["lemma"]).withColumn("chapters", F.array_join("chapters", " "))


@query("w_running", _T + """ SELECT run_id, lemma, chapter_index, occ, CAST(sum(occ) OVER w AS BIGINT) AS cumulative, lag(chapter_index) OVER w AS previous_chapter, lead(chapter_index) OVER w AS next_chapter,
chapter_index - lag(chapter_index) OVER w AS gap_before FROM t WINDOW w AS (PARTITION BY run_id, lemma ORDER BY chapter_index)""")
def w_running(spark, d):
    """Running total, chapter before and after, and gap, where a lemma occurs."""
    return tracks.running(tracks.by_chapter(load_facts(spark, d, "lemma"), ["lemma"]), ["lemma"])


@query("w_dense", """, t AS (SELECT run_id, type, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM f GROUP BY 1, 2, 3), g AS (SELECT DISTINCT t.run_id, t.type, ch.chapter_index FROM t JOIN ch USING (run_id))
SELECT run_id, type, chapter_index, coalesce((SELECT sum(occ) FROM t WHERE t.run_id = g.run_id AND t.type = g.type AND t.chapter_index = g.chapter_index), 0)::BIGINT AS occ,
coalesce((SELECT sum(occ) FROM t WHERE t.run_id = g.run_id AND t.type = g.type AND t.chapter_index <= g.chapter_index), 0)::BIGINT AS cumulative,
(SELECT max(chapter_index) FROM t WHERE t.run_id = g.run_id AND t.type = g.type AND t.chapter_index < g.chapter_index) AS previous_chapter,
(SELECT min(chapter_index) FROM t WHERE t.run_id = g.run_id AND t.type = g.type AND t.chapter_index > g.chapter_index) AS next_chapter FROM g""")
def w_dense(spark, d):
    """Counts and running totals of each part of speech in all chapters, and its nearest chapters before and after."""
    return tracks.dense(tracks.by_chapter(load_facts(spark, d, "type"), ["type"]), ["type"], load_chapters(spark, d))


# Chapter lens

_ROWS = """, g AS (SELECT run_id, chapter_index, lemma, parse, form, count(*) AS n, min(position) AS p FROM f GROUP BY 1, 2, 3, 4, 5),
r0 AS (SELECT run_id, chapter_index, lemma, parse, CAST(count(*) AS BIGINT) AS parse_occ, min(position) AS fp, arg_min(type, position) AS type FROM f GROUP BY 1, 2, 3, 4),
r1 AS (SELECT run_id, chapter_index, lemma, parse, string_agg(form || ':' || n || ':' || p, ' ' ORDER BY n DESC, p) AS forms, first(form ORDER BY n DESC, p) AS form, CAST(first(n ORDER BY n DESC, p) AS BIGINT) AS form_occ FROM g GROUP BY 1, 2, 3, 4),
ls AS (SELECT run_id, lemma, min(chapter_index) AS lemma_first_chapter, max(chapter_index) AS lemma_last_chapter FROM f GROUP BY 1, 2),
ps AS (SELECT run_id, lemma, parse, min(chapter_index) AS parse_first_chapter, max(chapter_index) AS parse_last_chapter FROM f GROUP BY 1, 2, 3),
fs AS (SELECT run_id, lemma, form, min(chapter_index) AS form_first_chapter, max(chapter_index) AS form_last_chapter FROM f GROUP BY 1, 2, 3),
lo AS (SELECT run_id, lemma, chapter_index, CAST(lemma_occ AS BIGINT) AS lemma_occ, CAST(sum(lemma_occ) OVER (PARTITION BY run_id, lemma ORDER BY chapter_index) AS BIGINT) AS lemma_cum
FROM (SELECT run_id, lemma, chapter_index, count(*) AS lemma_occ FROM f GROUP BY 1, 2, 3)),
rows_ AS (SELECT run_id, chapter_index, CAST(row_number() OVER (PARTITION BY run_id, chapter_index ORDER BY fp) - 1 AS INTEGER) AS row_no, type, lemma, form, parse, lemma_occ, parse_occ, form_occ, lemma_cum,
CAST(sum(parse_occ) OVER (PARTITION BY run_id, lemma, parse ORDER BY chapter_index) AS BIGINT) AS parse_cum, forms, lemma_first_chapter, lemma_last_chapter, parse_first_chapter, parse_last_chapter, form_first_chapter, form_last_chapter,
lemma_first_chapter = chapter_index AS first_occ_lemma, parse_first_chapter = chapter_index AS first_occ_parse, lemma_last_chapter = chapter_index AS last_occ_lemma, parse_last_chapter = chapter_index AS last_occ_parse
FROM r0 JOIN r1 USING (run_id, chapter_index, lemma, parse) JOIN lo USING (run_id, lemma, chapter_index) JOIN ls USING (run_id, lemma) JOIN ps USING (run_id, lemma, parse) JOIN fs USING (run_id, lemma, form))
"""


def _rows(spark, d):
    return chap.rows(_facts(spark, d))


@query("ch_rows", _ROWS + "SELECT * FROM rows_")
def ch_rows(spark, d):
    """All chapter rows, their ranked forms as text."""
    joined = F.array_join(F.transform("forms", lambda x: F.concat_ws(":", x["form"], x["occ"].cast("string"), x["first_position"].cast("string"))), " ")
    return _rows(spark, d).withColumn("forms", joined)


@query("ch_forms", ", g AS (SELECT run_id, chapter_index, lemma, parse, form, CAST(count(*) AS BIGINT) AS occ, min(position) AS first_position, arg_min(type, position) AS type FROM f GROUP BY 1, 2, 3, 4, 5) SELECT * FROM g")
def ch_forms(spark, d):
    return chap.form_counts(_facts(spark, d))


@query("ch_summary", f""", s AS (SELECT run_id, chapter_index, {_STATS} FROM f GROUP BY 1, 2)
SELECT run_id, chapter_index, coalesce(id, 'ch-' || (chapter_index + 1)) AS id, coalesce(title, '') AS title, coalesce(token_count, 0) AS token_count, coalesce(unique_lemmas, 0) AS unique_lemmas, coalesce(unique_forms, 0) AS unique_forms
FROM ch LEFT JOIN s USING (run_id, chapter_index)""")
def ch_summary(spark, d):
    return chap.summaries(load_facts(spark, d, "lemma", "form"), load_chapters(spark, d))


@query("ch_files", """, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR filename IS DISTINCT FROM lag(filename) OVER w THEN 1 ELSE 0 END AS turn FROM ch WINDOW w AS (PARTITION BY run_id ORDER BY chapter_index)),
b AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY run_id ORDER BY chapter_index) - 1 AS BIGINT) AS file_no FROM a)
SELECT run_id, file_no, filename, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, CAST(count(*) AS BIGINT) AS chapters FROM b GROUP BY 1, 2, 3""")
def ch_files(spark, d):
    return chap.files(load_chapters(spark, d))


@query("ui_labels", "SELECT run_id, chapter_index, CAST(chapter_index + 1 AS VARCHAR) AS short_label, (chapter_index + 1) || '. ' || coalesce(title, '') || CASE WHEN coalesce(filename, '') <> '' THEN ' (' || filename || ')' ELSE '' END AS long_label FROM ch")
def ui_labels(spark, d):
    return views.chapter_labels(load_chapters(spark, d))


# Grammar

_VOCAB = ", v(dimension, value, dimension_order, value_order) AS (VALUES " + ", ".join(f"('{d}', '{v}', {i}, {k})" for i, d in enumerate(DIMENSIONS) for k, v in enumerate(grammar.VALUES[d])) + ")"
_PROFILE = _READ + _VOCAB + """, tot AS (SELECT run_id, dimension, CAST(count(*) AS BIGINT) AS stated FROM st GROUP BY 1, 2),
val AS (SELECT run_id, dimension, value, CAST(count(*) AS BIGINT) AS occ, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, CAST(count(DISTINCT chapter_index) AS BIGINT) AS chapter_count FROM rd GROUP BY 1, 2, 3)"""


@query("gr_profile", _PROFILE + """ SELECT tot.run_id, v.dimension, v.value, dimension_order, value_order, coalesce(occ, 0) AS occ, coalesce(occ, 0) AS cumulative, first_chapter, last_chapter, coalesce(chapter_count, 0) AS chapter_count,
stated, stated AS stated_cumulative FROM tot JOIN v USING (dimension) LEFT JOIN val ON val.run_id = tot.run_id AND val.dimension = v.dimension AND val.value = v.value""", DECODED)
def gr_profile(spark, d):
    """Values of the dimensions a run states, zeros included."""
    return grammar.profile(_decoded(spark, d))


@query("gr_profile_chapter", _PROFILE + """, cells AS (SELECT ch.run_id, ch.chapter_index, v.dimension, v.value, dimension_order, value_order, first_chapter, last_chapter, coalesce(chapter_count, 0) AS chapter_count
FROM tot JOIN ch USING (run_id) JOIN v USING (dimension) LEFT JOIN val ON val.run_id = tot.run_id AND val.dimension = v.dimension AND val.value = v.value),
vc AS (SELECT run_id, chapter_index, dimension, value, count(*) AS n FROM rd GROUP BY 1, 2, 3, 4), dc AS (SELECT run_id, chapter_index, dimension, count(*) AS n FROM st GROUP BY 1, 2, 3)
SELECT cells.run_id, cells.chapter_index, cells.dimension, cells.value, dimension_order, value_order, CAST(coalesce(vc.n, 0) AS BIGINT) AS occ,
CAST(sum(coalesce(vc.n, 0)) OVER (PARTITION BY cells.run_id, cells.dimension, cells.value ORDER BY cells.chapter_index) AS BIGINT) AS cumulative, first_chapter, last_chapter, chapter_count,
CAST(coalesce(dc.n, 0) AS BIGINT) AS stated, CAST(sum(coalesce(dc.n, 0)) OVER (PARTITION BY cells.run_id, cells.dimension, cells.value ORDER BY cells.chapter_index) AS BIGINT) AS stated_cumulative
FROM cells LEFT JOIN vc USING (run_id, chapter_index, dimension, value) LEFT JOIN dc ON dc.run_id = cells.run_id AND dc.chapter_index = cells.chapter_index AND dc.dimension = cells.dimension""", DECODED)
def gr_profile_chapter(spark, d):
    return grammar.profile(_decoded(spark, d), load_chapters(spark, d))


@query("gr_stated", _STATED + " SELECT run_id, dimension, CAST(count(*) AS BIGINT) AS stated FROM st GROUP BY 1, 2", DECODED)
def gr_stated(spark, d):
    """Tokens that state each dimension; a dimension that a run never states is absent."""
    return tracks.by_chapter(tracks.stated(_decoded(spark, d)), ["dimension"]).groupBy(RUN, "dimension").agg(F.sum("occ").alias("stated"))


_INVENTORY = """, i0 AS (SELECT run_id, signature, form_class, sort_key, CAST(count(*) AS BIGINT) AS occ, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, CAST(count(DISTINCT chapter_index) AS BIGINT) AS chapter_count,
min(CAST(chapter_index AS BIGINT) * 1000000000 + position) AS seen FROM fm WHERE signature <> '' GROUP BY 1, 2, 3, 4),
inv AS (SELECT run_id, form_class, signature, CAST(row_number() OVER (PARTITION BY run_id ORDER BY sort_key, seen) - 1 AS INTEGER) AS "order", occ, occ AS cumulative, first_chapter, last_chapter, chapter_count FROM i0)"""


@query("fc_inventory", _INVENTORY + " SELECT * FROM inv", DECODED)
def fc_inventory(spark, d):
    """Combinations of features in paradigm order."""
    return grammar.inventory(_decoded(spark, d))


@query("fc_tables", _INVENTORY + """ SELECT run_id, form_class, CAST(list_position(['verb', 'participle', 'nominal', 'other'], form_class) AS INTEGER) AS class_order, CAST(count(*) AS BIGINT) AS forms, CAST(sum(occ) AS BIGINT) AS tokens FROM inv GROUP BY 1, 2
UNION ALL SELECT run_id, 'all', 0, CAST(count(*) AS BIGINT), CAST(sum(occ) AS BIGINT) FROM inv GROUP BY 1""", DECODED)
def fc_tables(spark, d):
    return grammar.inventory_tables(_decoded(spark, d))


_COUNTS = _INVENTORY + """, cc AS (SELECT run_id, chapter_index, signature, count(*) AS n FROM fm WHERE signature <> '' GROUP BY 1, 2, 3),
cells AS (SELECT ch.run_id, ch.chapter_index, inv.signature, inv."order", inv.form_class, inv.first_chapter, CAST(coalesce(n, 0) AS BIGINT) AS occ FROM ch JOIN inv USING (run_id) LEFT JOIN cc ON cc.run_id = ch.run_id AND cc.chapter_index = ch.chapter_index AND cc.signature = inv.signature),
run_ AS (SELECT *, CAST(sum(occ) OVER (PARTITION BY run_id, signature ORDER BY chapter_index) AS BIGINT) AS cumulative FROM cells)"""


@query("fc_counts", _COUNTS + ' SELECT run_id, chapter_index, "order", occ, cumulative FROM run_ WHERE cumulative > 0', DECODED)
def fc_counts(spark, d):
    return grammar.inventory_counts(_decoded(spark, d), load_chapters(spark, d))


_COMBO = _COUNTS + """, combo AS (SELECT run_id, chapter_index, form_class, "order", signature, occ, cumulative, first_chapter = chapter_index AND occ > 0 AS is_new,
CAST(sum(occ) OVER w AS BIGINT) AS class_tokens, CAST(sum(cumulative) OVER w AS BIGINT) AS class_tokens_cumulative FROM run_ WINDOW w AS (PARTITION BY run_id, chapter_index, form_class))"""


def _combo(spark, d):
    track, chapters = cut(grammar.combinations(_decoded(spark, d)), "combinations"), load_chapters(spark, d)
    return views.chapter_combinations(grammar.inventory_of(track), grammar.counts_of(track, chapters), chapters)


@query("ui_combo_join", _COMBO + " SELECT * FROM combo", DECODED)
def ui_combo_join(spark, d):
    """The inventory in every chapter, zeros included."""
    return _combo(spark, d)


@query("ui_hide_absent", _COMBO + " SELECT * FROM combo WHERE occ > 0", DECODED)
def ui_hide_absent(spark, d):
    return views.present(_combo(spark, d))


@query("ui_is_new", _COMBO + " SELECT run_id, chapter_index, signature FROM combo WHERE is_new", DECODED)
def ui_is_new(spark, d):
    return _combo(spark, d).where("is_new").select(RUN, "chapter_index", "signature")


# Text lens


def _vocab_sql(*keys: str) -> str:
    k = ", ".join(["run_id", *keys])
    return f""", n AS (SELECT {k}, form, count(*) AS n, min(CAST(chapter_index AS BIGINT) * 1000000000 + position) AS seen FROM f GROUP BY ALL),
a AS (SELECT {k}, first(form ORDER BY n DESC, seen) AS form, CAST(count(*) AS BIGINT) AS form_count FROM n GROUP BY ALL),
b AS (SELECT {k}, coalesce(arg_min(type, CAST(chapter_index AS BIGINT) * 1000000000 + position) FILTER (type <> ''), '') AS type, CAST(count(*) AS BIGINT) AS total, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter,
CAST(count(DISTINCT chapter_index) AS BIGINT) AS chapter_count FROM f GROUP BY ALL) SELECT * FROM b JOIN a USING ({k})"""


@query("tx_lemma_rows", _vocab_sql("lemma"))
def tx_lemma_rows(spark, d):
    return text.vocabulary(load_facts(spark, d, "type", "lemma", "form"), ["lemma"])


@query("tx_parse_rows", _vocab_sql("lemma", "parse"))
def tx_parse_rows(spark, d):
    return text.vocabulary(_facts(spark, d), ["lemma", "parse"])


def _progress_sql(*keys: str) -> str:
    k = ", ".join(["run_id", *keys])
    return f""", t AS (SELECT {k}, chapter_index, count(*) AS occ FROM f GROUP BY ALL), u AS (SELECT *, chapter_index = min(chapter_index) OVER (PARTITION BY {k}) AS new FROM t),
c AS (SELECT run_id, chapter_index, count(*) FILTER (new) AS new_types, count(*) FILTER (NOT new) AS repeated_types, sum(occ) FILTER (new) AS new_tokens, sum(occ) FILTER (NOT new) AS repeated_tokens FROM u GROUP BY 1, 2),
prog AS (SELECT ch.run_id, ch.chapter_index, CAST(coalesce(new_types, 0) AS BIGINT) AS new_types, CAST(coalesce(repeated_types, 0) AS BIGINT) AS repeated_types, CAST(coalesce(new_tokens, 0) AS BIGINT) AS new_tokens, CAST(coalesce(repeated_tokens, 0) AS BIGINT) AS repeated_tokens FROM ch LEFT JOIN c USING (run_id, chapter_index)) """


@query("tx_progress", _progress_sql("lemma") + "SELECT * FROM prog")
def tx_progress(spark, d):
    """New and repeated lemmas per chapter."""
    return text.progress(load_facts(spark, d, "lemma"), load_chapters(spark, d), ["lemma"])


@query("tx_progress_parse", _progress_sql("lemma", "parse") + "SELECT * FROM prog")
def tx_progress_parse(spark, d):
    return text.progress(load_facts(spark, d, "lemma", "parse"), load_chapters(spark, d), ["lemma", "parse"])


@query("ui_progress_cols", _progress_sql("lemma") + """, s AS (SELECT *, new_tokens + repeated_tokens AS tokens, CASE WHEN new_types + repeated_types = 0 THEN 0.0 ELSE new_types / (new_types + repeated_types)::DOUBLE END AS new_share FROM prog)
SELECT * EXCLUDE (new_share), new_share FROM s""")
def ui_progress_cols(spark, d):
    return views.progress_columns(tx_progress(spark, d)).drop("new_percent")


@query("ui_pct", _progress_sql("lemma") + """, s AS (SELECT run_id, chapter_index, CASE WHEN new_types + repeated_types = 0 THEN 0 ELSE 100 * (new_types / (new_types + repeated_types)::DOUBLE) END AS p FROM prog)
SELECT run_id, chapter_index, CASE WHEN p IN (0, 100) THEN printf('%.0f', p) ELSE printf('%.1f', round(p, 1)) END || '%' AS new_percent FROM s""")
def ui_pct(spark, d):
    """The share of new words per chapter as text."""
    return views.progress_columns(tx_progress(spark, d)).select(RUN, "chapter_index", "new_percent")


@query("tx_refs", "SELECT run_id, chapter_index, id, title, filename FROM ch")
def tx_refs(spark, d):
    return load_chapters(spark, d)


@query("ui_lemma_search", _vocab_sql("lemma").replace(" SELECT * FROM b JOIN a USING", ", v AS (SELECT * FROM b JOIN a USING") + r"""), h AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY total DESC, lemma) AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY run_id) AS BIGINT) AS matches
FROM v WHERE contains(lower(regexp_replace(strip_accents(lemma), '(\p{L})Σ([^\p{L}]|$)', '\1ς\2', 'g')), 'ος')) SELECT * FROM h WHERE place <= 200""")
def ui_lemma_search(spark, d):
    """Lemmas that hold a syllable, accents and case aside; the first 200 of each run."""
    return views.search(tx_lemma_rows(spark, d), "ος", 200)


@query("ui_sort", _vocab_sql("lemma"))
def ui_sort(spark, d):
    """Vocabulary in the order of the alphabet, accents and case aside."""
    return views.sort_rows(tx_lemma_rows(spark, d), "lemma", "text")


# Lemma lens

_SEEN = "CAST(chapter_index AS BIGINT) * 1000000000 + position"
_DOM = f"ty AS (SELECT run_id, lemma, type, count(*) AS n, min({_SEEN}) AS seen FROM f GROUP BY 1, 2, 3), dom AS (SELECT run_id, lemma, first(type ORDER BY n DESC, seen) AS type FROM ty GROUP BY 1, 2)"


@query("le_summary", f""", {_DOM}, tr AS (SELECT DISTINCT run_id, lemma, chapter_index FROM f), gp AS (SELECT run_id, lemma, chapter_index, chapter_index - lag(chapter_index) OVER (PARTITION BY run_id, lemma ORDER BY chapter_index) AS gap FROM tr),
g AS (SELECT run_id, lemma, CAST(count(*) AS BIGINT) AS chapter_count, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, max(gap) AS longest_gap FROM gp GROUP BY 1, 2),
s AS (SELECT run_id, lemma, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT parse) AS BIGINT) AS parse_count, CAST(count(DISTINCT form) AS BIGINT) AS form_count FROM f GROUP BY 1, 2) SELECT * FROM dom JOIN s USING (run_id, lemma) JOIN g USING (run_id, lemma)""")
def le_summary(spark, d):
    return lemma.summary(_facts(spark, d))


@query("le_parses", f""", t0 AS (SELECT run_id, lemma, parse, type, count(*) AS n, min({_SEEN}) AS seen FROM f GROUP BY ALL), t1 AS (SELECT run_id, lemma, parse, first(type ORDER BY n DESC, seen) AS type FROM t0 GROUP BY 1, 2, 3),
f0 AS (SELECT run_id, lemma, parse, form, count(*) AS n, min({_SEEN}) AS seen FROM f GROUP BY ALL), f1 AS (SELECT run_id, lemma, parse, first(form ORDER BY n DESC, seen) AS form, CAST(count(*) AS BIGINT) AS form_count FROM f0 GROUP BY 1, 2, 3),
s AS (SELECT run_id, lemma, parse, CAST(count(*) AS BIGINT) AS occ, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter FROM f GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY run_id, lemma ORDER BY occ DESC, parse) AS INTEGER) AS place FROM s JOIN f1 USING (run_id, lemma, parse) JOIN t1 USING (run_id, lemma, parse)""")
def le_parses(spark, d):
    return lemma.parses(_facts(spark, d))


@query("le_forms", f""", p0 AS (SELECT run_id, lemma, form, parse, count(*) AS n, min({_SEEN}) AS seen, min(chapter_index) AS a, max(chapter_index) AS b FROM f GROUP BY 1, 2, 3, 4),
s AS (SELECT run_id, lemma, form, CAST(sum(n) AS BIGINT) AS occ, string_agg(parse, '¦' ORDER BY n DESC, seen) AS parses, min(a) AS first_chapter, max(b) AS last_chapter FROM p0 GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY run_id, lemma ORDER BY occ DESC, form) AS INTEGER) AS place FROM s""")
def le_forms(spark, d):
    return lemma.forms(load_facts(spark, d, "lemma", "form", "parse")).withColumn("parses", F.array_join("parses", BAR))


def chosen(facts: DataFrame) -> DataFrame:
    """run_id, lemma: in each run its most frequent noun, on ties the smaller lemma."""
    counts = facts.where("type = 'noun' and lemma <> ''").groupBy(RUN, "lemma").agg(F.count("*").alias("n"))
    return cut(counts.groupBy(RUN).agg(F.min_by("lemma", F.struct(-F.col("n"), "lemma")).alias("lemma")), "chosen")


_CHOSEN = ", want AS (SELECT run_id, first(lemma ORDER BY n DESC, lemma) AS lemma FROM (SELECT run_id, lemma, count(*) AS n FROM f WHERE type = 'noun' AND lemma <> '' GROUP BY 1, 2) GROUP BY 1)"


@query("le_chapters", _CHOSEN + """, c0 AS (SELECT run_id, lemma, chapter_index, parse, count(*) AS n, min(position) AS p FROM f SEMI JOIN want USING (run_id, lemma) GROUP BY 1, 2, 3, 4),
c1 AS (SELECT run_id, lemma, chapter_index, sum(n) AS occ, string_agg(parse || ':' || n, '¦' ORDER BY n DESC, p) AS parses FROM c0 GROUP BY 1, 2, 3), c2 AS (SELECT *, chapter_index - lag(chapter_index) OVER (PARTITION BY run_id, lemma ORDER BY chapter_index) AS gap_before FROM c1)
SELECT want.run_id, want.lemma, ch.chapter_index, CAST(coalesce(occ, 0) AS BIGINT) AS occ, CAST(sum(coalesce(occ, 0)) OVER (PARTITION BY want.run_id ORDER BY ch.chapter_index) AS BIGINT) AS cumulative, gap_before, coalesce(parses, '') AS parses
FROM want JOIN ch USING (run_id) LEFT JOIN c2 ON c2.run_id = want.run_id AND c2.lemma = want.lemma AND c2.chapter_index = ch.chapter_index""")
def le_chapters(spark, d):
    """One word of each run in all its chapters."""
    facts = _kept_facts(spark, d, "type", "lemma", "parse")
    rows = lemma.in_chapters(facts.join(chosen(facts), [RUN, "lemma"], "left_semi"), load_chapters(spark, d))
    return rows.withColumn("parses", F.array_join(F.transform("parses", lambda x: F.concat_ws(":", x["parse"], x["occ"].cast("string"))), BAR))


_KWIC = _CHOSEN + """, a AS (SELECT *, list(form) OVER (PARTITION BY run_id, chapter_index ORDER BY position ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS bf, list(form) OVER (PARTITION BY run_id, chapter_index ORDER BY position ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS af FROM f),
k0 AS (SELECT run_id, chapter_index, position, lemma, form, parse, coalesce(array_to_string(bf, ' '), '') AS before, coalesce(array_to_string(af, ' '), '') AS after, CAST(row_number() OVER (PARTITION BY run_id, lemma ORDER BY chapter_index, position) AS INTEGER) AS line,
CAST(count(*) OVER (PARTITION BY run_id, lemma) AS BIGINT) AS total FROM a SEMI JOIN want USING (run_id, lemma)), kwic AS (SELECT * FROM k0 WHERE line <= 400)"""


def _kwic(spark, d):
    facts = _kept_facts(spark, d, "type", "lemma", "form", "parse")
    lines = lemma.concordance(facts, chosen(facts))
    return lines.withColumn("before", F.array_join("before", " ")).withColumn("after", F.array_join("after", " "))


@query("le_kwic", _KWIC + " SELECT * FROM kwic")
def le_kwic(spark, d):
    """The first 400 places of one word of each run, with six words on both sides."""
    return _kwic(spark, d)


@query("ui_kwic_group", _KWIC + """, z AS (SELECT *, parse AS group_key, count(*) OVER (PARTITION BY run_id, lemma, parse) AS group_size, min(line) OVER (PARTITION BY run_id, lemma, parse) AS gf FROM kwic)
SELECT run_id, chapter_index, position, lemma, form, parse, before, after, line, total, group_key, CAST(group_size AS BIGINT) AS group_size, CAST(dense_rank() OVER (PARTITION BY run_id, lemma ORDER BY group_size DESC, gf) AS INTEGER) AS group_place FROM z""")
def ui_kwic_group(spark, d):
    """Those places grouped by parse, larger groups first."""
    return views.group_concordance(_kwic(spark, d), "parse")


@query("le_total", _CHOSEN + " SELECT run_id, lemma, CAST(count(f.position) AS BIGINT) AS total FROM want LEFT JOIN f USING (run_id, lemma) GROUP BY 1, 2")
def le_total(spark, d):
    """Places of one word of each run in all its chapters."""
    facts = _kept_facts(spark, d, "type", "lemma")
    return lemma.totals(facts, chosen(facts))


@query("le_total_chapters", _CHOSEN + """, n AS (SELECT run_id, lemma, chapter_index, count(*) AS n FROM f SEMI JOIN want USING (run_id, lemma) GROUP BY 1, 2, 3)
SELECT want.run_id, want.lemma, ch.chapter_index, CAST(coalesce(n, 0) AS BIGINT) AS total FROM want JOIN ch USING (run_id) LEFT JOIN n ON n.run_id = want.run_id AND n.lemma = want.lemma AND n.chapter_index = ch.chapter_index""")
def le_total_chapters(spark, d):
    """Places of one word of each run in every chapter."""
    facts = _kept_facts(spark, d, "type", "lemma")
    return lemma.chapter_totals(facts, chosen(facts), load_chapters(spark, d))


@query("le_asked", _CHOSEN + """, asked AS (SELECT run_id, lemma FROM want UNION ALL SELECT run_id, 'no such lemma' FROM want)
SELECT run_id, lemma, CAST(count(f.position) AS BIGINT) AS total FROM asked LEFT JOIN f USING (run_id, lemma) GROUP BY 1, 2""")
def le_asked(spark, d):
    """Places of asked words, one that each run has and one that it lacks."""
    facts = _kept_facts(spark, d, "type", "lemma")
    want = chosen(facts)
    return lemma.totals(facts, want.union(want.select(RUN, F.lit("no such lemma"))))


@query("le_filter_chapters", _KWIC.replace("PARTITION BY run_id, lemma", "PARTITION BY run_id, lemma, chapter_index") + " SELECT run_id, lemma, chapter_index, position, line, total FROM kwic")
def le_filter_chapters(spark, d):
    """The first 400 places of one word of each run in every chapter."""
    facts = _kept_facts(spark, d, "type", "lemma", "form", "parse")
    return lemma.concordance(facts, chosen(facts), context=0, by_chapter=True).select(RUN, "lemma", "chapter_index", "position", "line", "total")


# Export

_EXPORT = _ROWS + """, ex AS (SELECT run_id, row_no, ch.filename AS file, chapter_index, ch.id AS chapter_id, ch.title AS chapter_title, type, lemma, form, parse, lemma_occ, parse_occ, form_occ, first_occ_lemma, first_occ_parse, last_occ_lemma, last_occ_parse,
lemma_first_chapter, lemma_last_chapter, parse_first_chapter, parse_last_chapter FROM rows_ JOIN ch USING (run_id, chapter_index)),
nw AS (SELECT * FROM ex WHERE lemma_first_chapter = chapter_index),
nf0 AS (SELECT nw.run_id, nw.lemma, g.form, min(nw.row_no * 1000000 + rk) AS o FROM nw JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, chapter_index, lemma, parse ORDER BY n DESC, p) AS rk FROM g) AS g USING (run_id, chapter_index, lemma, parse) WHERE g.form <> '' GROUP BY 1, 2, 3),
nf AS (SELECT run_id, lemma, CAST(count(*) AS INTEGER) AS form_count, string_agg(form, ' · ' ORDER BY o) AS forms FROM nf0 GROUP BY 1, 2),
np AS (SELECT run_id, lemma, CAST(count(*) AS INTEGER) AS parse_count, string_agg(parse, ' · ' ORDER BY row_no) AS parses FROM nw WHERE parse <> '' GROUP BY 1, 2),
nl AS (SELECT run_id, min(row_no) AS row_no, file, chapter_index, chapter_id, chapter_title, arg_min(type, row_no) AS type, lemma, min(lemma_occ) AS lemma_occ, min(lemma_last_chapter) AS lemma_last_chapter FROM nw GROUP BY run_id, file, chapter_index, chapter_id, chapter_title, lemma),
new_ AS (SELECT nl.*, coalesce(form_count, 0) AS form_count, coalesce(forms, '') AS forms, coalesce(parse_count, 0) AS parse_count, coalesce(parses, '') AS parses, lemma_last_chapter - chapter_index + 1 AS chapter_span FROM nl LEFT JOIN nf USING (run_id, lemma) LEFT JOIN np USING (run_id, lemma))
"""


def _sheets(spark, d):
    rows, chapters = _rows(spark, d), load_chapters(spark, d)
    return export.row_sheet(rows, chapters), export.new_lemma_sheet(rows, chapters)


@query("ex_rows", _EXPORT + "SELECT * FROM ex")
def ex_rows(spark, d):
    return _sheets(spark, d)[0]


@query("ex_new_lemmas", _EXPORT + "SELECT * FROM new_")
def ex_new_lemmas(spark, d):
    return _sheets(spark, d)[1]


@query("ex_build", _EXPORT + """SELECT r.run_id, (SELECT count(*) FROM ex WHERE ex.run_id = r.run_id)::BIGINT AS row_count, (SELECT count(*) FROM new_ WHERE new_.run_id = r.run_id)::BIGINT AS new_lemma_count,
(SELECT count(*) FROM ex WHERE ex.run_id = r.run_id) > 0 AS exportable FROM (SELECT DISTINCT id AS run_id FROM runs) AS r""")
def ex_build(spark, d):
    """What an export of each run would hold."""
    return export.counts(*_sheets(spark, d), table(spark, d, "runs").select(F.col("id").alias(RUN)).distinct())


# Runs

_RUNS = "SELECT id, any_value(created_at) AS created_at, any_value(model_id) AS model_id, any_value(filenames) AS filenames, any_value(chapter_count) AS chapter_count, any_value(token_count) AS token_count, any_value(note) AS note FROM runs GROUP BY id"


def unique_runs(spark, d):
    return table(spark, d, "runs").dropDuplicates(["id"])


@query("run_list", f", r AS ({_RUNS}) SELECT id, created_at, model_id FROM r ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10")
def run_list(spark, d):
    """A page of runs, the newest first. The limit is the feature."""
    return views.page(unique_runs(spark, d).select("id", "created_at", "model_id"), [F.desc("created_at"), F.desc("id")], 10, 50)


@query("run_count", "SELECT CAST(count(DISTINCT id) AS BIGINT) AS runs FROM runs")
def run_count(spark, d):
    return unique_runs(spark, d).agg(F.count("*").alias("runs"))


@query("run_latest", f", r AS ({_RUNS}) SELECT id, created_at, token_count FROM r ORDER BY created_at DESC LIMIT 1")
def run_latest(spark, d):
    return unique_runs(spark, d).agg(F.max_by(F.struct("id", "created_at", "token_count"), "created_at").alias("r")).select("r.*")


@query("run_filenames", f", r AS ({_RUNS}) SELECT id, CAST(len(from_json(filenames, '[\"VARCHAR\"]')) AS INTEGER) AS files, from_json(filenames, '[\"VARCHAR\"]')[1] AS first_file FROM r")
def run_filenames(spark, d):
    """The JSON list of files of each run."""
    parsed = unique_runs(spark, d).select("id", F.from_json("filenames", "array<string>").alias("f"))
    return parsed.select("id", F.size("f").alias("files"), F.get("f", F.lit(0)).alias("first_file"))


@query("ui_paging", "SELECT 11 AS first, least(60, count(DISTINCT id))::BIGINT AS last, CAST(count(DISTINCT id) AS BIGINT) AS total, true AS has_previous, least(60, count(DISTINCT id)) < count(DISTINCT id) AS has_next FROM runs")
def ui_paging(spark, d):
    first, last, before, after = views.page_range(F.col("runs"), 10, 50)
    return run_count(spark, d).select(first.alias("first"), last.alias("last"), F.col("runs").alias("total"), before.alias("has_previous"), after.alias("has_next"))


@query("sql_adhoc", "SELECT coalesce(feat_tense, '') AS tense, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT run_id, chapter_index, position, feat_tense FROM token_facts) GROUP BY 1")
def sql_adhoc(spark, d):
    """SQL over the stored features."""
    table(spark, d, "token_facts").createOrReplaceTempView("stored_facts")
    return spark.sql("SELECT coalesce(feat_tense, '') AS tense, count(*) AS n FROM (SELECT DISTINCT run_id, chapter_index, position, feat_tense FROM stored_facts) GROUP BY 1")


@query("run_reindex", f"SELECT run_id, chapter_index, position, {', '.join(f'"{x}" AS feat_{x}' for x in DIMENSIONS)}, status AS feat_status, CAST(is_deponent AS INTEGER) AS feat_deponent FROM fm", DECODED)
def run_reindex(spark, d):
    """The feature columns as the decoder of today would store them."""
    return _decoded(spark, d).select(RUN, "chapter_index", "position", *(F.col(x).alias(f"feat_{x}") for x in DIMENSIONS), F.col("status").alias("feat_status"), F.col("is_deponent").cast("int").alias("feat_deponent"))


def _newest(spark, d):
    return unique_runs(spark, d).agg(F.max_by("id", "created_at").alias(RUN))


_NEWEST = f", r AS ({_RUNS}), z AS (SELECT arg_max(id, created_at) AS run_id FROM r)"


@query("scan_facts", _NEWEST + " SELECT chapter_index, position, type, lemma, form, parse FROM f SEMI JOIN z USING (run_id)")
def scan_facts(spark, d):
    """The facts of one run in reading order."""
    rows = _facts(spark, d).join(F.broadcast(_newest(spark, d)), RUN, "left_semi")
    return rows.select("chapter_index", "position", "type", "lemma", "form", "parse").orderBy("chapter_index", "position")


@query("sink_filename", f""", r AS ({_RUNS}), n AS (SELECT id, from_json(filenames, '["VARCHAR"]') AS fs, replace(substr(replace(substr(created_at, 1, 16), 'T', '-'), 1, 16), ':', '') AS st FROM r)
SELECT id, 'tokenweave-' || CASE WHEN len(fs) = 1 THEN coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(fs[1], '(?i)[.]docx$', ''), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'report') ELSE len(fs) || '-files' END || '-' || replace(substr(st, 1, 10), '-', '') || substr(st, 11) || '.xlsx' AS name FROM n""")
def sink_filename(spark, d):
    """The name that an export of each run would bear, with the minute of the run."""
    from ..sources.sinks import export_name_column

    rows = unique_runs(spark, d).select("id", F.from_json("filenames", "array<string>").alias("f"), F.to_timestamp(F.substring("created_at", 1, 16), "yyyy-MM-dd'T'HH:mm").alias("t"))
    return rows.select("id", export_name_column(F.col("f"), F.col("t")).alias("name"))
