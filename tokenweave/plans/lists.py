"""Queries of the lexicon lens and of ingest, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import chapters as chap
from ..operators import lexicon as lx
from ..operators import views
from ..operators.facts import load_chapters, load_facts
from ..session import cut, fresh_path, table
from ..sources import lists as ls
from ..sources import sinks
from ..sources import text as tx
from .base import WITH, fold_key, match_key

RUN = "run_id"
_S = r"\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOLD = f"regexp_replace(coalesce(lemma, ''), '[{_S}]+', '', 'g') <> ''"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = ""):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = base + sql
        return fn

    return register


class Lens:
    """What the lexicon queries share. The matches of the distinct lemmas are a table of their own."""

    def __init__(self, spark: SparkSession, d: str, *columns: str):
        self.facts = load_facts(spark, d, "lemma", *columns)
        self.chapters = load_chapters(spark, d)
        entries = table(spark, d, "lexicon_entries")
        reference = entries.where("lemma is not null").agg(F.coalesce(F.sum("ref_count"), F.lit(0)).alias("n")).first().n
        self.entries = cut(lx.keyed(entries, reference), "entries")
        self.aliases = table(spark, d, "greek_core_5k_aliases")
        lemmas = table(spark, d, "token_facts").select(F.coalesce("lemma", F.lit("")).alias("lemma")).distinct()
        self.matches = cut(lx.lookup(lemmas, self.entries, self.aliases), "matches")
        self.placed = lx.place(self.facts, self.matches)
        self.runs = self.chapters.select(RUN).distinct()

    def rows(self) -> DataFrame:
        return lx.entry_rows(self.placed, self.matches, self.entries, self.runs)


_LIST = f"""
e AS (SELECT rank, lemma, coalesce(gloss, '') AS gloss, coalesce(kind, '') AS kind, coalesce(ref_count, 0) AS ref_count, {match_key('lemma')} AS match_key, {fold_key('lemma')} AS fold_key,
coalesce(ref_count, 0) / (SELECT sum(ref_count) FROM lexicon_entries WHERE lemma IS NOT NULL)::DOUBLE AS ref_share FROM lexicon_entries WHERE lemma IS NOT NULL),
al AS (SELECT DISTINCT {match_key('variant')} AS k, e.rank FROM greek_core_5k_aliases a JOIN e ON e.match_key = {match_key('a.lemma')} WHERE variant IS NOT NULL),
wd AS (SELECT lemma, {match_key('lemma')} AS mk, {fold_key('lemma')} AS fk FROM (SELECT DISTINCT coalesce(lemma, '') AS lemma FROM token_facts)),
ly AS (SELECT wd.lemma, rank, 0 AS layer FROM wd JOIN e ON mk = match_key UNION ALL SELECT wd.lemma, rank, 1 FROM wd JOIN al ON mk = k UNION ALL SELECT wd.lemma, rank, 2 FROM wd JOIN e ON fk = fold_key),
mt AS (SELECT lemma, rank, ['exact', 'alias', 'folded'][layer + 1] AS how, count(*) OVER (PARTITION BY lemma) > 1 AS ambiguous FROM (SELECT *, min(layer) OVER (PARTITION BY lemma) AS best FROM ly) WHERE layer = best)
"""
_ONLY_LIST = "WITH " + _LIST
_LX = WITH + "," + _LIST + """,
pl AS (SELECT run_id, lemma, chapter_index, count(*) AS occ, CASE WHEN lemma IN (SELECT lemma FROM mt) THEN 'on' WHEN regexp_matches(lemma, '^\\p{L}') AND substr(lemma, 1, 1) <> lower(substr(lemma, 1, 1)) THEN 'proper' ELSE 'off' END AS lot FROM f GROUP BY 1, 2, 3),
us AS (SELECT run_id, rank, chapter_index, pl.lemma, occ, how, ambiguous FROM pl JOIN mt ON pl.lemma = mt.lemma),
uc AS (SELECT run_id, rank, chapter_index, sum(occ) AS occ FROM us GROUP BY 1, 2, 3),
sp AS (SELECT run_id, rank, sum(occ) AS occ, min(chapter_index) AS first_chapter, count(*) AS chapter_count, string_agg(chapter_index || ':' || occ, ' ' ORDER BY chapter_index) AS chapters FROM uc GROUP BY 1, 2),
so AS (SELECT run_id, rank, lemma, sum(occ) AS n, min(CASE how WHEN 'exact' THEN 1 WHEN 'alias' THEN 2 ELSE 3 END) AS st, bool_or(ambiguous) AS ambiguous FROM us GROUP BY 1, 2, 3),
cr AS (SELECT run_id, rank, ['exact', 'alias', 'folded'][min(st)] AS matched_by, bool_or(ambiguous) AS ambiguous, first(lemma ORDER BY n DESC, lemma) AS source_lemma FROM so GROUP BY 1, 2),
rn AS (SELECT DISTINCT run_id FROM ch),
er AS (SELECT rn.run_id, e.rank, e.lemma, gloss, kind, ref_share, CAST(coalesce(occ, 0) AS BIGINT) AS occ, first_chapter, CAST(coalesce(chapter_count, 0) AS BIGINT) AS chapter_count, coalesce(chapters, '') AS chapters, coalesce(matched_by, '') AS matched_by,
coalesce(ambiguous, false) AS ambiguous, coalesce(source_lemma, '') AS source_lemma FROM rn CROSS JOIN e LEFT JOIN sp ON sp.run_id = rn.run_id AND sp.rank = e.rank LEFT JOIN cr ON cr.run_id = rn.run_id AND cr.rank = e.rank)
"""


@query("k_match_key", f"SELECT DISTINCT lemma, {match_key('lemma')} AS match_key FROM (SELECT lemma FROM token_facts UNION SELECT lemma FROM lexicon_entries) WHERE lemma IS NOT NULL")
def k_match_key(spark, d):
    lemmas = table(spark, d, "token_facts").select("lemma").union(table(spark, d, "lexicon_entries").select("lemma")).distinct().dropna()
    return lemmas.select("lemma", keys.match_key(F.col("lemma")).alias("match_key"))


@query("k_fold_key", f"SELECT DISTINCT lemma, {fold_key('lemma')} AS fold_key FROM (SELECT lemma FROM token_facts UNION SELECT lemma FROM lexicon_entries) WHERE lemma IS NOT NULL")
def k_fold_key(spark, d):
    lemmas = table(spark, d, "token_facts").select("lemma").union(table(spark, d, "lexicon_entries").select("lemma")).distinct().dropna()
    return lemmas.select("lemma", keys.fold_key(F.col("lemma")).alias("fold_key"))


@query("k_is_proper", "SELECT DISTINCT lemma, regexp_matches(lemma, '^\\p{L}') AND substr(lemma, 1, 1) <> lower(substr(lemma, 1, 1)) AS proper FROM token_facts WHERE lemma IS NOT NULL")
def k_is_proper(spark, d):
    return table(spark, d, "token_facts").select("lemma").distinct().dropna().select("lemma", keys.is_proper(F.col("lemma")).alias("proper"))


@query("k_ref_share", "SELECT rank, lemma, ref_share FROM e", _ONLY_LIST)
def k_ref_share(spark, d):
    entries = table(spark, d, "lexicon_entries").where("lemma is not null")
    total = entries.agg(F.sum("ref_count").alias("n"))
    return entries.crossJoin(F.broadcast(total)).select("rank", "lemma", keys.safe_share(F.coalesce("ref_count", F.lit(0)), F.col("n")).alias("ref_share"))


@query("ui_fold", "SELECT lemma, lower(strip_accents(lemma)) AS fold FROM lexicon_entries WHERE lemma IS NOT NULL")
def ui_fold(spark, d):
    lemmas = table(spark, d, "lexicon_entries").select("lemma").dropna()
    return lemmas.select("lemma", keys.search_fold(F.col("lemma")).alias("fold"))


@query("lx_lookup", "SELECT lemma, rank, how, ambiguous FROM mt", _ONLY_LIST)
def lx_lookup(spark, d):
    """What each distinct lemma finds on the list."""
    entries = lx.keyed(table(spark, d, "lexicon_entries"), 1)
    lemmas = table(spark, d, "token_facts").select(F.coalesce("lemma", F.lit("")).alias("lemma")).distinct()
    return lx.lookup(lemmas, entries, table(spark, d, "greek_core_5k_aliases"))


@query("lx_alias_resolve", "SELECT k AS match_key, rank FROM al", _ONLY_LIST)
def lx_alias_resolve(spark, d):
    return lx.resolve_aliases(table(spark, d, "greek_core_5k_aliases"), lx.keyed(table(spark, d, "lexicon_entries"), 1))


@query("lx_ambiguous", "SELECT DISTINCT lemma FROM mt WHERE ambiguous", _ONLY_LIST)
def lx_ambiguous(spark, d):
    return lx_lookup(spark, d).where("ambiguous").select("lemma").distinct()


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chapters", F.array_join(F.transform("chapters", lambda c: F.concat_ws(":", c["chapter_index"].cast("string"), c["occ"].cast("string"))), " "))


@query("lx_entries", "SELECT * FROM er", _LX)
def lx_entries(spark, d):
    """Every entry of the list in every run."""
    return _flat(Lens(spark, d).rows())


_SUMMARY = """, ls AS (SELECT run_id, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (occ > 0) AS BIGINT) AS covered, coalesce(sum(ref_share) FILTER (occ > 0), 0) AS ref_share_covered, sum(ref_share) AS ref_share_total FROM er GROUP BY 1),
lt AS (SELECT run_id, CAST(sum(occ) AS BIGINT) AS tokens, CAST(coalesce(sum(occ) FILTER (lot = 'on'), 0) AS BIGINT) AS tokens_on_list, CAST(coalesce(sum(occ) FILTER (lot = 'off'), 0) AS BIGINT) AS tokens_off_list, CAST(coalesce(sum(occ) FILTER (lot = 'proper'), 0) AS BIGINT) AS tokens_proper FROM pl GROUP BY 1),
lc AS (SELECT run_id, CAST(count(*) AS BIGINT) AS chapter_count FROM ch GROUP BY 1)"""


@query("lx_summary", _SUMMARY + " SELECT *, covered / entries::DOUBLE AS covered_share, tokens_on_list / tokens::DOUBLE AS on_list_share FROM ls JOIN lt USING (run_id) JOIN lc USING (run_id)", _LX)
def lx_summary(spark, d):
    lens = Lens(spark, d)
    return lx.summary(lens.placed, lens.rows(), lens.chapters)


@query("lx_bands", """, b AS (SELECT run_id, (rank - 1) // 500 AS band, * EXCLUDE (run_id) FROM er) SELECT run_id, CAST(band * 500 + 1 AS INTEGER) AS start, CAST(least((band + 1) * 500, (SELECT max(rank) FROM e)) AS INTEGER) AS "end", CAST(count(*) AS BIGINT) AS entries,
CAST(count(*) FILTER (occ > 0) AS BIGINT) AS covered, sum(ref_share) AS ref_share, coalesce(sum(ref_share) FILTER (occ > 0), 0) AS ref_share_covered FROM b GROUP BY run_id, band""", _LX)
def lx_bands(spark, d):
    return lx.bands(Lens(spark, d).rows())


_PROGRESS = """, ta AS (SELECT run_id, first_chapter AS chapter_index, count(*) AS new_entries, sum(ref_share) AS new_ref_share FROM er WHERE occ > 0 GROUP BY 1, 2),
nw AS (SELECT *, chapter_index = min(chapter_index) OVER (PARTITION BY run_id, lemma) AS new FROM pl),
lo AS (SELECT run_id, chapter_index, sum(occ) AS tokens, sum(occ) FILTER (lot = 'on') AS tokens_on_list, sum(occ) FILTER (lot = 'off') AS tokens_off_list, sum(occ) FILTER (lot = 'proper') AS tokens_proper, count(*) FILTER (lot = 'on' AND new) AS new_on_list_types,
count(*) FILTER (lot <> 'on' AND new) AS new_off_list_types, sum(occ) FILTER (lot = 'on' AND new) AS new_on_list_tokens, sum(occ) FILTER (lot <> 'on' AND new) AS new_off_list_tokens FROM nw GROUP BY 1, 2),
pr0 AS (SELECT ch.run_id, ch.chapter_index, CAST(coalesce(new_entries, 0) AS BIGINT) AS new_entries, coalesce(new_ref_share, 0) AS new_ref_share, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(tokens_on_list, 0) AS BIGINT) AS tokens_on_list,
CAST(coalesce(tokens_off_list, 0) AS BIGINT) AS tokens_off_list, CAST(coalesce(tokens_proper, 0) AS BIGINT) AS tokens_proper, CAST(coalesce(new_on_list_types, 0) AS BIGINT) AS new_on_list_types, CAST(coalesce(new_off_list_types, 0) AS BIGINT) AS new_off_list_types,
CAST(coalesce(new_on_list_tokens, 0) AS BIGINT) AS new_on_list_tokens, CAST(coalesce(new_off_list_tokens, 0) AS BIGINT) AS new_off_list_tokens FROM ch LEFT JOIN ta USING (run_id, chapter_index) LEFT JOIN lo USING (run_id, chapter_index)),
pr AS (SELECT *, CAST(sum(new_entries) OVER w AS BIGINT) AS cumulative_entries, sum(new_ref_share) OVER w AS cumulative_ref_share, tokens_off_list + tokens_proper AS tokens_off_list_with_names FROM pr0 WINDOW w AS (PARTITION BY run_id ORDER BY chapter_index))"""


def _progress(spark, d):
    lens = Lens(spark, d)
    return lx.progress(lens.placed, lens.rows(), lens.chapters)


@query("lx_progress", _PROGRESS + " SELECT * FROM pr", _LX)
def lx_progress(spark, d):
    """What of the list each chapter teaches, and how its words divide."""
    return _progress(spark, d)


@query("lx_gaps", ", g AS (SELECT run_id, rank, lemma, gloss, kind, ref_share, CAST(row_number() OVER (PARTITION BY run_id ORDER BY rank) AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY run_id) AS BIGINT) AS total FROM er WHERE occ = 0) SELECT * FROM g WHERE place <= 200", _LX)
def lx_gaps(spark, d):
    """The first 200 entries that each run never uses. The limit is the feature."""
    return lx.gaps(Lens(spark, d).rows())


@query("lx_off_list", """, r AS (SELECT run_id, lemma, CAST(sum(occ) AS BIGINT) AS occ, min(chapter_index) AS first_chapter, CAST(count(*) AS BIGINT) AS chapter_count, bool_or(lot = 'proper') AS proper FROM pl WHERE lot <> 'on' GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY occ DESC, lemma) AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY run_id) AS BIGINT) AS total FROM r),
ty AS (SELECT run_id, lemma, type, count(*) AS n, min(CAST(chapter_index AS BIGINT) * 1000000000 + position) AS seen FROM f GROUP BY 1, 2, 3), dm AS (SELECT run_id, lemma, first(type ORDER BY n DESC, seen) AS type FROM ty GROUP BY 1, 2) SELECT o.*, dm.type FROM o JOIN dm USING (run_id, lemma) WHERE place <= 200""", _LX)
def lx_off_list(spark, d):
    """The 200 most frequent words of each run that are not on the list. The limit is the feature."""
    lens = Lens(spark, d, "type")
    return lx.off_list(lens.facts, lens.placed)


_AUDIT = """, wl AS (SELECT run_id, lemma, lot, sum(occ) AS occ FROM pl GROUP BY 1, 2, 3), hw AS (SELECT lemma, min(how) AS how, bool_or(ambiguous) AS ambiguous FROM mt GROUP BY 1),
au AS (SELECT run_id, CAST(count(*) AS BIGINT) AS text_lemmas, CAST(count(*) FILTER (lot = 'on') AS BIGINT) AS matched_lemmas, CAST(count(*) FILTER (how = 'exact') AS BIGINT) AS exact, CAST(count(*) FILTER (how = 'alias') AS BIGINT) AS alias,
CAST(count(*) FILTER (how = 'folded') AS BIGINT) AS folded, CAST(count(*) FILTER (ambiguous) AS BIGINT) AS ambiguous, CAST(count(*) FILTER (lot = 'off') AS BIGINT) AS unmatched_lemmas, CAST(coalesce(sum(occ) FILTER (lot = 'off'), 0) AS BIGINT) AS unmatched_tokens,
CAST(count(*) FILTER (lot = 'proper') AS BIGINT) AS proper_lemmas, CAST(coalesce(sum(occ) FILTER (lot = 'proper'), 0) AS BIGINT) AS proper_tokens, CAST(coalesce(sum(occ) FILTER (lot = 'on'), 0) AS BIGINT) AS tokens_on_list, CAST(sum(occ) AS BIGINT) AS tokens
FROM wl LEFT JOIN hw USING (lemma) GROUP BY 1)"""


@query("lx_match", _AUDIT + " SELECT *, tokens_on_list / tokens::DOUBLE < 0.8 AS warn FROM au", _LX)
def lx_match(spark, d):
    lens = Lens(spark, d)
    return views.match_warning(lx.match_audit(lens.placed, lens.matches))


@query("lx_dominant_type", """WITH f AS (SELECT DISTINCT run_id, chapter_index, position, coalesce(type, '') AS type, coalesce(lemma, '') AS lemma FROM token_facts),
ty AS (SELECT run_id, lemma, type, count(*) AS n, min(CAST(chapter_index AS BIGINT) * 1000000000 + position) AS seen FROM f GROUP BY 1, 2, 3) SELECT run_id, lemma, first(type ORDER BY n DESC, seen) AS type FROM ty GROUP BY 1, 2""")
def lx_dominant_type(spark, d):
    return lx.dominant_type(load_facts(spark, d, "type", "lemma"), [RUN, "lemma"])


@query("lx_ref", f"SELECT 'core' AS id, 'Core list' AS name, 'Core' AS short_name, CAST(count(*) FILTER ({_TOLD}) AS BIGINT) AS entry_count, CAST(sum(ref_count) AS BIGINT) AS reference_tokens, true AS is_default FROM lexicon_entries")
def lx_ref(spark, d):
    """What the list is, as the registry of a folder with its manifest tells it."""
    entries = table(spark, d, "lexicon_entries")
    tokens = entries.agg(F.coalesce(F.sum("ref_count"), F.lit(0)).alias("n")).first().n
    folder = fresh_path(spark, "lists")
    entries.write.option("header", True).option("escape", '"').csv(f"{folder}/core.csv")
    manifest = {"lexicons": [{"id": "core", "name": "Core list", "short_name": "Core", "entries_file": "core.csv", "reference_tokens": tokens, "default": True}, {"id": "gone", "entries_file": "gone.csv"}, {"name": "without id"}]}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest.json")
    metas = [(m.id, m.name, m.short_name, m.entry_count, m.reference_tokens, m.is_default) for m in ls.ListRegistry(spark, folder).available()]
    return spark.createDataFrame(metas, "id string, name string, short_name string, entry_count long, reference_tokens long, is_default boolean")


#: Parts of speech and the kind of word they are.
KINDS = {"noun": "L", "verb": "L", "adjective": "L", "adverb": "L", "proper noun": "L", "article": "F", "particle": "F"}


@query("prep_freq", """, w AS (SELECT regexp_replace(lemma, '\\(([^)]*)\\)', '\\1', 'g') AS lemma, type, count(*) AS n, min((run_id, chapter_index, position)) AS seen FROM f GROUP BY 1, 2),
c AS (SELECT lemma, CAST(sum(n) AS BIGINT) AS ref_count, first(type ORDER BY n DESC, seen) AS type FROM w GROUP BY 1), gl AS (SELECT match_key, arg_min(gloss, rank) AS gloss FROM e WHERE gloss <> '' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY ref_count DESC, lemma) AS rank, sum(ref_count) OVER (ORDER BY ref_count DESC, lemma ROWS UNBOUNDED PRECEDING) AS running, sum(ref_count) OVER () AS everything FROM c)
SELECT CAST(rank AS INTEGER) AS rank, lemma, coalesce(gl.gloss, '') AS gloss, CASE WHEN type IN ('noun', 'verb', 'adjective', 'adverb', 'proper noun') THEN 'L' WHEN type IN ('article', 'particle') THEN 'F' ELSE '' END AS kind, ref_count,
round(100 * running / everything::DOUBLE, 4) AS ref_coverage FROM r LEFT JOIN gl ON gl.match_key = """ + match_key("r.lemma"), _LX)
def prep_freq(spark, d):
    """A frequency list made from the facts themselves."""
    entries = lx.keyed(table(spark, d, "lexicon_entries"), 1)
    return lx.frequency_list(load_facts(spark, d, "type", "lemma"), KINDS, entries.select("rank", "match_key", "gloss"))


@query("prep_core", "SELECT rank, lemma, coalesce(gloss, '') AS gloss, kind, ref_count, ref_coverage FROM lexicon_entries WHERE kind IN ('L', 'F') AND lemma IS NOT NULL")
def prep_core(spark, d):
    """The entries of known kind, from a list whose ranks and lemmas are sound."""
    return lx.core_list(table(spark, d, "lexicon_entries"))


# Scopes over the list

_SCOPE = """, sc AS (SELECT er.run_id, er.rank, er.lemma, CAST(coalesce(sum(uc.occ) FILTER (uc.chapter_index <= 3), 0) AS BIGINT) AS scope_occ, CAST(coalesce(sum(uc.occ) FILTER (uc.chapter_index = 3), 0) AS BIGINT) AS scope_here,
min(uc.chapter_index) FILTER (uc.chapter_index <= 3) AS scope_first, CAST(count(uc.chapter_index) FILTER (uc.chapter_index <= 3) AS BIGINT) AS scope_chapters, er.ambiguous, er.matched_by FROM er LEFT JOIN uc USING (run_id, rank) GROUP BY ALL)"""


def _scoped(spark, d):
    return views.scope_entries(Lens(spark, d).rows(), 3)


@query("ui_lex_scope_entry", _SCOPE + " SELECT run_id, rank, lemma, scope_occ, scope_here, scope_first, scope_chapters FROM sc", _LX)
def ui_lex_scope_entry(spark, d):
    """Entries through the fourth chapter of each run."""
    return _scoped(spark, d).select(RUN, "rank", "lemma", "scope_occ", "scope_here", "scope_first", "scope_chapters")


@query("ui_lex_scope_view", _SCOPE + _PROGRESS + """, a AS (SELECT run_id, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (scope_occ > 0) AS BIGINT) AS covered, max(scope_occ) AS max_occ FROM sc GROUP BY 1),
b AS (SELECT run_id, CAST(count(*) AS BIGINT) AS chapters, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens_on_list) AS BIGINT) AS tokens_on_list, CAST(sum(tokens_off_list) AS BIGINT) AS tokens_off_list, CAST(sum(tokens_proper) AS BIGINT) AS tokens_proper FROM pr WHERE chapter_index <= 3 GROUP BY 1)
SELECT a.*, coalesce(chapters, 0) AS chapters, coalesce(tokens, 0) AS tokens, coalesce(tokens_on_list, 0) AS tokens_on_list, coalesce(tokens_off_list, 0) AS tokens_off_list, coalesce(tokens_proper, 0) AS tokens_proper FROM a LEFT JOIN b USING (run_id)""", _LX)
def ui_lex_scope_view(spark, d):
    lens = Lens(spark, d)
    rows = lens.rows()
    return views.scope_summary(views.scope_entries(rows, 3), lx.progress(lens.placed, rows, lens.chapters), 3)


@query("ui_lex_scope_bands", _SCOPE + """, b AS (SELECT sc.run_id, (sc.rank - 1) // 500 AS band, sc.rank, scope_occ, e.ref_share FROM sc JOIN e USING (rank)) SELECT run_id, CAST(band * 500 + 1 AS INTEGER) AS start, CAST(least((band + 1) * 500, (SELECT max(rank) FROM e)) AS INTEGER) AS "end",
CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (scope_occ > 0) AS BIGINT) AS covered, sum(ref_share) AS ref_share, coalesce(sum(ref_share) FILTER (scope_occ > 0), 0) AS ref_share_covered FROM b GROUP BY run_id, band""", _LX)
def ui_lex_scope_bands(spark, d):
    return lx.bands(_scoped(spark, d).withColumn("occ", F.col("scope_occ")))


@query("ui_lex_scope_half", """, hf AS (SELECT run_id, max(chapter_index) // 2 AS half FROM ch GROUP BY 1), er2 AS (SELECT run_id, rank, half FROM er JOIN hf USING (run_id))
SELECT er2.run_id, er2.rank, half, CAST(coalesce(sum(uc.occ) FILTER (uc.chapter_index <= half), 0) AS BIGINT) AS scope_occ, CAST(coalesce(sum(uc.occ) FILTER (uc.chapter_index = half), 0) AS BIGINT) AS scope_here,
min(uc.chapter_index) FILTER (uc.chapter_index <= half) AS scope_first, CAST(count(uc.chapter_index) FILTER (uc.chapter_index <= half) AS BIGINT) AS scope_chapters FROM er2 LEFT JOIN uc USING (run_id, rank) GROUP BY 1, 2, 3""", _LX)
def ui_lex_scope_half(spark, d):
    """Entries through the chapter in the middle of each run."""
    lens = Lens(spark, d)
    half = lens.chapters.groupBy(RUN).agg(F.floor(F.max("chapter_index") / 2).cast("int").alias("half"))
    scoped = views.scope_entries(lens.rows().join(half, RUN), F.col("half"))
    return scoped.select(RUN, "rank", "half", "scope_occ", "scope_here", "scope_first", "scope_chapters")


@query("ui_growth", _PROGRESS + """ SELECT run_id, chapter_index, new_on_list_types AS on_new, CAST(sum(new_on_list_types) OVER w - new_on_list_types AS BIGINT) AS on_repeated, new_off_list_types AS off_new, CAST(sum(new_off_list_types) OVER w - new_off_list_types AS BIGINT) AS off_repeated,
CAST(sum(new_on_list_types) OVER w AS BIGINT) AS on_all, CAST(sum(new_off_list_types) OVER w AS BIGINT) AS off_all, CAST(sum(new_on_list_types + new_off_list_types) OVER w AS BIGINT) AS total FROM pr WINDOW w AS (PARTITION BY run_id ORDER BY chapter_index)""", _LX)
def ui_growth(spark, d):
    """Growth in types."""
    return views.growth(_progress(spark, d), "types")


@query("ui_growth_tokens", _PROGRESS + """ SELECT run_id, chapter_index, CAST(sum(new_on_list_tokens) OVER w AS BIGINT) AS on_new, CAST(sum(tokens_on_list - new_on_list_tokens) OVER w AS BIGINT) AS on_repeated, CAST(sum(new_off_list_tokens) OVER w AS BIGINT) AS off_new,
CAST(sum(tokens_off_list_with_names - new_off_list_tokens) OVER w AS BIGINT) AS off_repeated, CAST(sum(tokens_on_list) OVER w AS BIGINT) AS on_all, CAST(sum(tokens_off_list_with_names) OVER w AS BIGINT) AS off_all, CAST(sum(tokens) OVER w AS BIGINT) AS total
FROM pr WINDOW w AS (PARTITION BY run_id ORDER BY chapter_index)""", _LX)
def ui_growth_tokens(spark, d):
    return views.growth(_progress(spark, d), "tokens")


@query("ui_lex_window", _SCOPE + " SELECT run_id, rank, lemma, scope_occ FROM sc WHERE rank <= 1000 AND scope_occ > 0", _LX)
def ui_lex_window(spark, d):
    """The entries of the first 1,000 ranks met through the fourth chapter."""
    return views.window_entries(_scoped(spark, d), "1000", "met").select(RUN, "rank", "lemma", "scope_occ")


@query("ui_match_label", _SCOPE + " SELECT run_id, rank, CASE WHEN scope_occ = 0 THEN '' ELSE concat_ws(' · ', CASE WHEN ambiguous THEN 'ambiguous' END, CASE WHEN matched_by IN ('alias', 'folded') THEN matched_by END) END AS match_label FROM sc", _LX)
def ui_match_label(spark, d):
    return views.match_label(_scoped(spark, d)).select(RUN, "rank", "match_label")


@query("ui_sqrt_bar", ", mx AS (SELECT run_id, max(occ) AS most FROM er GROUP BY 1) SELECT run_id, rank, CAST(CASE WHEN occ > 0 THEN greatest(2, floor(100 * sqrt(occ / most::DOUBLE) + 0.5)) END AS INTEGER) AS width FROM er JOIN mx USING (run_id)", _LX)
def ui_sqrt_bar(spark, d):
    rows = Lens(spark, d).rows()
    most = rows.groupBy(RUN).agg(F.max("occ").alias("most"))
    return rows.join(most, RUN).select(RUN, "rank", views.bar_width(F.col("occ"), F.col("most")).alias("width"))


# Ingest, over the texts of the chapters

_T = f"""WITH t AS (SELECT DISTINCT run_id, filename, chapter_index, title, coalesce(text, '') AS text FROM text_chapters),
l AS (SELECT *, list_filter(string_split_regex(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), '\\r\\n|[\\n\\r]'), lambda x: NOT regexp_matches(nfc_normalize(regexp_replace(x, '^[{_S}]+', '')), '^μέρος')) AS ls FROM t),
c AS (SELECT run_id, filename, chapter_index, title, regexp_replace(array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_full_match(x, '[{_S}]*') THEN '' ELSE x END), chr(10)), '\\n$', '') AS text FROM l),
"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_chapters").dropDuplicates(["run_id", "chapter_index"])
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).withColumn("text", tx.clean(F.col("text")))


@query("src_clean", "z AS (SELECT 1) SELECT run_id, chapter_index, text FROM c", _T)
def src_clean(spark, d):
    """The texts without bracketed parts and running heads."""
    return _cleaned(spark, d).select(RUN, "chapter_index", "text")


_STRIPPED = f"regexp_replace(text, '^[{_S}]+|[{_S}]+$', '', 'g')"


@query("src_paragraphs", f"p AS (SELECT run_id, chapter_index, list_filter(list_transform(string_split_regex({_STRIPPED}, '\\n[{_S}]*\\n+'), lambda x: regexp_replace(x, '^[{_S}]+|[{_S}]+$', '', 'g')), lambda x: x <> '') AS ps FROM c) SELECT run_id, chapter_index, i - 1 AS paragraph_no, ps[i] AS paragraph FROM (SELECT *, unnest(range(1, len(ps) + 1))::INTEGER AS i FROM p)", _T)
def src_paragraphs(spark, d):
    return _cleaned(spark, d).select(RUN, "chapter_index", F.posexplode(tx.paragraphs(F.col("text"))).alias("paragraph_no", "paragraph"))


_PARAGRAPHS = f"p AS (SELECT run_id, chapter_index, list_filter(list_transform(string_split_regex({_STRIPPED}, '\\n[{_S}]*\\n+'), lambda x: regexp_replace(x, '^[{_S}]+|[{_S}]+$', '', 'g')), lambda x: x <> '') AS ps FROM c)"


def _pieces_sql(p: str, limit: int) -> str:
    """The pieces of a paragraph: sentences joined while they fit, longer ones cut by length and left alone."""
    sentences = f"string_split(regexp_replace({p}, '([.·;!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    cut_or_whole = f"""list_transform({sentences}, lambda s: CASE WHEN length(s) > {limit} THEN list_transform(range(0, (length(s) + {limit - 1}) // {limit}), lambda i: {{'t': substr(s, CAST(i * {limit} + 1 AS BIGINT), {limit}), 'o': false}}) ELSE [{{'t': s, 'o': true}}] END)"""
    packed = f"""list_reduce({cut_or_whole}, lambda a, x: CASE WHEN x[1].o AND a[-1].o AND length(a[-1].t) + 1 + length(x[1].t) <= {limit} THEN list_concat(a[1:len(a) - 1], [{{'t': a[-1].t || ' ' || x[1].t, 'o': true}}]) ELSE list_concat(a, x) END)"""
    return f"CASE WHEN length({p}) <= {limit} THEN [{p}] ELSE list_transform({packed}, lambda y: y.t) END"


@query("src_chunk", f"""{_PARAGRAPHS}, q AS (SELECT run_id, chapter_index, flatten(list_transform(ps, lambda p: {_pieces_sql('p', 1200)})) AS qs FROM p WHERE len(ps) > 0),
k AS (SELECT run_id, chapter_index, list_reduce(list_transform(qs, lambda q: [q]), lambda a, x: CASE WHEN length(a[-1]) + 2 + length(x[1]) <= 1200 THEN list_concat(a[1:len(a) - 1], [a[-1] || chr(10) || chr(10) || x[1]]) ELSE list_concat(a, x) END) AS ks FROM q)
SELECT run_id, chapter_index, CAST(i - 1 AS INTEGER) AS chunk_no, ks[i] AS chunk FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM k)""", _T)
def src_chunk(spark, d):
    """The chunks of every chapter, of at most 1,200 characters."""
    return _cleaned(spark, d).select(RUN, "chapter_index", F.posexplode(tx.chunks(F.col("text"), 1200)).alias("chunk_no", "chunk"))


@query("src_split_long", f"""{_PARAGRAPHS}, o AS (SELECT run_id, chapter_index, i - 1 AS paragraph_no, ps[i] AS p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p)),
k AS (SELECT run_id, chapter_index, paragraph_no, {_pieces_sql('p', 400)} AS ks FROM o WHERE length(p) > 400)
SELECT run_id, chapter_index, CAST(paragraph_no AS INTEGER) AS paragraph_no, CAST(i - 1 AS INTEGER) AS piece_no, ks[i] AS piece FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM k)""", _T)
def src_split_long(spark, d):
    """Every paragraph of more than 400 characters, in pieces."""
    paragraphs = _cleaned(spark, d).select(RUN, "chapter_index", F.posexplode(tx.paragraphs(F.col("text"))).alias("paragraph_no", "p"))
    return paragraphs.where(F.length("p") > 400).select(RUN, "chapter_index", "paragraph_no", F.posexplode(tx.split_long(F.col("p"), 400)).alias("piece_no", "piece"))


@query("src_word_tokens", f"w AS (SELECT *, list_filter(list_transform(string_split_regex({_STRIPPED}, '[{_S}]+'), lambda x: regexp_replace(x, '^[.,·;!?]+|[.,·;!?]+$', '', 'g')), lambda x: x <> '') AS ws FROM c) SELECT run_id, chapter_index, filename, title AS chapter_title, CAST(i - 1 AS INTEGER) AS position, ws[i] AS form, ws[i] AS lemma, 'noun' AS type, 'nom. sg.' AS parse FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)", _T)
def src_word_tokens(spark, d):
    """Facts made from the texts by the built-in provider: one row per word and its place."""
    return tx.locate(tx.word_provider(_cleaned(spark, d))).drop("chapter_id")


@query("src_locate", f"w AS (SELECT *, list_filter(list_transform(string_split_regex({_STRIPPED}, '[{_S}]+'), lambda x: regexp_replace(x, '^[.,·;!?]+|[.,·;!?]+$', '', 'g')), lambda x: x <> '') AS ws FROM c) SELECT run_id, chapter_index, CAST(len(ws) AS BIGINT) AS tokens FROM w WHERE len(ws) > 0", _T)
def src_locate(spark, d):
    """Words per chapter, counted after they are placed."""
    return tx.locate(tx.word_provider(_cleaned(spark, d))).groupBy(RUN, "chapter_index").agg(F.count("*").alias("tokens"))


_NATURAL = """, nk AS (SELECT *, string_split_regex(lower(filename), '[0-9]+') AS ps, regexp_extract_all(filename, '[0-9]+') AS ns FROM t),
nat AS (SELECT *, flatten(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i <= len(ns) THEN [ps[i], lpad(ns[i], 60, '0')] ELSE [ps[i]] END)) AS nkey FROM nk)"""


@query("src_natural_order", "z AS (SELECT 1)" + _NATURAL + ", u AS (SELECT DISTINCT run_id, filename, nkey FROM nat WHERE filename IS NOT NULL) SELECT run_id, filename, CAST(row_number() OVER (PARTITION BY run_id ORDER BY nkey, filename) AS INTEGER) AS place FROM u", _T)
def src_natural_order(spark, d):
    """The files of each run in natural order."""
    files = _texts(spark, d).select(RUN, "filename").distinct().dropna()
    w = Window.partitionBy(RUN).orderBy(tx.natural_key(F.col("filename")), "filename")
    return files.select(RUN, "filename", F.row_number().over(w).alias("place"))


@query("src_slug_id", "z AS (SELECT 1), s AS (SELECT run_id, chapter_index, regexp_replace(regexp_replace(lower(coalesce(title, '')), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug FROM t) SELECT run_id, chapter_index, substr((chapter_index + 1) || '-' || CASE WHEN slug = '' THEN 'ch-' || (chapter_index + 1) ELSE slug END, 1, 64) AS id FROM s", _T)
def src_slug_id(spark, d):
    return _texts(spark, d).select(RUN, "chapter_index", tx.slug_id(F.coalesce("title", F.lit("")), F.col("chapter_index") + 1).alias("id"))


@query("src_arrange", "z AS (SELECT 1)" + _NATURAL + """, a AS (SELECT run_id, filename, CAST(row_number() OVER (PARTITION BY run_id ORDER BY nkey NULLS FIRST, filename NULLS FIRST, chapter_index) AS INTEGER) AS n,
CASE WHEN count(*) OVER (PARTITION BY run_id, filename) = 1 AND coalesce(title, '') = 'Document' THEN regexp_replace(filename, '(.)\\.[^.]*$', '\\1') ELSE coalesce(title, '') END AS title FROM nat),
b AS (SELECT *, regexp_replace(regexp_replace(lower(title), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug FROM a)
SELECT run_id, filename, n - 1 AS chapter_index, substr(n || '-' || CASE WHEN slug = '' THEN 'ch-' || n ELSE slug END, 1, 64) AS chapter_id, title FROM b""", _T)
def src_arrange(spark, d):
    """Chapters put in corpus order from their files, with new ids."""
    sections = _texts(spark, d).select(RUN, "filename", F.col("chapter_index").alias("section_no"), F.coalesce("title", F.lit("")).alias("title"), "text")
    return tx.arrange(sections).drop("text")


@query("src_json_tokens", f"w AS (SELECT run_id, chapter_index, list_filter(list_transform(string_split_regex({_STRIPPED}, '[{_S}]+'), lambda x: regexp_replace(x, '^[.,·;!?]+|[.,·;!?]+$', '', 'g')), lambda x: x <> '') AS ws FROM c) SELECT run_id, chapter_index, CAST(len(ws) AS INTEGER) AS tokens FROM w", _T)
def src_json_tokens(spark, d):
    """A model's answer for each chapter (its words as JSON in a code fence) read back into tokens."""
    answers = tx.word_provider(_cleaned(spark, d)).select(RUN, "chapter_index", F.concat(F.lit("Here they are:\n```json\n"), F.to_json("tokens"), F.lit("\n```")).alias("raw"))
    return answers.select(RUN, "chapter_index", F.size(tx.json_tokens(tx.json_array(F.col("raw")))).alias("tokens"))


def _kept(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^[{_S}]+|[{_S}]+$', '', 'g')"


def _as_csv(df: DataFrame, label: str) -> str:
    """The path of df written as a CSV with a header, the way lists come."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("src_lexicon_csv", f"SELECT rank, nfc_normalize({_kept('lemma')}) AS lemma, {_kept('gloss')} AS gloss, {_kept('kind')} AS kind, coalesce(ref_count, 0) AS ref_count, coalesce(ref_coverage, 0) AS ref_coverage FROM lexicon_entries WHERE {_kept('lemma')} <> ''")
def src_lexicon_csv(spark, d):
    """The list, written as a CSV and read by its loader."""
    return ls.read_entries(spark, _as_csv(table(spark, d, "lexicon_entries"), "entries"))


@query("src_alias_csv", f"SELECT nfc_normalize({_kept('variant')}) AS variant, nfc_normalize({_kept('lemma')}) AS lemma, {_kept('kind')} AS kind, {_kept('note')} AS note FROM greek_core_5k_aliases WHERE {_kept('variant')} <> '' AND {_kept('lemma')} <> ''")
def src_alias_csv(spark, d):
    """The aliases, written as a CSV and read by their loader; blank ones are left out."""
    return ls.read_aliases(spark, _as_csv(table(spark, d, "greek_core_5k_aliases"), "aliases"))


@query("src_provider", f"w AS (SELECT run_id, chapter_index, list_filter(string_split_regex({_STRIPPED}, '[{_S}]+'), lambda x: x <> '') AS ws FROM c) SELECT run_id, chapter_index, CAST(len(ws) AS INTEGER) AS tokens FROM w", _T)
def src_provider(spark, d):
    """A provider written in Python, run once per chapter in parallel: here every word is a token."""
    analysed = tx.provide(_cleaned(spark, d).select(RUN, "chapter_index", "title", "text"), lambda text, title: [("noun", w, w, "-") for w in text.split()])
    return analysed.select(RUN, "chapter_index", F.size("tokens").alias("tokens"))


@query("src_llm", f"w AS (SELECT run_id, chapter_index, list_filter(string_split_regex({_STRIPPED}, '[{_S}]+'), lambda x: x <> '') AS ws FROM c) SELECT run_id, chapter_index, CAST(len(ws) AS INTEGER) AS tokens FROM w", _T)
def src_llm(spark, d):
    """A provider whose answers break off for texts of more than 2,000 characters: those are asked about in halves, in order."""

    def short(text, title):
        if len(text) > 2000 and len(text.split()) > 1:
            raise tx.CutOff
        return [("noun", w, w, "-") for w in text.split()]

    analysed = tx.provide(_cleaned(spark, d).select(RUN, "chapter_index", "title", "text"), tx.persistent(short, depth=16))
    return analysed.select(RUN, "chapter_index", F.size("tokens").alias("tokens"))


@query("src_json_extract", f"""w AS (SELECT run_id, chapter_index, list_filter(list_transform(string_split_regex({_STRIPPED}, '[{_S}]+'), lambda x: regexp_replace(x, '^[.,·;!?]+|[.,·;!?]+$', '', 'g')), lambda x: x <> '') AS ws FROM c)
SELECT run_id, chapter_index, CAST(length(CAST(to_json(list_transform(ws, lambda x: struct_pack("type" := 'noun', lemma := x, form := x, parse := 'nom. sg.'))) AS VARCHAR)) AS INTEGER) AS characters FROM w""", _T)
def src_json_extract(spark, d):
    """The first JSON array inside a model's answer for each chapter."""
    answers = tx.word_provider(_cleaned(spark, d)).select(RUN, "chapter_index", F.concat(F.lit("Answer: "), F.to_json("tokens"), F.lit(" -- end]")).alias("raw"))
    return answers.select(RUN, "chapter_index", F.length(tx.json_array(F.col("raw"))).alias("characters"))


@query("src_stem_title", "z AS (SELECT 1), k AS (SELECT *, count(*) OVER (PARTITION BY run_id, filename) AS n FROM t) SELECT run_id, chapter_index, CASE WHEN n = 1 AND title = 'Document' THEN regexp_replace(filename, '(.)\\.[^.]*$', '\\1') ELSE coalesce(title, '') END AS title FROM k", _T)
def src_stem_title(spark, d):
    """Titles, where a file's only chapter `Document` takes the name of its file."""
    sections = _texts(spark, d).select(RUN, "filename", F.col("chapter_index").alias("section_no"), F.coalesce("title", F.lit("")).alias("title"), F.col("chapter_index").cast("string").alias("text"))
    return tx.arrange(sections).select(RUN, F.col("text").cast("int").alias("chapter_index"), "title")


@query("sink_json", """, u AS (SELECT run_id, chapter_index, lemma, parse, CAST(count(*) AS BIGINT) AS parse_occ, CAST(row_number() OVER (PARTITION BY run_id, chapter_index ORDER BY min(position)) - 1 AS INTEGER) AS row_no FROM f GROUP BY 1, 2, 3, 4),
n AS (SELECT run_id, chapter_index, list(struct_pack(row_no := row_no, lemma := lemma, parse := parse, parse_occ := parse_occ) ORDER BY row_no) AS rows, CAST(sum(parse_occ) AS BIGINT) AS tokens, CAST(count(DISTINCT lemma) AS BIGINT) AS lemmas FROM u GROUP BY 1, 2)
SELECT ch.run_id, ch.chapter_index, CAST(to_json(struct_pack(chapter_index := ch.chapter_index, id := coalesce(id, 'ch-' || (ch.chapter_index + 1)), title := coalesce(title, ''), token_count := coalesce(tokens, 0), unique_lemmas := coalesce(lemmas, 0), rows := coalesce(rows, []))) AS VARCHAR) AS json FROM ch LEFT JOIN n USING (run_id, chapter_index)""", WITH)
def sink_json(spark, d):
    """The report of each chapter as one nested document: labels, counts, and its rows in order."""
    facts, refs = load_facts(spark, d, "type", "lemma", "form", "parse"), load_chapters(spark, d)
    heads = chap.summaries(facts, refs).select(RUN, "chapter_index", "id", "title", "token_count", "unique_lemmas")
    return sinks.chapter_reports(heads, chap.rows(facts).select(RUN, "chapter_index", "row_no", "lemma", "parse", "parse_occ"))
