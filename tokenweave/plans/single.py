"""Single operators over labels, tracks, lenses and stored runs, each called for itself and held against SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import morphology as mo
from ..functions.vocab import DIMENSIONS
from ..operators import chapters as chap
from ..operators import grammar, lemma, text, tracks
from ..operators.facts import KEY, PLACE, chapter_refs, clean_facts, load_chapters, load_facts
from ..session import cut, fresh_path, table
from ..sources.store import RunStore, migrate
from .base import DECODED, KNOWN, NOTHING, PHRASES, WITH, WORDS, bare, rank_sql, signature_sql, values_sql
from .reference import _CHOSEN, _NEWEST, _READ, _RUNS, _STATED, BAR, RUN, _decoded, _facts, _kept_facts, _labels, _newest, chosen, unique_runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, base: str = WITH):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = base + sql
        return fn

    return register


# Labels, step by step

_BARE_WORDS = WITH + WORDS
_SPELT = f", spelt(spelling, dimension, value) AS {values_sql(KNOWN)}"


def _parses(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "token_facts").select(F.coalesce("parse", F.lit("")).alias("parse")).distinct()
    return raw.select("parse", mo.without_phrases(mo.strip(F.col("parse"))).alias("marked"))


def _alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct alternative of a word of any label, in small letters."""
    words = _parses(spark, d).select(F.explode(mo.words(F.col("marked"))).alias("word"))
    return words.select(F.explode(mo.sides(F.col("word"))).alias("a")).select(F.lower("a").alias("alternative")).distinct()


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """alternative, dimension, value: what each states."""
    told = _alternatives(spark, d).select("alternative", F.explode(mo.meaning(F.col("alternative"))).alias("t"))
    return told.select("alternative", F.substring_index("t", "=", 1).alias("dimension"), F.substring_index("t", "=", -1).alias("value"))


@query("m_not_applicable", f"SELECT DISTINCT parse, type FROM f WHERE lower(trim(parse)) IN ({', '.join(repr(x) for x in NOTHING)})")
def m_not_applicable(spark, d):
    """Labels that say there is nothing to say."""
    return _labels(spark, d).where("status = 'not_applicable'").select("parse", "type")


@query("m_phrases", " UNION ".join(f"SELECT parse, '{name}' AS descriptor FROM f WHERE regexp_matches(parse, '(?i){pattern}')" for pattern, name in PHRASES))
def m_phrases(spark, d):
    """Labels that hold a phrase of several words, and what it stands for."""
    return _parses(spark, d).select("parse", F.explode(F.array_distinct(mo.phrases(F.col("marked")))).alias("descriptor"))


@query("m_tokenise", f" SELECT parse, string_agg({bare('word')}, '{BAR}' ORDER BY i) AS words FROM pw GROUP BY 1", _BARE_WORDS)
def m_tokenise(spark, d):
    """The words of each label, phrases and punctuation aside."""
    words = mo.words(F.col("marked"))
    return _parses(spark, d).where(F.size(words) > 0).select("parse", F.array_join(F.transform(words, mo.bare), BAR).alias("words"))


@query("m_slash", f" SELECT parse, word, string_agg(alternative, '{BAR}' ORDER BY k) AS alternatives FROM pa WHERE contains(word, '/') GROUP BY parse, i, word", _BARE_WORDS)
def m_slash(spark, d):
    """Words that offer alternatives."""
    words = _parses(spark, d).select("parse", F.explode(mo.words(F.col("marked"))).alias("word")).where(F.contains("word", F.lit("/")))
    return words.where(F.size(mo.sides(F.col("word"))) > 0).select("parse", "word", F.array_join(mo.sides(F.col("word")), BAR).alias("alternatives"))


@query("m_person_number", " SELECT DISTINCT lower(alternative) AS alternative, lower(alternative)[1] AS person, CASE WHEN lower(alternative)[2] = 's' THEN 'sg' ELSE 'pl' END AS number FROM pa WHERE regexp_full_match(lower(alternative), '[123](sg|pl|s|p)')", _BARE_WORDS)
def m_person_number(spark, d):
    """Words that state a person and a number at once."""
    both = _stated(spark, d).where("dimension in ('person', 'number')").groupBy("alternative").pivot("dimension", ["person", "number"]).agg(F.first("value"))
    return both.dropna().select("alternative", "person", "number")


@query("m_deponent", " SELECT DISTINCT lower(alternative) AS alternative, 'mid' AS voice FROM pa WHERE lower(alternative) IN ('deponent', 'depon', 'dep')", _BARE_WORDS)
def m_deponent(spark, d):
    """Words that say: middle in form, active in meaning."""
    told = _stated(spark, d)
    flagged = told.where("dimension = 'deponent'").select("alternative")
    return told.where("dimension = 'voice'").join(flagged, "alternative", "left_semi").select("alternative", F.col("value").alias("voice"))


_ALTERNATIVE = " SELECT DISTINCT lower(alternative) AS alternative, dimension, value FROM pa JOIN spelt ON lower(alternative) = spelling WHERE "


@query("m_feature", _SPELT + _ALTERNATIVE + "dimension NOT IN ('descriptor', 'deponent')", _BARE_WORDS)
def m_feature(spark, d):
    """What each word states of a dimension."""
    return _stated(spark, d).where(F.col("dimension").isin(*DIMENSIONS))


@query("m_descriptor", _SPELT + _ALTERNATIVE + "dimension = 'descriptor'", _BARE_WORDS)
def m_descriptor(spark, d):
    """Words that describe without being morphology."""
    return _stated(spark, d).where("dimension = 'descriptor'")


@query("m_unmatched", f"""{_SPELT}, e AS (SELECT DISTINCT parse, i, word, alternative, spelling FROM pa LEFT JOIN spelt ON lower(alternative) = spelling),
n AS (SELECT parse, i, word, count(*) AS n, count(spelling) AS known FROM e GROUP BY 1, 2, 3), nothing AS (SELECT DISTINCT parse FROM f WHERE lower(trim(parse)) IN ({', '.join(repr(x) for x in NOTHING)}))
SELECT DISTINCT parse, CASE WHEN known = 0 THEN word ELSE alternative END AS unread FROM e JOIN n USING (parse, i, word) ANTI JOIN nothing USING (parse) WHERE spelling IS NULL""", _BARE_WORDS)
def m_unmatched(spark, d):
    """What of each label was not understood."""
    return _labels(spark, d).select("parse", F.explode("unparsed").alias("unread")).distinct()


@query("m_particle_fix", " SELECT parse, mood, list_contains(string_split(descriptors, '¦'), 'particle') AS particle FROM m WHERE type = 'particle'", DECODED)
def m_particle_fix(spark, d):
    """Labels of particles, where a lone `part.` is no participle."""
    return _labels(spark, d).where("type = 'particle'").select("parse", "mood", F.array_contains("descriptors", "particle").alias("particle"))


@query("m_ambiguity", " UNION ALL ".join(f"SELECT parse, type, '{x}' AS dimension, \"{x}\" AS value FROM m WHERE contains(\"{x}\", '|')" for x in DIMENSIONS), DECODED)
def m_ambiguity(spark, d):
    """Dimensions that a label leaves open."""
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value")) for x in DIMENSIONS)))
    return _labels(spark, d).select("parse", "type", pairs.alias("p")).select("parse", "type", "p.*").where(F.contains("value", F.lit("|")))


@query("m_status", """, w AS (SELECT parse, type, CASE WHEN nothing THEN 'not_applicable' ELSE concat_ws('+', CASE WHEN stated THEN 'features' END, CASE WHEN descriptors <> '' THEN 'descriptors' END, CASE WHEN unparsed <> '' THEN 'rest' END) END AS made_of FROM m0)
SELECT parse, type, CASE made_of WHEN 'not_applicable' THEN 'not_applicable' WHEN 'features' THEN 'ok' WHEN 'features+descriptors' THEN 'ok' WHEN 'descriptors' THEN 'descriptive' WHEN 'rest' THEN 'unparsed' WHEN '' THEN 'unparsed' ELSE 'partial' END AS status FROM w""", DECODED)
def m_status(spark, d):
    """How well each label was understood."""
    return _labels(spark, d).select("parse", "type", "status")


@query("m_features", f""" SELECT parse, type, concat_ws(' ', {', '.join(f"'{x}=' || \"{x}\"" for x in DIMENSIONS)}) AS features FROM m WHERE signature <> ''""", DECODED)
def m_features(spark, d):
    """The dimensions a label states, in the order of citation.

    The labels are written down first: the planner would move the condition, and with it all of the decoder, below the
    distinct, where it is evaluated for every row of the facts.
    """
    told = F.concat_ws(" ", *(F.concat(F.lit(f"{x}="), F.col(x)) for x in DIMENSIONS))
    labels = cut(_labels(spark, d).select("parse", "type", "signature", told.alias("features")), "labels")
    return labels.where("signature <> ''").select("parse", "type", "features")


# Features as they were stored with the facts

_STORED = f"WITH s AS (SELECT DISTINCT coalesce(type, '') AS type, {', '.join(f'feat_{x} AS "{x}"' for x in DIMENSIONS)} FROM token_facts)"
_LISTED = ", ".join(f'"{x}"' for x in DIMENSIONS)


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    rows = table(spark, d, "token_facts").select(F.coalesce("type", F.lit("")).alias("type"), *(F.col(f"feat_{x}").alias(x) for x in DIMENSIONS)).distinct()
    return rows, {x: F.col(x) for x in DIMENSIONS}


@query("m_signature", f" SELECT DISTINCT {_LISTED}, {signature_sql()} AS signature FROM s", _STORED)
def m_signature(spark, d):
    """Each combination of stored features as a grammar writes it."""
    rows, m = _stored(spark, d)
    return rows.select(*DIMENSIONS, mo.signature(m).alias("signature")).distinct()


@query("m_classify", f" SELECT DISTINCT {_LISTED}, CASE WHEN regexp_matches(mood, '(^|[|])part([|]|$)') THEN 'participle' WHEN tense IS NOT NULL OR mood IS NOT NULL OR voice IS NOT NULL THEN 'verb' WHEN \"case\" IS NOT NULL THEN 'nominal' ELSE 'other' END AS form_class FROM s", _STORED)
def m_classify(spark, d):
    rows, m = _stored(spark, d)
    return rows.select(*DIMENSIONS, mo.form_class(m).alias("form_class")).distinct()


@query("m_sort_key", f" SELECT DISTINCT {_LISTED}, array_to_string([{', '.join(map(rank_sql, DIMENSIONS))}], ' ') AS sort_key FROM s", _STORED)
def m_sort_key(spark, d):
    rows, m = _stored(spark, d)
    return rows.select(*DIMENSIONS, F.array_join(mo.sort_key(m), " ").alias("sort_key")).distinct()


@query("m_is_verb_form", " SELECT DISTINCT type, tense, mood, type = 'verb' OR tense IS NOT NULL OR mood IS NOT NULL AS verb_form FROM s", _STORED)
def m_is_verb_form(spark, d):
    rows, m = _stored(spark, d)
    return rows.select("type", "tense", "mood", mo.is_verb_form(m, F.col("type")).alias("verb_form")).distinct()


@query("m_missing_voice", " SELECT DISTINCT type, tense, mood, voice, voice IS NULL AND (type = 'verb' OR tense IS NOT NULL OR mood IS NOT NULL) AS missing FROM s", _STORED)
def m_missing_voice(spark, d):
    rows, m = _stored(spark, d)
    return rows.select("type", "tense", "mood", "voice", mo.missing_voice(m, F.col("type")).alias("missing")).distinct()


# Tracks


def _span(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return tracks.span(tracks.by_chapter(load_facts(spark, d, "lemma"), ["lemma"]), ["lemma"]).select(RUN, "lemma", *columns)


@query("w_total", "SELECT run_id, lemma, CAST(count(*) AS BIGINT) AS total FROM f GROUP BY 1, 2")
def w_total(spark, d):
    return _span(spark, d, "total")


@query("w_chapters", "SELECT run_id, lemma, array_to_string(list_sort(list(DISTINCT chapter_index)), ' ') AS chapters FROM f GROUP BY 1, 2")
def w_chapters(spark, d):
    return _span(spark, d, "chapters").withColumn("chapters", F.array_join("chapters", " "))


@query("w_chapter_count", "SELECT run_id, lemma, CAST(count(DISTINCT chapter_index) AS BIGINT) AS chapter_count FROM f GROUP BY 1, 2")
def w_chapter_count(spark, d):
    return _span(spark, d, "chapter_count")


@query("w_first", "SELECT run_id, lemma, min(chapter_index) AS first_chapter FROM f GROUP BY 1, 2")
def w_first(spark, d):
    return _span(spark, d, "first_chapter")


@query("w_last", "SELECT run_id, lemma, max(chapter_index) AS last_chapter FROM f GROUP BY 1, 2")
def w_last(spark, d):
    return _span(spark, d, "last_chapter")


@query("w_gap_before", """, c AS (SELECT DISTINCT run_id, lemma, chapter_index FROM f), b AS (SELECT a.run_id, a.lemma, a.chapter_index, max(b.chapter_index) AS before FROM c AS a LEFT JOIN c AS b ON a.run_id = b.run_id AND a.lemma = b.lemma AND b.chapter_index < a.chapter_index GROUP BY 1, 2, 3)
SELECT run_id, lemma, chapter_index, chapter_index - before AS gap_before FROM b""")
def w_gap_before(spark, d):
    """Chapters since a lemma was last met."""
    return tracks.running(tracks.by_chapter(load_facts(spark, d, "lemma"), ["lemma"]), ["lemma"]).select(RUN, "lemma", "chapter_index", "gap_before")


_KINDS = ", k AS (SELECT DISTINCT run_id, type FROM f), g AS (SELECT run_id, type, chapter_index FROM k JOIN ch USING (run_id)), n AS (SELECT run_id, type, chapter_index, count(*) AS n FROM f GROUP BY 1, 2, 3)"


def _dense(spark: SparkSession, d: str, column: str) -> DataFrame:
    return tracks.dense(tracks.by_chapter(load_facts(spark, d, "type"), ["type"]), ["type"], load_chapters(spark, d)).select(RUN, "type", "chapter_index", column)


@query("w_count_in", _KINDS + " SELECT run_id, type, chapter_index, CAST(coalesce(n, 0) AS BIGINT) AS occ FROM g LEFT JOIN n USING (run_id, type, chapter_index)")
def w_count_in(spark, d):
    """Words of each kind in every chapter, 0 where there is none."""
    return _dense(spark, d, "occ")


@query("w_cumulative", _KINDS + " SELECT run_id, type, chapter_index, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY run_id, type ORDER BY chapter_index) AS BIGINT) AS cumulative FROM g LEFT JOIN n USING (run_id, type, chapter_index)")
def w_cumulative(spark, d):
    return _dense(spark, d, "cumulative")


@query("w_previous", _KINDS + " SELECT g.run_id, g.type, g.chapter_index, max(n.chapter_index) AS previous_chapter FROM g LEFT JOIN n ON n.run_id = g.run_id AND n.type = g.type AND n.chapter_index < g.chapter_index GROUP BY 1, 2, 3")
def w_previous(spark, d):
    """The nearest chapter before, from any chapter, that has the kind of word."""
    return _dense(spark, d, "previous_chapter")


@query("w_next", _KINDS + " SELECT g.run_id, g.type, g.chapter_index, min(n.chapter_index) AS next_chapter FROM g LEFT JOIN n ON n.run_id = g.run_id AND n.type = g.type AND n.chapter_index > g.chapter_index GROUP BY 1, 2, 3")
def w_next(spark, d):
    return _dense(spark, d, "next_chapter")


@query("ix_voice_gaps", " SELECT run_id, parse, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM fm WHERE voice IS NULL AND is_verb_form GROUP BY ALL", DECODED)
def ix_voice_gaps(spark, d):
    """Labels that should state a voice and do not, per chapter."""
    return tracks.by_chapter(_decoded(spark, d).where("missing_voice"), ["parse"])


@query("ix_deponents", " SELECT run_id, type, chapter_index, CAST(count(*) AS BIGINT) AS occ FROM fm WHERE is_deponent GROUP BY ALL", DECODED)
def ix_deponents(spark, d):
    return tracks.by_chapter(_decoded(spark, d).where("is_deponent"), ["type"])


@query("ix_chapter_access", ", z AS (SELECT run_id, max(chapter_index) AS chapter_index FROM ch GROUP BY 1) SELECT ch.run_id, ch.chapter_index, ch.id, f.position, f.lemma, f.form FROM ch SEMI JOIN z USING (run_id, chapter_index) LEFT JOIN f USING (run_id, chapter_index)")
def ix_chapter_access(spark, d):
    """The last chapter of each run: its reference with its facts, or with none."""
    refs = load_chapters(spark, d)
    last = refs.groupBy(RUN).agg(F.max("chapter_index").alias("chapter_index"))
    return refs.join(last, [RUN, "chapter_index"], "left_semi").join(load_facts(spark, d, "lemma", "form"), [RUN, "chapter_index"], "left").select(RUN, "chapter_index", "id", "position", "lemma", "form")


# Lenses


@query("ch_representative", """, g AS (SELECT run_id, chapter_index, lemma, parse, form, count(*) AS n, min(position) AS p FROM f GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, chapter_index, lemma, parse ORDER BY n DESC, p) AS place FROM g) SELECT run_id, chapter_index, lemma, parse, form, CAST(n AS BIGINT) AS form_occ FROM o WHERE place = 1""")
def ch_representative(spark, d):
    """The form that stands for a lemma and label in a chapter: the most frequent, on ties the first."""
    return chap.rows(_facts(spark, d)).select(RUN, "chapter_index", "lemma", "parse", "form", "form_occ")


@query("ch_form_span", """, g AS (SELECT run_id, chapter_index, lemma, parse, form, count(*) AS n, min(position) AS p FROM f GROUP BY ALL), r AS (SELECT run_id, lemma, first(form ORDER BY n DESC, p) AS form FROM g GROUP BY run_id, chapter_index, lemma, parse)
SELECT run_id, lemma, form, min(chapter_index) AS form_first_chapter, max(chapter_index) AS form_last_chapter FROM f SEMI JOIN r USING (run_id, lemma, form) GROUP BY 1, 2, 3""")
def ch_form_span(spark, d):
    """First and last chapter of each form that stands for its lemma somewhere, over all labels it has."""
    return chap.rows(_facts(spark, d)).select(RUN, "lemma", "form", "form_first_chapter", "form_last_chapter").distinct()


@query("ch_first_last", """, p AS (SELECT run_id, lemma, parse, min(chapter_index) AS a, max(chapter_index) AS b FROM f GROUP BY 1, 2, 3), l AS (SELECT run_id, lemma, min(a) AS la, max(b) AS lb FROM p GROUP BY 1, 2), c AS (SELECT DISTINCT run_id, lemma, parse, chapter_index FROM f)
SELECT run_id, chapter_index, lemma, parse, chapter_index = la AS first_occ_lemma, chapter_index = a AS first_occ_parse, chapter_index = lb AS last_occ_lemma, chapter_index = b AS last_occ_parse FROM c JOIN p USING (run_id, lemma, parse) JOIN l USING (run_id, lemma)""")
def ch_first_last(spark, d):
    """Whether a lemma, and a label of it, is met for the first or the last time."""
    return chap.rows(_facts(spark, d)).select(RUN, "chapter_index", "lemma", "parse", "first_occ_lemma", "first_occ_parse", "last_occ_lemma", "last_occ_parse")


@query("gr_scope", _READ + """, t AS (SELECT DISTINCT run_id, dimension FROM st), z AS (SELECT run_id, max(chapter_index) AS chapter_index FROM ch GROUP BY 1), v(dimension, value) AS (VALUES """ + ", ".join(f"('{x}', '{v}')" for x in DIMENSIONS for v in grammar.VALUES[x]) + """)
SELECT t.run_id, z.chapter_index, t.dimension, v.value, CAST(count(rd.value) FILTER (rd.chapter_index = z.chapter_index) AS BIGINT) AS occ, CAST(count(rd.value) AS BIGINT) AS cumulative
FROM t JOIN v USING (dimension) JOIN z USING (run_id) LEFT JOIN rd ON rd.run_id = t.run_id AND rd.dimension = v.dimension AND rd.value = v.value GROUP BY 1, 2, 3, 4""", DECODED)
def gr_scope(spark, d):
    """Values of the dimensions in the last chapter of each run and up to there, zeros included."""
    refs = load_chapters(spark, d)
    last = refs.groupBy(RUN).agg(F.max("chapter_index").alias("chapter_index"))
    return grammar.profile(_decoded(spark, d), refs).join(last, [RUN, "chapter_index"], "left_semi").select(RUN, "chapter_index", "dimension", "value", "occ", "cumulative")


@query("gr_drop_dim", _STATED + ", r AS (SELECT DISTINCT run_id FROM f), v(dimension) AS (VALUES " + ", ".join(f"('{x}')" for x in DIMENSIONS) + ") SELECT run_id, v.dimension FROM r CROSS JOIN v ANTI JOIN st USING (run_id, dimension)", DECODED)
def gr_drop_dim(spark, d):
    """Dimensions that a run never states, which its profile leaves out."""
    decoded = _decoded(spark, d)
    every = decoded.select(RUN).distinct().crossJoin(F.broadcast(grammar.vocabulary(decoded).select("dimension").distinct()))
    return every.join(grammar.profile(decoded).select(RUN, "dimension").distinct(), [RUN, "dimension"], "left_anti")


@query("fc_order", """, i AS (SELECT run_id, signature, sort_key, min((chapter_index, position)) AS seen FROM fm WHERE signature <> '' GROUP BY 1, 2, 3)
SELECT run_id, signature, CAST((SELECT count(*) FROM i AS j WHERE j.run_id = i.run_id AND (j.sort_key, j.seen) < (i.sort_key, i.seen)) AS INTEGER) AS "order" FROM i""", DECODED)
def fc_order(spark, d):
    """The place of each combination of features in paradigm order."""
    return grammar.inventory(_decoded(spark, d)).select(RUN, "signature", "order")


@query("tx_type", "SELECT run_id, lemma, coalesce(first(type ORDER BY chapter_index, position) FILTER (type <> ''), '') AS type FROM f GROUP BY 1, 2")
def tx_type(spark, d):
    """The first type a lemma is met with."""
    return text.vocabulary(load_facts(spark, d, "type", "lemma", "form"), ["lemma"]).select(RUN, "lemma", "type")


@query("tx_form", """, n AS (SELECT run_id, lemma, form, count(*) AS n, min((chapter_index, position)) AS seen FROM f GROUP BY 1, 2, 3) SELECT run_id, lemma, first(form ORDER BY n DESC, seen) AS form, CAST(count(*) AS BIGINT) AS form_count FROM n GROUP BY 1, 2""")
def tx_form(spark, d):
    """The most frequent form of a lemma, and how many it has."""
    return text.vocabulary(load_facts(spark, d, "type", "lemma", "form"), ["lemma"]).select(RUN, "lemma", "form", "form_count")


@query("ui_share", """, c AS (SELECT DISTINCT run_id, lemma, chapter_index FROM f), n AS (SELECT run_id, chapter_index, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c AS b WHERE b.run_id = c.run_id AND b.lemma = c.lemma AND b.chapter_index < c.chapter_index)) AS new FROM c GROUP BY 1, 2)
SELECT run_id, chapter_index, coalesce(new / n::DOUBLE, 0) AS new_share FROM ch LEFT JOIN n USING (run_id, chapter_index)""")
def ui_share(spark, d):
    """The share of new lemmas in each chapter, 0 for chapters without words."""
    counts = text.progress(load_facts(spark, d, "lemma"), load_chapters(spark, d), ["lemma"])
    return counts.select(RUN, "chapter_index", keys.safe_share(F.col("new_types"), F.col("new_types") + F.col("repeated_types")).alias("new_share"))


@query("le_longest_gap", """, c AS (SELECT DISTINCT run_id, lemma, chapter_index FROM f), g AS (SELECT run_id, lemma, list_sort(list(chapter_index)) AS cs FROM c GROUP BY 1, 2)
SELECT run_id, lemma, list_max(list_transform(range(2, len(cs) + 1), lambda i: cs[i] - cs[i - 1])) AS longest_gap FROM g""")
def le_longest_gap(spark, d):
    """The longest way between two chapters with a lemma; null for a lemma of one chapter."""
    return lemma.summary(_facts(spark, d)).select(RUN, "lemma", "longest_gap")


@query("le_missing", """, r AS (SELECT DISTINCT run_id FROM f), q AS (SELECT run_id, lemma FROM r CROSS JOIN (SELECT DISTINCT lemma FROM lexicon_entries WHERE lemma IS NOT NULL)), w AS (SELECT DISTINCT run_id, lemma FROM f)
SELECT run_id, CAST(count(*) AS BIGINT) AS asked, CAST(count(*) FILTER (w.lemma IS NULL) AS BIGINT) AS missing FROM q LEFT JOIN w USING (run_id, lemma) GROUP BY 1""")
def le_missing(spark, d):
    """How many words of the list each run lacks: a word that is asked for and not there has no place."""
    facts = load_facts(spark, d, "lemma")
    words = table(spark, d, "lexicon_entries").select("lemma").dropna().distinct()
    asked = facts.select(RUN).distinct().crossJoin(words)
    return lemma.totals(facts, asked).groupBy(RUN).agg(F.count("*").alias("asked"), F.count_if(F.col("total") == 0).alias("missing"))


@query("le_filter", _CHOSEN + """, k AS (SELECT f.*, row_number() OVER (PARTITION BY run_id, lemma ORDER BY position) AS line, count(*) OVER (PARTITION BY run_id, lemma) AS total FROM f SEMI JOIN want USING (run_id, lemma) WHERE chapter_index = 1)
SELECT run_id, lemma, chapter_index, position, CAST(line AS INTEGER) AS line, CAST(total AS BIGINT) AS total FROM k WHERE line <= 400""")
def le_filter(spark, d):
    """The places of one word of each run in its second chapter. The chapter is the feature; le_filter_chapters has all."""
    facts = _kept_facts(spark, d, "type", "lemma", "form", "parse")
    return lemma.concordance(facts, chosen(facts), chapter_index=1).select(RUN, "lemma", "chapter_index", "position", "line", "total")


@query("src_chapter_refs", "SELECT ch.run_id, ch.chapter_index, ch.id, count(f.position) = 0 AS without_words FROM ch LEFT JOIN f USING (run_id, chapter_index) GROUP BY 1, 2, 3")
def src_chapter_refs(spark, d):
    """All chapters, those without words too."""
    rows = table(spark, d, "token_facts").select(*KEY, *PLACE)
    with_words = rows.select(RUN, "chapter_index").distinct().withColumn("some", F.lit(True))
    refs = chapter_refs(rows, table(spark, d, "text_chapters"))
    return refs.join(with_words, [RUN, "chapter_index"], "left").select(RUN, "chapter_index", "id", F.col("some").isNull().alias("without_words"))


# Stored runs


def _store(spark: SparkSession, d: str, facts: bool) -> RunStore:
    """A store that holds the runs of the table, and their facts if wanted."""
    store = RunStore(spark, fresh_path(spark, "store"))
    runs = unique_runs(spark, d).withColumn("filenames", F.from_json("filenames", "array<string>"))
    store.add(runs, clean_facts(table(spark, d, "token_facts")) if facts else None)
    return store


def _newest_id(spark: SparkSession, d: str) -> str:
    return _newest(spark, d).first()[RUN]


@query("run_get", f", r AS ({_RUNS}), z AS (SELECT arg_max(id, created_at) AS id FROM r) SELECT id, created_at, model_id, chapter_count, token_count, note FROM r SEMI JOIN z USING (id)")
def run_get(spark, d):
    """One run of a store by its id."""
    store = _store(spark, d, False)
    found, none = store.get(_newest_id(spark, d)), store.get("no such run")
    assert none is None
    return spark.createDataFrame([found], store.runs().schema).select("id", "created_at", "model_id", "chapter_count", "token_count", "note")


@query("run_delete", _NEWEST + " SELECT run_id, CAST(count(*) AS BIGINT) AS tokens FROM f ANTI JOIN z USING (run_id) GROUP BY 1")
def run_delete(spark, d):
    """What a store holds once one run is deleted; asking twice, or for a run that is not there, makes no difference."""
    store, newest = _store(spark, d, True), _newest_id(spark, d)
    assert store.delete([newest, "no such run", newest]) == [newest]
    return store.table().groupBy(RUN).agg(F.count("*").alias("tokens"))


@query("scan_index", _NEWEST + ", g AS (SELECT * FROM f SEMI JOIN z USING (run_id)) SELECT run_id, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT lemma) AS BIGINT) AS lemmas, CAST(count(DISTINCT (lemma, form)) AS BIGINT) AS forms, CAST(count(DISTINCT (lemma, parse)) AS BIGINT) AS parses, CAST(count(DISTINCT chapter_index) AS BIGINT) AS chapters FROM g GROUP BY 1")
def scan_index(spark, d):
    """The totals of a run read back from a store; chapters without words do not survive there."""
    facts = _store(spark, d, True).facts(_newest_id(spark, d))
    return tracks.totals(facts, chapter_refs(facts))


@query("run_migrate", "SELECT DISTINCT run_id, chapter_index, position, feat_tense, feat_case, CAST(NULL AS VARCHAR) AS feat_voice, CAST(NULL AS VARCHAR) AS feat_status, CAST(NULL AS INTEGER) AS feat_deponent FROM token_facts", "")
def run_migrate(spark, d):
    """A table from before most features were stored, with the columns it lacks."""
    older = table(spark, d, "token_facts").select(*KEY, "feat_tense", "feat_case").distinct()
    return migrate(older).select(*KEY, "feat_tense", "feat_case", "feat_voice", "feat_status", "feat_deponent")
