"""SQL shared by the oracles: the base tables as DuckDB sees them, and a label decoder of its own."""

from __future__ import annotations

from ..functions.vocab import DIMENSIONS, VALUES

# What labels may say. The oracle's own tables, written out apart from those of the library, so that a wrong
# spelling on one side shows.
STATED_BY = {
    ("case", "nom"): ["nom", "nominative"],
    ("case", "gen"): ["gen", "genitive"],
    ("case", "dat"): ["dat", "dative"],
    ("case", "acc"): ["acc", "accusative"],
    ("case", "voc"): ["voc", "vocative"],
    ("number", "sg"): ["sg", "sing", "singular", "1sg", "1s", "2sg", "2s", "3sg", "3s"],
    ("number", "pl"): ["pl", "plur", "plural", "1pl", "1p", "2pl", "2p", "3pl", "3p"],
    ("number", "dual"): ["dual", "du"],
    ("gender", "masc"): ["masc", "m", "masculine"],
    ("gender", "fem"): ["fem", "f", "feminine"],
    ("gender", "neut"): ["neut", "n", "neuter"],
    ("tense", "pres"): ["pres", "present"],
    ("tense", "impf"): ["impf", "imperf", "imperfect"],
    ("tense", "fut"): ["fut", "future"],
    ("tense", "aor"): ["aor", "aorist"],
    ("tense", "perf"): ["perf", "perfect"],
    ("tense", "plup"): ["plup", "pluperf", "pluperfect"],
    ("voice", "act"): ["act", "active"],
    ("voice", "mid"): ["mid", "middle", "mp", "midpass", "deponent", "depon", "dep"],
    ("voice", "pass"): ["pass", "passive", "mp", "midpass"],
    ("mood", "ind"): ["ind", "indic", "indicative"],
    ("mood", "subj"): ["subj", "subjunctive"],
    ("mood", "opt"): ["opt", "optative"],
    ("mood", "imp"): ["imp", "imper", "imperative"],
    ("mood", "inf"): ["inf", "infin", "infinitive"],
    ("mood", "part"): ["part", "ptc", "participle"],
    ("degree", "comp"): ["comp", "compar", "comparative"],
    ("degree", "superl"): ["superl", "sup", "superlative"],
    ("person", "1"): ["1", "1st", "1sg", "1s", "1pl", "1p"],
    ("person", "2"): ["2", "2nd", "2sg", "2s", "2pl", "2p"],
    ("person", "3"): ["3", "3rd", "3sg", "3s", "3pl", "3p"],
    ("deponent", "1"): ["deponent", "depon", "dep"],
    ("descriptor", "interrogative"): ["interrogative", "interrog"],
    ("descriptor", "negative"): ["negative", "neg"],
    ("descriptor", "affirmative"): ["affirmative", "affirm"],
    ("descriptor", "demonstrative"): ["demonstrative", "dem"],
    ("descriptor", "relative"): ["relative", "rel"],
    ("descriptor", "reflexive"): ["reflexive", "refl"],
    ("descriptor", "possessive"): ["possessive", "poss"],
    ("descriptor", "indefinite"): ["indefinite", "indef"],
    ("descriptor", "indeclinable"): ["indeclinable", "indecl"],
    ("descriptor", "adverb"): ["adv", "adverb", "adverbial"],
    ("descriptor", "particle"): ["particle"],
    ("descriptor", "conjunction"): ["conj"],
    ("descriptor", "preposition"): ["prep"],
    ("descriptor", "abbreviation"): ["abbreviation"],
    ("descriptor", "proper noun"): ["proper"],
}
KNOWN = [(spelling, dimension, value) for (dimension, value), spellings in STATED_BY.items() for spelling in spellings]
# Phrases, in this order, and the descriptor of each; labels that say there is nothing to say.
PHRASES = [
    (r"\bdef(inite)?[.]?\s+art(icle)?[.]?", "def. art."),
    (r"\bindef(inite)?[.]?\s+art(icle)?[.]?", "indef. art."),
    (r"\binterrog(ative)?[.]?\s+adv(erb)?[.]?", "interrogative"),
    (r"\binterrog(ative)?[.]?\s+part(icle)?[.]?", "interrogative"),
    (r"\bneg(ative)?[.]?\s+part(icle)?[.]?", "negative"),
    (r"\baffirm(ative)?[.]?\s+part(icle)?[.]?", "affirmative"),
    (r"\bproper\s+n(oun)?[.]?", "proper noun"),
    (r"\bindecl(inable)?[.]?\s+noun[.]?", "indeclinable"),
    (r"\babbrev(iation)?[.]?\s+(for\s+)?\S*", "abbreviation"),
]
NOTHING = ("", "-", "--", "n/a", "na", "none", "unknown", "?")

#: f: unique facts; ch: chapters.
FACTS = """
f AS (SELECT run_id, chapter_index, position, any_value(filename) AS filename, any_value(chapter_id) AS chapter_id, any_value(chapter_title) AS chapter_title,
coalesce(any_value(type), '') AS type, coalesce(any_value(lemma), '') AS lemma, coalesce(any_value(form), '') AS form, coalesce(any_value(parse), '') AS parse FROM token_facts GROUP BY 1, 2, 3),
named AS (SELECT DISTINCT run_id, chapter_index, chapter_id AS id, title, filename FROM text_chapters),
ch AS (SELECT * FROM named UNION ALL SELECT run_id, chapter_index, arg_min(chapter_id, position), arg_min(chapter_title, position), arg_min(filename, position)
FROM f ANTI JOIN named USING (run_id, chapter_index) GROUP BY 1, 2)
"""

WITH = "WITH " + FACTS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values_sql(rows: list[tuple]) -> str:
    cell = lambda x: _text(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def marked(label: str) -> str:
    """A label with chr(1) and a number in place of each phrase."""
    text = f"regexp_replace({label}, '^\\s+|\\s+$', '', 'g')"
    for i, (p, _) in enumerate(PHRASES):
        text = f"regexp_replace({text}, {_text(p)}, ' ' || chr(1) || '{i} ', 'gi')"
    return text


def bare(word: str) -> str:
    return f"regexp_replace(regexp_replace({word}, '^\\s*[.,;:]*\\s*', ''), '\\s*[.,;:]*\\s*$', '')"


#: pw: label and word, of every distinct label; pa: label, word and alternative.
WORDS = f""",
pl AS (SELECT DISTINCT parse, {marked("parse")} AS text FROM f),
pw AS (SELECT parse, i, ws[i] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT parse, string_split_regex(regexp_replace(text, chr(1) || '[0-9]', ' ', 'g'), '\\s+') AS ws FROM pl)) WHERE {bare("ws[i]")} <> ''),
pa AS (SELECT parse, i, word, k, alts[k] AS alternative FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS k FROM (SELECT *, list_filter(list_transform(string_split({bare("word")}, '/'), lambda a: {bare("a")}), lambda a: a <> '') AS alts FROM pw)))
"""


def _decoder() -> str:
    """m: every distinct (parse, type) with its features, found by joining words to a table of spellings."""
    text = marked("parse")
    flags = ", ".join(f"CASE WHEN contains(text, chr(1) || '{i}') THEN {_text(d)} END" for i, (_, d) in enumerate(PHRASES))
    feature = lambda d: f"string_agg(DISTINCT value, '|' ORDER BY value) FILTER (dimension = '{d}') AS \"{d}\""
    return f"""
labels AS (SELECT DISTINCT parse, type FROM f),
spelt(spelling, dimension, value) AS {values_sql(KNOWN)},
p0 AS (SELECT parse, type, {text} AS text, lower(regexp_replace(parse, '^\\s+|\\s+$', '', 'g')) IN ({", ".join(map(_text, NOTHING))}) AS nothing FROM labels),
p1 AS (SELECT parse, type, nothing, list_filter([{flags}], lambda x: x IS NOT NULL) AS phrases, string_split_regex(regexp_replace(text, chr(1) || '[0-9]', ' ', 'g'), '\\s+') AS ws FROM p0),
p2 AS (SELECT parse, type, ws[i] AS word, i, list_filter(list_transform(string_split({bare("ws[i]")}, '/'), lambda a: {bare("a")}), lambda a: a <> '') AS alts
FROM (SELECT parse, type, ws, unnest(range(1, len(ws) + 1)) AS i FROM p1 WHERE NOT nothing)),
p3 AS (SELECT parse, type, word, i, alts[k] AS alt, k, len(alts) AS n FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS k FROM p2)),
p4 AS (SELECT p3.*, spelt.dimension, spelt.value FROM p3 LEFT JOIN spelt ON lower(alt) = spelling),
odd AS (SELECT parse, type, word, i, n, count(*) AS bad, list(alt ORDER BY k) AS alts FROM p4 WHERE dimension IS NULL GROUP BY 1, 2, 3, 4, 5),
unread AS (SELECT parse, type, string_agg(CASE WHEN bad = n THEN word ELSE array_to_string(alts, '¦') END, '¦' ORDER BY i) AS unparsed FROM odd GROUP BY 1, 2),
part AS (SELECT parse, type FROM p4 GROUP BY 1, 2 HAVING type = 'particle' AND count(*) FILTER (dimension = 'mood') = 1 AND max(value) FILTER (dimension = 'mood') = 'part'
AND count(*) FILTER (dimension IN ('tense', 'voice', 'person')) = 0),
p5 AS (SELECT parse, type, CASE WHEN dimension = 'mood' AND part.type IS NOT NULL THEN 'descriptor' ELSE dimension END AS dimension,
CASE WHEN dimension = 'mood' AND part.type IS NOT NULL THEN 'particle' ELSE value END AS value, CASE WHEN dimension = 'mood' THEN 1000 ELSE i END AS i, k
FROM p4 LEFT JOIN (SELECT parse, type, 1 AS hit FROM part) AS part USING (parse, type)),
feats AS (SELECT parse, type, {", ".join(map(feature, DIMENSIONS))}, bool_or(dimension = 'deponent') AS deponent FROM p5 GROUP BY 1, 2),
d0 AS (SELECT parse, type, phrases[j] AS d, j - 100 AS o FROM (SELECT *, unnest(range(1, len(phrases) + 1)) AS j FROM p1 WHERE NOT nothing)
UNION ALL SELECT parse, type, value, i * 100 + k FROM p5 WHERE dimension = 'descriptor'),
descs AS (SELECT parse, type, string_agg(d, '¦' ORDER BY o) AS descriptors FROM (SELECT parse, type, d, min(o) AS o FROM d0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
m0 AS (SELECT p1.parse, p1.type, nothing, {", ".join(f'"{d}"' for d in DIMENSIONS)}, coalesce(deponent, false) AS is_deponent, coalesce(descriptors, '') AS descriptors, coalesce(unparsed, '') AS unparsed,
coalesce({", ".join(f'"{d}"' for d in DIMENSIONS)}) IS NOT NULL AS stated FROM p1 LEFT JOIN feats USING (parse, type) LEFT JOIN descs USING (parse, type) LEFT JOIN unread USING (parse, type)),
m1 AS (SELECT *, CASE WHEN nothing THEN 'not_applicable' WHEN stated AND unparsed <> '' THEN 'partial' WHEN stated THEN 'ok' WHEN descriptors <> '' AND unparsed = '' THEN 'descriptive'
WHEN descriptors <> '' THEN 'partial' ELSE 'unparsed' END AS status FROM m0),
m AS (SELECT *, {signature_sql()} AS signature, CASE WHEN list_contains(string_split(coalesce(mood, ''), '|'), 'part') THEN 'participle' WHEN coalesce(tense, mood, voice) IS NOT NULL THEN 'verb'
WHEN "case" IS NOT NULL THEN 'nominal' ELSE 'other' END AS form_class, type = 'verb' OR tense IS NOT NULL OR mood IS NOT NULL AS is_verb_form,
(type = 'verb' OR tense IS NOT NULL OR mood IS NOT NULL) AND voice IS NULL AS missing_voice, [{", ".join(map(rank_sql, DIMENSIONS))}] AS sort_key FROM m1),
fm AS (SELECT f.*, m.* EXCLUDE (parse, type, nothing, stated) FROM f JOIN m USING (parse, type))
"""


def _sorted(d: str) -> str:
    return f"list_filter([{', '.join(map(_text, VALUES[d]))}], lambda v: list_contains(string_split(\"{d}\", '|'), v))"


def rank_sql(d: str) -> str:
    return f"coalesce(list_min(list_transform(string_split(\"{d}\", '|'), lambda v: list_position([{', '.join(map(_text, VALUES[d]))}], v) - 1)), 99)"


def signature_sql() -> str:
    ab = lambda d: f"array_to_string(list_transform({_sorted(d)}, lambda v: v || '.'), '/')"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} END"
    has = lambda d: f'"{d}" IS NOT NULL'
    both = 'person IS NOT NULL AND number IS NOT NULL AND "case" IS NULL'
    person = f"array_to_string({_sorted('person')}, '/')"
    fused = f"CASE WHEN contains(person, '|') OR contains(number, '|') THEN {person} || ' ' || {ab('number')} ELSE person || number END"
    parts = [*(when(has(d), ab(d)) for d in ("tense", "voice", "mood", "case")), when(both, fused), when(f"NOT ({both}) AND {has('number')}", ab("number")), when(f"NOT ({both}) AND {has('person')}", person), *(when(has(d), ab(d)) for d in ("gender", "degree"))]
    return f"concat_ws(' ', {', '.join(parts)})"


DECODED = WITH + "," + _decoder()

_FOLD_I = "ιίὶῖἰἱἴἵἲἳἶἷϊΐῒῗῐῑ"
_SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


# Vowels with a mark of quantity, and without.
_LONG_SHORT = "ᾱᾰῑῐῡῠᾹᾸῙῘῩῨāăēĕīĭōŏūŭĀĂĒĔĪĬŌŎŪŬ"
_NEITHER = "ααιιυυΑΑΙΙΥΥaaeeiioouuAAEEIIOOUU"


def match_key(x: str) -> str:
    bare = f"regexp_replace(nfc_normalize(regexp_replace(translate(nfc_normalize({x}), '{_LONG_SHORT}', '{_NEITHER}'), '[\\x{{0304}}\\x{{0306}}]', '', 'g')), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return f"regexp_replace(lower(regexp_replace(regexp_replace({bare}, '[0-9]+$', ''), '{_SPACE}+$', '')), '([\\p{{L}}])σ$', '\\1ς')"


def fold_key(x: str) -> str:
    return f"replace(replace(regexp_replace(nfc_normalize({match_key(x)}), 'γ([{_FOLD_I}])γν', 'γ\\1ν', 'g'), 'ττ', 'σσ'), 'ρρ', 'ρσ')"
