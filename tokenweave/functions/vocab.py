"""Closed vocabularies of morphological labels. Fixed values, in citation and paradigm order."""

from __future__ import annotations

DIMENSIONS = ("tense", "voice", "mood", "case", "number", "gender", "person", "degree")

VALUES = {
    "tense": ("pres", "impf", "fut", "aor", "perf", "plup"),
    "voice": ("act", "mid", "pass"),
    "mood": ("ind", "subj", "opt", "imp", "inf", "part"),
    "case": ("nom", "gen", "dat", "acc", "voc"),
    "number": ("sg", "dual", "pl"),
    "gender": ("masc", "fem", "neut"),
    "person": ("1", "2", "3"),
    "degree": ("comp", "superl"),
}

#: dimension -> value -> spellings in labels; the last one is the display name, if it is a word.
SPELLINGS = {
    "tense": {
        "pres": ("pres", "present"),
        "impf": ("impf", "imperf", "imperfect"),
        "fut": ("fut", "future"),
        "aor": ("aor", "aorist"),
        "perf": ("perf", "perfect"),
        "plup": ("plup", "pluperf", "pluperfect"),
    },
    "voice": {"act": ("act", "active"), "mid": ("mid", "middle"), "pass": ("pass", "passive")},
    "mood": {
        "ind": ("ind", "indic", "indicative"),
        "subj": ("subj", "subjunctive"),
        "opt": ("opt", "optative"),
        "imp": ("imp", "imper", "imperative"),
        "inf": ("inf", "infin", "infinitive"),
        "part": ("part", "ptc", "participle"),
    },
    "case": {
        "nom": ("nom", "nominative"),
        "gen": ("gen", "genitive"),
        "dat": ("dat", "dative"),
        "acc": ("acc", "accusative"),
        "voc": ("voc", "vocative"),
    },
    "number": {"sg": ("sg", "sing", "singular"), "dual": ("du", "dual"), "pl": ("pl", "plur", "plural")},
    "gender": {"masc": ("masc", "m", "masculine"), "fem": ("fem", "f", "feminine"), "neut": ("neut", "n", "neuter")},
    "person": {"1": ("1", "1st"), "2": ("2", "2nd"), "3": ("3", "3rd")},
    "degree": {"comp": ("comp", "compar", "comparative"), "superl": ("superl", "sup", "superlative")},
}
LABELS = {d: {v: names[-1] for v, names in s.items()} for d, s in SPELLINGS.items()}
DIMENSION_LABELS = {d: d.capitalize() for d in DIMENSIONS}

#: Spellings of a voice that may be either of two.
MIDDLE_OR_PASSIVE = ("mp", "midpass")
#: Spellings that say: middle in form, active in meaning.
DEPONENT = ("deponent", "depon", "dep")

#: descriptor -> spellings.
DESCRIPTORS = {
    "interrogative": ("interrogative", "interrog"),
    "negative": ("negative", "neg"),
    "affirmative": ("affirmative", "affirm"),
    "demonstrative": ("demonstrative", "dem"),
    "relative": ("relative", "rel"),
    "reflexive": ("reflexive", "refl"),
    "possessive": ("possessive", "poss"),
    "indefinite": ("indefinite", "indef"),
    "indeclinable": ("indeclinable", "indecl"),
    "adverb": ("adv", "adverb", "adverbial"),
    "particle": ("particle",),
    "conjunction": ("conj",),
    "preposition": ("prep",),
    "abbreviation": ("abbreviation",),
    "proper noun": ("proper",),
}

#: Phrases, replaced in this order, each with its descriptor.
PHRASES = (
    (r"\bdef(?:inite)?\.?\s+art(?:icle)?\.?", "def. art."),
    (r"\bindef(?:inite)?\.?\s+art(?:icle)?\.?", "indef. art."),
    (r"\binterrog(?:ative)?\.?\s+adv(?:erb)?\.?", "interrogative"),
    (r"\binterrog(?:ative)?\.?\s+part(?:icle)?\.?", "interrogative"),
    (r"\bneg(?:ative)?\.?\s+part(?:icle)?\.?", "negative"),
    (r"\baffirm(?:ative)?\.?\s+part(?:icle)?\.?", "affirmative"),
    (r"\bproper\s+n(?:oun)?\.?", "proper noun"),
    (r"\bindecl(?:inable)?\.?\s+noun\.?", "indeclinable"),
    (r"\babbrev(?:iation)?\.?\s+(?:for\s+)?\S*", "abbreviation"),
)

#: Whole labels that say a form has no morphology.
NOT_APPLICABLE = ("", "-", "--", "n/a", "na", "none", "unknown", "?")

FORM_CLASSES = ("verb", "participle", "nominal", "other")
MATCHES = ("exact", "alias", "folded")


def tags() -> dict[str, list[str]]:
    """Each spelling a label may have with what it states, as `dimension=value` or `descriptor=word`."""
    out = {s: [f"{d}={v}"] for d, values in SPELLINGS.items() for v, names in values.items() for s in names}
    out |= {s: ["voice=mid", "voice=pass"] for s in MIDDLE_OR_PASSIVE}
    out |= {s: ["voice=mid", "deponent=1"] for s in DEPONENT}
    for d, names in DESCRIPTORS.items():
        for s in names:
            out.setdefault(s, [f"descriptor={d}"])
    for person in VALUES["person"]:
        for number, short in (("sg", "s"), ("pl", "p")):
            out[person + number] = out[person + short] = [f"person={person}", f"number={number}"]
    return out
