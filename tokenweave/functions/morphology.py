"""Free-text morphological labels decoded into typed features, in the JVM.

A label is decoded once per distinct (parse, type), by higher-order functions over its words, and joined
back to the rows; tokens never pass through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small
from .vocab import DIMENSIONS, FORM_CLASSES, LABELS, NOT_APPLICABLE, PHRASES, VALUES, tags

_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_PUNCTUATION = r"^[\s\p{Z}]*[.,;:]*[\s\p{Z}]*|[\s\p{Z}]*[.,;:]*[\s\p{Z}]*$"


def strip(value: Column) -> Column:
    """value without white space of any script at its ends."""
    return F.regexp_replace(value, _EDGES, "")


def bare(value: Column) -> Column:
    """A word without white space and .,;: around it."""
    return F.regexp_replace(value, _PUNCTUATION, "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def without_phrases(label: Column) -> Column:
    """label with a sentinel, \\u0001 and its number, in place of each phrase."""
    for i, (pattern, _) in enumerate(PHRASES):
        label = F.regexp_replace(label, "(?iU)" + pattern, f" \u0001{i} ")
    return label


def phrases(marked: Column) -> Column:
    """The descriptors of the phrases that without_phrases() found, in the order of PHRASES."""
    return F.array_compact(F.array(*(F.when(marked.contains(f"\u0001{i}"), d) for i, (_, d) in enumerate(PHRASES))))


def words(marked: Column) -> Column:
    """The words of a label beside its phrases, those of nothing but .,;: left out; as written."""
    return F.filter(F.split(F.regexp_replace(marked, "\u0001[0-9]", " "), r"[\s\p{Z}]+"), lambda w: bare(w) != "")


def sides(word: Column) -> Column:
    """The alternatives of a word, without white space and .,;: around them."""
    return F.filter(F.transform(F.split(bare(word), "/"), bare), lambda a: a != "")


def meaning(alternative: Column) -> Column:
    """What an alternative states, as `dimension=value` or `descriptor=word`; null if it is not known."""
    known = F.create_map(*(x for s, t in tags().items() for x in (F.lit(s), _strings(t))))
    return F.try_element_at(known, F.lower(alternative))


def with_morph(df: DataFrame, parse: str = "parse", token_type: str = "type") -> DataFrame:
    """df with the dimensions, status, is_deponent, descriptors and unparsed of its labels.

    A dimension is null unless the label states it; several readings are joined by `|` in alphabetical order.
    A null label counts as empty. The steps are columns of their own, which the planner keeps apart, so that
    each is evaluated once however often the next ones use it.
    """
    kept = df.columns
    sided = F.transform(words(F.col("__text")), lambda w: F.struct(w.alias("word"), sides(w).alias("sides")))
    read = F.transform("__sided", lambda x: F.struct(x["word"].alias("word"), x["sides"].alias("sides"), F.transform(x["sides"], meaning).alias("means")))
    said = F.flatten(F.transform("__read", lambda x: F.flatten(F.transform(x["means"], lambda m: F.coalesce(m, _strings([]))))))
    unread = F.flatten(F.transform("__read", lambda x: _unread(x["word"], x["sides"], F.filter(x["sides"], lambda a, i: F.get(x["means"], i).isNull()))))

    steps = df.withColumn("__raw", strip(F.coalesce(parse, F.lit("")))).withColumn("__text", without_phrases(F.col("__raw")))
    steps = steps.withColumns({"__phrases": phrases(F.col("__text")), "__sided": sided}).withColumn("__read", read).withColumns({"__said": said, "__unread": unread})
    steps = steps.withColumns({f"__{n}": _of(n) for n in (*DIMENSIONS, "descriptor", "deponent")} | {"__nothing": F.lower("__raw").isin(*NOT_APPLICABLE)})
    alone = F.size("__tense") + F.size("__voice") + F.size("__person") == 0
    steps = steps.withColumn("__bare_part", (F.col(token_type) == "particle") & (F.col("__mood") == _strings(["part"])) & alone)
    steps = steps.withColumn("__mood", F.when(F.col("__bare_part"), _strings([])).otherwise(F.col("__mood")))
    added = F.when(F.col("__bare_part"), _strings(["particle"])).otherwise(_strings([]))
    nothing, empty = F.col("__nothing"), _strings([])
    stated = {d: F.when(~nothing & (F.size(f"__{d}") > 0), F.array_join(F.array_sort(F.array_distinct(f"__{d}")), "|")) for d in DIMENSIONS}
    found = {
        "is_deponent": ~nothing & (F.size("__deponent") > 0),
        "descriptors": F.when(nothing, empty).otherwise(F.array_distinct(F.concat("__phrases", "__descriptor", added))),
        "unparsed": F.when(nothing, empty).otherwise(F.col("__unread")),
    }
    steps = steps.withColumns(stated | found)
    some, odd, words_only = F.coalesce(*DIMENSIONS).isNotNull(), F.size("unparsed") > 0, F.size("descriptors") > 0
    status = F.when(nothing, "not_applicable").when(some & odd, "partial").when(some, "ok").when(words_only & ~odd, "descriptive").when(words_only, "partial").otherwise("unparsed")
    return steps.select(*kept, *DIMENSIONS, status.alias("status"), "is_deponent", "descriptors", "unparsed")


def _of(name: str) -> Column:
    return F.transform(F.filter("__said", lambda t: t.startswith(name + "=")), lambda t: F.substring(t, len(name) + 2, 99))


def _unread(word: Column, sides: Column, odd: Column) -> Column:
    """What of a word was not understood: all of it as written, or the sides that were not."""
    return F.when(F.size(sides) == 0, _strings([])).when(F.size(odd) == F.size(sides), F.array(word)).otherwise(odd)


def parts(value: Column) -> Column:
    return F.split(value, r"\|")


def in_order(dimension: str, value: Column) -> Column:
    """The readings of a value as an array in paradigm order."""
    return F.filter(_strings(VALUES[dimension]), lambda v: F.array_contains(parts(value), v))


def has(value: Column, reading: str) -> Column:
    """Whether a value has a reading; false for null."""
    return F.coalesce(F.array_contains(parts(value), reading), F.lit(False))


def feature_label(dimension: str, value: Column) -> Column:
    """Human names of the readings, joined by / in stored order."""
    names = F.create_map(*(F.lit(x) for pair in LABELS[dimension].items() for x in pair))
    return F.array_join(F.transform(parts(value), lambda p: F.coalesce(F.try_element_at(names, p), p)), "/")


def feature_abbr(dimension: str, value: Column) -> Column:
    return F.array_join(F.transform(in_order(dimension, value), lambda p: F.concat(p, F.lit("."))), "/")


def person_abbr(value: Column) -> Column:
    return F.array_join(in_order("person", value), "/")


def paradigm_rank(dimension: str, value: Column) -> Column:
    """Place of the first reading in paradigm order; null for null."""
    return (F.array_position(_strings(VALUES[dimension]), F.get(in_order(dimension, value), F.lit(0))) - 1).cast("int")


def signature(m: dict[str, Column]) -> Column:
    """The whole combination as a grammar writes it; '' if nothing is stated. m: the dimensions' columns."""
    number, person = m["number"], m["person"]
    single = ~F.coalesce(person.contains("|") | number.contains("|"), F.lit(False))
    fused = F.when(single, F.concat(person, number)).otherwise(F.concat_ws(" ", person_abbr(person), feature_abbr("number", number)))
    together = person.isNotNull() & number.isNotNull() & m["case"].isNull()
    ab = lambda d: F.when(m[d].isNotNull(), feature_abbr(d, m[d]))
    return F.concat_ws(
        " ", ab("tense"), ab("voice"), ab("mood"), ab("case"),
        F.when(together, fused), F.when(~together, ab("number")), F.when(~together & person.isNotNull(), person_abbr(person)),
        ab("gender"), ab("degree"),
    )


def form_class(m: dict[str, Column]) -> Column:
    verbal = m["tense"].isNotNull() | m["mood"].isNotNull() | m["voice"].isNotNull()
    return F.when(has(m["mood"], "part"), FORM_CLASSES[1]).when(verbal, FORM_CLASSES[0]).when(m["case"].isNotNull(), FORM_CLASSES[2]).otherwise(FORM_CLASSES[3])


def sort_key(m: dict[str, Column]) -> Column:
    """Paradigm order of combinations, as an array; what a combination does not state sorts last."""
    return F.array(*(F.coalesce(paradigm_rank(d, m[d]), F.lit(99)) for d in DIMENSIONS))


def is_verbal(m: dict[str, Column]) -> Column:
    return m["tense"].isNotNull() | m["mood"].isNotNull() | m["voice"].isNotNull()


def is_nominal(m: dict[str, Column]) -> Column:
    return m["case"].isNotNull()


def is_verb_form(m: dict[str, Column], token_type: Column) -> Column:
    """Whether a voice is to be expected."""
    return (token_type == "verb") | m["tense"].isNotNull() | m["mood"].isNotNull()


def missing_voice(m: dict[str, Column], token_type: Column) -> Column:
    return is_verb_form(m, token_type) & m["voice"].isNull()


def decode_labels(labels: DataFrame) -> DataFrame:
    """labels (parse, type, any case) with the dimensions, status, is_deponent, descriptors, unparsed, signature, form_class, is_verb_form, missing_voice, sort_key."""
    m = {d: F.col(d) for d in DIMENSIONS}
    flat = with_morph(labels.select("parse", "type"))
    return flat.select("*", signature(m).alias("signature"), form_class(m).alias("form_class"), is_verb_form(m, F.col("type")).alias("is_verb_form"), missing_voice(m, F.col("type")).alias("missing_voice"), sort_key(m).alias("sort_key"))


def decode(facts: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """facts with decode_labels' columns. parse and type must not be null.

    Each distinct (parse, type) is decoded once, into a table in the shared folder: the long expression is
    evaluated and optimised once, and its real size decides whether the join broadcasts it. raw: a table that holds
    all labels of facts and is cheaper to read, such as the one that facts were made from; its nulls count as empty.
    """
    source = facts if raw is None else raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("parse", "type")))
    labels = cut(decode_labels(source.select("parse", "type").distinct()), "labels")
    return facts.join(small(labels), ["parse", "type"])
