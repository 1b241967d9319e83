"""From raw text to facts: cleaning, paragraphs, chunks, words, chapter ids."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.morphology import strip

#: Lines that begin with this word are running heads. Fixed value.
PART = "μέρος"
TOKEN = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "lemma", "form", "parse")])


def clean(text: Column) -> Column:
    """text without [bracketed] parts and without lines that begin with PART; lines of blanks become empty."""
    part = "|".join(dict.fromkeys((unicodedata.normalize("NFC", PART), unicodedata.normalize("NFD", PART), PART.replace("έ", "έ"))))
    lines = F.split(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    kept = F.filter(lines, lambda x: ~strip(x).rlike(f"^(?:{part})"))
    joined = F.array_join(F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x)), "\n")
    return F.when(text == "", text).otherwise(F.regexp_replace(joined, r"\n\z", ""))


def paragraphs(text: Column) -> Column:
    """The parts between blank lines, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(strip(text), r"\n\s*\n+"), strip), lambda p: p != "")


def _pack(items: Column, joiner: str, limit: int) -> Column:
    """Neighbouring strings joined as long as the result stays within limit."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, x: Column) -> Column:
        fits = F.length(acc["open"]) + len(joiner) + F.length(x) <= limit
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(joiner), x).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), x.alias("open")))
        )

    return F.aggregate(items, start, add, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def split_long(paragraph: Column, limit: int) -> Column:
    """Pieces of a paragraph within limit: whole sentences packed together; a longer sentence is cut by length.

    Sentences are packed only between cut ones, so a cut sentence never shares a piece.
    """
    sentences = F.split(paragraph, r"(?<=[.·;!?])\s+")
    hard = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, limit))
    stretches = F.aggregate(
        sentences,
        F.expr("cast(array() as array<struct<cut:boolean,parts:array<string>>>)"),
        lambda acc, s: F.when(F.length(s) > limit, F.array_append(acc, F.struct(F.lit(True).alias("cut"), hard(s).alias("parts"))))
        .when((F.size(acc) > 0) & ~F.coalesce(F.try_element_at(acc, F.lit(-1))["cut"], F.lit(True)), F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.lit(False).alias("cut"), F.array_append(F.try_element_at(acc, F.lit(-1))["parts"], s).alias("parts"))))
        .otherwise(F.array_append(acc, F.struct(F.lit(False).alias("cut"), F.array(s).alias("parts")))),
    )
    packed = F.flatten(F.transform(stretches, lambda x: F.when(x["cut"], x["parts"]).otherwise(_pack(x["parts"], " ", limit))))
    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(packed)


def chunks(text: Column, limit: int = 1200) -> Column:
    """Chunks of at most limit characters: paragraphs, long ones split, packed with a blank line between."""
    pieces = F.flatten(F.transform(paragraphs(text), lambda p: split_long(p, limit)))
    return _pack(pieces, "\n\n", limit)


def natural_key(name: Column) -> Column:
    """A sort key that compares runs of digits as numbers, however long, and what stands between them without case."""
    digits = F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1))
    number = lambda n: F.concat(F.lpad(F.length(n).cast("string"), 10, "0"), n)  # noqa: E731 - longer numbers are larger
    pairs = F.zip_with(F.split(F.lower(name), r"\d+"), F.transform(digits, lambda n: number(F.ltrim(n, F.lit("0")))), lambda t, n: F.array_compact(F.array(t, n)))
    return F.flatten(pairs)


def slug_id(title: Column, ordinal: Column) -> Column:
    """`n-title` in small letters, digits and hyphens, at most 64 characters; `n-ch-n` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)\s+", "-"), "[^a-z0-9-]", "")
    number = ordinal.cast("string")
    return F.substring(F.concat(number, F.lit("-"), F.when(slug == "", F.concat(F.lit("ch-"), number)).otherwise(slug)), 1, 64)


def arrange(sections: DataFrame) -> DataFrame:
    """Sections of files (run_id, filename, section_no, title, text) in corpus order, with chapter_index and id.

    Files stand in natural order of their names; a file of one section titled `Document` takes its file's name. Sections
    are told apart by run_id, filename and section_no. They are numbered without their texts, which are joined then.
    """
    key = ["run_id", "filename", "section_no"]
    alone = (F.count("*").over(Window.partitionBy("run_id", "filename")) == 1) & (F.col("title") == "Document")
    stem = F.regexp_replace(F.regexp_replace("filename", "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    index = F.row_number().over(Window.partitionBy("run_id").orderBy(natural_key(F.col("filename")), "filename", "section_no"))
    titled = sections.select(*key, F.when(alone, stem).otherwise(F.col("title")).alias("title"), index.alias("__n"))
    listed = titled.select(*key, (F.col("__n") - 1).alias("chapter_index"), slug_id(F.col("title"), F.col("__n")).alias("chapter_id"), "title")
    texts = sections.select(*(F.col(c).alias(f"__{c}") for c in key), "text")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key))
    return listed.join(texts, same).select("run_id", "filename", "chapter_index", "chapter_id", "title", "text")


def words(text: Column) -> Column:
    """The words between white space, without .,·;!? around them."""
    return F.filter(F.transform(F.split(strip(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, "^[.,·;!?]+|[.,·;!?]+$", "")), lambda w: w != "")


def word_provider(chapters: DataFrame, lemma_map: dict[str, str] | None = None, parse: str = "nom. sg.", token_type: str = "noun") -> DataFrame:
    """The built-in provider: chapters with `tokens`, one per word, its lemma from lemma_map or the word itself."""
    known = F.create_map(*(F.lit(x) for pair in (lemma_map or {"": ""}).items() for x in pair))
    token = lambda w: F.struct(F.lit(token_type).alias("type"), F.coalesce(F.try_element_at(known, w), w).alias("lemma"), w.alias("form"), F.lit(parse).alias("parse"))
    return chapters.withColumn("tokens", F.transform(words(F.coalesce("text", F.lit(""))), token))


def provide(chapters: DataFrame, analyze: Callable[[str, str], list[tuple[str, str, str, str]]]) -> DataFrame:
    """Any provider: analyze(text, title) gives (type, lemma, form, parse) of each word; runs once per chapter, in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tokens=[[dict(zip(TOKEN.names, t)) for t in analyze(text or "", title or "")] for text, title in zip(batch["text"], batch["title"])])

    return chapters.mapInPandas(run, T.StructType([*chapters.schema.fields, T.StructField("tokens", T.ArrayType(TOKEN))]))


class CutOff(Exception):
    """A provider's answer broke off before the end of the text it was asked about."""


#: Where a text may be halved, the best place first: between paragraphs, after a sentence, between words.
_BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"(?<=[.·;!?])\s+"), re.compile(r"\s+"))


def halves(text: str) -> tuple[str, str] | None:
    """text in two, at the place nearest to its middle of the best kind that it has; None for a single word."""
    for pattern in _BREAKS:
        spots = [m.span() for m in pattern.finditer(text) if 0 < m.start() and m.end() < len(text)]
        if spots:
            a, b = min(spots, key=lambda s: abs(s[0] + s[1] - len(text)))
            return text[:a], text[b:]
    return None


def persistent(analyze: Callable[[str, str], list], tries: int = 3, depth: int = 4) -> Callable[[str, str], list]:
    """analyze for provide(), asked again after a failure, `tries` times in all. Where an answer was CutOff, both halves of the
    text are asked about and their tokens put together in order, halved `depth` times at most; then CutOff is raised."""

    def ask(text: str, title: str, left: int) -> list:
        for turn in range(tries):
            try:
                return list(analyze(text, title))
            except CutOff:
                parts = halves(text) if left else None
                if parts is None:
                    raise
                return [token for part in parts for token in ask(part, title, left - 1)]
            except Exception:  # noqa: BLE001 - whatever a service may raise
                if turn + 1 == tries:
                    raise
        return []

    return lambda text, title: ask(text, title, depth)


def locate(analysed: DataFrame) -> DataFrame:
    """Facts from analysed chapters: one row per token with its position, from 0."""
    return analysed.select("run_id", "filename", "chapter_index", "chapter_id", F.col("title").alias("chapter_title"), F.posexplode("tokens").alias("position", "t")).select("run_id", "filename", "chapter_index", "chapter_id", "chapter_title", "position", "t.*")


def json_array(raw: Column) -> Column:
    """The first valid JSON array in a model's answer: inside a code fence, else from the first `[`; null without one."""
    text = strip(raw)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", strip(fenced)).otherwise(text)
    tail = F.when(F.instr(body, "[") > 0, F.substring(body, F.instr(body, "["), F.length(body)))
    ends = F.split(tail, r"\]")
    slices = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ends) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(ends, 1, n), "]"), F.lit("]")))
    valid = lambda s: F.try_parse_json(s).isNotNull()
    whole = F.when(valid(body) & (fenced != ""), body)
    return F.coalesce(whole, F.when(tail.isNotNull() & (F.size(ends) > 1), F.get(F.filter(slices, valid), F.lit(0))))


def json_tokens(array: Column) -> Column:
    """The tokens of a JSON array; null if it is no array of objects that have all four fields."""
    parsed = F.from_json(array, T.ArrayType(TOKEN))
    whole = F.forall(parsed, lambda t: t["type"].isNotNull() & t["lemma"].isNotNull() & t["form"].isNotNull() & t["parse"].isNotNull())
    return F.when(whole, parsed)
