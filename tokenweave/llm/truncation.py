"""Texts that break off: a classifier trained on texts cut on purpose, which then scores every record.

Training pairs are made from intact texts (those that end with a closing mark): cut at a random place, with
and without the sign that a cut may leave, for positives; whole, without any marks, without the closing mark,
trailing off or closed by a mark in the middle of a sentence, for negatives, along with headlines. A logistic
regression over hashed features looks at the closing characters and words, the punctuation of the whole text,
and the distance to the length at which a source cuts its texts. Its score alone decides.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, small

#: Bits of a feature's hash and features of a text but for its last word being known; passes, batch and rate of the fit.
BITS, WIDTH = 18, 18
EPOCHS, BATCH, RATE = 6, 1024, 0.5
#: Most texts that the classifier is fitted on, the most characters each may have, and the seed that picks cuts.
SAMPLE, SAMPLE_CHARS, SEED = 10000, 4000, 11
#: A length is a limit of its source if so large a share of its texts lacks a closing mark, and if these texts are so many
#: standard deviations more than those of the lengths around it, so many on each side.
LIMIT_SHARE, LIMIT_SIGMAS, LIMIT_AROUND = 0.6, 5, 10

_MARKS = ".!?"
_ANY_MARK = re.compile(r"[.!?…]")
# Scores and signs that authors put after their last sentence.
_CLOSING = re.compile(
    r"(?:\s+|(?<=[.!?]))(?:\d{1,2}(?:[.,]\d)?\s?(?:/|out of|of|von|sur|de|auf)\s?\d{1,3}|[:;=8]-?[()\[\]DPp|/\\*]+|<3|x{2,}|[xX][oO]+[xX]*|\^\^)\s*\Z"
)
_CLOSERS = "\"'”’»)]"
_TAG = re.compile(r"[\[(<{][^\[\](){}<>]{0,24}[\])>}]\s*\Z")
_WORD = re.compile(r"[^\W\d_]+|\d+")
# Signs that a cut may leave behind.
CLOSED_WITH = (".", ".", ".", "!", "?", "”.", " !", ".”")
RESIDUES = ("", "", "", "", "", " ", "\n", "�", " �", "…", "...", " …", " ...", " [more]", "[...]", " -", "-", ",")


def _symbol(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk", "Mn", "Cf") and ch != "�"


def strip_closing(text: str) -> str:
    """text without scores, emoticons, stars and the like after its last sentence."""
    while True:
        t = text
        end = len(t)
        while end and _symbol(t[end - 1]):
            end -= 1
        if end < len(t):
            t = t[:end].rstrip()
        before = t.rsplit(None, 5)  # no such sign has more than five words
        if m := _CLOSING.search(t, len(before[0]) if len(before) > 5 else 0):
            t = t[: m.start()]
        if t == text or not t:
            return t or text
        text = t


def ended(text: str) -> bool:
    """True if the last sign of text, scores and closing quotes aside, is a closing mark that ends no initial or decimal."""
    return _ended(strip_closing(text))


def _ended(body: str) -> bool:
    end = len(body)
    while end and (body[end - 1] in _CLOSERS or body[end - 1].isspace()):
        end -= 1
    last = body[end - 1 : end]
    if last != ".":
        return last in ("!", "?")
    return not (end > 1 and body[end - 2].isalnum()) or end > 2 and body[end - 3].isalnum()


def describe(text: str, at_limit: bool) -> tuple[str, list[str], str, bool]:
    """State of the ending, last words of its sentence, sign left, whether the text ends with its closing mark.

    States: E closed; D dots; N no mark, though the text before has some. Of texts without any closing mark:
    V dots, U all in small letters and without commas, H others, such as headlines.
    """
    body = strip_closing(text)
    closed = _ended(body)
    opening = max(map(body.rfind, "[(<{"))
    tag = opening > 0 and bool(_TAG.match(body, opening)) and not body[:opening].isspace()
    if tag:
        body = body[:opening].rstrip()
    end = len(body)
    while end and not body[end - 1].isalnum():
        end -= 1
    sign = body[end:]
    plain = sign.strip()
    dots = "…" in sign or ".." in sign
    if not tag and not dots and any(c in sign for c in _MARKS):
        state = "E"
    elif dots:
        state = "D"
    else:
        state = "N"
    mark = max(body.rfind(c, 0, end) for c in _MARKS + "…")
    if state != "E" and mark < 0:
        state = "V" if state == "D" else "U" if body == body.lower() and "," not in body else "H"
    last = body[mark + 1 : end]
    words = ["0" if w[0].isdigit() else w.lower() for w in _WORD.findall(last)]
    words = ["^", *words][-5:]
    return state, words, ("t" if tag else "") + plain[:3] + ("_" if sign[-1:].isspace() else "") + ("l" if at_limit else ""), closed


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def features(text: str, at_limit: bool) -> tuple[list[int], str, str]:
    """The features of text but for those of its last word being known, then its state and that word; `0` is any number."""
    state, words, sign, closed = describe(text, at_limit)
    w = ["^"] * (5 - len(words)) + words
    close = {"E": "E", "N": "N"}.get(state, "W")
    length = min(6, len(text).bit_length())
    names = [
        "b", "e" + str(closed) + state, "f" + str(closed), "s" + state, "g" + sign, "sg" + state + sign, "l" + str(at_limit) + state, "n" + str(length) + state,
        "1" + w[-1], "2" + " ".join(w[-2:]), "3" + " ".join(w[-3:]), "4" + " ".join(w[-4:]), "5" + " ".join(w),
        "1" + close + w[-1], "2" + close + " ".join(w[-2:]), "3" + close + " ".join(w[-3:]),
        "c" + w[-1][-2:], "z" + str(min(len(w[-1]), 5)) + close,
    ]
    return [*map(_hashed, names)], state, w[-1]


@lru_cache(maxsize=64)
def of_word(known: bool, state: str) -> tuple[int, int]:
    """The features of a text whose last word is a known one, or is not."""
    k = "k" if known else "u"
    return _hashed("k" + k), _hashed("ks" + k + state)


_SENTENCE_END = re.compile(r"[.!?]+(?=\s|\Z)")
_MARK_RUN = re.compile(r"[^\w\s'’-]+")


def _unmarked(text: str) -> str:
    return re.sub(r"\s+", " ", _MARK_RUN.sub(" ", text)).strip().lower()


def examples(texts: list[str], titles: list[str], seed: int) -> Iterator[tuple[str, bool, int]]:
    """(text, at limit, 1 if cut) made from intact texts and headlines."""
    for text in texts:
        rng = random.Random(f"{seed} {text}")
        ends = [m.end() for m in _SENTENCE_END.finditer(text)]
        if not ends:
            continue
        starts = [0, *ends[:-1]]
        yield text, rng.random() < 0.02, 0
        for turn in range(6):
            k = rng.randrange(len(ends))
            whole = text[: ends[k]].strip()
            bare = whole.rstrip(_MARKS)
            yield _unmarked(whole), rng.random() < 0.02, 0
            if turn < 3 and rng.random() < 0.7:
                yield bare + rng.choice(("…", "...", " ...", " …")), False, 0
            if rng.random() < 0.1:
                yield _unmarked(whole) + rng.choice(("…", "...")), False, 0
        for turn in range(6):
            k = rng.randrange(len(ends))
            low, high = starts[k], ends[k] - 1
            while low < high and text[low].isspace():
                low += 1
            inner = text[low:high].rstrip(_MARKS)
            if len(inner) < 3:
                continue
            at = low + rng.randrange(1, len(inner))
            if turn % 2:  # a passage that ends in the middle of its sentence, but with a mark
                yield text[:at].rstrip() + rng.choice(CLOSED_WITH), rng.random() < 0.02, 0
            if turn >= 3:  # between words, where it is hardest to tell
                while at < low + len(inner) and not text[at].isspace():
                    at += 1
                if at >= low + len(inner):
                    continue
                yield text[:at] + rng.choice(("…", "...", "")), rng.random() < 0.3, 1
                yield text[low:at] + rng.choice(("…", "...", "", " ")), False, 1
                yield _unmarked(text[:at]), False, 1
                continue
            cut = text[:at]
            yield cut + rng.choice(RESIDUES), rng.random() < 0.3, 1
            flat = _unmarked(cut)
            if flat:
                yield flat + rng.choice(RESIDUES), rng.random() < 0.3, 1
    for title in titles:
        yield title, False, 0


class Cutoff:
    """The fitted classifier: weights of hashed features, and the words of its examples that it takes for whole ones."""

    def __init__(self, weights: np.ndarray, vocabulary: set[str]):
        self.weights, self.vocabulary = weights, vocabulary

    def scores(self, texts: list[str], at_limit: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The last word of each text, and the score if that is a known word and if it is not."""
        told = [features(t, a) for t, a in zip(texts, at_limit)]
        z = self.weights[np.array([f for f, _, _ in told], np.int32).reshape(-1, WIDTH)].sum(1, dtype=np.float64)
        more = ({s: float(self.weights[[*of_word(k, s)]].sum()) for s in {s for _, s, _ in told}} for k in (True, False))
        known, unknown = (1 / (1 + np.exp(-np.clip(z + np.array([m[s] for _, s, _ in told]), -30, 30))) for m in more)
        return [w for _, _, w in told], known, unknown

    def score(self, text: str, at_limit: bool) -> float:
        (word,), (known,), (unknown,) = self.scores([text], [at_limit])
        return float(known if word == "0" or word in self.vocabulary else unknown)


def _counted(texts: Iterable[str]) -> Counter[str]:
    """Word -> number of texts that have it before their last word; numbers, which are all alike, aside."""
    return Counter(w for t in texts for w in set(_WORD.findall(t.lower())[:-1]) if not w[0].isdigit())


class Examples(NamedTuple):
    """Features but for those of the last word, labels, states and last words of examples, one row each."""

    x: np.ndarray
    y: np.ndarray
    states: list[str]
    words: list[str]

    @classmethod
    def made(cls, texts: list[str], titles: list[str], seed: int) -> Examples:
        rows = list(examples(texts, titles, seed))
        told = [features(t, at_limit) for t, at_limit, _ in rows]
        x = np.array([f for f, _, _ in told], np.int32).reshape(len(rows), WIDTH)
        return cls(x, np.array([c for _, _, c in rows], np.int8), [s for _, s, _ in told], [w for _, _, w in told])

    def fitted(self, vocabulary: set[str], seed: int, epochs: int) -> Cutoff:
        more = np.array([of_word(w == "0" or w in vocabulary, s) for w, s in zip(self.words, self.states)], np.int32).reshape(-1, 2)
        return Cutoff(weigh(np.hstack([self.x, more]), self.y, seed, epochs), vocabulary)


def weigh(x: np.ndarray, y: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic regression, by gradient steps over batches, each weight with a rate of its own."""
    w = np.zeros(1 << BITS, np.float32)
    if not len(y):
        return w
    used, at = np.unique(x, return_inverse=True)
    at = at.reshape(x.shape).astype(np.int32)
    v, g = np.zeros(len(used), np.float32), np.full(len(used), 1e-4, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            some = order[a : a + BATCH]
            idx = at[some]
            p = 1 / (1 + np.exp(-np.clip(v[idx].sum(1), -30, 30)))
            step = np.bincount(idx.ravel(), np.repeat(p - y[some], idx.shape[1]), minlength=len(used)).astype(np.float32) / len(some)
            g += step * step
            v -= RATE * step / np.sqrt(g)
    w[used] = v
    return w


def fit(texts: list[str], titles: list[str], seed: int = SEED, epochs: int = EPOCHS, vocabulary: set[str] | None = None) -> Cutoff:
    """vocabulary: the words taken for whole ones, by default those of more than 2 of texts."""
    if vocabulary is None:
        vocabulary = {w for w, n in _counted(texts).items() if n > 2}
    return Examples.made(texts, titles, seed).fitted(vocabulary, seed, epochs)


CLOSED = r"(?s)[^.][.!?][\"'”’»)]*\s*$"


def is_open(text: Column) -> Column:
    """Whether a text lacks a closing mark at its end but has some before, unlike headlines and texts without marks; or ends with dots."""
    return text.rlike(r"[^.!?\s]\s*$") & text.rlike("[.!?]") | text.rlike(r"\.\.\s*$")


def limits(documents: DataFrame, source: str, text: str) -> DataFrame:
    """source, unit (chars or bytes), length: lengths at which a source cuts, from counts over all documents."""
    at = lambda c: F.col(f"`{c}`")
    sized = documents.where(at(text).isNotNull() & (F.length(at(text)) > 0)).select(at(source).alias("source"), (~at(text).rlike(CLOSED) & is_open(at(text))).cast("int").alias("open"), F.explode(F.create_map(F.lit("chars"), F.length(at(text)), F.lit("bytes"), F.octet_length(at(text)))).alias("unit", "length"))
    counts = sized.groupBy("source", "unit", "length").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    w = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    around = (F.sum("open").over(w) - F.col("open")) / (2 * LIMIT_AROUND)
    stands_out = F.col("open") >= around + LIMIT_SIGMAS * F.sqrt(around + 1)
    return counts.withColumn("is_limit", stands_out & (F.col("open") >= LIMIT_SHARE * F.col("n"))).where("is_limit").select("source", "unit", "length")


def whole_words(documents: DataFrame, text: str) -> DataFrame:
    """word: those in more than 2 intact texts of all documents, whatever their length."""
    at = F.col(f"`{text}`")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = _counted(batch["text"])
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())}).astype({"word": object, "n": "int64"})

    parts = documents.where(at.rlike(CLOSED)).select(at.alias("text")).mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 2").select("word")


def fitted(documents: DataFrame, words: DataFrame, doc_id: str, text: str, title: str | None = None, sample: int = SAMPLE) -> Cutoff:
    """A classifier from at most `sample` intact texts of at most SAMPLE_CHARS characters, those with the least hash of their id, and their headlines.

    words: those taken for whole ones, from whole_words(). Examples are made by the executors; the driver gets their features,
    WIDTH numbers each, some thirty a text, and of words those that end an example.
    """
    at = lambda c: F.col(f"`{c}`")
    intact = documents.where((F.length(at(text)) <= SAMPLE_CHARS) & at(text).rlike(CLOSED)).select(F.xxhash64(at(doc_id)).alias("h"), at(text).alias("text"), (at(title) if title else F.lit(None).cast("string")).alias("title"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, body, head in batch.itertuples(index=False, name=None):
                e = Examples.made([body], [head] if head and head.strip() else [], SEED)
                rows.append((h, zlib.crc32(body.encode()), e.x.tobytes(), e.y.tobytes(), "".join(e.states), e.words))
            yield pd.DataFrame(rows, columns=["h", "t", "x", "y", "states", "words"])

    tasks = documents.sparkSession.sparkContext.defaultParallelism
    total = documents.count()
    share = min(1.0, 4 * sample / max(1, total))
    while True:
        # the least hashes of all are those of a share of them, if that share holds enough; so no task gets a sample from every other
        some = intact if share >= 1 else intact.where(F.col("h") < int(share * (1 << 64)) - (1 << 63))
        made = cut(some.orderBy("h").limit(sample).repartition(tasks).mapInPandas(make, "h long, t long, x binary, y binary, states string, words array<string>"), "examples")
        if share >= 1 or made.count() >= sample:
            break
        share = min(1.0, 8 * share)
    ends = made.select(F.explode("words").alias("word")).distinct()
    vocabulary = {r.word for r in words.join(small(ends), "word", "left_semi").collect()}
    got = made.toArrow()
    order = np.lexsort((got["t"].to_numpy(), got["h"].to_numpy()))
    column = {c: got[c].to_pylist() for c in ("x", "y", "states", "words")}
    x = np.frombuffer(b"".join(column["x"][i] for i in order), np.int32).reshape(-1, WIDTH)
    y = np.frombuffer(b"".join(column["y"][i] for i in order), np.int8)
    every = Examples(x, y, [s for i in order for s in column["states"][i]], [w for i in order for w in column["words"][i]])
    return every.fitted(vocabulary, SEED, EPOCHS)


def score_truncation(documents: DataFrame, doc_id: str, source: str, text: str, title: str | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Every row of documents: doc_id, source, score (that its text breaks off), truncated (score >= threshold).

    Null and empty texts score 0. Repeated rows are scored alike; a null source has limits of its own. Extra
    columns are not read. The weights of the classifier are fitted when this is called, on a bounded sample;
    everything else, its known words too, covers all rows: a text gets the scores for both cases, and its last word is
    joined to the words of the corpus, however many they are.
    """
    spark = documents.sparkSession
    at = lambda c: F.col(f"`{c}`")
    words = cut(whole_words(documents, text), "words")
    model = spark.sparkContext.broadcast(fitted(documents, words, doc_id, text, title, sample))
    lim = limits(documents, source, text)
    chars = lim.where("unit = 'chars'").select(F.col("source").alias("__cs"), F.col("length").alias("__c"))
    octets = lim.where("unit = 'bytes'").select(F.col("source").alias("__bs"), F.col("length").alias("__b"))
    base = documents.select(at(doc_id).alias("doc"), at(source).alias("source"), at(text).alias("text"))
    marked = base.join(chars, F.col("source").eqNullSafe(F.col("__cs")) & (F.length("text") == F.col("__c")), "left")
    marked = marked.join(octets, F.col("source").eqNullSafe(F.col("__bs")) & (F.octet_length("text") == F.col("__b")), "left")
    marked = marked.select("doc", "source", "text", (F.col("__c").isNotNull() | F.col("__b").isNotNull()).alias("at_limit"))
    out = T.StructType([T.StructField("doc", documents.schema[doc_id].dataType), T.StructField("source", documents.schema[source].dataType), T.StructField("last", T.StringType()), T.StructField("known", T.DoubleType()), T.StructField("unknown", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit_ = model.value
        for batch in batches:
            some = [bool(t) for t in batch["text"]]
            last, known, unknown = fit_.scores([t for t in batch["text"] if t], [bool(x) for x, t in zip(batch["at_limit"], some) if t])
            told = pd.DataFrame({"doc": batch["doc"], "source": batch["source"], "last": pd.Series([None] * len(batch), dtype=object), "known": 0.0, "unknown": 0.0})
            told.loc[some, "last"], told.loc[some, "known"], told.loc[some, "unknown"] = last, known, unknown
            yield told

    scored = marked.mapInPandas(score, out).join(small(words), F.col("last") == F.col("word"), "left")
    final = F.when(F.col("word").isNotNull() | (F.col("last") == "0"), F.col("known")).otherwise(F.col("unknown"))
    return scored.select(F.col("doc").alias(doc_id), F.col("source").alias(source), final.alias("score")).withColumn("truncated", F.col("score") >= threshold)
