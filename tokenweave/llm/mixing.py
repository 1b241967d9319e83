"""A mixture of sources with given shares of all tokens.

Tokens are counted once per document by a public tokenizer and summed per source. A source's rate is the
number of times each of its documents is used on average: its wanted tokens over those it has, at most its
cap. Each document is then emitted floor(rate) times and once more with the probability of the fraction,
decided by a hash of its id, so that the same documents come out on every run and every cluster.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how this tokenizer splits a text before it encodes the pieces.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of blanks that the fast encoder's splitting has no stack for.
_LONG_RUN = re.compile(r"\s{5000}")


@lru_cache(maxsize=4)
def _counter(path: str, ranks: str | None) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts. ranks: the same vocabulary as ranks, for the encoder that is some five times as fast."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    every = lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if ranks is None:
        return every
    import tiktoken

    with open(ranks, "rb") as lines:
        fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    return lambda texts: [every([t])[0] if _LONG_RUN.search(t) else len(fast.encode_ordinary(t)) for t in texts]


def with_tokens(documents: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents without `text` but with `tokens`, the number of its tokens; 0 for a null or empty text.

    tokenizer: a file on the driver's machine, which executors are sent; so is the file of the same name that ends in
    .tiktoken, if there is one.
    """
    rest = [f.name for f in documents.schema.fields if f.name != text]
    if "tokens" in rest:
        raise ValueError("rename the column tokens")
    inner = documents.select(F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)))
    ranks = Path(tokenizer).with_suffix(".tiktoken")
    files = [tokenizer, *([str(ranks)] if ranks.is_file() else [])]
    for f in files:
        documents.sparkSession.sparkContext.addFile(f)
    names = [Path(f).name for f in files]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        at = [SparkFiles.get(n) for n in names]
        tokens = _counter(at[0], at[1] if len(at) > 1 else None)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.pop("text")]
            yield batch.assign(tokens=tokens(texts))

    schema = inner.drop("text").withColumn("tokens", F.lit(0).cast("long")).schema
    counted = inner.mapInPandas(count, schema)
    return counted.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), "tokens")


def chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def rates(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: source, target_share, max_repeats, documents, tokens, total_tokens, rate.

    counted: source, tokens. The total is that of all documents, those of unlisted and null sources too. A
    source without tokens has rate 0; a target without max_repeats is used once at most.
    """
    sums = counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    joined = targets.select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).join(sums, "source", "left").crossJoin(F.broadcast(total))
    wanted = F.col("target_share") * F.col("total_tokens") / F.col("tokens")
    rate = F.when(F.coalesce("tokens", F.lit(0)) > 0, F.least(wanted, F.col("max_repeats").cast("double"))).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "total_tokens", rate.alias("rate"))


def mix(counted: DataFrame, rated: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, tokens, copy (from 1): each document as often as its source's rate says.

    counted: doc_id, source, tokens. Documents of sources that are not listed, or of none, are not used. A
    document repeated in counted is used for each of its rows; documents without tokens follow their source.
    rated is counted when this is called, and broadcast if it is small.
    """
    whole = F.floor("rate")
    copies = (whole + (chance(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("int")
    picked = counted.join(small(rated.select("source", "rate")), "source").withColumn("__n", copies).where("__n > 0")
    return picked.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))


def reached(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """rated with what came out: used_documents, copies, used_tokens, actual_share (of the total), mix_share (of the mixture)."""
    sums = mixed.groupBy("source").agg(F.count_distinct("doc_id").alias("used_documents"), F.count("*").alias("copies"), F.sum("tokens").alias("used_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = rated.join(sums, "source", "left").select(*rated.columns, zero("used_documents"), zero("copies"), zero("used_tokens"))
    everything = out.agg(F.sum("used_tokens").alias("__all"))
    share = lambda c: F.when(F.col(c) > 0, F.col("used_tokens") / F.col(c)).otherwise(0.0)
    return out.crossJoin(F.broadcast(everything)).withColumn("actual_share", share("total_tokens")).withColumn("mix_share", share("__all")).drop("__all")
