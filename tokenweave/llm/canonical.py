"""Values entered freely, mapped to the entries of a reference list.

Reference entries, and alias variants as further paths to them, are the words of a trie. A value is looked
up by running a Levenshtein automaton (with swaps of neighbours) along the trie: the states are bit masks,
one bit for each position of the value and one mask for each number of slips, and a branch ends where no
state is left. All entries within a distance that depends on the length of the value are returned.

A list of any size is taken in blocks: a worker holds the tries of one block, every value is looked up in each, and
what the blocks found is compared by the same order as within a block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import tags
from .blocks import by_block, union
from .lookalike import look


class Trie:
    """Words, each with the numbers of the entries it leads to."""

    def __init__(self, words: Iterable[tuple[str, int]] = ()):
        self.root: dict = {}
        for word, entry in words:
            self.add(word, entry)

    def add(self, word: str, entry: int) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        found = node.setdefault("", [])
        if entry not in found:
            found.append(entry)

    def within(self, word: str, slips: int, floors: dict[int, int] | None = None) -> dict[int, int]:
        """Entry -> distance, for every entry at most `slips` insertions, losses, changes or swaps away.

        floors: number of slips -> letters of word that have to be behind when so many are made.
        """
        n = len(word)
        done = 1 << n
        at: dict[str, int] = {}
        for i, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << i
        swaps: dict[tuple[str, str], int] = {}
        for i in range(n - 1):
            if word[i] != word[i + 1]:
                pair = word[i + 1], word[i]
                swaps[pair] = swaps.get(pair, 0) | 1 << i
        start, mask = [1], 1
        for _ in range(slips):
            mask |= mask << 1
            start.append(mask)
        out: dict[int, int] = {}
        full = (done << 1) - 1
        allow = [full & -1 << (floors or {}).get(e, 0) for e in range(slips + 1)]
        todo = [(self.root, [m & a for m, a in zip(start, allow)], "", None)]
        while todo:
            node, states, last, before = todo.pop()
            for ch, child in node.items():
                if ch == "":
                    for e, mask in enumerate(states):
                        if mask & done:
                            for entry in child:
                                if out.get(entry, slips + 1) > e:
                                    out[entry] = e
                            break
                    continue
                eq = at.get(ch, 0)
                new = [(states[0] & eq) << 1]
                alive = new[0]
                for e in range(1, slips + 1):
                    less = states[e - 1]
                    m = (states[e] & eq) << 1 | less | less << 1 | new[e - 1] << 1
                    if before is not None and (swap := swaps.get((last, ch))):
                        m |= (before[e - 1] & swap) << 2
                    m &= allow[e]
                    new.append(m)
                    alive |= m
                if alive:
                    todo.append((child, new, ch, states))
        return out


@lru_cache(maxsize=8192)
def letters(value: str) -> str:
    """The letters of the value as it looks, lower case, without accents and other signs; one kind of sigma."""
    plain = unicodedata.normalize("NFD", look(value).lower())
    return "".join(ch for ch in plain if unicodedata.category(ch)[0] == "L").replace("ς", "σ")


def _apart(a: str, b: str) -> int:
    """Insertions, losses, changes and swaps of neighbours between two short texts."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


class WordList:
    """A reference list of words, or a block of one: entries in order of rank, and aliases (variant, entry)."""

    def __init__(self, entries: list[str], aliases: list[tuple[str, str]], slips: tuple[tuple[int, int], ...] = ((1, 1),), ranks: dict[str, int] | None = None):
        """slips: (shortest length in letters, most slips) in rising order, for candidates and closest alike.

        ranks: entry -> rank, for a block; it may name entries that only their aliases are in the block of. Else aliases
        of what is no entry are left out.
        """
        self.slips = slips
        own = {e: i for i, e in reversed([*enumerate(entries)])}
        number = {e: i for i, e in enumerate([*own, *(e for e in ranks or {} if e not in own)])} if ranks else own
        self.entries = [*number] if ranks else entries
        self.ranks = [ranks[e] for e in number] if ranks else range(len(entries))
        self.exact: dict[str, int] = {}
        for e in own:
            self.exact[look(e)] = min(number[e], self.exact.get(look(e), number[e]), key=lambda i: self.ranks[i])
        self.alias: dict[str, int] = {}
        for variant, entry in sorted(set(aliases)):
            if entry in number:
                v, i = look(variant), number[entry]
                self.alias[v] = min(i, self.alias.get(v, i), key=lambda i: self.ranks[i])
        self.trie = Trie((letters(e), number[e]) for e in own)
        self.paths = Trie((v, i) for v, i in self.alias.items())
        self.ways = [(letters(e), number[e]) for e in own]
        self.ways += [(v, number[e]) for v, e in ((letters(v), e) for v, e in aliases if e in number) if v]

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str, str | None]], slips: tuple[tuple[int, int], ...] = ((1, 1),)) -> WordList:
        """A block of rows (rank, entry, None for the entry itself or an alias variant of it)."""
        rows = list(rows)
        ranks: dict[str, int] = {}
        for rank, entry, _ in rows:
            ranks[entry] = min(rank, ranks.get(entry, rank))
        return cls([*dict.fromkeys(e for _, e, v in rows if v is None)], [(v, e) for _, e, v in rows if v is not None], slips, ranks)

    @cached_property
    def _both(self) -> tuple[Trie, Trie]:
        """Entries and alias variants in letters, read forwards and backwards."""
        return Trie(self.ways), Trie((w[::-1], i) for w, i in self.ways)

    def _by_ways(self, word: str, slips: int) -> dict[int, int]:
        """Entry -> distance, by the entry itself or a variant, whichever is nearer.

        Either the last of `slips` slips is made in the second half of word, or that half has none. So the search
        forwards leaves out the last slip at first, and the search backwards begins without any: the same result
        as one search with all slips from the start, without its many branches near the root.
        """
        half = len(word) // 2
        found = self._both[0].within(word, slips, {slips: half} if slips else None)
        if slips and half:
            floor = len(word) - half + 1
            for i, d in self._both[1].within(word[::-1], slips, dict.fromkeys(range(1, slips + 1), floor)).items():
                found[i] = min(d, found.get(i, d))
        return found

    def most(self, word: str) -> int:
        return max([0, *(k for n, k in self.slips if len(word) >= n)])

    def near(self, value: str) -> dict[int, int]:
        """Entry -> distance, for every entry within the distance for the value's length, aliases aside."""
        word = letters(value)
        return self.trie.within(word, self.most(word)) if word else {}

    def candidates(self, value: str) -> list[tuple[int, int]]:
        """(entry, distance) of every entry that itself or by an alias variant is within the distance for the value's length.

        An entry reached in several ways has the least of their distances. An entry or a variant of the same look is at 0.
        """
        seen, word = look(value), letters(value)
        found = self._by_ways(word, self.most(word)) if word else {}
        for i in (self.exact.get(seen), self.alias.get(seen)):
            if i is not None:
                found[i] = 0
        return sorted(found.items())

    def best(self, value: str) -> list[tuple[tuple[int, ...], str]]:
        """The entry that value stands for, if any, with (way, distance in letters, distance with signs, rank).

        Same look before alias path before distance in letters. Among entries as close in letters the one
        counts that is closest with case, accents and signs, then the one of better rank.
        """
        seen = look(value)
        i = self.exact.get(seen)
        if i is not None:
            return [((0, 0, 0, self.ranks[i]), self.entries[i])]
        if hit := self.paths.within(seen, 0):
            i = min(hit, key=lambda i: self.ranks[i])
            return [((1, 0, 0, self.ranks[i]), self.entries[i])]
        near = self.near(value)
        if not near:
            return []
        least = min(near.values())
        apart = lambda i: _apart(unicodedata.normalize("NFD", seen), unicodedata.normalize("NFD", self.entries[i]))
        return [min(((2, least, apart(i), self.ranks[i]), self.entries[i]) for i, d in near.items() if d == least)]

    def closest(self, value: str) -> str:
        """The entry that value stands for, or the empty string."""
        return next((entry for _, entry in self.best(value)), "")


# Spellings beside those of the closed vocabulary, and the spelling each stands for.
MORE_SPELLINGS = {"pf": "perf", "plupf": "plup", "plpf": "plup", "impv": "imp", "ptcp": "part", "s": "sg", "p": "pl", "first": "1", "second": "2", "third": "3", "mediopassive": "mp"}
_WORD = re.compile(r"[^\W_]+")
#: Spellings shorter than this have to be right: a slip would make most of them something else.
SLIP_FROM = 3


def _words(label: str) -> list[str]:
    return _WORD.findall(look(label).lower())


class FeatureList:
    """A reference list of labels, each read as a set of features."""

    def __init__(self, labels: list[str]):
        """Features are those of the closed vocabulary; any other word of a label is a feature of its own."""
        spelt: dict[str, frozenset] = {s: frozenset(features) for s, features in tags().items()}
        spelt |= {s: spelt[of] for s, of in MORE_SPELLINGS.items()}
        self.spelt: dict[str, frozenset] = {}
        self._spell(spelt)
        unknown = {w for label in labels for w in _words(label) if not any(slips == 0 for _, slips in self._joined(w))}
        self._spell(spelt | {w: frozenset({f"word={w}"}) for w in unknown})
        self.label: dict[frozenset, str] = {}
        for label in labels:
            for features, slips in self.readings(label):
                if not slips:
                    self.label.setdefault(features, label)

    def _spell(self, spelt: dict[str, frozenset]) -> None:
        self.spelt, self.names = spelt, list(spelt)
        self.trie = Trie((s, i) for i, s in enumerate(self.names))
        self.widest = 1 + max(map(len, self.names))
        longest: dict[frozenset, int] = {}
        for s, features in spelt.items():
            longest[features] = max(len(s), longest.get(features, 0))
        self.longest = 1 + sum(longest.values())
        self._word.cache_clear()

    @lru_cache(maxsize=65536)  # noqa: B019
    def _word(self, word: str) -> tuple[tuple[frozenset, int], ...]:
        """What a word may name, with its slips: as it is written, else at one slip."""
        if word in self.spelt:
            return ((self.spelt[word], 0),)
        if len(word) < SLIP_FROM:
            return ()
        found: dict[frozenset, int] = {}
        for i, d in self.trie.within(word, 1).items():
            if len(self.names[i]) >= SLIP_FROM or len(word) > SLIP_FROM:
                found.setdefault(self.spelt[self.names[i]], d)
        return tuple(found.items())

    def _joined(self, word: str) -> tuple[tuple[frozenset, int], ...]:
        """What several spellings run together may name, with one slip at most in all."""
        if len(word) > self.longest:  # no feature can be named twice, so nothing longer has a reading
            return ()
        reach: list[dict[frozenset, int]] = [{} for _ in range(len(word) + 1)]
        reach[0][frozenset()] = 0
        for i in range(len(word)):
            for got, slips in reach[i].items():
                for j in range(i + 1, min(len(word), i + self.widest) + 1):
                    for features, more in self._word(word[i:j]):
                        if slips + more <= 1 and not features & got:
                            key = got | features
                            reach[j][key] = min(reach[j].get(key, 99), slips + more)
        return tuple(reach[-1].items())

    def readings(self, value: str) -> Iterator[tuple[frozenset, int]]:
        """Every set of features that the value can be read as, with the slips that takes."""
        words = _words(value)
        partial: dict[frozenset, int] = {frozenset(): 0} if words else {}
        for word in words:
            longer: dict[frozenset, int] = {}
            some = self._word(word) or self._joined(word)
            for got, slips in partial.items():
                for features, more in some:
                    if not features & got:  # a feature named twice is one too many
                        key = got | features
                        longer[key] = min(longer.get(key, 99), slips + more)
            partial = longer
        yield from partial.items()

    def best(self, value: str) -> list[tuple[tuple[int, ...], str]]:
        """The labels naming the same features with the fewest slips, each with (slips,)."""
        found: dict[str, int] = {}
        for features, slips in self.readings(value):
            if label := self.label.get(features):
                found[label] = min(found.get(label, 99), slips)
        least = min(found.values(), default=0)
        return [((least,), label) for label, s in found.items() if s == least]

    def closest(self, value: str) -> str:
        """The label naming the same features, with the fewest slips; empty if there is none or two as good."""
        top = self.best(value)
        return top[0][1] if len(top) == 1 else ""


def blocks(rows: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The rows, in their order, in lists of `size`; at least one list."""
    block: list[tuple] = []
    any_yet = False
    for row in rows.toLocalIterator():
        block.append(tuple(row))
        if len(block) >= size:
            yield block
            block, any_yet = [], True
    if block or not any_yet:
        yield block


def map_values(values: DataFrame, finders: Iterator[dict]) -> DataFrame:
    """values (field, entered) with `canonical`, the entry that the finder of the field gives, '' for none.

    finders: for each block of the lists, field -> finder with best(value); a field that a block lacks has no entries
    there. Of the entries that several blocks find the one with the least order counts; two as good give ''. Null values
    and values of fields without a finder give an empty canonical. Every row is looked at once a block and comes out once;
    make rows distinct before. values should be cheap to read again.
    """
    narrow = values.select(F.col("field").cast("string"), F.col("entered").cast("string"))

    def scan(shared: Broadcast) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = shared.value
            for batch in batches:
                rows = [(f, v, order, entry) for f, v in zip(batch["field"], batch["entered"]) if v is not None and f in of for order, entry in of[f].best(v)]
                yield pd.DataFrame(rows, columns=["field", "entered", "order", "canonical"])

        return narrow.mapInPandas(find, "field string, entered string, order array<int>, canonical string")

    def settled(shared: Broadcast) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = shared.value
            for batch in batches:
                batch["canonical"] = [of[f].closest(v) if v is not None and f in of else "" for f, v in zip(batch["field"], batch["entered"])]
                yield batch

        return narrow.mapInPandas(find, "field string, entered string, canonical string")

    spark = values.sparkSession
    first = next(finders, {})
    second = next(finders, None)
    if second is None:
        return settled(spark.sparkContext.broadcast(first))
    found = union(by_block(spark, chain([first, second], finders), scan, "mapped"))
    least = found.groupBy("field", "entered").agg(F.min("order").alias("order"))
    top = found.distinct().join(least, ["field", "entered", "order"]).groupBy("field", "entered").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical"))
    best = top.select("field", "entered", F.when(F.col("n") == 1, F.col("canonical")).alias("canonical"))
    return narrow.join(best, ["field", "entered"], "left").fillna("", ["canonical"]).select("field", "entered", "canonical")


def list_candidates(values: DataFrame, lists: Iterator[WordList]) -> DataFrame:
    """entered, entry, distance: all entries within the distance that the length of a value allows, alias variants counted in.

    lists: the blocks of the list. An entry whose aliases lie in several blocks has the least of its distances.
    """
    narrow = values.select(F.col("entered").cast("string"))

    def scan(shared: Broadcast) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = shared.value
            for batch in batches:
                rows = [(v, of.entries[e], d) for v in batch["entered"] if v is not None for e, d in of.candidates(v)]
                if rows:
                    yield pd.DataFrame(rows, columns=["entered", "entry", "distance"])

        return narrow.mapInPandas(find, "entered string, entry string, distance int")

    parts = by_block(values.sparkSession, lists, scan, "candidates")
    return parts[0] if len(parts) == 1 else union(parts).groupBy("entered", "entry").agg(F.min("distance").alias("distance"))
