"""Test items that leak into training text.

All items, as words, go into one generalised suffix automaton. Training text streams through it: the state
and the length of the longest match ending at each word follow from those of the word before, whatever the
length of the text. A document holds a passage of an item if its match reaches `least` words in a state
that stands for that item.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import by_block, each_block, union

_WORD = re.compile(r"[^\W_]+")
#: Words of items in one automaton.
BLOCK_WORDS = 500_000


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text)]


class ItemAutomaton:
    """Suffix automaton over the words of several items; states that stand for passages know the items they occur in.

    Once built it is packed: of each state one move is kept in arrays, further moves, which few states have, in dicts.
    """

    def __init__(self, items: Iterable[tuple[int, str]], least: int):
        self.least = least
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        link, length = self.link, self.length = [-1], [0]
        self.items: list[int] = []
        coded: list[list[int]] = []
        for item, text in items:
            self.items.append(item)
            coded.append([self.ids.setdefault(word, len(self.ids)) for word in words_of(text)])
            last = 0
            for word in coded[-1]:
                last = self._extend(last, word)
        # of the states whose strings end alike, the shortest that is still long enough has the most items
        top = [-1] * len(length)
        for state in sorted(range(1, len(length)), key=length.__getitem__):
            if length[state] >= least:
                up = top[link[state]]
                top[state] = state if up < 0 else up
        # every place of an item leads to the one of those states that stands for its last `least` words
        found: dict[int, set[int]] = {}
        for no, words in enumerate(coded):
            state = 0
            for word in words:
                state = self.next[state][word]
                if top[state] >= 0:
                    found.setdefault(top[state], set()).add(no)
        self.found = {state: tuple(sorted(nos)) for state, nos in found.items()}
        self.word, self.to = array("i", [-1]) * len(length), array("i", [-1]) * len(length)
        self.more: dict[int, dict[int, int]] = {}
        for state, moves in enumerate(self.next):
            for word, to in moves.items():
                if self.word[state] < 0:
                    self.word[state], self.to[state] = word, to
                else:
                    self.more.setdefault(state, {})[word] = to
        self.link, self.length, self.top = array("i", link), array("i", length), array("i", top)
        del self.next

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def matches(self, text: str) -> tuple[list[int], list[tuple[int, int]], int]:
        """The items that share `least` words in a row with text, the matching spans of words, and the number of words."""
        ids, only, to, more, link, length, least = self.ids, self.word, self.to, self.more, self.link, self.length, self.least
        none: dict[int, int] = {}
        state = run = 0
        hits: set[int] = set()
        spans: list[tuple[int, int]] = []
        words = words_of(text)
        for i, w in enumerate(words):
            word = ids.get(w)
            if word is None:
                state = run = 0
                continue
            while True:
                if only[state] == word:
                    state = to[state]
                    run += 1
                    break
                if (there := more.get(state, none).get(word)) is not None:
                    state = there
                    run += 1
                    break
                if not state:
                    break
                state = link[state]
                run = length[state]
            if run >= least:
                hits.update(self.found[self.top[state]])
                first = i + 1 - run
                if spans and first <= spans[-1][1]:
                    spans[-1] = (min(first, spans[-1][0]), i + 1)
                else:
                    spans.append((first, i + 1))
        return [self.items[no] for no in sorted(hits)], spans, len(words)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((int(a), int(b)) for a, b in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, begin = [], 0
    for first, end in spans:
        out.append(text[begin : at[first][0]])
        begin = at[end - 1][1]
    return "".join([*out, text[begin:]])


def blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of block_words words or one item more; at least one block."""
    block, size, any_yet = [], 0, False
    for item, body in items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).dropna().toLocalIterator():
        block.append((item, body))
        size += len(words_of(body))
        if size >= block_words:
            yield block
            block, size, any_yet = [], 0, True
    if block or not any_yet:
        yield block


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least: int = 12, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item that share at least `least` consecutive words: doc_id, item_id.

    Rows with a null id or text are left out; texts with fewer than `least` words have no match. Documents
    are taken as they come: a repeated row gives repeated results, items with the same text are all reported.
    Extra columns are not read. Items reach the driver one by one and are put into automata of block_words
    words at most (one item more); each is broadcast by itself and the documents are scanned once for each,
    so that the driver, a worker and a broadcast hold one automaton, however many items there are.
    """
    spark = documents.sparkSession
    at = lambda c: F.col(f"`{c}`")
    docs = documents.select(at(doc_id).alias("doc"), at(text).alias("text")).dropna()
    out = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])

    def scan(shared: Broadcast) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = shared.value
            for batch in batches:
                rows = [(doc, item) for doc, body in zip(batch["doc"], batch["text"]) for item in automaton.matches(body)[0]]
                if rows:
                    yield pd.DataFrame(rows, columns=out.names)

        return docs.mapInPandas(find, out)

    automata = (ItemAutomaton(block, least) for block in blocks(items, item_id, item_text, block_words))
    return union(by_block(spark, automata, scan, "leaks"))


def cleaned(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least: int = 12, most_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document without the passages it shares with an item: doc_id, text, removed_words, dropped.

    A document of whose words more than most_coverage lie in passages is dropped: its text is null and `dropped`
    true. Null texts stay null and are not dropped. Passages of all blocks of items are found in the untouched
    text and merged before they are cut and coverage is judged, so the number of blocks makes no difference.
    With several blocks each scan is written to the shared folder, and the next one reads it.
    """
    spark = documents.sparkSession
    at = lambda c: F.col(f"`{c}`")
    rows = documents.select(at(doc_id).alias("doc"), at(text).alias("text"), F.array().cast("array<int>").alias("spans"))

    def scan(shared: Broadcast) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = shared.value
            for batch in batches:
                spans = [[*had, *chain(*automaton.matches(body)[1])] if body is not None else had for body, had in zip(batch["text"], batch["spans"])]
                yield batch.assign(spans=pd.Series(spans, index=batch.index, dtype=object))

        return rows.mapInPandas(find, rows.schema)

    def one_more(shared: Broadcast) -> DataFrame:
        nonlocal rows
        rows = scan(shared)
        return rows

    automata = (ItemAutomaton(block, least) for block in blocks(items, item_id, item_text, block_words))
    for rows in each_block(spark, automata, one_more, "spans"):
        pass

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, removed, dropped = [], [], []
            for body, flat in zip(batch["text"], batch["spans"]):
                spans = merged(zip(flat[::2], flat[1::2]))
                words = sum(b - a for a, b in spans)
                over = bool(spans) and words > most_coverage * len(words_of(body))
                texts.append(None if over else without(body, spans) if spans else body)
                removed.append(words)
                dropped.append(over)
            yield pd.DataFrame({"doc": batch["doc"], "text": pd.Series(texts, index=batch.index, dtype=object), "removed": removed, "dropped": dropped})

    kept = T.StructType([rows.schema["doc"], rows.schema["text"], T.StructField("removed", T.LongType()), T.StructField("dropped", T.BooleanType())])
    rows = rows.mapInPandas(cut, kept)
    return rows.select(F.col("doc").alias(doc_id), F.col("text"), F.col("removed").alias("removed_words"), "dropped")
