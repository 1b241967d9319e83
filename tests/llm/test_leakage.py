import random

import pytest

from tokenweave.llm.leakage import ItemAutomaton, cleaned, leaks, without, words_of


def grams(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("seed, n", [(s, n) for s in range(8) for n in (1, 2, 3, 5)])
def test_automaton_against_brute_force(seed, n):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice("abc") for _ in range(rng.randrange(k)))
    items = [(i, text(14)) for i in range(12)]
    automaton = ItemAutomaton(items, n)
    for _ in range(40):
        doc = text(30) + (" " + rng.choice(items)[1] if rng.random() < 0.5 else "")
        hits, spans, count = automaton.matches(doc)
        assert hits == [i for i, t in items if grams(t, n) & grams(doc, n)]
        w = words_of(doc)
        covered = {i for g in grams(doc, n) if any(g in grams(t, n) for _, t in items) for j in range(len(w)) if tuple(w[j : j + n]) == g for i in range(j, j + n)}
        assert covered == {i for a, b in spans for i in range(a, b)} and count == len(w)


def test_words():
    assert words_of("It's a_B, Ünïcode-42!") == ["it", "s", "a", "b", "ünïcode", "42"]
    assert without("a b, c! d", [(1, 3)]) == "a ! d"


def test_operators(spark):
    passage = "the quick brown fox jumps over the lazy dog while thirteen cats watch quietly"
    items = spark.createDataFrame([(1, passage, "doc"), (2, passage.upper(), "x"), (3, None, "x"), (4, "too short", "x"), (None, passage, "x")], "item_id long, text string, doc string")
    docs = spark.createDataFrame([(10, "Before it: The QUICK, brown fox jumps over the lazy dog while thirteen cats -- end of it all with many more words to come here", 0), (11, "the quick brown fox", 0), (12, None, 0), (13, "", 0), (14, passage, 0), (14, passage, 0), (15, "word " * 100_000, 0)], "doc_id long, text string, item int")
    for block in (500_000, 10):
        got = sorted(map(tuple, leaks(docs, items, "doc_id", "text", "item_id", "text", 12, block).collect()))
        assert got == [(10, 1), (10, 2), (14, 1), (14, 1), (14, 2), (14, 2)]
    clean = {r.doc_id: (r.text, r.removed_words, r.dropped) for r in cleaned(docs, items, "doc_id", "text", "item_id", "text", 12).collect()}
    assert clean[10] == ("Before it:  -- end of it all with many more words to come here", 12, False)
    assert clean[14][0] is None and clean[14][2] and clean[12] == (None, 0, False) and clean[11] == ("the quick brown fox", 0, False) and clean[13] == ("", 0, False)
    assert leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0


def test_the_number_of_blocks_changes_no_cleaned_text(spark):
    w = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    two = f"{w('a', 40)} {w('x', 10)} {w('b', 40)} {w('y', 10)}"
    overlap = f"{w('z', 60)} {w('c', 15)} {w('d', 8)} {w('q', 60)}"
    joined = f"{w('z', 60)} {w('e', 8)} {w('a', 14)} {' '.join(f'e{i}' for i in range(8, 16))} {w('q', 60)}"
    docs = spark.createDataFrame([(1, two), (2, overlap), (3, joined), (4, None), (5, "")], "doc_id long, text string")
    # the second passage overlaps the first by ten words; the fourth item stands apart in the document until a cut
    items = [(1, w("a", 40)), (2, w("b", 40)), (3, w("c", 15)), (4, " ".join([*w("c", 15).split()[5:], w("d", 8)])), (5, w("e", 16))]
    items = spark.createDataFrame(items, "item_id long, text string")
    run = lambda n: sorted(map(tuple, cleaned(docs, items, "doc_id", "text", "item_id", "text", block_words=n).collect()))
    got = run(500_000)
    assert run(1) == got == run(50)
    assert got[0] == (1, None, 80, True) and got[1][2:] == (23, False) and got[2][2:] == (14, False) and "e7  e8" in got[2][1]
    assert got[3:] == [(4, None, 0, False), (5, "", 0, False)]


@pytest.mark.parametrize("seed", range(3))
def test_nested_and_overlapping_items_in_blocks_of_any_size(spark, seed):
    rng = random.Random(seed)
    text = lambda a, b: " ".join(rng.choice("abcd") for _ in range(rng.randrange(a, b)))
    bodies = [text(3, 20) for _ in range(12)]
    bodies += [" ".join(b.split()[2:-1]) for b in bodies[:6]] + [f"{a} {b}" for a, b in zip(bodies, bodies[3:])]
    items = spark.createDataFrame(list(enumerate(bodies)), "item_id long, text string")
    docs = [text(0, 60) + (" " + rng.choice(bodies) if rng.random() < 0.6 else "") + " " + text(0, 9) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for op in (leaks, cleaned):
        first, *rest = [sorted(map(tuple, op(docs, items, "doc_id", "text", "item_id", "text", least=4, block_words=n).collect()), key=str) for n in (500_000, 60, 1)]
        assert first and all(r == first for r in rest)
