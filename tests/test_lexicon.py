import pytest
from pyspark.sql import functions as F

from tests.helpers import GEN, NOM, facts, refs, rows
from tokenweave.functions import keys
from tokenweave.operators import lexicon as lx
from tokenweave.operators import views

# Words, keys and figures in these tests are those of the definition's own examples.
F6 = [("λόγος", "λόγος", NOM, 0), ("λόγος", "λόγου", GEN, 0), ("Γρηγόριος", "Γρηγόριος", NOM, 0), ("δαίμων", "δαίμων", NOM, 0), ("καί", "καί", "-", 1), ("λόγος", "λόγος", NOM, 1)]
LIST = [(1, "καί", 500), (2, "λόγος", 300), (3, "ἵππος", 100)]


def lens(spark, fact_rows, entries, aliases=(), reference=1000, chapters=2):
    f = facts(spark, fact_rows)
    e = lx.keyed(spark.createDataFrame([(r, x, None, "L", n) for r, x, n in entries], "rank int, lemma string, gloss string, kind string, ref_count long"), reference)
    a = spark.createDataFrame(list(aliases), "variant string, lemma string")
    m = lx.lookup(f.select("lemma").distinct(), e, a)
    placed = lx.place(f, m)
    ch = refs(spark, chapters)
    return f, e, m, placed, ch, lx.entry_rows(placed, m, e, ch.select("run_id").distinct())


@pytest.mark.parametrize("a, b, same", [("σῠ́", "σύ", True), ("ὅς2", "ὅς", True), ("Ὁ", "ὁ", True), ("τίς", "τις", False), ("βιός", "βίος", False)])
def test_match_key(a, b, same):
    assert (keys.match_key_of(a) == keys.match_key_of(b)) == same


@pytest.mark.parametrize("a, b, same", [("πράττω", "πράσσω", True), ("θάλαττα", "θάλασσα", True), ("γίγνομαι", "γίνομαι", True), ("τίς", "τις", False), ("οὔ", "οὖς", False)])
def test_fold_key(a, b, same):
    assert (keys.fold_key_of(a) == keys.fold_key_of(b)) == same


def test_a_capital_without_composed_form_matches_by_its_folded_key():
    assert keys.match_key_of("Υ\u0313φος") != keys.match_key_of("\u1f50φος")
    assert keys.fold_key_of("Υ\u0313φος") == keys.fold_key_of("\u1f50φος")


def test_keys_as_columns(spark):
    df = spark.createDataFrame([("Ὅς2",), (None,), ("",), ("Γρηγόριος",), ("λόγος",)], "l string")
    got = df.select("l", keys.match_key(F.col("l")).alias("m"), keys.is_proper(F.col("l")).alias("p"), keys.search_fold(F.col("l")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("Ὅς2", "ὅς", True, "ος2"), (None, None, None, None), ("", "", False, ""), ("Γρηγόριος", "γρηγόριος", True, "γρηγοριος"), ("λόγος", "λόγος", False, "λογος")]


def test_report(spark):
    f, e, m, placed, ch, entries = lens(spark, F6, LIST)
    s = lx.summary(placed, entries, ch).first()
    assert (s.entries, s.covered, s.tokens_proper, s.tokens_off_list, s.tokens_on_list, s.tokens) == (3, 2, 1, 1, 4, 6)
    assert s.covered_share == pytest.approx(2 / 3) and s.ref_share_covered == pytest.approx(0.8) and s.ref_share_total == pytest.approx(0.9)
    by = {r.lemma: r for r in entries.collect()}
    assert [(c.chapter_index, c.occ) for c in by["λόγος"].chapters] == [(0, 2), (1, 1)] and by["λόγος"].occ == 3
    assert (by["ἵππος"].occ, by["ἵππος"].first_chapter, by["ἵππος"].matched_by) == (0, None, "")
    assert rows(lx.gaps(entries), "lemma", "total") == [("ἵππος", 1)]
    p = lx.progress(placed, entries, ch)
    assert rows(p, "chapter_index", "cumulative_entries", "new_on_list_types", "new_off_list_types", "new_on_list_tokens") == [(0, 1, 1, 2, 2), (1, 2, 1, 0, 1)]
    assert p.where("tokens <> tokens_on_list + tokens_off_list + tokens_proper").count() == 0
    assert p.agg(F.sum("new_entries")).first()[0] == s.covered == lx.bands(entries).agg(F.sum("covered")).first()[0]
    assert rows(lx.off_list(f, placed), "place", "lemma", "proper", "total") == [(1, "Γρηγόριος", True, 2), (2, "δαίμων", False, 2)]
    a = lx.match_audit(placed, m).first()
    assert (a.text_lemmas, a.matched_lemmas, a.exact, a.unmatched_lemmas, a.proper_lemmas) == (4, 2, 2, 1, 1)
    scoped = views.scope_entries(entries, 0)
    assert rows(scoped, "lemma", "scope_occ", "scope_here", "scope_first", "scope_chapters") == [("καί", 0, 0, None, 0), ("λόγος", 2, 2, 0, 1), ("ἵππος", 0, 0, None, 0)]
    assert views.scope_summary(scoped, p, 0).first().covered == 1
    assert rows(views.growth(p, "types"), "chapter_index", "on_new", "on_repeated", "total") == [(0, 1, 0, 3), (1, 1, 1, 4)]
    assert rows(views.growth(p, "tokens"), "chapter_index", "on_new", "on_repeated", "total") == [(0, 2, 0, 4), (1, 3, 1, 6)]


def test_layers_aliases_and_sources(spark):
    _, _, m, _, _, entries = lens(spark, [("θέλω", "θέλω", NOM, 0), ("πράττω", "πράττω", NOM, 0), ("οὕτως", "a", NOM, 0), ("οὕτως", "a", NOM, 0), ("οὕτω", "b", NOM, 1), ("ὅς", "ὅς", NOM, 0)], [(1, "ἐθέλω", 9), (2, "πράσσω", 8), (3, "οὕτως", 7), (4, "ὅς", 6), (5, "ὅς2", 5)], [("θέλω", "ἐθέλω"), ("οὕτω", "οὕτως"), ("οὕτω", "οὕτως"), ("x", "absent")])
    by = {r.rank: r for r in entries.collect()}
    assert (by[1].source_lemma, by[1].matched_by) == ("θέλω", "alias") and (by[2].source_lemma, by[2].matched_by) == ("πράττω", "folded")
    assert (by[3].occ, by[3].source_lemma, by[3].matched_by) == (3, "οὕτως", "exact")
    assert by[4].ambiguous and by[5].ambiguous and not by[3].ambiguous
    labels = {r.rank: r.match_label for r in views.match_label(views.scope_entries(entries, None)).collect()}
    assert labels == {1: "alias", 2: "folded", 3: "", 4: "ambiguous", 5: "ambiguous"}


def test_sparse_bands_and_limits(spark):
    _, _, _, _, _, entries = lens(spark, F6, [(1, "καί", 5), (2, "λόγος", 5), (600, "x", 1), (1200, "y", 1)])
    assert rows(lx.bands(entries), "start", "end", "entries") == [(1, 500, 2), (1001, 1200, 1), (501, 1000, 1)]
    _, _, _, _, _, many = lens(spark, F6, [(i, f"w{i}x", 1) for i in range(1, 51)])
    assert rows(lx.gaps(many, 5), "rank", "total") == [(i, 50) for i in range(1, 6)]


def test_empty_list(spark):
    _, _, m, placed, ch, entries = lens(spark, F6, [], reference=0)
    assert m.count() == 0 and entries.count() == 0 and lx.bands(entries).count() == 0
    assert lx.progress(placed, entries, ch).agg(F.sum("new_entries"), F.sum("tokens")).first()[:] == (0, 6)


def test_frequency_list(spark):
    f = facts(spark, [("οὕτω(ς)", "a", NOM, 0, "adverb"), ("λόγος", "a", NOM, 0), ("λόγος", "a", NOM, 0), ("ὁ", "a", NOM, 0, "article"), ("ὁ", "a", NOM, 1, "article")])
    glosses = spark.createDataFrame([(2, "λόγος", "word"), (1, "λόγος", "speech")], "rank int, match_key string, gloss string")
    got = rows(lx.frequency_list(f, {"noun": "L", "article": "F"}, glosses), "rank", "lemma", "gloss", "kind", "ref_count", "ref_coverage")
    assert got == [(1, "λόγος", "speech", "L", 2, 40.0), (2, "ὁ", "", "F", 2, 80.0), (3, "οὕτως", "", "", 1, 100.0)]


def test_ranks_over_many_ranges(spark):
    import random

    rng = random.Random(2)
    counts = [(f"w{i:04}", rng.choice([1, 1, 1, 2, 5, 40]), "noun") for i in range(400)]
    df = spark.createDataFrame(counts, "lemma string, ref_count long, type string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r["rank"], r.lemma, r.running, r.everything) for r in lx._ranks(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order, so_far, expected = sorted(counts, key=lambda c: (-c[1], c[0])), 0, []
    for i, (w, n, _) in enumerate(order, 1):
        so_far += n
        expected.append((i, w, so_far, sum(c[1] for c in counts)))
    assert got == expected


def test_the_sql_of_the_keys_on_marks_of_quantity():
    import duckdb

    from tokenweave.plans import base

    words = ["ᾱ̓́ηρ", "τῑμή", "ῠ̔πό", "ἄνθρωπος2", "ō", "γῑ́γνομαι", "γίγνομαι", "θάλαττα", "ἄρρην", " ΛΟΓΟΣ ", "λόγος", "Ζεύς1 "]
    for sql, of in ((base.match_key, keys.match_key_of), (base.fold_key, keys.fold_key_of)):
        rows_ = duckdb.execute(f"SELECT w, {sql('w')} FROM (SELECT unnest(?) AS w)", [words]).fetchall()
        assert {w: k for w, k in rows_} == {w: of(w) for w in words}
