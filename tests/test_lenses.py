from pyspark.sql import functions as F

from tests.helpers import GEN, NOM, VOC, facts, refs, rows
from tokenweave.functions import morphology as mo
from tokenweave.operators import chapters, export, grammar, lemma, text, tracks, views

# Rows (lemma, form, label, chapter) of the definition's own examples, and below what must come out of them.
F1 = [("λόγος", "λόγος", NOM, 0)] * 2 + [("θεός", "θεός", NOM, 0), ("θεός", "θεοῦ", GEN, 1)] + [("λόγος", "λόγου", GEN, 2)] * 3
F2 = [("ὁ", "ὁ", NOM, 0), ("λόγος", "λόγος", NOM, 0), ("ὁ", "τοῦ", GEN, 0), ("λόγος", "λόγου", GEN, 0), ("ὁ", "ὁ", NOM, 0), ("ὁ", "Ὁ", NOM, 0)]
F3 = [("ὁ", "ὁ", NOM, 0), ("λόγος", "λόγος", NOM, 0), ("λόγος", "λόγου", GEN, 0)] + [("λόγος", "λόγος", NOM, 1)] * 2 + [("λόγος", "λόγου", GEN, 1)]
F4 = [
    ("λέγω", "λέγει", "pres. act. ind. 3sg", 0), ("γράφω", "γράφει", "pres. ind. 3sg", 0), ("ἔχω", "ἔχει", "pres. act. ind. 3sg.", 0), ("λύω", "ἔλυσε", "aor. act. ind. 3sg", 0), ("ὁ", "τό", "def. art. nom./acc. sg. neut.", 0),
    ("λέγω", "λέγει", "pres. act. ind. 3sg", 2), ("λύω", "ἔλυσε", "aor. act. ind. 3sg", 2), ("λύω", "λυθήσεται", "fut. pass. ind. 3sg", 2),
]
F5 = [("ὁ", "ὁ", NOM, 0, "article"), ("λόγος", "λόγος", NOM, 0), ("λόγος", "λόγου", GEN, 0), ("ὁ", "ὁ", NOM, 1, "article"), ("ὁ", "ὁ", NOM, 2, "article"), ("λόγος", "λόγοι", NOM, 3), ("λόγος", "λόγοι", VOC, 3), ("λόγος", "λόγος", NOM, 3)]
F7 = [("ὁ", "Ὁ", NOM, 0), ("ὁ", "ὁ", NOM, 0), ("λόγος", "λόγος", NOM, 0), ("λόγος", "λόγου", GEN, 0), ("λόγος", "λόγος", NOM, 1), ("θεός", "θεοῦ", GEN, 1)]


def test_tracks(spark):
    f = facts(spark, F1)
    track = tracks.by_chapter(f, ["lemma"])
    assert rows(tracks.span(track, ["lemma"]), "lemma", "total", "first_chapter", "last_chapter", "chapters") == [("θεός", 2, 0, 1, [0, 1]), ("λόγος", 5, 0, 2, [0, 2])]
    assert rows(tracks.running(track, ["lemma"]).where("lemma = 'λόγος'"), "chapter_index", "cumulative", "previous_chapter", "next_chapter", "gap_before") == [(0, 2, None, 2, None), (2, 5, 0, None, 2)]
    dense = tracks.dense(track, ["lemma"], refs(spark, 4)).where("lemma = 'λόγος'")
    assert rows(dense, "chapter_index", "occ", "cumulative", "previous_chapter", "next_chapter") == [(0, 2, 2, None, 2), (1, 0, 2, 0, 2), (2, 3, 5, 0, None), (3, 0, 5, 2, None)]
    assert rows(tracks.totals(f, refs(spark, 4)), "tokens", "lemmas", "forms", "parses", "chapters") == [(7, 2, 4, 4, 4)]
    assert rows(tracks.chapter_stats(f), "chapter_index", "token_count", "unique_lemmas", "unique_forms") == [(0, 3, 2, 2), (1, 1, 1, 1), (2, 3, 1, 1)]


def test_chapter_rows(spark):
    got = chapters.rows(facts(spark, F2)).orderBy("row_no").collect()
    assert [(r.lemma, r.parse) for r in got] == [("ὁ", NOM), ("λόγος", NOM), ("ὁ", GEN), ("λόγος", GEN)]
    assert [(x.form, x.occ) for x in got[0].forms] == [("ὁ", 2), ("Ὁ", 1)] and (got[0].form, got[0].form_occ, got[0].lemma_occ, got[0].parse_occ) == ("ὁ", 2, 4, 3)
    tie = chapters.rows(facts(spark, [("ὁ", "Ὁ", NOM, 0), ("ὁ", "ὁ", NOM, 0)])).first()
    assert tie.form == "Ὁ"
    spans = chapters.rows(facts(spark, [("λόγος", "λόγος", NOM, 0), ("λόγος", "λόγου", NOM, 2)])).orderBy("chapter_index").collect()
    assert [(r.lemma_first_chapter, r.lemma_last_chapter, r.form_first_chapter, r.form_last_chapter, r.first_occ_lemma, r.last_occ_lemma) for r in spans] == [(0, 2, 0, 0, True, False), (0, 2, 2, 2, False, True)]
    both = chapters.rows(facts(spark, F3)).where(f"lemma = 'λόγος' and parse = '{NOM}'")
    assert rows(both, "chapter_index", "parse_occ", "parse_cum", "lemma_cum") == [(0, 1, 1, 2), (1, 2, 3, 5)]
    summary = rows(chapters.summaries(facts(spark, F3), refs(spark, 3)), "chapter_index", "token_count", "unique_lemmas")
    assert summary == [(0, 3, 2), (1, 3, 1), (2, 0, 0)]


def test_files_that_come_back(spark):
    names = ["a", "a", "b", "a", None, None]
    ch = spark.createDataFrame([("r", i, str(i), "t", n) for i, n in enumerate(names)], "run_id string, chapter_index int, id string, title string, filename string")
    assert rows(chapters.files(ch), "file_no", "filename", "first_chapter", "last_chapter") == [(0, "a", 0, 1), (1, "b", 2, 2), (2, "a", 3, 3), (3, None, 4, 5)]


def test_text_lens(spark):
    f = facts(spark, F3)
    assert rows(text.vocabulary(f, ["lemma"]), "lemma", "total", "form", "form_count", "first_chapter", "last_chapter", "chapter_count") == [("λόγος", 5, "λόγος", 2, 0, 1, 2), ("ὁ", 1, "ὁ", 1, 0, 0, 1)]
    assert rows(text.progress(f, refs(spark, 2), ["lemma"]), "chapter_index", "new_types", "repeated_types", "new_tokens", "repeated_tokens") == [(0, 2, 0, 3, 0), (1, 0, 1, 0, 3)]
    g = facts(spark, [("λόγος", "λόγος", NOM, 0, ""), ("λόγος", "λόγου", GEN, 1, "noun"), ("λόγος", "λόγου", GEN, 1, "x"), ("λόγος", "λόγου", GEN, 1, "x")])
    assert rows(text.progress(g, refs(spark, 3), ["lemma", "parse"]), "chapter_index", "new_types", "repeated_types") == [(0, 1, 0), (1, 1, 0), (2, 0, 0)]
    assert text.vocabulary(g, ["lemma"]).first().type == "noun"
    assert lemma.dominant_type(g, ["run_id", "lemma"]).first().type == "x"


def test_grammar(spark):
    d = mo.decode(facts(spark, F4))
    ch = refs(spark, 3)
    p = {(r.dimension, r.value, r.chapter_index): r for r in grammar.profile(d, ch).collect()}
    assert [(p["tense", "pres", c].occ, p["tense", "pres", c].cumulative) for c in range(3)] == [(3, 3), (0, 3), (1, 4)]
    assert (p["tense", "fut", 0].occ, p["tense", "fut", 2].occ, p["voice", "act", 0].occ, p["voice", "pass", 2].occ, p["case", "nom", 0].occ, p["case", "acc", 0].occ) == (0, 1, 3, 1, 1, 1)
    assert p["tense", "perf", 1].occ == 0 and p["tense", "perf", 1].first_chapter is None
    assert not any(k[0] == "degree" for k in p)
    assert p["tense", "pres", 0].stated == 4 and p["tense", "pres", 2].stated_cumulative == 7
    values = tracks.by_chapter(tracks.readings(tracks.stated(d)), ["dimension", "value"]).where("dimension = 'tense'")
    assert {r.value for r in values.collect()} == {"pres", "aor", "fut"}
    assert rows(tracks.by_chapter(tracks.stated(d), ["dimension", "value"]).where("dimension = 'case'"), "value", "occ") == [("acc|nom", 1)]
    c = grammar.coverage(d, ["run_id"]).first()
    assert (c.total, c.ok, c.needs_attention, c.understood_share, c.missing_voice) == (8, 8, 0, 1.0, 1)
    inv = grammar.inventory(d)
    assert inv.agg(F.sum("occ")).first()[0] == d.where("signature <> ''").count()
    counts = grammar.inventory_counts(d, ch)
    combo = views.chapter_combinations(inv, counts, ch)
    assert combo.where("is_new").count() == inv.count() and combo.count() == 3 * inv.count()
    mix = mo.decode(facts(spark, [("a", "a", x, 0) for x in ("pres. act. ind. 3sg", "abbreviation for πρῶτον", "-", "gen. sg. (incomplete)")]))
    m = grammar.coverage(mix, ["run_id"]).first()
    assert (m.total, m.ok, m.descriptive, m.not_applicable, m.partial, m.morphological) == (4, 1, 1, 1, 1, 3)
    bare = grammar.coverage(mo.decode(facts(spark, [("a", "a", "-", 0)])), ["run_id"]).first()
    assert (bare.understood_share, bare.voice_gap_share) == (1.0, 0.0)


def test_paradigm_order_ties_by_first_appearance(spark):
    d = mo.decode(facts(spark, [("a", "a", "nom./acc. pl.", 0), ("a", "a", "nom. pl.", 0), ("a", "a", "aor. act. ind. 3sg", 0), ("a", "a", "pres. act. ind. 3sg", 1)]))
    assert [r.signature for r in grammar.inventory(d).orderBy("order").collect()] == ["pres. act. ind. 3sg", "aor. act. ind. 3sg", "nom./acc. pl.", "nom. pl."]
    assert rows(grammar.inventory_tables(d), "form_class", "forms", "tokens") == [("all", 4, 4), ("nominal", 2, 2), ("verb", 2, 2)]


def test_lemma_lens(spark):
    f = facts(spark, F5)
    logos = f.where("lemma = 'λόγος'")
    s = lemma.summary(logos).first()
    assert (s.total, s.parse_count, s.form_count, s.longest_gap, s.chapter_count) == (5, 3, 3, 3, 2)
    assert lemma.summary(f.where("lemma = 'ὁ'")).first().longest_gap == 1
    assert rows(lemma.parses(logos), "place", "parse", "occ", "form_count") == [(1, NOM, 3, 2), (2, GEN, 1, 1), (3, VOC, 1, 1)]
    assert {r.form: (r.occ, r.parses) for r in lemma.forms(logos).collect()}["λόγοι"] == (2, [NOM, VOC])
    per = lemma.in_chapters(logos, refs(spark, 4)).orderBy("chapter_index").collect()
    assert [(r.occ, r.cumulative, r.gap_before) for r in per] == [(2, 2, None), (0, 2, None), (0, 2, None), (3, 5, 3)]
    assert [(p.parse, p.occ) for p in per[3].parses] == [(NOM, 2), (VOC, 1)]
    want = spark.createDataFrame([("r", "λόγος")], "run_id string, lemma string")
    lines = lemma.concordance(f, want).orderBy("line").collect()
    assert (lines[0].position, lines[0].before, lines[0].after) == (1, ["ὁ"], ["λόγου"]) and (lines[2].before, lines[2].after) == ([], ["λόγοι", "λόγος"])
    assert lemma.concordance(f, want, context=1).where("chapter_index = 3 and position = 2").first().before == ["λόγοι"]
    assert rows(lemma.concordance(f, want, limit=2), "line", "total") == [(1, 5), (2, 5)]
    assert rows(lemma.concordance(f, want, chapter_index=3), "total") == [(3,)] * 3
    assert lemma.concordance(f, want.where("lemma = 'x'")).count() == 0
    assert rows(lemma.totals(f, want, 9), "total") == [(0,)]
    grouped = views.group_concordance(lemma.concordance(f, want), "form")
    assert rows(grouped, "group_place", "group_key", "line") == [(1, "λόγος", 1), (1, "λόγος", 5), (2, "λόγοι", 3), (2, "λόγοι", 4), (3, "λόγου", 2)]


def test_export(spark):
    r, ch = chapters.rows(facts(spark, F7)), refs(spark, 2)
    sheet = export.row_sheet(r, ch).orderBy("chapter_index", "row_no").collect()
    assert [(x.chapter_index, x.lemma, x.parse) for x in sheet] == [(0, "ὁ", NOM), (0, "λόγος", NOM), (0, "λόγος", GEN), (1, "λόγος", NOM), (1, "θεός", GEN)]
    new = {x.lemma: x for x in export.new_lemma_sheet(r, ch).collect()}
    assert sorted((x.chapter_index, k) for k, x in new.items()) == [(0, "λόγος"), (0, "ὁ"), (1, "θεός")]
    assert (new["λόγος"].parse_count, new["λόγος"].lemma_occ, new["λόγος"].lemma_last_chapter, new["λόγος"].chapter_span, new["λόγος"].forms) == (2, 2, 1, 2, "λόγος · λόγου")
    assert (new["ὁ"].form_count, new["ὁ"].forms, new["ὁ"].lemma_last_chapter, new["ὁ"].chapter_span) == (2, "Ὁ · ὁ", 0, 1)
    runs = spark.createDataFrame([("r",), ("none",)], "run_id string")
    assert rows(export.counts(export.row_sheet(r, ch), export.new_lemma_sheet(r, ch), runs), "run_id", "row_count", "new_lemma_count", "exportable") == [("none", 0, 0, False), ("r", 5, 3, True)]


def test_new_and_repeated_make_up_each_chapter(spark):
    f = facts(spark, F5)
    tokens = {r.chapter_index: r.token_count for r in tracks.chapter_stats(f).collect()}
    for keys in (["lemma"], ["lemma", "parse"]):
        assert {r.chapter_index: r.new_tokens + r.repeated_tokens for r in text.progress(f, refs(spark, 4), keys).collect()} == tokens


def test_views(spark):
    df = spark.createDataFrame([("β", 0.0, None), ("Ἄ", 1.0, 3), ("α", 0.1234, 1)], "lemma string, share double, n int")
    assert [r.lemma for r in views.sort_rows(df, "lemma", "text").collect()][2] == "β"
    assert [r.n for r in views.sort_rows(df, "n", "num").collect()] == [None, 1, 3]
    assert {r.p for r in df.select(views.percent(F.col("share")).alias("p")).collect()} == {"0%", "100%", "12.3%"}
    vocab = spark.createDataFrame([("r", "λόγος", 5), ("r", "λογικός", 3), ("r", "θεός", 2)], "run_id string, lemma string, total long")
    assert rows(views.search(vocab, " ΛΟΓ ", 1), "lemma", "matches") == [("λόγος", 2)]
    assert [tuple(r) for r in spark.range(1).select(*views.page_range(F.lit(25), 20, 10)).collect()] == [(21, 25, True, False)]
    assert [tuple(r) for r in spark.range(1).select(*views.page_range(F.lit(0), 0, 10)).collect()] == [(0, 0, False, False)]
    assert spark.range(1).select(views.bar_width(F.lit(1), F.lit(10000)), views.bar_width(F.lit(0), F.lit(9)), views.bar_width(F.lit(9), F.lit(9))).first()[:] == (2, None, 100)


def test_totals_and_lines_of_every_chapter(spark):
    f = facts(spark, [("λόγος", "λόγος", NOM, c) for c in (0, 0, 2, 2, 2)] + [("ἄνθρωπος", "ἄνθρωπος", NOM, 1)])
    want = spark.createDataFrame([("r", "λόγος")], "run_id string, lemma string")
    assert rows(lemma.chapter_totals(f, want, refs(spark, 4)), "chapter_index", "total") == [(0, 2), (1, 0), (2, 3), (3, 0)]
    assert rows(lemma.concordance(f, want, limit=2, by_chapter=True), "chapter_index", "line", "total") == [(0, 1, 2), (0, 2, 2), (2, 1, 3), (2, 2, 3)]
    for c in (0, 1, 2):
        by = lemma.concordance(f, want, by_chapter=True).where(f"chapter_index = {c}")
        for context in (0, 2):
            one = lemma.concordance(f, want, context=context, chapter_index=c)
            assert rows(by, "position", "line", "total") == rows(one, "position", "line", "total")


def test_contexts_reach_over_blocks_and_gaps(spark, monkeypatch):
    import random

    rng = random.Random(3)
    at = {c: sorted(rng.sample(range(200), n)) for c, n in ((0, 60), (1, 3), (2, 25))}
    made = [("r", "a", c, "i", "t", p, "noun", rng.choice("xyz"), f"f{c}-{p}", NOM) for c, ps in at.items() for p in ps]
    f = spark.createDataFrame(made, "run_id string, filename string, chapter_index int, chapter_id string, chapter_title string, position int, type string, lemma string, form string, parse string")
    want = spark.createDataFrame([("r", "x")], "run_id string, lemma string")
    form = {(r[2], r[5]): r[8] for r in made}
    expected = sorted((c, p, [form[c, q] for q in at[c] if q < p][-6:], [form[c, q] for q in at[c] if q > p][:6]) for _, _, c, _, _, p, _, w, *_ in made if w == "x")
    for block in (3, 50, 1 << 16):
        monkeypatch.setattr(lemma, "BLOCK", block)
        assert sorted((r.chapter_index, r.position, r.before, r.after) for r in lemma.concordance(f, want, limit=None).collect()) == expected


def test_profile_and_counts_of_a_run_without_labels(spark):
    decoded = mo.decode(facts(spark, [("λόγος", "λόγος", "", 0)]))
    assert grammar.profile(decoded).count() == grammar.profile(decoded, refs(spark, 2)).count() == grammar.inventory_counts(decoded, refs(spark, 2)).count() == 0
