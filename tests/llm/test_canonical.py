import random

import pytest

from tokenweave.llm.canonical import FeatureList, Trie, WordList, _apart, letters, list_candidates, map_values
from tokenweave.llm.queries import p6_candidates, p6_found

LABELS = ["nom. sg. masc.", "nom./acc. sg. neut.", "pres. act. ind. 3sg", "pres. ind. 3sg", "pres. mid./pass. ind. 3pl", "pres. act. inf.", "aor. act. part. nom. sg. masc.", "adv.", "particle"]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 7)))
    words = sorted({word() for _ in range(150)})
    trie = Trie((w, i) for i, w in enumerate(words))
    for _ in range(60):
        sought = word()
        for k in range(3):
            assert trie.within(sought, k) == {i: _apart(sought, w) for i, w in enumerate(words) if _apart(sought, w) <= k}


def test_swap_is_one_slip():
    assert _apart("abcd", "acbd") == 1 and Trie([("abcd", 0)]).within("acbd", 1) == {0: 1}


def test_words():
    entries = ["λόγος", "θεός", "ὅς", "ὅς2", "καί", "βίος", "βιός", "ἐθέλω"]
    words = WordList(entries, [("θέλω", "ἐθέλω"), ("ἦλθον", "ἔρχομαι")])
    cases = {
        "λόγоς": "λόγος", "λογος": "λόγος", "ΛΟΓΟΣ": "λόγος", "λόγος*": "λόγος", "λόγο(ς)": "λόγος", "λόος": "λόγος", "λόογος": "λόγος", "λγόος": "λόγος", "λόμος": "λόγος",
        "θέλω": "ἐθέλω", "θέλω​": "ἐθέλω", "ἦλθον": "", "ὅς1": "ὅς", "Ὅς": "ὅς", "βίος,": "βίος", "βιός.": "βιός", "vox": "", "": "", "***": "", "ἄνθρωπος": "", "x" * 50000: "",
    }
    assert {v: words.closest(v) for v in cases} == cases
    assert letters("Λόγος (?)") == "λογοσ"
    assert words.candidates("βίως") and all(d <= 1 for _, d in words.candidates("βίως"))
    assert WordList([], []).closest("λόγος") == ""


@pytest.mark.parametrize(
    "value, label",
    [
        ("Masc. Nom. Sg.", "nom. sg. masc."), ("nominative singular masculine", "nom. sg. masc."), ("nom sg m", "nom. sg. masc."), ("nom.-sg.-masc.", "nom. sg. masc."), ("nomsgmasc", "nom. sg. masc."), ("nom. sg. massc.", "nom. sg. masc."), ("nmo. sg. masc.", "nom. sg. masc."), ("nomsgmaasc", "nom. sg. masc."),
        ("acc/nom sg n", "nom./acc. sg. neut."), ("pres act ind 3 sg.", "pres. act. ind. 3sg"), ("PRESACTIND3SG", "pres. act. ind. 3sg"), ("pres. ind. 3sg.", "pres. ind. 3sg"), ("pres. mp. ind. 3pl", "pres. mid./pass. ind. 3pl"), ("prres. act. inf.", "pres. act. inf."),
        ("aor. act. patr. nom. sg. masc.", "aor. act. part. nom. sg. masc."), (" adverb", "adv."), ("PARTTICLE", "particle"), ("nom. sg.", ""), ("nom. sg. fem.", ""), ("lacuna 14", ""), ("gloss only", ""), ("-", ""), ("", ""), ("nom. nom. sg. masc.", ""), ("nom" * 9000, ""),
    ],
)
def test_labels(value, label):
    assert FeatureList(LABELS).closest(value) == label


def test_operators(spark):
    words, labels = WordList(["λόγος"], []), FeatureList(LABELS)
    df = spark.createDataFrame([("lemma", "λογος", 1), ("parse", "Adverb", 1), ("lemma", None, 1), ("lemma", "λογος", 1)], "field string, entered string, canonical int")
    got = sorted(map(tuple, map_values(df, iter([{"lemma": words, "parse": labels}])).collect()), key=str)
    assert got == sorted([("lemma", "λογος", "λόγος"), ("lemma", "λογος", "λόγος"), ("parse", "Adverb", "adv."), ("lemma", None, "")], key=str)
    assert map_values(df.limit(0), iter([])).count() == 0
    assert [tuple(r) for r in list_candidates(df.where("field = 'lemma'").limit(1), iter([words])).collect()] == [("λογος", "λόγος", 0)]


@pytest.mark.parametrize("seed", range(4))
def test_candidates_against_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
    entries, variants = sorted({word() for _ in range(80)}), sorted({word() for _ in range(80)})
    aliases = [(v, rng.choice(entries)) for v in variants]
    words = WordList(entries, aliases, ((1, 0), (3, 1), (5, 2), (8, 3)))
    for _ in range(80):
        sought, best = word(), {}
        for w, e in [(e, e) for e in entries] + aliases:
            if (d := _apart(sought, w)) <= words.most(sought):
                best[e] = min(d, best.get(e, d))
        assert {entries[i]: d for i, d in words.candidates(sought)} == best


def test_candidates_by_alias_and_length(spark):
    bands = ((1, 1), (8, 2))
    words = WordList(["λόγος", "ἄνθρωπος", "θεός", "2"], [("παρμιδεμώφος", "λόγος"), ("παρμιδεμώφος", "θεός"), ("θέλω", "ἐθέλω"), ("ἀνθρώπος", "ἄνθρωπος"), ("***", "θεός")], bands)
    names = lambda v: [(words.entries[e], d) for e, d in words.candidates(v)]
    assert names("παρμιδεμώφος") == [("λόγος", 0), ("θεός", 0)] and names("παρμιδεμφω") == []
    assert names("παρμιδεμώφ") == [("λόγος", 2), ("θεός", 2)] and names("θέλω") == []
    assert names("ἄνθπος") == [] and names("ἄνθρωποςις") == [("ἄνθρωπος", 2)] and names("λόγοςις") == []
    assert ("θεός", 0) in names("***") and names("2") == [("2", 0)] and names("") == []
    assert words.closest("παρμιδεμώφος") == "λόγος" and words.closest("παρμιδεμώφο") == ""
    df = spark.createDataFrame([("παρμιδεμώφος",)], "entered string")
    assert sorted(map(tuple, list_candidates(df, iter([words])).collect())) == [("παρμιδεμώφος", "θεός", 0), ("παρμιδεμώφος", "λόγος", 0)]


def test_query_of_candidates_has_aliases_and_bands(spark, tmp_path):
    facts = [("r", "παρμιδεμώφος", "adv."), ("r", "ἄνθρωποςις", "adv.")]
    spark.createDataFrame(facts, "run_id string, lemma string, parse string").write.parquet(f"{tmp_path}/token_facts.parquet")
    spark.createDataFrame([(1, "λόγος"), (2, "ἄνθρωπος")], "rank int, lemma string").write.parquet(f"{tmp_path}/lexicon_entries.parquet")
    spark.createDataFrame([("παρμιδεμώφος", "λόγος")], "variant string, lemma string").write.parquet(f"{tmp_path}/greek_core_5k_aliases.parquet")
    spark.createDataFrame([(1, "adv.")], "label_id int, label string").write.parquet(f"{tmp_path}/parse_labels.parquet")
    got = sorted(map(tuple, p6_candidates(spark, str(tmp_path)).collect()))
    assert got == sorted([("παρμιδεμώφος", "λόγος", 0), ("ἄνθρωποςις", "ἄνθρωπος", 2)])


def test_only_whole_labels_say_nothing(spark, tmp_path):
    labels = ["-", "n/a", "", " ", "\u00a0", "\n", "\u0085", "\u2028", "-\n", "n/a\u2028", "adv.\n", None]
    spark.createDataFrame([("r", None, p) for p in labels], "run_id string, lemma string, parse string").write.parquet(f"{tmp_path}/token_facts.parquet")
    spark.createDataFrame([(1, "λόγος")], "rank int, lemma string").write.parquet(f"{tmp_path}/lexicon_entries.parquet")
    spark.createDataFrame([("v", "λόγος")], "variant string, lemma string").write.parquet(f"{tmp_path}/greek_core_5k_aliases.parquet")
    spark.createDataFrame([(1, "adv.")], "label_id int, label string").write.parquet(f"{tmp_path}/parse_labels.parquet")
    got = sorted((r.entered, r.canonical) for r in p6_found(spark, str(tmp_path)).collect())
    assert got == [("-\n", ""), ("adv.\n", "adv."), ("n/a\u2028", "")]


def test_words_of_labels_outside_the_vocabulary():
    labels = FeatureList([*LABELS, "nom. sg. masc. enclitic", "crasis"])
    assert labels.closest("masc enclitic nom sg") == "nom. sg. masc. enclitic" and labels.closest("nom. sg. masc.") == "nom. sg. masc."
    assert labels.closest("crassis") == "crasis" and labels.closest("nom. sg. masc. crasis") == "" and labels.closest("Adverb") == "adv."


@pytest.mark.parametrize("seed", range(3))
def test_blocks_find_what_one_list_finds(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("αβγάι") for _ in range(rng.randrange(2, 6)))
    entries = sorted({word() for _ in range(60)}, key=lambda _: rng.random())
    aliases = sorted({(word(), rng.choice(entries)) for _ in range(60)})
    values = spark.createDataFrame([("lemma", v) for v in sorted({word() for _ in range(200)})] + [("lemma", None), ("other", "x")], "field string, entered string")
    rows = [(i, e, None) for i, e in enumerate(entries)] + [(entries.index(e), e, v) for v, e in aliases]
    rows.sort(key=lambda r: (r[0], r[2] or ""))
    bands = ((1, 1), (4, 2))
    lists = lambda n, slips: (WordList.of(rows[a : a + n], slips) for a in range(0, len(rows), n))
    mapped = lambda n: sorted(map(tuple, map_values(values, ({"lemma": w} for w in lists(n, ((1, 1),)))).collect()), key=str)
    assert mapped(7) == mapped(1000) and len(mapped(7)) == values.count()
    whole = WordList(entries, aliases)
    assert {r[1]: r[2] for r in mapped(7) if r[0] == "lemma" and r[1]} == {v: whole.closest(v) for _, v in values.dropna().collect() if _ == "lemma"}
    near = lambda n: sorted(map(tuple, list_candidates(values.where("field = 'lemma'").select("entered"), lists(n, bands)).collect()))
    assert near(7) == near(1000)


def test_labels_in_blocks(spark):
    values = spark.createDataFrame([("parse", v) for v in ("nom sg m", "adverb", "nom. sg.", "prres. act. inf.")], "field string, entered string")
    run = lambda n: sorted(map(tuple, map_values(values, ({"parse": FeatureList(LABELS[a : a + n])} for a in range(0, len(LABELS), n))).collect()))
    assert run(2) == run(100) == sorted([("parse", "nom sg m", "nom. sg. masc."), ("parse", "adverb", "adv."), ("parse", "nom. sg.", ""), ("parse", "prres. act. inf.", "pres. act. inf.")])
