import pytest
from pyspark.sql import functions as F

from tokenweave.functions import morphology as mo
from tokenweave.functions.vocab import DIMENSIONS
from tokenweave.plans import single

CASES = [
    # label, type, features, status, descriptors, unparsed
    ("pres. act. ind. 3sg", "verb", "tense=pres voice=act mood=ind number=sg person=3", "ok", [], []),
    ("PRES. ACT. IND. 3SG.", "verb", "tense=pres voice=act mood=ind number=sg person=3", "ok", [], []),
    ("pres act ind 3 sg.", "verb", "tense=pres voice=act mood=ind number=sg person=3", "ok", [], []),
    ("nom. sg. f.", "", "case=nom number=sg gender=fem", "ok", [], []),
    ("def. art. nom. sg. fem.", "", "case=nom number=sg gender=fem", "ok", ["def. art."], []),
    ("definite article nom. sg. fem.", "", "case=nom number=sg gender=fem", "ok", ["def. art."], []),
    ("nom./acc. sg. neut.", "", "case=acc|nom number=sg gender=neut", "ok", [], []),
    ("gen. sg. m./n.", "", "case=gen number=sg gender=masc|neut", "ok", [], []),
    ("aor. mid./pass. ind. 3sg", "", "tense=aor voice=mid|pass mood=ind number=sg person=3", "ok", [], []),
    ("masc./xyz sg.", "", "gender=masc number=sg", "partial", [], ["xyz"]),
    ("aor. ind. 3sg deponent", "verb", "tense=aor voice=mid mood=ind number=sg person=3", "ok", [], []),
    ("aor. mp. ind. 3sg deponent", "verb", "tense=aor voice=mid|pass mood=ind number=sg person=3", "ok", [], []),
    ("-", "", "", "not_applicable", [], []),
    ("", "", "", "not_applicable", [], []),
    ("   ", "", "", "not_applicable", [], []),
    ("n/a", "", "", "not_applicable", [], []),
    ("interrogative", "", "", "descriptive", ["interrogative"], []),
    ("negative particle", "", "", "descriptive", ["negative"], []),
    ("affirmative particle", "", "", "descriptive", ["affirmative"], []),
    ("interrog. adv.", "", "", "descriptive", ["interrogative"], []),
    ("interrog. adv. interrog. part.", "", "", "descriptive", ["interrogative"], []),
    ("abbreviation for πρῶτον", "", "", "descriptive", ["abbreviation"], []),
    ("dat. sg. (incomplete)", "", "case=dat number=sg", "partial", [], ["(incomplete)"]),
    ("τι λέγεις", "", "", "unparsed", [], ["τι", "λέγεις"]),
    ("adverbial", "", "", "descriptive", ["adverb"], []),
    ("indeclinable noun", "", "", "descriptive", ["indeclinable"], []),
    ("interrog. nom. sg.", "", "case=nom number=sg", "ok", ["interrogative"], []),
    ("part.", "particle", "", "descriptive", ["particle"], []),
    ("part.", "", "mood=part", "ok", [], []),
    ("pres. act. part. nom. sg. masc.", "particle", "tense=pres voice=act mood=part case=nom number=sg gender=masc", "ok", [], []),
    ("neg. participle", "", "", "partial", ["negative"], ["iciple"]),
    ("nom. n/a", "", "case=nom gender=neut", "partial", [], ["a"]),
    (None, "", "", "not_applicable", [], []),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, parse string, type string")
    for r in mo.with_morph(df).collect():
        label, _, said, status, descriptors, unparsed = CASES[r.i]
        got = {d: r[d] for d in DIMENSIONS if r[d] is not None}
        assert got == dict(x.split("=") for x in said.split()), label
        assert (r.status, r.descriptors, r.unparsed) == (status, descriptors, unparsed), label
        assert r.is_deponent == ("deponent" in (label or "")), label


@pytest.mark.parametrize(
    "label, signature, form_class",
    [
        ("pres. act. ind. 3 sg.", "pres. act. ind. 3sg", "verb"), ("pres. act. ind. 3 sg./pl.", "pres. act. ind. 3 sg./pl.", "verb"), ("pres. act. ind. 2/3 sg.", "pres. act. ind. 2/3 sg.", "verb"), ("acc./nom. pl. masc./fem.", "nom./acc. pl. masc./fem.", "nominal"),
        ("nom. sg. 3/2", "nom. sg. 2/3", "nominal"), ("def. art. gen. sg. fem.", "gen. sg. fem.", "nominal"), ("-", "", "other"), ("superl.", "superl.", "other"), ("aor. act. inf.", "aor. act. inf.", "verb"), ("pres. act. part. nom. sg. masc.", "pres. act. part. nom. sg. masc.", "participle"),
    ],
)
def test_signatures_and_classes(spark, label, signature, form_class):
    r = mo.decode_labels(spark.createDataFrame([(label, "")], "parse string, type string")).first()
    assert (r.signature, r.form_class) == (signature, form_class)


def test_order_gaps_and_names(spark):
    labels = ["impf. act. ind. 3sg", "nom. sg.", "pres. ind. 3sg", "gen. sg.", "pres. part. nom. sg. masc.", "voc."]
    rows = {r.parse: r for r in mo.decode_labels(spark.createDataFrame([(x, "") for x in labels], "parse string, type string")).collect()}
    assert sorted(labels, key=lambda x: rows[x].sort_key) == ["pres. ind. 3sg", "pres. part. nom. sg. masc.", "impf. act. ind. 3sg", "nom. sg.", "gen. sg.", "voc."]
    assert [x for x in labels if rows[x].missing_voice] == ["pres. ind. 3sg", "pres. part. nom. sg. masc."]
    one = spark.createDataFrame([("acc|nom", "2|3", None)], "c string, p string, n string")
    r = one.select(mo.feature_label("case", F.col("c")).alias("l"), mo.feature_abbr("case", F.col("c")).alias("a"), mo.person_abbr(F.col("p")).alias("p"), mo.paradigm_rank("case", F.col("c")).alias("r"), mo.has(F.col("c"), "nom").alias("h"), mo.has(F.col("n"), "nom").alias("x")).first()
    assert tuple(r) == ("accusative/nominative", "nom./acc.", "2/3", 0, True, False)


def test_features_are_read_once_per_label(spark, tmp_path):
    said = [("nom./acc. sg. neut.", "noun"), ("part.", "particle"), ("part.", "verb"), ("part.", None), (None, "verb"), ("-", ""), ("xyz", "noun"), ("gen. xyz", None)]
    spark.createDataFrame(said * 50, "parse string, type string").write.parquet(str(tmp_path / "token_facts.parquet"))
    df = single.m_features(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("gen. xyz", "", "case=gen"), ("nom./acc. sg. neut.", "noun", "case=acc|nom number=sg gender=neut"), ("part.", "", "mood=part"), ("part.", "verb", "mood=part")]
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x[:200] for x in plan if "Filter" in x and "regexp_replace" in x], "labels are decoded for every row of the facts"
