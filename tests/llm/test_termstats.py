import random
from collections import Counter

from pyspark.sql import functions as F

from tokenweave.llm.termstats import mark_terms, term_counts


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([1, 2, None]), "hot" if rng.random() < 0.4 else rng.choice(["x", "y", "", None, "z" * 9000]), rng.choice("pq"), "n") for _ in range(3000)]
    df = spark.createDataFrame(rows, "run string, ch int, lemma string, form string, n string")
    got = {(r.field, r.term): (r.occurrences, r.records) for r in term_counts(df, ["run", "ch"], ["lemma", "form"]).collect()}
    occ, rec = Counter(), {}
    for run, ch, lemma, form, _ in rows:
        for f, t in (("lemma", lemma), ("form", form)):
            if t is not None:
                occ[f, t] += 1
                rec.setdefault((f, t), set()).add((run, ch))
    assert got == {k: (occ[k], len(rec[k])) for k in occ}


def test_marks_and_their_edges(spark):
    counts = spark.createDataFrame([("f", "a", 9, 1), ("f", "b", 9, 2), ("f", "c", 9, 3), ("f", "d", 9, 4), ("f", "e", 9, 5)], "field string, term string, occurrences long, records long")
    total = spark.createDataFrame([(10,)], "n long")
    assert {r.term: r.mark for r in mark_terms(counts, total).collect()} == {"a": "rare", "b": "rare", "c": "kept", "d": "kept", "e": "common"}
    few = mark_terms(counts, spark.createDataFrame([(2,)], "n long"))
    assert {r.mark for r in few.where(F.col("records") <= 2).collect()} == {"rare"}


def test_empty(spark):
    df = spark.createDataFrame([], "run string, lemma string")
    assert mark_terms(term_counts(df, ["run"], ["lemma"]), df.agg(F.count("*"))).count() == 0
