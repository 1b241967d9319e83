import random

import pytest
from pyspark.sql import functions as F

from tokenweave.llm.truncation import describe, ended, fit, fitted, is_open, limits, score_truncation, strip_closing, whole_words

THINGS = ["kettle", "tent", "pillow", "rucksack", "desk lamp", "garden hose", "pan"]


def sentence(rng):
    t, n = rng.choice(THINGS), rng.randrange(2, 60)
    return rng.choice([f"I ordered the {t} in the {n} litre size.", f"It replaced a {t} that was {n} years old.", "My sister chose the colour, I only paid.", f"For {n} coins this is a fair deal!", f"It arrived after {n} days in a plain box.", "The whole office wants another one.", f"We use it roughly {n} times a week."])


def review(rng):
    return " ".join(sentence(rng) for _ in range(rng.randrange(2, 8)))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return fit([review(rng) for _ in range(1500)], [f"Great {t}" for t in THINGS] * 20)


def test_held_out_accuracy(model):
    rng = random.Random(2)
    right = total = 0
    for _ in range(400):
        text = review(rng)
        k = rng.randrange(20, len(text) - 2)
        complete = text[k - 1] in ".!?" or text[k] in ".!? "
        cases = [(text, False), (text[:-1] + "...", False), (text.lower().replace(".", "").replace(",", "").replace("!", ""), False), (text + " 10 out of 10 :-)", False)]
        if not complete:
            cases += [(text[:k], True), (text[:k] + "...", True), (text[:k] + " [more]", True), (text[:k] + "�", True)]
        for t, cut in cases:
            total += 1
            right += (model.score(t, False) >= 0.5) == cut
    assert right / total > 0.97


def test_shapes(model):
    assert strip_closing("Good. 5/5") == "Good." and strip_closing("Good! ★★★ :-)") == "Good!" and strip_closing("Good. xx") == "Good."
    assert describe("All fine.", False)[0] == "E" and describe("All fine. It was the...", False)[0] == "D" and describe("all fine it was", False)[0] == "U" and describe("Great tent", False)[0] == "H" and describe("Fine. It was", False)[0] == "N"
    assert model.score("Great tent", False) < 0.5 < model.score("I ordered the tent. It replaced a", True)


def test_operator(spark):
    rng = random.Random(4)
    rows = [(i, "web", review(rng), "Great tent", "x") for i in range(600)]
    rows += [(1000 + i, "sms", (review(rng) + " " + review(rng) + " " + review(rng))[:118].rstrip(".!") + "q", None, "x") for i in range(40)]
    rows += [(2000, None, None, None, "x"), (2001, "web", "", None, "x"), (2002, "web", "It replaced a tent that was", "t", "x"), (2003, None, "word " * 50_000 + "end.", None, "x"), (2004, "web", "...", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, title string, at_limit string")
    assert ("sms", "chars", 119) in {tuple(r) for r in limits(df, "source", "text").collect()}
    got = {r.doc_id: r.truncated for r in score_truncation(df, "doc_id", "source", "text", "title").collect()}
    assert len(got) == len(rows)
    assert not got[2000] and not got[2001] and got[2002] and not got[2003]
    assert sum(got[1000 + i] for i in range(40)) >= 38 and sum(got[i] for i in range(600)) <= 6
    assert score_truncation(df.limit(0), "doc_id", "source", "text").count() == 0


def test_known_words_come_from_all_intact_texts(spark):
    rows = [(i, f"The word{'abc'[i % 3]} is rare here. It stands in many texts.") for i in range(60)] + [(100 + i, "A long tale of zebras. " * 300) for i in range(3)]
    rows += [(200 + i, "Only quaggas twice. That is all.") for i in range(2)] + [(300 + i, "the text breaks off in gnu") for i in range(5)] + [(400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    words = whole_words(docs, "text")
    found = {r.word for r in words.collect()}
    assert {"worda", "wordb", "wordc", "zebras"} <= found and not {"quaggas", "gnu"} & found
    assert found == fit([t for _, t in rows[:65]], []).vocabulary
    model = fitted(docs, words, "doc_id", "text", sample=4)
    assert model.vocabulary <= found


def test_scores_join_the_words_of_the_corpus(spark):
    rng = random.Random(6)
    docs = [(i, "web", review(rng)) for i in range(300)] + [(1000 + i, "web", f"I ordered the tent. It replaced a {w}") for i, w in enumerate(("kettle", "kett", "17", "", "^"))] + [(1005, "web", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    words = whole_words(df, "text")
    model = fitted(df, words, "doc_id", "text")
    model.vocabulary = {r.word for r in words.collect()}
    got = {r.doc_id: r.score for r in score_truncation(df, "doc_id", "source", "text").collect()}
    assert got == pytest.approx({i: model.score(t, False) if t else 0.0 for i, _, t in docs})


@pytest.mark.parametrize(
    "text, closed",
    [
        ("It works well.", True), ("It works well!)", True), ('He said "it works."', True), ("It works. 4/5", True), ("So do I!", True), ("It took 10.", True),
        ("We met K.", False), ("Sent by K.T.", False), ("It weighs 4.", False), ('He said "it works." -', False), ("It works (mostly.),", False), ("It works", False),
    ],
)
def test_closing_mark_at_the_end(text, closed):
    assert ended(text) == closed


def test_score_alone_decides(model):
    for text in ("I ordered the tent. It replaced a.", "I ordered the tent. It replaced a”.", "It arrived after 3 days in a plain!"):
        assert model.score(text, False) < 0.5 < model.score(text.rstrip(".!”"), False)


def test_limits_stand_out_from_the_lengths_around(spark):
    rows = [("even", "x" * n + ". Word " + "y" * 3) for n in range(60, 100) for _ in range(30)]
    rows += [("cut", "x" * n + ". Word " + "y" * 3) for n in range(60, 100) for _ in range(2)] + [("cut", "x" * 80 + ". Word yyy")] * 30
    found = limits(spark.createDataFrame(rows, "source string, text string"), "source", "text")
    assert {tuple(r) for r in found.collect()} == {("cut", "chars", 90), ("cut", "bytes", 90)}


def test_closing_signs_of_any_length_are_seen_whole():
    assert strip_closing("Good." + " " * 500 + "9 out of" + " " + "10") == "Good." and strip_closing("Good. " + "x" * 500) == "Good."
    assert describe("Fine. " + "very" * 100 + " long", False)[1] == ["^", "very" * 100, "long"]


def test_the_sample_is_the_same_whatever_share_is_looked_at(spark):
    rng = random.Random(8)
    docs = [(i, review(rng) if i % 40 == 0 else "no mark at its end") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    words = whole_words(df, "text")
    one = fitted(df, words, "doc_id", "text", sample=60)  # a first share holds too few intact texts
    intact = df.where("text <> 'no mark at its end'")
    assert (one.weights == fitted(intact, words, "doc_id", "text", sample=60).weights).all() and one.weights.any()


def test_many_sentences_without_an_end_are_no_trouble(spark):
    body = "It works well. " * 60_000
    df = spark.createDataFrame([(body,), (body + "And",), ("Fine. It",), ("fine it",), ("Fine..  ",), ("Fine.",)], "t string")
    assert [r.o for r in df.select(is_open(F.col("t")).alias("o")).collect()] == [False, True, True, False, True, False]
