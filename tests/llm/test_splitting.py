import random

import pytest

from tokenweave.llm.splitting import split, split_oversized


def check(text, limit, overlap):
    level, pieces = split(text, limit, overlap)
    assert pieces[0][:2] == (0, 0) and pieces[-1][2] == len(text)
    for a, new, b in pieces:
        assert b - a <= limit and a <= new <= b
    for (_, _, end), (a, new, _) in zip(pieces, pieces[1:]):
        assert new == end and 0 <= end - a <= overlap
    assert "".join(text[new:b] for _, new, b in pieces) == text
    return level, pieces


def test_levels():
    p = "word " * 20
    assert split(p + "\n \t\n" + p, 110, 10)[0] == "paragraph"
    assert split(p + ". " + p, 120, 10)[0] == "sentence"
    assert split(p + p, 120, 10)[0] == "word"
    assert split("x" * 130 + " a", 120, 10)[0] == "none"
    assert split("a·b" * 50, 100, 10)[0] == "none"  # no blank after the mark
    assert split(("a" * 60 + "· ") * 3, 100, 10)[0] == "sentence"
    assert split("a" * 60 + " " + "b" * 60, 100, 10)[0] == "none"  # a no-break space is no blank
    assert split("a" * 90 + "\r\n\r\n" + "b" * 90, 100, 10)[0] == "paragraph"
    assert split(" " * 90 + "a" * 90, 100, 10)[0] == "paragraph"  # blanks at the ends do not count


def test_pieces_prefer_sentence_ends():
    text = " ".join(f"This is sentence number {i} of the text." for i in range(60))
    _, pieces = check(text, 300, 40)
    assert all(text[:b].rstrip().endswith(".") for _, _, b in pieces)
    sizes = [b - new for _, new, b in pieces]
    assert max(sizes) - min(sizes) < 150


def test_overlap_begins_at_words():
    text = "lorem ipsum dolor sit amet " * 100
    _, pieces = check(text, 200, 30)
    assert all(a == 0 or text[a - 1].isspace() for a, _, _ in pieces)


@pytest.mark.parametrize("seed", range(30))
def test_random_texts_lose_nothing(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a" * rng.randrange(1, 30), " ", ". ", "\n\n", "\r\n", "; ", "β", "x" * rng.randrange(150)]) for _ in range(400))
    limit = rng.randrange(20, 200)
    check(text, limit, rng.randrange(0, limit))


def test_very_long_and_empty_texts():
    check("x" * 300_000, 1200, 120)
    check("word " * 200_000, 1200, 120)
    assert split("", 10, 2) == ("paragraph", [(0, 0, 0)])
    assert split(" " * 50, 10, 2)[0] == "paragraph"
    check(" " * 50, 10, 2)
    with pytest.raises(ValueError):
        split("a", 10, 10)


def test_operator(spark):
    df = spark.createDataFrame([("r", None, None, 1), ("r", 2, "", 1), (None, 3, "one. " * 100, 1), ("r", 3, "short", 1)], "run string, no int, text string, __text int")
    rows = split_oversized(df, ["run", "no"], "text", 100, 10).orderBy("run", "no", "piece_no").collect()
    long = [r for r in rows if r.run is None]
    assert len(long) == long[0].pieces > 4 and {r.boundary for r in long} == {"sentence"}
    assert "".join(r.piece[r.new_from - r.start :] for r in long) == "one. " * 100
    assert [(r.no, r.piece) for r in rows if r.run] == [(2, ""), (3, "short")]
    assert split_oversized(df.limit(0), ["run"], "text").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df.withColumnRenamed("run", "piece"), ["piece"], "text")
