import random

import pytest

from tokenweave.operators.diff import diff_copies
from tokenweave.operators.repeats import thin_repeats
from tokenweave.session import fresh_path, release, tasks_for

SCHEMA = "a string, b int, x string, y int, extra string"


def frames(spark, left, right, schema=SCHEMA):
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_missing_changed_and_repeated(spark):
    left = [("k", 1, "u", 1, "e"), ("k", 1, "u", 1, "e"), ("k", 2, "u", 2, "e"), ("l", 1, None, None, "e"), ("m", 1, None, 5, "e")]
    right = [("k", 1, "v", 1, "other"), ("l", 1, None, None, None), ("m", 1, "", 6, "e"), ("m", 1, "", 6, "e"), ("z", 9, "u", 1, "e")]
    got = found(diff_copies(*frames(spark, left, right), ["a", "b"], ["x", "y"]))
    assert got == sorted([("k", 1, "x", "u", "v"), ("k", 2, "missing_in_right", None, None), ("m", 1, "x", None, ""), ("m", 1, "y", "5", "6"), ("z", 9, "missing_in_left", None, None)], key=str)


def test_composition_is_no_difference_but_null_is(spark):
    left, right = [("k", 1, "ά", 1, "")], [("k", 1, "ά", 1, "")]
    assert found(diff_copies(*frames(spark, left, right), ["a", "b"], ["x"])) == []


def test_null_keys_equal_each_other(spark):
    left, right = [(None, 1, "u", 1, ""), (None, None, "u", 1, "")], [(None, 1, "w", 1, "")]
    got = found(diff_copies(*frames(spark, left, right), ["a", "b"], ["x"]))
    assert got == sorted([(None, 1, "x", "u", "w"), (None, None, "missing_in_right", None, None)], key=str)


def test_unlike_repeats_take_the_first_in_field_order(spark):
    left, right = [("k", 1, "z", 1, ""), ("k", 1, "a", 1, "")], [("k", 1, "a", 1, "")]
    assert found(diff_copies(*frames(spark, left, right), ["a", "b"], ["x"])) == []


@pytest.mark.parametrize("n, m", [(0, 0), (3, 0), (0, 3)])
def test_empty_copies(spark, n, m):
    rows = lambda k: [(str(i), i, "u", 1, "") for i in range(k)]
    assert len(found(diff_copies(*frames(spark, rows(n), rows(m)), ["a", "b"], ["x"]))) == n + m


def test_names_used_inside_may_be_columns(spark):
    schema = "side string, k0 int, f0 string, t string, z string"
    got = found(diff_copies(*frames(spark, [("s", 1, "u", "", "")], [("s", 1, "v", "", "")], schema), ["side", "k0"], ["f0"]))
    assert got == [("s", 1, "f0", "u", "v")]
    with pytest.raises(ValueError):
        diff_copies(*frames(spark, [], []), ["a"], [])


def test_against_brute_force_with_a_hot_key_and_long_texts(spark):
    rng = random.Random(5)
    def copy():
        rows = [(f"k{rng.randrange(40)}", rng.randrange(30), None, None, "") for _ in range(900)]
        return {(a, b): (a, b, rng.choice(["u", "v", None, "w" * 50000 if b == 7 else "w"]), rng.choice([1, 2, None]), "") for a, b, *_ in rows}
    one, two = copy(), copy()
    left = [r for r in one.values() for _ in range(rng.choice([1, 1, 2]))] + [one[next(iter(one))]] * 700
    right = [r for r in two.values() for _ in range(rng.choice([1, 1, 3]))]
    rng.shuffle(left), rng.shuffle(right)
    expected = [(*k, "missing_in_right") for k in one.keys() - two.keys()] + [(*k, "missing_in_left") for k in two.keys() - one.keys()]
    expected += [(*k, name) for k in one.keys() & two.keys() for i, name in ((2, "x"), (3, "y")) if one[k][i] != two[k][i]]
    l, r = frames(spark, left, right)
    got = [(x["a"], x["b"], x["diff"]) for x in diff_copies(l.repartition(7), r.repartition(3), ["a", "b"], ["x", "y"]).collect()]
    assert sorted(got) == sorted(expected)


def test_hot_keys_are_thinned_to_their_first_row(spark):
    rows = [("hot", 1, "v", 1, ""), ("hot", 1, "u", 1, ""), ("hot", 1, "u", 2, None), (None, None, "u", 1, "")] * 20000 + [(str(i), i, "u", 1, "") for i in range(300)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    thin, n = thin_repeats(df, ["a", "b"])
    assert thin.columns == df.columns and 60_000 < n < 100_000
    assert thin.where("a = 'hot'").collect() == [("hot", 1, "u", 1, "")] and thin.where("a is null").count() == 1 and thin.where("b < 300 and a <> 'hot'").count() == 600
    assert thin_repeats(df.where("a <> 'hot'"), ["a", "b"])[0].count() == 600
    assert thin_repeats(df.select("a", "b"), ["a", "b"])[0].count() == 602
    left, right = df, spark.createDataFrame([("hot", 1, "w", 1, "")], SCHEMA)
    assert diff_copies(left, right, ["a", "b"], ["x"]).where("a = 'hot'").collect()[0][2:] == ("x", "u", "w")


def test_tasks_follow_the_rows(spark):
    df = spark.createDataFrame([], "a string, b int")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(df, 10) == few and tasks_for(df, 48_000_000) == -(-48_000_000 * 28 // (2 * 64 * 1024 * 1024)) and tasks_for(df, 10**12) > 200_000


def test_what_is_written_goes_with_the_application(spark):
    from pathlib import Path

    at = fresh_path(spark, "x")
    spark.range(3).write.parquet(at)
    assert spark.read.parquet(at).count() == 3
    release(spark)
    assert not Path(at.removeprefix("file://")).parent.exists()
    assert fresh_path(spark, "x") != at
