import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tokenweave.llm.topn import LOWEST, LoserTree, merge_top, top_per_group


class ListRun:
    def __init__(self, rows, groups=1):
        self.rows, self.at, self.groups, self.seeks = rows, 0, groups, 0

    @property
    def key(self):
        return self.rows[self.at] if self.at < len(self.rows) else None

    def step(self):
        self.at += 1

    def seek_past(self, group):
        self.seeks += 1
        while self.key is not None and self.key[: self.groups] == group:
            self.at += 1


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_sorts(k):
    rng = random.Random(k)
    runs = [ListRun(sorted((rng.randrange(50), i) for _ in range(rng.randrange(30)))) for i in range(k)]
    expected = sorted(x for r in runs for x in r.rows)
    tree, got = LoserTree(runs), []
    while tree.k and (top := tree.top()).key is not None:
        got.append(top.key)
        top.step()
        tree.replay()
    assert got == expected


def test_merge_seeks_after_n():
    runs = [ListRun([("g", i) for i in range(r, 1000, 2)] + [("h", r)]) for r in range(2)]
    assert [(row, p) for row, p in merge_top(runs, 3)] == [(("g", 0), 1), (("g", 1), 2), (("g", 2), 3), (("h", 0), 1), (("h", 1), 2)]
    assert sum(r.seeks for r in runs) == 2


def test_null_sorts_first():
    assert LOWEST < "a" and not LOWEST < LOWEST and "a" > LOWEST and (LOWEST, 2) < ("", 1)


def brute(rows, n):
    groups = defaultdict(list)
    for g, s, a, b in rows:
        groups[g].append((s is None, -(s or 0), (a is not None, a or ""), (b is not None, b or ""), s, a, b))
    return sorted(((g, i, s, a, b) for g, items in groups.items() for i, (*_, s, a, b) in enumerate(sorted(items)[:n], 1)), key=str)


@pytest.mark.parametrize("fan_in", [128, 3, 2])
def test_against_brute_force(spark, fan_in):
    rng = random.Random(3)
    seen = {}
    for _ in range(4000):
        g = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", None, "long" * 3000, str(rng.randrange(300))])
        seen[g, rng.choice([None, "", "p", "π", str(rng.randrange(200))]), rng.choice([None, "x", "y"])] = rng.choice([None, 1, 2, 2, 3, -5])
    rows = [(g, s, a, b) for (g, a, b), s in seen.items()]
    df = spark.createDataFrame(rows, "h string, s long, t0 string, z string").withColumn("extra", F.lit(1)).repartition(9)
    got = top_per_group(df, ["h"], "s", ["t0", "z"], 3, buckets=5, max_fan_in=fan_in, row_group_rows=50)
    assert got.columns == ["h", "place", "t0", "z", "s"]
    assert sorted(((r.h, r.place, r.s, r.t0, r.z) for r in got.collect()), key=str) == brute(rows, 3)


def test_repeated_items_and_empty_input(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 1, "a")], "g string, s int, t string")
    assert [(r.place, r.t) for r in top_per_group(df, ["g"], "s", ["t"], 5).orderBy("place").collect()] == [(1, "a"), (2, "a")]
    assert top_per_group(df.limit(0), ["g"], "s", ["t"], 3).count() == 0
    with pytest.raises(ValueError):
        top_per_group(df.withColumnRenamed("t", "place"), ["g"], "s", ["place"], 3)


def test_groups_that_share_a_hash_stay_apart():
    runs = [ListRun([(7, "a", 1), (7, "a", 3), (7, "a", 5), (7, "b", 1), (9, "a", 1)], 2), ListRun([(7, "a", 2), (7, "b", 0), (7, "c", 4)], 2)]
    assert [(*row, place) for row, place in merge_top(runs, 2)] == [(7, "a", 1, 1), (7, "a", 2, 2), (7, "b", 0, 1), (7, "b", 1, 2), (7, "c", 4, 1), (9, "a", 1, 1)]
