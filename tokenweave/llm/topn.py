"""The N best items of every group, by merging sorted runs.

1. Scored items, unique per (group, item), are spread over tasks without regard to groups, so a group of
   any size is shared by all of them. Each task sorts its items by group and score and stores them as one run
   (a Parquet file of small row groups) in the shared folder.
2. Groups are bucketed by ranges of a 32-bit hash, the leading sort key (groups that share a hash stay apart by what
   follows it). From the runs' footers a table of
   (bucket, run, row groups) is built, so that a merge task reads what its bucket needs and no more.
3. One task per bucket merges its runs with a loser tree. After N items of a group every run seeks to its
   next group: past rows by galloping, past row groups by their statistics, unread.

With more runs than max_fan_in the runs are first merged in sets of that many, each set keeping N items
a group, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import fresh_path

_SPAN = 1 << 32
_LOW = -(1 << 31)


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    for scheme in ("s3a://", "s3n://"):  # the same store by the name this reader knows
        if path.startswith(scheme):
            path = "s3://" + path[len(scheme):]
    return fs.FileSystem.from_uri(path)


def _parquet(path: str):
    import pyarrow.parquet as pq

    system, name = _open(path)
    return pq.ParquetFile(system.open_input_file(name))


class _Lowest:
    """Stands for null: before every value."""

    def __lt__(self, other):
        return other is not self

    def __le__(self, other):
        return True

    def __gt__(self, other):
        return False

    def __ge__(self, other):
        return other is self

    def __reduce__(self):
        return "LOWEST"


LOWEST = _Lowest()


class Run:
    """A cursor over one sorted run, within the hashes low to high: rows (hash, group.., null score, -score, ties..).

    key is the current row, None at the end; its first `groups` parts are its group.
    """

    def __init__(self, path: str, row_groups: list[tuple[int, int, int]], columns: list[str], groups: int, low: int, high: int):
        self.path, self.columns, self.groups, self.low, self.high = path, columns, groups, low, high
        self.left = sorted(row_groups)
        self.file = None
        self.rows: list[tuple] = []
        self.at, self.n, self.unread = 0, 0, 0
        self.key: tuple | None = None
        self._load(None)

    def _load(self, beyond: int | None) -> None:
        """Reads the next row group, but those whose hashes all lie before `beyond` are passed by unread."""
        while self.left:
            no, _, hi = self.left.pop(0)
            if beyond is not None and hi < beyond:
                self.unread += 1
                continue
            if self.file is None:
                self.file = _parquet(self.path)
            data = self.file.read_row_group(no, columns=self.columns)
            hashes = data.column(0).to_numpy()
            first, end = np.searchsorted(hashes, self.low, "left"), np.searchsorted(hashes, self.high, "right")
            if end < len(hashes):
                self.left = []
            if first < end:
                lists = [[LOWEST if v is None else v for v in c.to_pylist()] if c.null_count else c.to_pylist() for c in data.slice(first, end - first).columns]
                self.rows = list(zip(*lists))
                self.at, self.n, self.key = 0, len(self.rows), self.rows[0]
                return
        self.file, self.rows, self.key = None, [], None

    def step(self) -> None:
        self.at += 1
        if self.at < self.n:
            self.key = self.rows[self.at]
        else:
            self._load(None)

    def seek_past(self, group: tuple) -> None:
        """To the first row of another group, by doubling steps and then halving them."""
        g, rows = self.groups, self.rows
        while self.key is not None and self.key[:g] == group:
            step, low = 1, self.at
            while low + step < self.n and rows[low + step][:g] == group:
                low += step
                step *= 2
            high = min(self.n, low + step)
            while high - low > 1:
                mid = (low + high) // 2
                if rows[mid][:g] == group:
                    low = mid
                else:
                    high = mid
            self.at = high
            if high < self.n:
                self.key = rows[high]
            else:
                self._load(group[0])
                rows = self.rows


class LoserTree:
    """The smallest of many cursors; after a change of the winner only its path is replayed."""

    def __init__(self, runs: list):
        self.runs, self.k = runs, len(runs)
        self.tree = [-1] * max(1, self.k)
        winners = [*([-1] * self.k), *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.runs[a], self.runs[b]
        if y.key is None:
            return True
        return x.key is not None and (x.key <= y.key if a < b else x.key < y.key)

    def top(self):
        return self.runs[self.tree[0]] if self.k else None

    def replay(self, leaf: int | None = None) -> None:
        if self.k < 2:
            return
        winner = self.tree[0] if leaf is None else leaf
        node = (winner + self.k) // 2
        while node:
            if self._before(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner


def merge_top(runs: list, n: int) -> Iterator[tuple[tuple, int]]:
    """(row, place) of the first n rows of each group, over runs sorted alike."""
    tree = LoserTree(runs)
    group, place = None, 0
    while tree.k and (head := tree.top()).key is not None:
        row = head.key
        if row[: head.groups] != group:
            group, place = row[: head.groups], 0
        if place < n:
            place += 1
            yield row, place
            head.step()
        else:
            head.seek_past(group)
        tree.replay()


def top_per_group(items: DataFrame, group: list[str], score: str, ties: list[str], n: int, buckets: int | None = None, max_fan_in: int = 128, row_group_rows: int = 32768) -> DataFrame:
    """group.., place (from 1), ties.., score: the n rows of each group with the highest score.

    Ties go to the smaller values of `ties`, in their order, text by code point. Nulls: a null group part
    is a group of its own, a null tie sorts first, a null score last. Rows alike in group and ties all take
    places, in no settled order: make items unique before. Empty input gives no row. score must be a number.
    Extra columns are not read; names may be any but `place`. Runs are written when this is called.
    """
    spark = items.sparkSession
    if "place" in {*group, *ties, score}:
        raise ValueError("rename the column place")
    at = lambda c: F.col(f"`{c}`")
    gs, ts = [f"g{i}" for i in range(len(group))], [f"t{i}" for i in range(len(ties))]
    shaped = items.select(*(at(c).alias(a) for c, a in zip(group, gs)), (-at(score)).alias("s"), at(score).isNull().alias("z"), *(at(c).alias(a) for c, a in zip(ties, ts)))
    columns = ["h", *gs, "z", "s", *ts]
    runs = shaped.withColumn("h", F.hash(*gs)).select(*columns).sortWithinPartitions(*columns)
    kinds = dict(runs.dtypes)
    g = 1 + len(gs)
    if max_fan_in < 2:
        raise ValueError("max_fan_in must be at least 2")
    if buckets is None:
        buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = -(-_SPAN // buckets)

    def stored(df: DataFrame, label: str) -> tuple[str, list[str]]:
        path = fresh_path(spark, label)
        df.write.option("parquet.block.row.count.limit", row_group_rows).option("compression", "zstd").option("parquet.compression.codec.zstd.level", 6).parquet(path)
        return path, sorted(spark.read.schema(df.schema).parquet(path).inputFiles())

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for no, path in batch.itertuples(index=False, name=None):
                meta = _parquet(path).metadata
                for k in range(meta.num_row_groups):
                    stats = meta.row_group(k).column(0).statistics
                    rows.append((no, path, k, stats.min, stats.max))
            yield pd.DataFrame(rows, columns=["no", "path", "rg", "lo", "hi"])

    def plan(files: list[str], fan_in: int, sets: int) -> DataFrame:
        """One row and partition per merge: the row groups that its bucket needs from its set of at most fan_in runs."""
        listed = spark.createDataFrame(list(enumerate(files)), "no int, path string").repartition(min(len(files), 4 * buckets))
        found = listed.mapInPandas(footers, "no int, path string, rg int, lo long, hi long")
        of = lambda c: F.expr(f"cast(floor((cast({c} as decimal(20,0)) - {_LOW}) / {width}) as int)")
        spread = found.withColumn("bucket", F.explode(F.sequence(of("lo"), of("hi"))))
        run = F.dense_rank().over(Window.partitionBy("bucket").orderBy("no")) - 1
        placed = spread.withColumn("set_no", F.floor(run / fan_in).cast("int"))
        grouped = placed.groupBy("bucket", "set_no").agg(F.collect_list(F.struct("path", "rg", "lo", "hi")).alias("parts"))
        return grouped.repartitionById(buckets * sets, F.col("bucket") * sets + F.col("set_no"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, parts in zip(batch.column("bucket").to_pylist(), batch.column("parts").to_pylist()):
                low = _LOW + bucket * width
                by: dict[str, list] = {}
                for p in parts:
                    by.setdefault(p["path"], []).append((p["rg"], p["lo"], p["hi"]))
                runs = [Run(path, rgs, columns, g, low, low + width - 1) for path, rgs in sorted(by.items())]
                out = merge_top(runs, n)
                while block := list(islice(out, 20000)):
                    values = [*zip(*(row for row, _ in block)), [place for _, place in block]]
                    arrays = [pa.array([None if v is LOWEST else v for v in c], f.type) for c, f in zip(values, arrow)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    schema = T.StructType([*runs.schema.fields, T.StructField("place", T.IntegerType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    arrow = to_arrow_schema(schema)
    _, files = stored(runs, "runs")
    runs_each = len(files)  # per bucket, at most
    while runs_each > max_fan_in:
        runs_each = -(-runs_each // max_fan_in)
        merged = plan(files, max_fan_in, runs_each).mapInArrow(merge, schema).drop("place")
        _, files = stored(merged, "runs")
    back = [*(F.col(a).alias(c) for c, a in zip(group, gs)), "place", *(F.col(a).alias(c) for c, a in zip(ties, ts)), (-F.col("s")).cast(kinds["s"]).alias(score)]
    if not files:
        return spark.createDataFrame([], schema).select(*back)
    return plan(files, max(1, runs_each), 1).mapInArrow(merge, schema).select(*back)
