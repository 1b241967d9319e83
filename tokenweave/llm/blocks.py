"""A side that every worker holds, taken in blocks, so that neither workers nor the driver hold more than one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TypeVar

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..session import cut

T = TypeVar("T")
#: Distinct values that a task looks up; a lookup takes some 0.1 ms.
VALUES_A_TASK = 10_000


def each_block(spark: SparkSession, blocks: Iterator[T], scan: Callable[[Broadcast], DataFrame], label: str) -> Iterator[DataFrame]:
    """scan() of each block, which it gets as a broadcast. One block's result is lazy. Of several, each is written
    to the shared folder and its broadcast let go before the next block is made."""
    block, following = next(blocks), next(blocks, None)
    if following is None:
        yield scan(spark.sparkContext.broadcast(block))
        return
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        yield cut(scan(shared), label)
        shared.destroy()
        block, following = following, None
        if block is not None:
            following = next(blocks, None)


def by_block(spark: SparkSession, blocks: Iterator[T], scan: Callable[[Broadcast], DataFrame], label: str) -> list[DataFrame]:
    return list(each_block(spark, blocks, scan, label))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def spread(values: DataFrame, label: str, each: int = VALUES_A_TASK) -> DataFrame:
    """values, written down and counted, over as many tasks as their number calls for and the cluster has cores, so that
    the planner, which sees only how few bytes they are, does not put them into one or two."""
    stored = cut(values, label)
    tasks = max(values.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // each))
    return stored.repartition(tasks)
