"""Keys that are repeated so often that a shuffle by key would send too many rows to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, tasks_for

#: Share of rows looked at, and the rows of one key among them below which it can overload no task.
FRACTION, NOISE = 0.01, 100


def thin_repeats(df: DataFrame, keys: list[str], fraction: float = FRACTION, noise: int = NOISE) -> tuple[DataFrame, int]:
    """df, where rows of a hot key are one row: the least by the other columns, in their order; and about how many rows df has.

    A key is hot if it has more than a quarter of the rows that a task gets on average. A sample of the keys (whose size
    only decides how surely a hot key is seen) tells which; without any, df is given back as it is. Rows of hot keys are
    combined within each task before they are shuffled, so that a key costs one row a task, be its rows alike or not.
    Other keys keep all their rows.
    """
    at = [F.col(f"`{k}`") for k in keys]
    named = [f"__h{i}" for i in range(len(at))]
    looked_at = df.select(*(c.alias(h) for c, h in zip(at, named))).sample(fraction=fraction, seed=17)
    counts = looked_at.groupingSets([named, []], *named).agg(F.count("*").alias("n"), F.grouping_id().alias("whole"))
    top = counts.where(f"whole > 0 or n >= {noise}").orderBy(F.desc("whole"), F.desc("n")).limit(1 + BROADCAST_ROWS).collect()
    seen = top[0].n if top else 0
    rows = int(seen / fraction)
    # no more than BROADCAST_ROWS keys can have that share, so the limit above leaves none out
    share = 1 / min(BROADCAST_ROWS, 4 * tasks_for(df, rows))
    found = [tuple(r)[:-2] for r in top[1:] if r.n >= share * seen]
    if not found:
        return df, rows
    listed = F.broadcast(df.sparkSession.createDataFrame(found, looked_at.schema))
    same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(h)) for c, h in zip(at, named)))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    hot = df.join(listed, same, "left_semi")
    thin = hot.groupBy(*at).agg(F.min(F.struct(*rest)).alias("__m")).select(*at, "__m.*") if rest else hot.distinct()
    return df.join(listed, same, "left_anti").unionByName(thin.select(*(F.col(f"`{c}`") for c in df.columns))), rows
