"""Differences between two copies of a table, key by key and field by field.

Both copies go through one range partitioner, so they share their split points; each partition is
sorted by key, and one streaming pass per partition merges the two sides. No group is ever held:
the merge keeps at most the last row of each side between Arrow batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import tasks_for
from .repeats import thin_repeats


def _differs(a: pa.Array, b: pa.Array) -> pa.Array:
    """a and b differ, where null equals null only."""
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))


def _changed(batch: pa.Table, columns: list[str]) -> pa.Array:
    """True for each row but the first that differs from the row before in one of columns."""
    out = None
    for c in columns:
        col = batch[c].combine_chunks()
        d = _differs(col[1:], col[:-1])
        out = d if out is None else pc.or_(out, d)
    return out


def _as_array(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _same_text(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and unicodedata.normalize("NFC", a) == unicodedata.normalize("NFC", b)


def merge_sorted(batches: Iterator[pa.RecordBatch], keys: int, fields: list[tuple[str, bool]], missing: tuple[str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge of rows sorted by (k0.., side): columns k0.., side, f0..

    fields: name and whether it is text (compared under canonical composition).
    """
    ks = [f"k{i}" for i in range(keys)]
    carry: pa.Table | None = None

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows: the first row of each (key, side), whole keys only."""
        n = rows.num_rows
        if not n:
            return
        starts = pa.concat_arrays([pa.array([True]), _as_array(_changed(rows, ks))]) if n > 1 else pa.array([True])
        ends = pa.concat_arrays([starts[1:], pa.array([True])])
        lone = pc.and_(starts, ends)
        side = _as_array(rows["side"])
        only = rows.filter(lone)
        if only.num_rows:
            diff = pc.if_else(pc.equal(_as_array(only["side"]), 0), missing[0], missing[1])
            null = pa.nulls(only.num_rows, pa.string())
            yield from _out(only, diff, null, null)
        first = pc.indices_nonzero(pc.and_(starts, pc.invert(ends)))
        if not len(first):
            return
        left, right = rows.take(first), rows.take(pc.add(first, pa.scalar(1, first.type)))
        assert side is not None
        for i, (name, text) in enumerate(fields):
            a, b = _as_array(left[f"f{i}"]), _as_array(right[f"f{i}"])
            at = pc.indices_nonzero(_differs(a, b))
            if text and len(at):
                at = pa.array([j for j in at.to_pylist() if not _same_text(a[j].as_py(), b[j].as_py())], pa.uint64())
            if len(at):
                yield from _out(left.take(at), pa.array([name] * len(at)), pc.cast(a.take(at), pa.string()), pc.cast(b.take(at), pa.string()))

    def _out(rows: pa.Table, diff: pa.Array, a: pa.Array, b: pa.Array) -> Iterator[pa.RecordBatch]:
        columns = [_as_array(rows[k]) for k in ks] + [_as_array(diff), _as_array(a), _as_array(b)]
        yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        if table.num_rows > 1:
            table = table.filter(pa.concat_arrays([pa.array([True]), _as_array(_changed(table, [*ks, "side"]))]))
        n = table.num_rows
        last = n - 1
        if n > 1 and not _changed(table.slice(n - 2), ks)[0].as_py():
            last = n - 2
        yield from settle(table.slice(0, last))
        carry = table.slice(last).combine_chunks()
    if carry is not None:
        yield from settle(carry)


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], missing_in_right: str = "missing_in_right", missing_in_left: str = "missing_in_left", partitions: int | None = None) -> DataFrame:
    """One row per key held by one side only and per field that differs: keys.., diff, left_value, right_value.

    * Text counts as equal if it is equal under canonical composition; null equals null only; keys are
      compared as stored, and a null key part equals a null one.
    * Rows that repeat a key count once; should they disagree, the one first in field order stands for its side.
    * Rows of a key with very many copies, alike or not, are combined within each task before the shuffle.
    * partitions: by default as many as the number of rows calls for.
    * An empty copy makes every key of the other one missing; two empty copies give no row.
    * Extra columns are not read; columns may bear any names, those used inside included.
    """
    if not keys or not fields:
        raise ValueError("keys and fields must not be empty")
    clash = {"diff", "left_value", "right_value"} & set(keys)
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}: the result has columns of these names")
    types = dict(left.dtypes)
    for c in [*keys, *fields]:
        if dict(right.dtypes)[c] != types[c]:
            raise ValueError(f"column {c} is {types[c]} on the left, {dict(right.dtypes)[c]} on the right")

    def shaped(df: DataFrame, side: int) -> DataFrame:
        at = lambda c: F.col(f"`{c}`")
        return df.select(*(at(c).alias(f"k{i}") for i, c in enumerate(keys)), F.lit(side).cast("tinyint").alias("side"), *(at(c).alias(f"f{i}") for i, c in enumerate(fields)))

    ks = [f"k{i}" for i in range(len(keys))]
    both, rows = thin_repeats(shaped(left, 0).unionByName(shaped(right, 1)), [*ks, "side"])
    ranged = both.repartitionByRange(partitions or tasks_for(both, rows), *ks)
    ordered = ranged.sortWithinPartitions(*ks, "side", *(f"f{i}" for i in range(len(fields))))
    out = T.StructType([*(T.StructField(k, left.schema[c].dataType) for k, c in zip(ks, keys)), *(T.StructField(n, T.StringType()) for n in ("diff", "left_value", "right_value"))])
    plain = [(name, types[name] == "string") for name in fields]
    missing = (missing_in_right, missing_in_left)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    n = len(keys)
    merged = ordered.mapInArrow(lambda batches: merge_sorted(batches, n, plain, missing, schema), out)
    return merged.select(*(F.col(k).alias(c) for k, c in zip(ks, keys)), "diff", "left_value", "right_value")
