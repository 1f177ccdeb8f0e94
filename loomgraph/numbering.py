"""Running numbers over sorted rows without a window: ranges are sorted and numbered where they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(rows: DataFrame, key: list[str], order: list[Column], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with `_n`, which rises in key and order: the range in its upper bits, the place in the range in the lower 33.

    Rows are dealt by ranges of key and order (and of a hash of the row and its place in the input, so that equal rows spread too), sorted
    in their range and written once. The order of rows that are equal in `order` is that of their hash.
    """
    plain = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    by = [*[F.asc(c) for c in key], *order, F.xxhash64(*[F.col(c) for c in plain]), F.col("_place")]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    return cut(placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_place").withColumn("_n", F.monotonically_increasing_id()))


def running_number(rows: DataFrame, order: list[Column], name: str, cut: Callable[[DataFrame], DataFrame], key: list[str] | None = None) -> DataFrame:
    """rows with a number from 1 on in the given order, within each key if there is one (see in_ranges).

    What the ranges before hold of the key is added up from one row for each range, or each key and range, so nothing gathers a key.
    """
    key = key or []
    numbered = in_ranges(rows, key, order, cut)
    part = F.shiftright("_n", 33)
    if not key:
        starts, before = {}, 0
        for r in numbered.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a range
            starts[r.p], before = before, before + r[1]
        offset = F.lit(0)
        if starts:
            offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), part)
        return numbered.select(*rows.columns, (offset + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
    first = numbered.groupBy(*key, part.alias("_p")).agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    return _within_keys(numbered, first, key, part, name, rows.columns)


def _within_keys(numbered: DataFrame, first: DataFrame, key: list[str], part: Column, name: str, columns: list[str]) -> DataFrame:
    """Numbers within keys: a key's rows in earlier ranges, plus the row's place among the key's rows in its own range."""
    earlier = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    joined = numbered.withColumn("_p", part).alias("n").join(starts.alias("s"), [*same, F.col("n._p") == F.col("s._p")])
    return joined.select(*[F.col(f"n.{c}") for c in columns], (F.col("_before") + F.col("n._n") - F.col("_first") + 1).alias(name))
