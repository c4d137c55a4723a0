"""Ordered work on keys of any size: rows are cut by ranges of their order, each range of a key is worked on apart, and what one leaves is carried to the next.

A window over a whole key is one task's work, however large the key is. Here windows go over (key, range), and only one row for each of these is
looked at by key. Rows are matched by structs, which are equal where their fields are, nulls included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def cuts(rows: DataFrame, order: Column, parts: int = PARTS) -> list:
    """Values of the order that cut the rows into about equal parts: at most parts - 1 numbers."""
    shares = [k / parts for k in range(1, parts)]
    return sorted(set(rows.agg(F.percentile_approx(order, shares, 10_000)).first()[0] or []))


def range_of(order: Column, edges: list) -> Column:
    """How many edges are at or below the value, by halving; -1 for null, which comes first."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order < F.lit(edges[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(order.isNull(), -1).otherwise(among(0, len(edges)))


def ranged(rows: DataFrame, keys: list[str], order: Column, parts: int = PARTS) -> DataFrame:
    """rows with _key (the keys), _range (of the order) and _at (both)."""
    edges = cuts(rows, order, parts)
    return rows.select("*", F.struct(*keys).alias("_key"), range_of(order, edges).alias("_range")).withColumn("_at", F.struct("_key", "_range"))


def within(*order: Column | str) -> Window:
    """Over one range of a key, up to the row."""
    return Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier() -> Window:
    """Over the ranges of a key before a range, for tables with one row for each range."""
    return Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def later() -> Window:
    """Over the ranges of a key behind a range."""
    return Window.partitionBy("_key").orderBy("_range").rowsBetween(1, Window.unboundedFollowing)


def carried(rows: DataFrame, **sums: Column) -> DataFrame:
    """_at and, by name, the sum of an aggregate over all earlier ranges of the key (0 for the first)."""
    own = rows.groupBy("_at", "_key", "_range").agg(*(c.alias(f"_own_{name}") for name, c in sums.items()))
    return own.select("_at", *(F.coalesce(F.sum(f"_own_{name}").over(earlier()), F.lit(0)).alias(name) for name in sums))


def row_numbers(rows: DataFrame, keys: list[str], by: Column, order: list, name: str, parts: int = PARTS) -> DataFrame:
    """rows with their number from 1 within the keys, by `order`, whose first part is `by`, a number or a time in microseconds."""
    marked = ranged(rows, keys, by, parts)
    before = carried(marked.select("_at", "_key", "_range"), _before=F.count("*"))
    own = F.row_number().over(Window.partitionBy("_at").orderBy(*order))
    return marked.join(before, "_at").withColumn(name, own + F.col("_before")).drop("_at", "_key", "_range", "_before")
