"""Operators over a total order of rows that never sort all rows in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_buckets(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Adds `_bucket`: ranges of the numeric key of about equal counts, numbered in its order.
    The boundaries are quantiles, so they are the same however often the plan runs. Null keys
    are no rows of the order and go to the first range."""
    n = n or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_x", F.coalesce(F.col(key).cast("double"), F.lit(-float("inf"))))
    cuts = d.approxQuantile("_x", [i / n for i in range(1, n)], 0.25 / n)
    inner = sorted({c for c in cuts if abs(c) != float("inf")} or {0.0})
    return Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_x", outputCol="_b").transform(d).withColumn("_bucket", F.col("_b").cast("int")).drop("_x", "_b")


def prefix_sums(df: DataFrame, key: str, values: dict[str, str], ties: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds each `out` of values {out: column}: the column's sum over all rows of the same `by` before this one in the
    order of key and ties. Sums run within ranges of the key, so that a group of any size spreads over
    tasks; the totals of the ranges before, one row for each group and range, are added."""
    by = by or []
    d = range_buckets(df, key)
    order = [F.col(key), *map(F.col, ties or [])]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = upto(Window.partitionBy(*by, "_bucket").orderBy(*order))
    totals = d.groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_bucket").alias("_of")).agg(*(F.sum(v).alias(f"_t{i}") for i, v in enumerate(values.values())))
    across = upto((Window.partitionBy(*(f"_by{i}" for i in range(len(by)))) if by else Window).orderBy("_of"))
    before = totals.select(*(f"_by{i}" for i in range(len(by))), "_of", *((F.sum(f"_t{i}").over(across) - F.col(f"_t{i}")).alias(f"_b{i}") for i in range(len(values))))
    d = d.withColumns({out: F.sum(v).over(own) - F.col(v) for out, v in values.items()})
    same = F.col("_bucket") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    d = d.join(before if by else F.broadcast(before), same)  # without groups: a row a range
    return d.withColumns({out: F.col(out) + F.col(f"_b{i}") for i, out in enumerate(values)}).drop("_bucket", *before.columns)


def prefix_sum(df: DataFrame, key: str, value: str, out: str, ties: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows (of the same `by`) before this one in the order of key and ties."""
    return prefix_sums(df, key, {out: value}, ties, by)


def row_index(df: DataFrame, key: str, out: str = "idx", ties: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds `out`: the row's number, from 0, in the order of key and ties (within its `by`)."""
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", out, ties, by).drop("_one")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, names): exact quantiles of each group with linear interpolation, nulls aside. Distinct values are counted
    first and cumulated in ranges, so no buffer holds a group's values and no window a whole group."""
    d = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    d = prefix_sum(d, "_v", "_n", "_first", by=by)
    total = d.groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by))).agg(F.sum("_n").alias("_total"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    d = d.join(total if by else F.broadcast(total), same)
    found = []
    for i, p in enumerate(shares.values()):
        at = (F.col("_total") - 1) * p
        value_at = lambda k: F.min(F.when(F.col("_first") + F.col("_n") > k, F.col("_v")))
        found += [value_at(F.floor(at)).alias(f"_lo{i}"), value_at(F.ceil(at)).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_part{i}")]
    g = d.groupBy(*by).agg(*found)
    return g.select(*by, *((F.col(f"_lo{i}") + F.col(f"_part{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n) for i, n in enumerate(shares)))
