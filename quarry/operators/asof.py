"""As-of and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """For each left row the `value` of the last right row of its group with right.at <= left.at, else null:
    one shuffle and one sort of both, no range join. Equal times match; of right rows with one time
    the largest value counts."""
    rest = [c for c in left.columns if c not in (*by, at)]
    l = left.select(*by, at, F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*by, at, F.lit(0).alias("_kind"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(at, "_kind", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionAll(r).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_kind = 1").select(*by, at, "_row.*", F.col("_last").alias(out))


def prefix_map(source: Column, target: Column) -> Column:
    """Within a row: for each source span (s, e) the index of the last non-empty target span that ends no
    later; -1 where there is none or the source span is empty."""

    def last(x: Column) -> Column:
        ends = F.transform(target, lambda y, i: F.when((y["e"] > y["s"]) & (y["e"] <= x["e"]), i).otherwise(-1))
        return F.when(x["e"] > x["s"], F.coalesce(F.array_max(ends), F.lit(-1))).otherwise(F.lit(-1))

    return F.transform(source, last)


def overlap_max(spans: DataFrame, labels: DataFrame, by: list[str], width: int, strength: str) -> DataFrame:
    """For each span (id, s, e) the largest strength of the labels (a, b) that overlap it: s < b and
    e > a. Both sides are cut into cells of `width`, so the join is an equi-join on (group, cell)."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    x = spans.where("e > s").withColumn("_cell", cells("s", "e"))
    y = labels.where("b > a").withColumn("_cell", cells("a", "b"))
    return x.join(y, [*by, "_cell"]).where("s < b AND e > a").groupBy(*by, "id").agg(F.max(strength).alias(strength))
