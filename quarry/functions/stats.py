"""Rank statistics and evaluation metrics by group.

Ranks come from counts of distinct values, cumulated in ranges of the value within each group: no window runs
over a whole group, so a group of any size and of as many values spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import prefix_sum, prefix_sums


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, rank): each distinct value's count and average rank, from 1."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return prefix_sum(n, value, "n", "_first", by=by).withColumn("rank", F.col("_first") + (F.col("n") + 1) / 2).drop("_first")


def auroc(df: DataFrame, by: list[str], score: str, label: str, out: str = "auroc") -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives; null where a side is empty."""
    n = df.groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    r = prefix_sum(n, score, "_n", "_first", by=by).withColumn("_rank", F.col("_first") + (F.col("_n") + 1) / 2)
    g = r.groupBy(*by).agg(F.sum("_p").alias("_np"), F.sum(F.col("_n") - F.col("_p")).alias("_nn"), F.sum(F.col("_p") * F.col("_rank")).alias("_rs"))
    value = (F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2) / (F.col("_np") * F.col("_nn"))
    return g.select(*by, F.when((F.col("_np") > 0) & (F.col("_nn") > 0), value).alias(out))


def spearman(df: DataFrame, by: list[str], a: str, b: str, out: str = "rho", constant: float | None = None) -> DataFrame:
    """Correlation of average ranks; `constant` (null) where a side is constant or there are under three rows."""
    ra = average_ranks(df, by, a).select(*by, a, F.col("rank").alias("_ra"))
    rb = average_ranks(df, by, b).select(*by, b, F.col("rank").alias("_rb"))
    pairs = df.groupBy(*by, a, b).agg(F.count("*").alias("_n")).join(ra, [*by, a]).join(rb, [*by, b])
    s = lambda c: F.sum(F.col("_n") * c)
    x, y = F.col("_ra"), F.col("_rb")
    g = pairs.groupBy(*by).agg(F.sum("_n").alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    rho = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return g.select(*by, F.when((F.col("n") >= 3) & (vx > 1e-9) & (vy > 1e-9), rho).otherwise(F.lit(constant)).alias(out))


def auprc(df: DataFrame, by: list[str], score: str, label: str, key: str, out: str = "auprc") -> DataFrame:
    """Mean precision at the positives, by falling score; ties in the order of the key."""
    d = df.withColumns({"_falling": -F.col(score), "_one": F.lit(1)})
    d = prefix_sums(d, "_falling", {"_tp": label, "_k": "_one"}, [key], by)
    return d.groupBy(*by).agg((F.sum((F.col("_tp") + F.col(label)) / (F.col("_k") + 1) * F.col(label)) / F.nullif(F.sum(label), F.lit(0))).alias(out))


def calibration_error(df: DataFrame, by: list[str], p: str, y: str, bins: int = 10, out: str = "ece") -> DataFrame:
    """Expected gap of mean prediction and mean outcome over equal bins of [0, 1], the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = df.groupBy(*by, b.alias("_b")).agg(F.count("*").alias("_n"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("_d"))
    return g.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_d")) / F.sum("_n")).alias(out))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of the score interval of a share; null without observations."""
    p, n = k / n, n.cast("double")
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return tuple(F.when(n > 0, (mid + s * half) / (1 + z * z / n)) for s in (-1, 1))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from md5 of the parts: the same draw on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / float(1 << 32)
