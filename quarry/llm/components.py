"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (u long, v long), in any direction and number -> (node, component): the smallest node
    that can be reached. Nodes without an edge to another node are not returned.

    Every round halves the depth of the trees that the edges form. All steps are joins and
    min-aggregates, so neither links nor components are gathered anywhere; a hub's join key is a
    plain equi-join that adaptive execution can split. Each round is cut by checkpoint(), which
    survives lost executors."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        e, after = small, _state(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
