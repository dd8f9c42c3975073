"""Exact and near duplicates, and greedy selection by earlier kept rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import alike


def checkpointed(spark: SparkSession) -> None:
    """A cluster names its shared folder in spark.checkpoint.dir; a local folder is set only where none is named
    and the master is this machine."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-checkpoint-"))


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_by_aggregate(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """As first_of, as a partial aggregate: a key with a third of all rows meets no single task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def shingle_keys(df: DataFrame, key: str, text: str, n: int = 8) -> DataFrame:
    """(id, k1, k2): each text's shingle set, by 128 bits; written once, for several readers."""
    checkpointed(df.sparkSession)
    return alike.signatures(df, key, text, n).checkpoint()


def shingle_pairs(df: DataFrame, key: str, text: str, n: int = 8, least: float = 0.6, keys: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard), a < b: pairs whose n-word shingle sets have at least that Jaccard likeness (see alike).
    Texts that are equal as shingle sets are one set, by its smallest id. Ids are whole numbers, each in one row."""
    keys = keys or shingle_keys(df, key, text, n)
    return alike.alike(df, key, text, n, least, keys.groupBy("k1", "k2").agg(F.min("id").alias("first")))


def shingle_classes(df: DataFrame, key: str, text: str, n: int = 8, keys: DataFrame | None = None) -> DataFrame:
    """(id, first): for each text the smallest id of those with an equal set of n-word shingles, which
    is the id that stands for them in shingle_pairs."""
    each = keys or shingle_keys(df, key, text, n)
    return each.join(each.groupBy("k1", "k2").agg(F.min("id").alias("first")), ["k1", "k2"]).select("id", "first")


def greedy_dropped(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id): texts dropped because an earlier kept text is alike: of equal shingle sets all but the
    first, and all of a set whose first is dropped."""
    keys = shingle_keys(df, key, text)
    gone = greedy_kept(shingle_pairs(df, key, text, keys=keys)).select(F.col("b").alias("first"), F.lit(True).alias("gone"))
    return shingle_classes(df, key, text, keys=keys).join(gone, "first", "left").where("id <> first OR gone").select("id")


def greedy_kept(pairs: DataFrame, local_pairs: int = 1 << 16) -> DataFrame:
    """(b): rows dropped because an earlier *kept* row a is alike. Rounds, until no row is undecided: a row
    is kept once all its earlier neighbours are dropped, and dropped once one of them is kept. A round
    settles two links of a chain, so the last `local_pairs` open pairs are settled in order at once."""
    checkpointed(pairs.sparkSession)
    open_ = pairs.select("a", "b").distinct().checkpoint()
    dropped = open_.select("b").limit(0)
    rounds = 0
    while (left := open_.limit(local_pairs + 1).count()) > local_pairs:
        kept = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = open_.join(kept, "a", "left_semi").select("b").distinct().checkpoint()
        dropped = dropped.union(gone)
        rest = open_.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti")
        open_ = rest.join(kept, "a", "left_anti").checkpoint()
        rounds += 1
        if rounds % 20 == 0:  # else the plan grows with the rounds
            dropped = dropped.checkpoint()
    if left:
        gone_ = set()
        for a, b in sorted(map(tuple, open_.collect()), key=lambda r: r[::-1]):
            if a not in gone_:
                gone_.add(b)
        dropped = dropped.union(pairs.sparkSession.createDataFrame([(b,) for b in sorted(gone_)], dropped.schema))
    return dropped.distinct()
