"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0 (a null id: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """The documents (doc_id, ...) of at most `rows_per_class` labelled rows of each class that are
    not held out, with `y`; and how many rows of each class there are. The rows taken are those with the
    least hash of their id, so the choice depends on neither order nor partitions; of documents that
    share an id the least one counts, so the sample stays bounded whatever repeats."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(11))

    def least(y: int) -> DataFrame:
        # a hash bound that leaves some more than the rows wanted, so that no task gathers a top list of each partition
        share = (rows_per_class + 10 * rows_per_class**0.5 + 100) / max(1, sizes.get(y, 0))
        some = known.where(F.col("y") == y)
        some = some if share >= 1 else some.where(order < int(share * 2**64) - 2**63)
        return some.orderBy(order, "doc_id").limit(rows_per_class)

    taken = least(0).unionAll(least(1))
    rest = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(taken), "doc_id")  # at most 2 * rows_per_class ids are broadcast
    return found.groupBy("doc_id", "y").agg(F.min(F.struct(*rest)).alias("d")).select("doc_id", *(F.col("d")[c].alias(c) for c in rest), "y"), sizes
