"""Shared plumbing of the training-data operators.

Every operator reads only the columns it names, so further columns of a table, whatever they are
called, never clash with the operator's own. A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string never null), nothing else."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key() -> list[Column]:
    """A 128-bit key of (doc_id, text). Rows that share it are whole copies, ids included, and
    get the same result, so tables without unique or non-null ids still join correctly."""
    return [F.xxhash64(F.col("doc_id"), F.col("text")).alias("k1"), F.xxhash64(F.col("text"), F.lit(7), F.col("doc_id"), F.length("text")).alias("k2")]


def packed(docs: DataFrame) -> DataFrame:
    """(row struct of all columns, doc_id long, text string never null, k1, k2: a key of the row): the caller's
    columns cannot clash with an operator's own."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return row.select("row", F.col("row")["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.col("row")["text"].cast("string"), F.lit("")).alias("text")).select("*", *row_key())


def one_of_each(rows: DataFrame, stay: DataFrame) -> DataFrame:
    """Of packed() rows those whose key (k1, k2) `stay` has, of whole copies one, unpacked."""
    names = rows.schema["row"].dataType.names
    return rows.select("row", "k1", "k2").join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*(F.col("row")[c].alias(c) for c in names))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into runs of rows of about `limit` text bytes (one row at least)."""
    import numpy as np

    if batch.num_rows == 0:
        return
    arr = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, int(off[at]) + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """A cluster names its shared folder in spark.checkpoint.dir; only where none is named and the
    master is this machine (tests, a laptop) a local folder is set."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-checkpoint-"))
