"""Structured Streaming forms of the bounded-memory iterations: merged accumulators, resumable logs, budgets, readiness."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream: a shard is read once its file is there."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def moments(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean and population variance by key so far; the state has one row a key (output mode complete or update)."""
    x = F.col(value)
    return stream.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_"))


def once_per_key(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the delay: a log that can be replayed without repeats.
    The state of a key is dropped once the watermark has passed it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def budget(stream: DataFrame, by: str, value: str, at: str, delay: str, width: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Calls and spending by key in sliding windows, closed by the watermark (output mode append)."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width, step).alias("w"), by).agg(F.count("*").alias("calls"), F.sum(value).alias("spent"))


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what its in-memory table has (for tests and small reports)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.table(name)


def merge_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Appends each micro-batch's rows with new keys to a Parquet folder. A batch that is run again writes its own folder again, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            old = spark.read.parquet(path).where(F.col("batch") < number)
            fresh = fresh.join(old.select(*keys), keys, "left_anti")
        except Exception as e:  # the first batch: there is no folder yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def complete_documents(stream: DataFrame, key: str, window: str, windows: str, value: str) -> DataFrame:
    """(key, n, total): a document once all of its `windows` windows have come, whatever their order and however often;
    a pending document's state has its distinct window numbers and their sum, and goes once it is emitted."""

    def step(ids: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, total = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0.0)
        wanted = 0
        for b in batches:
            for w, n, v in zip(b[window], b[windows], b[value]):
                wanted = int(n)
                if w >= 0 and int(w) not in seen:
                    seen.add(int(w))
                    total += float(v)
        done = -1 in seen  # emitted before: only repeats follow
        if not done and wanted and len(seen) == wanted:
            yield pd.DataFrame({key: [ids[0]], "n": [wanted], "total": [total]})
            seen, total = {-1}, 0.0
        state.update((sorted(seen), total))

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, window, windows, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "seen array<long>, total double", "append", "NoTimeout")


class Uploader:
    """Hands results to `upload` in one background thread with at most `depth` waiting: put() blocks beyond that, and
    the first error is raised by the next put() or by close(), after which nothing more is uploaded."""

    def __init__(self, upload: Callable, depth: int = 1):
        self._queue: queue.Queue = queue.Queue(depth)
        self._error: BaseException | None = None
        self._thread = threading.Thread(target=self._run, args=(upload,), daemon=True)
        self._thread.start()

    def _run(self, upload: Callable) -> None:
        while (item := self._queue.get()) is not None:
            if self._error is None:
                try:
                    upload(item[0])
                except BaseException as e:
                    self._error = e

    def _check(self) -> None:
        if self._error is not None:
            raise RuntimeError("upload failed") from self._error

    def put(self, item) -> None:
        self._check()
        self._queue.put((item,))

    def close(self) -> None:
        self._queue.put(None)
        self._thread.join()
        self._check()


def ready_shards(parts: DataFrame, shard: str, part: str, expected: str) -> DataFrame:
    """(shard): those of which as many distinct parts are there as expected."""
    return parts.groupBy(shard).agg(F.count_distinct(part).alias("n"), F.max(expected).alias("of")).where("n = of").select(shard)


def wait_until(ready: Callable[[], bool], poll: float, limit: float) -> None:
    """Asks every `poll` seconds whether a shard is ready; raises after `limit` seconds."""
    end = time.monotonic() + limit
    while not ready():
        if time.monotonic() + poll > end:
            raise TimeoutError(f"not ready after {limit} s")
        time.sleep(poll)
