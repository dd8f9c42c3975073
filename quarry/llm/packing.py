"""Best-fit packing of texts into bins under conflicts.

A text of more words than a bin is cut into full bins and a rest. The rests, largest first, go to
the open bin with the least room that still holds them and that conflicts in nothing: a bin carries
a bitmap of the sources and one of the duplicate clusters in it, and where the tightest bin has the
item's source or cluster already, the search goes on to the next tightest, up to the last.
Items are dealt by hash into shards of about `shard_rows`, each packed on its own, so no task grows
with the corpus and a source or cluster of any size spreads over all shards.

Defined results: a text without words (null, empty) gets one row without a bin; a null source
conflicts with none; ties are packed in the order of id, then of text hash; whole copies of a row share
a cluster and so never a bin; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BIN_WORDS = 2048
SHARD_ROWS = 4096


def best_fit(sizes: list[int], conflicts: list[int], room: int) -> list[int]:
    """The bin of each item, in the given order. conflicts: the bits of the item's source and cluster;
    a bin never holds the same bit twice."""
    at: list[list[int]] = [[] for _ in range(room + 1)]  # bins by residual
    open_, carried, out = 0, [], []  # open_: a bit for each residual that has bins
    for size, bits in zip(sizes, conflicts):
        rest = open_ >> size << size
        chosen = -1
        while rest:  # successors of `size` among the residuals
            low = rest & -rest
            left = low.bit_length() - 1
            for place, b in enumerate(at[left]):
                if not carried[b] & bits:
                    chosen = b
                    del at[left][place]
                    if not at[left]:
                        open_ ^= low
                    break
            if chosen >= 0:
                break
            rest ^= low
        if chosen < 0:
            chosen, left = len(carried), room
            carried.append(0)
        carried[chosen] |= bits
        left -= size
        if left:
            at[left].append(chosen)
            open_ |= 1 << left
        out.append(chosen)
    return out


def conflict_bits(sources: list, clusters: list) -> list[int]:
    """A bit for each source, then one for each cluster that has several items."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    ids: dict = {}
    for key in [("s", s) for s in sources if s is not None] + [("c", c) for c in clusters if seen[c] > 1]:
        ids.setdefault(key, len(ids))
    return [(0 if s is None else 1 << ids["s", s]) | (1 << ids["c", c] if seen[c] > 1 else 0) for s, c in zip(sources, clusters)]


def pack_shard(rows: list[tuple], room: int) -> list[tuple]:
    """Rows (doc_id, key, n_words, source, cluster) -> (doc_id, piece, first_word, n_words, bin)."""
    rows = sorted(rows, key=lambda r: (-(r[2] % room), r[0] is None, r[0] or 0, r[1]))
    rests = [r for r in rows if r[2] % room]
    bins = best_fit([r[2] % room for r in rests], conflict_bits([r[3] for r in rests], [r[4] for r in rests]), room)
    out = [(r[0], r[2] // room, r[2] // room * room, r[2] % room, b) for r, b in zip(rests, bins)]
    used = max(bins, default=-1) + 1
    for r in rows:
        if not r[2]:
            out.append((r[0], 0, 0, 0, None))
        for i in range(r[2] // room):
            out.append((r[0], i, i * room, room, used))
            used += 1
    return out


def pack(docs: DataFrame, room: int = BIN_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, text, source) -> doc_id, piece, first_word, n_words long, bin_id long: a row for each
    piece. Texts with the same words, letter case aside, are one duplicate cluster."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("key"), F.size(words).cast("long").alias("n"), F.col("source").cast("string").alias("source"), F.xxhash64(F.lower(F.array_join(words, " "))).alias("cluster"))
    n_shards = max(1, -(-docs.count() // shard_rows))
    n = common.shuffle_partitions(docs.sparkSession)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_shards))).repartition(min(n, n_shards), "shard").sortWithinPartitions("shard")
    names = ["doc_id", "piece", "first_word", "n_words", "bin_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            out = [(*r[:4], None if r[4] is None else now << 32 | r[4]) for r in pack_shard(held, room)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

        for batch in batches:
            for *row, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if held:
                        yield done()
                    now, held = shard, []
                held.append(tuple(row))
        if held:
            yield done()

    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
