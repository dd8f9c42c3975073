"""SimHash near-duplicates at a Jaccard likeness: the Gray-ordered index finds them, whole sets decide.

Two sets of five-word shingles at the limit of 0.8 differ in some ten of 64 fingerprint bits and now
and then in twenty, far too many for keys of agreeing bit blocks as in `simhash` (no table would
hold a pair apart from chance). Which fingerprints meet is therefore decided by the sets' minima under 200
permutations, five at a time: sets that share one of the 40 keys meet in a cluster; a pair at the
limit shares none with a chance of (1 - 0.8^5)^40 = 1.3e-7, a closer pair with less. Inside a cluster the
hierarchical index over Gray-ordered fingerprints finds the pairs within 28 bits (five standard
deviations beyond what a pair at the limit differs in, the smallest sets included), pruning whole groups,
and every such pair that is not yet connected is compared as whole sets, so no pair below the limit is a
link. Clusters above `cluster_rows` sets are dealt out as pairs of salted chunks.

Defined results: words are cut at the six ASCII spaces, A-Z lower-cased; a text of fewer than five
words is one shingle; null and empty texts are one set; equal sets are linked; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import common, textkit
from .components import components
from .simhash import FANOUT, GrayIndex

WORDS, LEAST, BITS = 5, 0.8, 28
BANDS, ROWS = 40, 5
CLUSTER_ROWS, CLUSTER_SHINGLES = 512, 1 << 19
U = np.uint64


@lru_cache(1)
def _factors() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, U) * U(2) + U(1)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    import xxhash

    w = text.lower().split()  # of bytes: A-Z, and the six ASCII spaces
    digest = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1) if w else 0
    return np.unique(np.fromiter((digest(b" ".join(w[i : i + words]), 42) for i in range(n)), U, n))


def bucket_keys(s: np.ndarray) -> list[int]:
    """The 40 bucket keys of a set."""
    import xxhash

    least = np.full(BANDS * ROWS, ~U(0))
    for i in range(0, len(s), 4096):
        np.minimum(least, np.multiply.outer(_factors(), s[i : i + 4096]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[ROWS * b : ROWS * b + ROWS].tobytes(), b) for b in range(BANDS)]


def sketches(df: DataFrame) -> DataFrame:
    """(text, further columns) -> the further columns, sid (names the set), n (its size) and its buckets."""
    rest = [c for c in df.columns if c != "text"]
    schema = df.select(*rest).schema.add("sid", "long").add("n", "long").add("buckets", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in common.slices(batch):
                sets = [shingle_set(t) for t in textkit.strings(part.column(part.schema.get_field_index("text")))]
                sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], U).view(np.int64)
                keys = np.array([bucket_keys(s) for s in sets], U).reshape(-1).view(np.int64)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), pa.array(sid), pa.array([len(s) for s in sets], pa.int64()), buckets], names=[*rest, "sid", "n", "buckets"])

    return df.mapInArrow(run, schema)


def set_fingerprint(s: np.ndarray) -> int:
    """A bit is 1 if over half the hashes of a set have it."""
    if not len(s):
        return 0
    votes = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(s)).view(U)[0])


def candidates(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j, sorted, whose fingerprints differ in at most that many bits, from the Gray-ordered index."""
    fp = np.array([set_fingerprint(s) for s in sets], U)
    if len(fp) <= FANOUT:  # one node
        i, j = np.triu_indices(len(fp), 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        return i[near], j[near]
    rank = fp.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(step)
    order = np.argsort(rank, kind="stable")
    a, b = (order[x] for x in GrayIndex(np.zeros(len(fp), np.int64), fp[order], bits).near_pairs())
    i, j = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((j, i))
    return i[by], j[by]


def connect(sets: list[np.ndarray], least: float, bits: int = BITS) -> np.ndarray:
    """For each set the first set of its component, links being candidates of at least that Jaccard likeness."""
    size = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(size)[:-1])
    root, mark = np.arange(len(sets)), np.zeros(len(values), np.int64)
    first, second = candidates(sets, bits)
    cut = np.searchsorted(first, np.arange(len(sets) + 1))
    for i in range(len(sets) - 1):
        j = second[cut[i] : cut[i + 1]]
        j = j[(root[j] != root[i]) & (np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]))]
        if not len(j):
            continue
        mark[codes[i]] = 1
        common_ = np.add.reduceat(mark[np.concatenate([codes[x] for x in j])], np.cumsum(size[j]) - size[j])
        mark[codes[i]] = 0
        near = j[common_ / (size[i] + size[j] - common_) >= least]
        if len(near):
            joined = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


def links(rows: DataFrame, least: float = LEAST, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """(cluster, sid, n, text), a row a set -> links (u, v) that connect what is connected by pairs of
    one cluster that are at least that alike: a forest for each task."""
    sizes = rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / cluster_rows), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).cast("int").alias("chunks"))
    # a row of chunk c goes to each task (i, j), i <= j, with c in it
    dealt = rows.join(sizes, "cluster").select("cluster", "sid", "text", F.pmod(F.xxhash64("sid"), "chunks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tasks = dealt.select(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "sid", "text")
    tasks = tasks.repartition(common.shuffle_partitions(rows.sparkSession), "task").sortWithinPartitions("task", "sid")

    def solve(sid: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.array(sid, np.int64)
        root = connect(sets, least)
        at = np.flatnonzero(ids != ids[root])
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sid, sets = None, [], []
        for batch in batches:
            for part in common.slices(batch):
                for task, i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), textkit.strings(part.column(2))):
                    if task != now and sid:
                        yield solve(sid, sets)
                        sid, sets = [], []
                    now = task
                    sid.append(i)
                    sets.append(shingle_set(text))
        if sid:
            yield solve(sid, sets)

    return tasks.mapInArrow(run, "u long, v long").distinct()


def deduplicate(docs: DataFrame, least: float = LEAST, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """The documents, all columns, without all but one of each component: the one with the
    smallest doc_id (nulls last), of whole copies one."""
    common.ensure_checkpoint_dir(docs.sparkSession)
    packed = common.packed(docs)
    each = sketches(packed.select("doc_id", "text", "k1", "k2")).checkpoint()
    keys = each.select("sid", F.explode("buckets").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("bucket", "lo")
    clusters = components(keys.join(shared, "bucket").where("sid <> lo").select(F.col("sid").alias("u"), F.col("lo").alias("v")))
    members = each.join(clusters, each["sid"] == clusters["node"]).groupBy("sid").agg(F.min(F.struct("k1", "k2")).alias("k"), F.max("n").alias("n"), F.min("component").alias("cluster"))
    rows = packed.select("k1", "k2", "text").join(members.select("k.k1", "k.k2", "sid", "n", "cluster"), ["k1", "k2"]).select("cluster", "sid", "n", "text")
    comp = components(links(rows, least, cluster_rows))
    named = each.join(comp, each["sid"] == comp["node"], "left").select(F.coalesce("component", "sid").alias("root"), "doc_id", "k1", "k2")
    stay = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("s")).select("s.k1", "s.k2")
    return common.one_of_each(packed, stay)
