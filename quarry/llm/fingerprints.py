"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes runs over a text. A chunk ends where the hash's top bits are zero:
seven bits up to the normal size, five beyond it (normalised chunking), between a least and a largest
size. An edit moves only the chunks that it touches, so two texts share the chunks of what they share.
A fingerprint is the sorted set of its chunks, 48 bits of digest and a byte of length each,
in hex; containment weighs each shared chunk by its length.

Defined results: a null text is empty, an empty text has the empty fingerprint; two empty texts
are alike (1), an empty and another are not (0); equal texts have equal fingerprints; documents
with equal ids follow each other by text; null ids come first; a lone document is its own
next; an empty table gives an empty result. Rows that share an id and the first 64 characters stay in one
task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit

U = np.uint64
LEAST, NORMAL, MOST = 32, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
HEAD = 64
GEAR = (textkit.mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR of the last 32 bytes, each shifted by its distance, modulo 2^32."""
    h = GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        further = h.copy()
        further[step:] += h[:-step] << np.uint32(step)
        h = further
    return h


def chunks(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each chunk. A chunk's least size is the hash's reach, so no
    boundary depends on bytes outside its chunk."""
    h = gear_hashes(buf)
    strict = np.flatnonzero(h >> np.uint32(32 - STRICT_BITS) == 0).tolist()
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0).tolist()
    strict.append(len(buf) + MOST)
    loose.append(len(buf) + MOST)
    ends, docs, i, j = [], [], 0, 0
    for d, (at, stop) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        while stop - at > LEAST:
            low, mid, top = at + LEAST - 1, at + NORMAL - 1, min(at + MOST, stop) - 1
            while strict[i] < low:
                i += 1
            end = strict[i]
            if end >= mid:
                j = bisect_left(loose, mid, j)
                end = loose[j]
            at = min(end, top) + 1
            ends.append(at)
            docs.append(d)
        if at < stop:
            ends.append(stop)
            docs.append(d)
    e, doc = np.array(ends, np.int64), np.array(docs, np.int64)
    start = np.concatenate(([0], e[:-1])) if len(e) else e
    return start, e, doc


def fingerprint(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct keys of its chunks: 48 bits of digest, 8 of length - 1."""
    buf, off = textkit.flat(pa.array(texts, pa.large_string()))
    s, e, doc = chunks(buf, off)
    key = (textkit.word_hashes(buf, s, e) >> U(16)) << U(8) | (e - s - 1).astype(U)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [key[a:b] for a, b in zip(cut, cut[1:])]


def text_form(key: np.ndarray) -> str:
    return key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's length whose chunks b has too."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = (a & U(255)).astype(np.int64) + 1
    return float(weight[np.isin(a, b, assume_unique=True)].sum() / weight.sum())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _ranges(d: DataFrame, n: int) -> DataFrame:
    """Adds `bucket`, a number of ranges of (at, head) at about equal counts of rows. The cuts come from a
    random sample of about 50 keys a range; an id that holds several cuts is a range of its own, cut further by `head`."""
    total, most = max(1, d.count()), max(2000, 100 * n)  # the count is read from the files' footers
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(total)) < most
    sample = d.select("at", "head", drawn.alias("drawn")).where("drawn").collect()
    keys = sorted((r["at"], r["head"]) for r in sample)
    cuts = sorted({keys[i * len(keys) // (2 * n)] for i in range(1, 2 * n)} if keys else set())
    heads: dict[int, list[str]] = {}
    for at, head in cuts:
        heads.setdefault(at, []).append(head)
    hot = [(at, h) for at, h in heads.items() if len(h) > 1]
    splits = sorted({*heads, *(at + 1 for at, _ in hot)})
    at_or_below = F.size(F.filter(F.lit(splits) if splits else F.array().cast("array<bigint>"), lambda c: c <= F.col("at")))
    if not hot:
        return d.withColumn("bucket", at_or_below)
    most = 1 + max(len(h) for _, h in hot)
    table = F.broadcast(d.sparkSession.createDataFrame(hot, "at long, heads array<string>"))  # at most 2 n cuts
    sub = F.coalesce(F.size(F.filter("heads", lambda h: h <= F.col("head"))), F.lit(0))
    return d.join(table, "at", "left").withColumn("bucket", at_or_below * most + F.when(F.col("heads").isNull(), F.lit(0)).otherwise(sub)).drop("heads")


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (bucket, extra, doc_id, text), partitioned and sorted so that each document is
    followed by the next one in the order of (id, text), nulls first. Buckets are ranges of that order; each
    gets the first document of the next range (the last range that of the first) as an extra last row, so the
    texts are shuffled once and no order over all rows is made in one task. An id, or null, of very many rows
    spreads over ranges of its texts' first HEAD characters."""
    spark = docs.sparkSession
    n = common.shuffle_partitions(spark)
    d = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), "doc_id", "text", F.substring("text", 1, HEAD).alias("head"))
    d = _ranges(d, n)
    # the first key of each range (a row a range), then of the few rows with that key the first text
    first = sorted((r["bucket"], r["k"]["at"], r["k"]["head"]) for r in d.groupBy("bucket").agg(F.min(F.struct("at", "head")).alias("k")).collect())
    before = [(b, at, head, first[i - 1][0]) for i, (b, at, head) in enumerate(first)]
    keys = F.broadcast(spark.createDataFrame(before, "bucket int, at long, head string, before int"))
    extra = d.join(keys, ["bucket", "at", "head"]).groupBy("before").agg(F.min("text").alias("text"), F.first("at").alias("at"))
    rows = d.select("bucket", F.lit(0).alias("extra"), "at", "doc_id", "text").unionAll(extra.select(F.col("before").alias("bucket"), F.lit(1).alias("extra"), "at", F.lit(None).cast("long").alias("doc_id"), "text"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "at", "text").select("bucket", "extra", "doc_id", "text")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id long, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next: the containment of the document in its edited text and in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in common.slices(batch):
                rows = held + list(zip(*(part.column(i).to_pylist() for i in range(4))))
                at = [i for i in range(len(rows) - 1) if not rows[i][1]]  # an extra row has no result
                changed = [edited(rows[i][3], rows[i + 1][3]) for i in at]
                one, two = fingerprint([r[3] for r in rows]), fingerprint(changed)
                out = [(rows[i][2], len(rows[i][3]), hashlib.sha256(c.encode()).hexdigest(), text_form(one[i]), text_form(f), containment(one[i], f), containment(one[i], one[i + 1])) for i, c, f in zip(at, changed, two)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], names=_NAMES)
                held = rows[-1:]

    return neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, text) -> (doc_id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                found = fingerprint([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(text_form, found), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(common.texts(common.table(spark, sf_dir, "documents")))
