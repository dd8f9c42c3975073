"""Removal of repeated word windows with Rabin-Karp hashes.

Every window of `window_words` words of every document is hashed by two independent rolling hashes, of
which 80 bits are kept, and counted: among 10^12 windows 0.4 pairs are expected to agree by chance, among
the 1.6 * 10^13 of 100 TB about a hundred.
Counting moves no row per window: a task packs the distinct hashes of a block of documents, sorted
and delta-coded, into one binary value per hash range; a reducer unpacks the values of a range,
sorts them together and answers each block with the windows that occur elsewhere too. A hash that
repeats within a block is known there already and is sent once, so even a passage that a third of
all documents share reaches a reducer no more than once a block. Flagged windows are merged to
maximal intervals of words, which are then cut.

Defined results: a null text has no words; texts shorter than a window lose nothing; rows with
equal id and text (whole copies) repeat one another and get the same result; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit

U = np.uint64
BLOCK_WORDS, SLICE_BYTES = 2 << 20, 1 << 20
_PACKED = "bucket int, block long, n int, raw int, payload binary"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _squeeze(*parts: np.ndarray) -> tuple[int, bytes]:
    """Byte planes of the arrays, compressed."""
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in parts)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _planes(raw: bytes, at: int, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(dtype)[:, 0]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("raw", pa.int32()), ("payload", pa.binary())])


class _Block:
    def __init__(self, number: int):
        self.number, self.words = number, 0
        self.keys, self.counts, self.hashes, self.more, self.starts = [], [], [], [], []

    def add(self, part: pa.RecordBatch, k: int) -> None:
        buf, off = textkit.flat(part.column(2))
        s, e, doc = textkit.words(buf, off)
        h, at = textkit.windows(textkit.word_hashes(buf, s, e), doc, k)
        self.keys.append(np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1))
        self.counts.append(np.bincount(doc, minlength=part.num_rows))
        self.hashes.append(h)
        self.more.append((textkit.windows(textkit.word_hashes(buf, s, e, 1), doc, k, 1)[0] >> U(48)).astype(np.uint16))
        self.starts.append((at + self.words).astype(np.uint32))
        self.words += len(s)

    def packed(self, buckets: int) -> Iterator[pa.RecordBatch]:
        h, x, at = np.concatenate(self.hashes), np.concatenate(self.more), np.concatenate(self.starts)
        self.hashes, self.more, self.starts = [], [], []
        order = np.lexsort((x, h))
        h, x, at = h[order], x[order], at[order]
        twice = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
        again = np.concatenate((twice, [False])) | np.concatenate(([False], twice)) if len(h) else np.zeros(0, bool)
        once = np.concatenate(([True], ~twice)) if len(h) else again
        known = np.sort(at[again])
        h, x, at = h[once], x[once], at[once]
        # the block's own row: its documents, and the windows already known to repeat
        raw, payload = _squeeze(np.concatenate(self.keys).reshape(-1), np.concatenate(self.counts).astype(np.int64), np.diff(known, prepend=np.uint32(0)).astype(np.uint32))
        rows = [(self.number % buckets, self.number, -sum(map(len, self.counts)), raw, payload)]
        cut = np.searchsorted(((h >> U(32)) * U(buckets)) >> U(32), np.arange(buckets + 1, dtype=U))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            a, z = cut[b], cut[b + 1]
            raw, payload = _squeeze(np.diff(h[a:z], prepend=U(0)), at[a:z], x[a:z])
            rows.append((b, self.number, int(z - a), raw, payload))
            if len(rows) == 512:
                yield _rows(rows, _SCHEMA)
                rows = []
        if rows:
            yield _rows(rows, _SCHEMA)


def _count(bucket: list[tuple]) -> list[tuple]:
    """Rows (block, n, raw, payload) of one hash range -> the same with only the windows whose hash
    another row has too."""
    out, hashes, more, starts = [], [], [], []
    for block, n, raw, payload in bucket:
        x = pa.decompress(payload, raw, codec="zstd", asbytes=True)
        hashes.append(np.cumsum(_planes(x, 0, n, U), dtype=U))
        starts.append(_planes(x, 8 * n, n, np.uint32))
        more.append(_planes(x, 12 * n, n, np.uint16))
    h, x = np.concatenate(hashes), np.concatenate(more)
    order = np.lexsort((x, h))
    h, x = h[order], x[order]
    twice = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
    found = np.sort(order[np.concatenate((twice, [False])) | np.concatenate(([False], twice))])
    size = np.cumsum([0, *map(len, starts)])
    cut = np.searchsorted(found, size)
    for i, (block, *_) in enumerate(bucket):
        if cut[i + 1] > cut[i]:
            at = np.sort(starts[i][found[cut[i] : cut[i + 1]] - size[i]])
            out.append((0, block, len(at), *_squeeze(np.diff(at, prepend=np.uint32(0)).astype(np.uint32))))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of a stream sorted by the key."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[key] != now:
                if held:
                    yield now, held
                now, held = row[key], []
            held.append(row)
    if held:
        yield now, held


def intervals(keyed: DataFrame, window_words: int = 35, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(k1, k2, text) -> (k1, k2, cuts binary): for each document that loses words, int32 pairs of
    the first and the last-but-one word of its maximal repeated stretches."""
    n = common.shuffle_partitions(keyed.sparkSession)
    buckets = 4 * n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for part in common.slices(batch, limit=SLICE_BYTES):
                block.add(part, window_words)
                if block.words >= block_words:
                    yield from block.packed(buckets)
                    block = _Block(block.number + 1)
        if block.keys:
            yield from block.packed(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 0):
            out = [(0, *r[1:]) for r in rows if r[2] < 0]
            if len(rows) > len(out):
                out += _count([r[1:] for r in rows if r[2] > 0])
            if out:
                yield _rows(out, _SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            own = next(r for r in rows if r[2] < 0)
            docs = -own[2]
            x = pa.decompress(own[4], own[3], codec="zstd", asbytes=True)
            keys, counts = _planes(x, 0, 2 * docs, np.int64).reshape(-1, 2), _planes(x, 16 * docs, docs, np.int64)
            starts = [np.cumsum(_planes(x, 24 * docs, (own[3] - 24 * docs) // 4, np.uint32))]
            starts += [np.cumsum(_planes(pa.decompress(p, raw, codec="zstd", asbytes=True), 0, m, np.uint32)) for _, _, m, raw, p in rows if m > 0]
            at = np.concatenate(starts).astype(np.int64)
            if not len(at):
                continue
            words = int(counts.sum())
            depth = np.bincount(at, minlength=words + 1) - np.bincount(at + window_words, minlength=words + 1)
            covered = np.concatenate(([False], np.cumsum(depth)[:words] > 0, [False]))
            doc = np.repeat(np.arange(docs), counts)
            cut_doc = np.concatenate(([True], doc[1:] != doc[:-1], [True]))  # stretches end with their document
            first = np.flatnonzero(covered[1:-1] & (~covered[:-2] | cut_doc[:-1]))
            last = np.flatnonzero(covered[1:-1] & (~covered[2:] | cut_doc[1:])) + 1
            base = np.cumsum(counts) - counts
            of = doc[first]
            pairs = np.stack([first - base[of], last - base[of]], 1).astype(np.int32)
            ids, cut = np.unique(of, return_index=True)
            cut = np.append(cut, len(of))
            yield pa.RecordBatch.from_arrays([pa.array(keys[ids, 0]), pa.array(keys[ids, 1]), pa.array([pairs[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["k1", "k2", "cuts"])

    packed = keyed.select("k1", "k2", "text").mapInArrow(pack, _PACKED)
    answered = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _PACKED)
    merged = answered.repartition(n, "block").sortWithinPartitions("block").mapInArrow(merge, "k1 long, k2 long, cuts binary")
    return merged.dropDuplicates(["k1", "k2"])


def _cut(text: bytes, cuts: np.ndarray) -> bytes:
    """The text without the words of the cuts and the space after them; what stays is unchanged."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in cuts.tolist():
        out.append(text[done : at[a][0]])
        done = at[b][0] if b < len(at) else len(text)
    return b"".join([*out, text[done:]])


def remove_repeats(docs: DataFrame, window_words: int = 35, digest: bool = False) -> DataFrame:
    """Removes each word that a window covers whose word sequence also starts anywhere else.
    -> the documents' columns with `text` (null: empty) cut, then n_words and n_removed long, each
    unless the documents have a column of that name, which stays as it is; with digest, kept_sha256 instead
    of text: of the kept words, joined by one space."""
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id"))
    keyed = base.select("row", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id", F.length("text")).alias("k2"))
    both = keyed.join(intervals(keyed, window_words), ["k1", "k2"], "left").select("row", "text", "cuts")
    schema = both.select("row").schema.add("text", "string").add("n_words", "long").add("n_removed", "long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                text, n_words, n_removed = [], [], []
                for t, c in zip(textkit.strings(part.column(1)), part.column(2).to_pylist()):
                    cuts = np.frombuffer(c or b"", np.int32).reshape(-1, 2)
                    w = t.split()
                    n_words.append(len(w))
                    n_removed.append(int((cuts[:, 1] - cuts[:, 0]).sum()))
                    if digest:
                        for a, b in cuts[::-1].tolist():
                            del w[a:b]
                        text.append(hashlib.sha256(b" ".join(w)).hexdigest())
                    else:
                        text.append((_cut(t, cuts) if len(cuts) else t).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["row", "text", "n_words", "n_removed"])

    out = [F.col("text").alias("kept_sha256" if digest else "text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return both.mapInArrow(apply, schema).select(*out, *(n for n in ("n_words", "n_removed") if n not in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    return remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN rep USING (g), range(35) AS r(j)),
pos AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM pos ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
