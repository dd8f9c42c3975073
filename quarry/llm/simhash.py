"""SimHash near-duplicates with a Gray-ordered hierarchical index.

A fingerprint is a majority vote, bit by bit, of the XXH64 hashes of a text's word shingles.
Fingerprints that differ in at most four bits agree in two of six blocks of their bits, so
fifteen tables, keyed by two blocks each, bring every such pair together in some bucket. Inside a
bucket the fingerprints are sorted by Gray rank and an index is built bottom-up: a node keeps the
bits that all its members share (a masked pattern). Two nodes are compared by the differences
accumulated on the bits both have fixed: above the limit, the whole pair of groups is pruned;
where even the free bits cannot exceed the limit, the whole groups are linked at once.
A bucket gives a spanning forest, never its pairs. Buckets above `bucket_rows` are dealt out
as pairs of salted chunks, so one crowded bucket spreads over many tasks and stays exact.

Defined results: a null or empty text has fingerprint zero, linked like any other; equal texts,
ties and repeated rows share a fingerprint and so a component; an empty table gives an empty
result; a component whose ids are all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textkit
from .components import components

BLOCKS = (11, 11, 11, 11, 10, 10)
FANOUT, SALTS = 8, 16
U = np.uint64

#: byte -> its eight bits as eight bytes in one word, so 255 of them can be added without a carry
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(-1).view(U)


def fingerprint(texts: list[bytes], shingle_words: int = 4) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts; a bit is 1 if over half the shingle hashes have it."""
    import xxhash

    digest = xxhash.xxh64_digest
    counts, digests = np.zeros(len(texts), np.int64), []
    for d, text in enumerate(texts):
        w = text.lower().split()  # of bytes: A-Z, and the six ASCII spaces
        if not w:
            continue
        joined = b" ".join(w)
        if len(w) <= shingle_words:
            digests.append(digest(joined, 42))
            counts[d] = 1
            continue
        end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        start = np.concatenate(([0], end[: -shingle_words])).tolist()
        digests += [digest(joined[i:j], 42) for i, j in zip(start, (end[shingle_words - 1 :] - 1).tolist())]
        counts[d] = len(start)
    out = np.zeros(len(texts), U)
    if not digests:
        return out
    planes = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    full = np.flatnonzero(counts)
    n = counts[full]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    parts = (n + 254) // 255
    part_first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    starts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_first, parts))
    votes = np.empty((len(full), 64), np.int64)
    for b in range(8):
        sums = np.add.reduceat(_SPREAD[planes[:, b]], starts).view(np.uint8).reshape(-1, 8)
        votes[:, 8 * b : 8 * b + 8] = np.add.reduceat(sums.astype(np.int64), part_first, axis=0)
    out[full] = np.packbits(votes * 2 > n[:, None], axis=1).view(">u8")[:, 0].astype(U)
    return out


def fingerprints(df: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(text, further columns) -> the further columns and fp long."""
    rest = [c for c in df.columns if c != "text"]
    schema = df.select(*rest).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                fp = fingerprint(textkit.strings(part.column(part.schema.get_field_index("text"))), shingle_words)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), pa.array(fp.view(np.int64))], names=[*rest, "fp"])

    return df.mapInArrow(run, schema)


class GrayIndex:
    """Of rows sorted by (group, Gray rank). Level 0 has the fingerprints; FANOUT consecutive nodes
    of a group make a node above, until each group has one node."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, limit: int):
        self.limit, self.root = limit, np.arange(len(fp))
        full = ~U(0)
        self.levels = [{"and": fp, "or": fp, "leaf": np.arange(len(fp) + 1)}]
        while True:
            head = np.concatenate(([True], group[1:] != group[:-1]))
            at = np.flatnonzero(head)
            place = np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))
            new = np.flatnonzero(place % FANOUT == 0)
            low = self.levels[-1]
            if len(self.levels) > 1 and len(new) == len(group):
                break
            self.levels.append({"and": np.bitwise_and.reduceat(low["and"], new), "or": np.bitwise_or.reduceat(low["or"], new), "first": np.append(new, len(group)), "leaf": np.append(low["leaf"][new], len(fp))})
            group = group[new]
        for x in self.levels:
            x["mask"] = full ^ (x["and"] ^ x["or"])

    def near_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of rows of one group that differ in at most `limit` bits."""
        found = [(a, b) for a, b, _ in self._near(whole_groups=False)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def join(self) -> np.ndarray:
        """For each row the first row of its component within this index."""
        for a, b, leaf in self._near(whole_groups=True):
            if leaf is None:
                self._unite(a, b)
            else:
                for p, q in ((a, b), (b, a)):
                    n = leaf[q + 1] - leaf[q]
                    self._unite(np.repeat(leaf[p], n), _ranges(leaf[q], n))
        return self.root

    def _near(self, whole_groups: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(a, b, None): pairs of rows within the limit. With whole_groups also (a, b, leaf): pairs of nodes all
        of whose rows, from leaf[a] to leaf[a + 1] and likewise of b, are within it."""
        top = len(self.levels) - 1
        a = np.flatnonzero(np.diff(self.levels[top]["leaf"]) > 1)
        stack = [(top, a, a)]
        while stack:
            k, a, b = stack.pop()
            if len(a) > 1 << 17:
                stack += [(k, a[i : i + (1 << 17)], b[i : i + (1 << 17)]) for i in range(0, len(a), 1 << 17)]
                continue
            x = self.levels[k]
            fixed = x["mask"][a] & x["mask"][b]
            least = np.bitwise_count((x["and"][a] ^ x["and"][b]) & fixed)
            near = least <= self.limit
            if k == 0:
                yield a[near], b[near], None
                continue
            sure = near & (least + np.bitwise_count(~fixed) <= self.limit) & whole_groups
            if sure.any():
                yield a[sure], b[sure], x["leaf"]
            a, b = a[near & ~sure], b[near & ~sure]
            if not len(a):
                continue
            first = x["first"]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            n = na * nb
            pair, t = np.repeat(np.arange(len(a)), n), _ranges(np.zeros(len(a), np.int64), n)
            ca, cb = first[a][pair] + t // nb[pair], first[b][pair] + t % nb[pair]
            same = a[pair] == b[pair]
            keep = ~same | ((ca <= cb) if k > 1 else (ca < cb))
            stack.append((k - 1, ca[keep], cb[keep]))

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] of them, then those of start[1], and so on."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - before, n)


def _gray_rank(c: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def _buckets(fp: Column) -> Column:
    """The fifteen bucket keys: the table's number and the values of its two blocks."""
    at = [sum(BLOCKS[:i]) for i in range(6)]
    block = [F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1)) for i in range(6)]
    return F.explode(F.array(*[F.lit(t << 22).bitwiseOR(F.shiftleft(block[i], 11)).bitwiseOR(block[j]) for t, (i, j) in enumerate(combinations(range(6), 2))]))


def links(fps: DataFrame, limit: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) that connect what is connected by pairs of at
    most `limit` <= 4 differing bits: a forest for each bucket."""
    if limit > 4:
        raise ValueError("two of six blocks agree only up to four differing bits")
    rows = fps.select("fp").withColumn("bucket", _buckets(F.col("fp"))).select("bucket", _gray_rank(F.col("fp")).alias("rank"))
    crowded = rows.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks"))
    # a row of chunk c goes to each task (i, j), i <= j, with c in it
    own = F.pmod(F.xxhash64("rank"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = rows.join(crowded, "bucket", "left").select("bucket", "rank", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rank")
    n = common.shuffle_partitions(fps.sparkSession)
    tasks = dealt.select(F.xxhash64("bucket", "i", "j").alias("task"), "rank").repartition(n, "task").sortWithinPartitions("task", "rank")

    def solve(task: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        fp = rank ^ (rank >> U(1))
        root = GrayIndex(task, fp, limit).join()
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[root[at]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(U)))
            rows += batch.num_rows
            if rows >= 1 << 17:
                task, rank = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(task, task[-1]))  # the last task may go on
                if cut:
                    yield solve(task[:cut], rank[:cut])
                held, rows = [(task[cut:], rank[cut:])], len(task) - cut
        if rows:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return tasks.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(df: DataFrame, shingle_words: int = 4, limit: int = 4) -> DataFrame:
    """(doc_id, text, further columns) -> (doc_id, further columns, fp, root, component_id):
    the component's smallest doc_id, and `root`, a fingerprint that names the component. Members of a
    component meet its smallest id under SALTS keys, and so do the copies of a crowded fingerprint (over a
    thousandth of all rows, so there are at most a thousand): a component or a fingerprint of any size spreads."""
    common.ensure_checkpoint_dir(df.sparkSession)
    each = fingerprints(df, shingle_words).checkpoint()
    first = each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    most = max(1000, each.count() // 1000)
    comp = components(links(first.select("fp"), limit))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    members = first.join(comp, first["fp"] == comp["node"]).select("fp", "component", "least", salt)
    ids = members.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = members.join(ids, ["component", "salt"]).select("fp", "component", "component_id")
    some = F.when(F.col("copies") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    named = first.join(linked, "fp", "left").select("fp", F.explode(some).alias("salt"), F.coalesce("component", "fp").alias("root"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    crowded = F.broadcast(first.where(F.col("copies") > most).select("fp", F.lit(SALTS).alias("salts")))
    rest = [c for c in each.columns if c != "fp"]
    own = each.join(crowded, "fp", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int")))
    return own.join(named, ["fp", "salt"]).select(*rest, "fp", "root", "component_id")


def deduplicate(docs: DataFrame, shingle_words: int = 4, limit: int = 4) -> DataFrame:
    """The documents, all columns, without all but one of each component: the one with the
    smallest doc_id (nulls last), of whole copies one."""
    rows = common.packed(docs)
    found = near_duplicates(rows.select("doc_id", "text", "k1", "k2"), shingle_words, limit)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("s")).select("s.k1", "s.k2")
    return common.one_of_each(rows, stay)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.texts(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
