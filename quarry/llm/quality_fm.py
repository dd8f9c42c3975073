"""Text quality by a factorisation machine.

Features: hashed words (log counts, unit length), structure statistics of the text, and the metadata
of length. The machine weighs every feature and, through `FACTORS` latent factors, every pair of
features; pairs are summed in linear time as half of (sum of v x)^2 - sum of (v x)^2. It is
trained in numpy on a bounded sample of labelled rows (`rows_per_class` of each class, weighted back
to the classes' true shares) and applied to every whole text on the executors.

Defined results: a null or empty text has no words and zero statistics and still gets a score;
repeated rows and ties get equal scores; without both classes among the labels the score is the
share of label 1 (0.5 without labels); a null id is held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling, textkit

U = np.uint64
WORD_BITS, FACTORS, ROWS_PER_CLASS, ENTRIES_PER_ROW = 15, 8, 3000, 2048
THRESHOLD = 0.3
_WORDS = 1 << WORD_BITS


def _chars(*groups: str) -> np.ndarray:
    """byte -> two counters of 31 bits, one for each group of ASCII characters."""
    t = np.zeros(256, np.int64)
    for i, g in enumerate(groups):
        t[np.frombuffer(g.encode(), np.uint8)] += 1 << 32 * i
    return t


_UPPER, _LOWERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLES = [_chars(_UPPER, _LOWERS), _chars("#*$%&<>@\\^~=+_{}[]", "|"), _chars("!?", ".,;:"), _chars("0123456789", " \t\n\x0b\x0c\r")]
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
STATISTICS = ["upper", "lower", "symbols", "bars", "marks", "stops", "digits", "spaces", "log_words", "log_lines", "word_length", "distinct", "repeated_lines", "log_chars"]


def _distinct(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=docs)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each document and the end, feature, value): sparse rows."""
    buf, off = textkit.flat(texts)
    docs = len(off) - 1
    size = np.maximum(1, np.diff(off))
    shares = []
    for t in _TABLES:
        total = np.concatenate(([0], np.cumsum(t[buf])))
        n = total[off[1:]] - total[off[:-1]]
        shares += [(n & 0xFFFFFFFF) / size, (n >> 32) / size]
    s, e, doc = textkit.words(textkit.LOWER[buf], off, textkit.NON_ALNUM)
    n_words = np.bincount(doc, minlength=docs)
    hashes = textkit.word_hashes(textkit.LOWER[buf], s, e)
    ls, le, ldoc = textkit.words(buf, off, _NEWLINE)
    n_lines = np.bincount(ldoc, minlength=docs)
    repeated = n_lines - _distinct(textkit.word_hashes(buf, ls, le), ldoc, docs)
    key = np.sort(doc.astype(U) << U(WORD_BITS) | hashes >> U(64 - WORD_BITS))
    key, count = np.unique(key, return_counts=True)
    of, word = (key >> U(WORD_BITS)).astype(np.int64), (key & U(_WORDS - 1)).astype(np.int64)
    distinct = np.bincount(of, minlength=docs)
    x = 1 + np.log(count)
    x /= np.sqrt(np.bincount(of, x * x, minlength=docs))[of]
    length = np.bincount(doc, e - s, minlength=docs) / np.maximum(1, n_words)
    stats = np.stack([*shares, np.log1p(n_words) / 5, np.log1p(n_lines) / 3, length / 8, distinct / np.maximum(1, n_words), repeated / np.maximum(1, n_lines), np.log1p(np.diff(off)) / 8], 1)
    k = stats.shape[1]
    doc = np.concatenate((of, np.repeat(np.arange(docs), k)))
    order = np.argsort(doc, kind="stable")
    feature = np.concatenate((word, np.tile(np.arange(k) + _WORDS, docs)))[order]
    value = np.concatenate((x, stats.reshape(-1))).astype(np.float32)[order]
    return np.concatenate(([0], np.cumsum(distinct + k))), feature, value


class Machine:
    """bias, linear weights and factors; statistics are standardised by `centre` and `scale`."""

    def __init__(self, share: float):
        n = _WORDS + len(STATISTICS)
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        self.w = np.zeros(n, np.float32)
        self.v = np.random.default_rng(5).normal(0, 0.02, (n, FACTORS)).astype(np.float32)
        self.centre, self.scale = np.zeros(len(STATISTICS), np.float32), np.ones(len(STATISTICS), np.float32)

    def _values(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        value = value.copy()
        at = np.flatnonzero(feature >= _WORDS)
        j = feature[at] - _WORDS
        value[at] = np.clip((value[at] - self.centre[j]) / self.scale[j], -4, 4) / 4
        return value

    def logits(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, sums of v x); value: standardised."""
        vx = self.v[feature] * value[:, None]
        at = first[:-1]  # no row is empty: each has its statistics
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), at)
        return self.bias + np.add.reduceat(self.w[feature] * value, at) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        z = self.logits(first, feature, self._values(feature, value))[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> Machine:
        stats = value[feature >= _WORDS].reshape(len(y), -1)
        self.centre, self.scale = stats.mean(0), stats.std(0) + 1e-3
        value = self._values(feature, value)
        rng = np.random.default_rng(7)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.w, self.v)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for rows in (order[i : i + batch] for i in range(0, len(y), batch)):
                n = np.diff(first)[rows]
                at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
                own = np.concatenate(([0], np.cumsum(n)))
                f, x = feature[at], value[at]
                z, sums = self.logits(own, f, x)
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                each = np.repeat(g, n)
                gw, gv = np.zeros_like(self.w), np.zeros_like(self.v)
                np.add.at(gw, f, each * x)
                np.add.at(gv, f, each[:, None] * (x[:, None] * np.repeat(sums, n, axis=0) - self.v[f] * (x * x)[:, None]))
                self.bias -= rate * float(g.sum())
                step += 1
                for p, grad, (m, s) in zip((self.w, self.v), (gw + decay * self.w, gv + decay * self.v), state):
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad * grad - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows_per_class: int = ROWS_PER_CLASS, entries_per_row: int = ENTRIES_PER_ROW) -> Machine:
    """The driver gets eight bytes for each of at most `entries_per_row` entries of at most
    2 * rows_per_class rows (98 MB at most): of a text with more, its most frequent words."""
    rows, sizes = sampling.labelled(docs, labels, target, rows_per_class)
    total = sum(sizes.values())
    machine = Machine(sizes.get(1, 0) / total if total else 0.5)
    if len(sizes) < 2:
        return machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                first, feature, value = features(part.column(2))
                f, x = [], []
                for a, b in zip(first, first[1:]):
                    keep = np.arange(a, b)
                    if b - a > entries_per_row:  # the statistics come last and stay
                        n_words = b - a - len(STATISTICS)
                        top = np.argsort(-value[a : a + n_words], kind="stable")[: entries_per_row - len(STATISTICS)]
                        keep = np.concatenate((a + np.sort(top), np.arange(a + n_words, b)))
                    f.append(feature[keep].astype(np.int32).tobytes())
                    x.append(value[keep].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(f, pa.binary()), pa.array(x, pa.binary())], names=["doc_id", "y", "f", "x"])

    # features are made on the executors
    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, f binary, x binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = got["y"].to_numpy().astype(np.float32)
    if len(set(y)) < 2:
        return machine
    feature, value = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in got[c]]) for c, t in (("f", np.int32), ("x", np.float32)))
    first = np.cumsum([0, *(x.as_buffer().size // 4 for x in got["f"])])
    share = np.array([sizes.get(c, 0) / total / max(1, (y == c).sum()) * len(y) for c in (0, 1)], np.float32)
    return machine.fit(first, feature, value, y, share[y.astype(int)])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, text) -> (doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores(*features(part.column(1))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
