"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of six hashed embeddings: of the word by two hashes, so that it
is wrong only where both collide, and of its first four to seven bytes, each only if the word goes on
after them, so that inflected forms share what they have in common and the bare stem does not. Filters
of one, two and three words run over the text; the largest response of each goes through a linear layer.

The net is trained on a bounded sample of labelled rows: `rows_per_class` of each class, weighted
back to the classes' true shares, of a text above `words_per_row` words a stretch of as many
consecutive ones (scoring reads whole texts). Embeddings start as the log odds of the hash between the
classes, as far as they are sure (`SURE` standard errors off), along one direction: what occurs
in a single text starts at zero and is hardly learnt, so the net cannot memorise its sample and its
result hardly depends on the seed. Steps shrink to nothing over the epochs.

Calibration uses the scores of rows by nets that did not learn from them (`INNER_FOLDS` crossed folds of
the sample): two numbers make log odds of the scores, the same for all rows, and for each language a threshold is set
where F1 is best. The language decides the flag only, never the score.

Defined results: a null or empty text has no words and the score of an empty text; repeated rows
and ties get equal scores; a language without enough sample rows, or null, has the common
threshold 0.5; without both classes among the labels the score is the share of label 1; a null id
is held out; rows that share an id count once in the sample; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling, textkit

U = np.uint64
HASH_BITS, DIMENSIONS, FILTERS, WIDTHS = 16, 16, 16, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
TABLES = 2 + len(PREFIXES)
ROWS_PER_CLASS, WORDS_PER_ROW = 2500, 2048
SURE, STRENGTH, INNER_FOLDS = 1.3, 0.25, 3
THRESHOLD = 0.5
SLICE_BYTES = 1 << 20


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words x TABLES hashed ids, document of each word); id 0 of a prefix table: the word is no longer."""
    buf, off = textkit.flat(texts)
    buf = textkit.LOWER[buf]
    s, e, doc = textkit.words(buf, off, textkit.NON_ALNUM)
    h = textkit.word_hashes(buf, s, e)
    low = U((1 << HASH_BITS) - 1)
    starts = [np.where(e - s > k, np.maximum(textkit.word_hashes(buf, s, np.minimum(e, s + k)) >> U(20) & low, U(1)), U(0)) for k in PREFIXES]
    return np.stack([h >> U(64 - HASH_BITS), h & low, *starts], 1).astype(np.uint16), doc


class Net:
    def __init__(self, share: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.emb = np.zeros((TABLES, 1 << HASH_BITS, DIMENSIONS), np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(DIMENSIONS * w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.array([np.log((share + 1e-6) / (1 - share + 1e-6))], np.float32)
        self.slope, self.offset = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def responses(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedded words, responses of all filters where each word begins a window); a window that
        leaves its document goes on in zeros."""
        x = self.emb[0][ids[:, 0]]
        for t in range(1, TABLES):
            x += self.emb[t][ids[:, t]]
        y = x @ np.concatenate([f[o] for f in self.filters for o in range(len(f))], 1)
        r = np.empty((len(x), len(self.shift)), np.float32)
        at = 0
        for k, f in enumerate(self.filters):
            part = r[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(len(f)):
                z = y[:, at : at + FILTERS]
                at += FILTERS
                if o == 0:
                    part[:] = z
                elif len(x) > o:
                    part[:-o] += np.where((doc[o:] == doc[:-o])[:, None], z[o:], 0)
        r += self.shift
        return x, r

    def scores(self, ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        pooled = np.zeros((docs, len(self.shift)), np.float32)
        if len(ids):
            full, first = np.unique(doc, return_index=True)
            pooled[full] = np.maximum(np.maximum.reduceat(self.responses(ids, doc)[1], first, axis=0), 0)
        z = (pooled @ self.out + self.bias).astype(np.float64) * self.slope + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def begin(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Embeddings along one direction: the log odds of finding the hash in a text of label 1, shrunk
        by SURE standard errors."""
        direction = np.random.default_rng(self.seed + 1).normal(0, 1, DIMENSIONS)
        direction *= STRENGTH / np.linalg.norm(direction)
        of, size = (y == 1).astype(int), np.bincount(y.astype(int), minlength=2)
        for t in range(TABLES):
            n = np.zeros((2, 1 << HASH_BITS))
            for c, x in zip(of, texts):
                n[c, np.unique(x[:, t])] += 1
            odds = np.log((n[1] + 0.5) / (size[1] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1))
            odds = np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * np.sqrt(1 / (n[0] + 0.5) + 1 / (n[1] + 0.5)))
            odds[n.sum(0) == 0] = 0
            if t >= 2:
                odds[0] = 0
            self.emb[t] = odds[:, None] * direction

    def gradients(self, ids: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean weighted log loss of documents of n words each: (gradients of the filters, shift,
        out and bias; the words that embeddings get a gradient from, with repeats; the gradients of their sums)."""
        x, r = self.responses(ids, np.repeat(np.arange(len(n)), n))
        end = np.cumsum(n)
        where = np.zeros((len(n), r.shape[1]), np.int64)
        pooled = np.zeros((len(n), r.shape[1]), np.float32)
        for d, (a, b) in enumerate(zip(end - n, end)):
            if b > a:
                m = r[a:b].argmax(0)
                where[d], pooled[d] = m + a, r[a + m, np.arange(r.shape[1])]
        active = pooled > 0
        pooled *= active
        z = pooled @ self.out + self.bias
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(n)).astype(np.float32)
        back = g[:, None] * self.out * active  # to each document's and filter's one window
        grads, touched, changes = [], [], []
        last = end[:, None] - 1
        for k, f in enumerate(self.filters):
            b, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
            gf = np.zeros_like(f)
            for o in range(len(f)):
                inside = (at + o <= last) & (n[:, None] > 0)
                pos = np.where(inside, at + o, 0)
                bo = b * inside
                gf[o] = np.einsum("df,dfe->ef", bo, x[pos])
                touched.append(pos.reshape(-1))
                changes.append((bo[:, :, None] * f[o].T[None]).reshape(-1, DIMENSIONS))
            grads.append(gf)
        pos, change = np.concatenate(touched), np.concatenate(changes)
        live = np.flatnonzero(np.abs(change).sum(1))
        return [*grads, back.sum(0), g @ pooled, np.array([g.sum()], np.float32)], pos[live], change[live]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.005, rate_words: float = 0.02) -> Net:
        self.begin(texts, y)
        rng = np.random.default_rng(self.seed + 2)
        params = [*self.filters, self.shift, self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, steps = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for rows in (order[i : i + batch] for i in range(0, len(y), batch)):
                step += 1
                n = np.array([len(texts[r]) for r in rows])
                if not n.sum():
                    continue
                ids, left = np.concatenate([texts[r] for r in rows]), 1 - step / (steps + 1)
                grads, pos, change = self.gradients(ids, n, y[rows], weight[rows])
                for p, grad, (m, s) in zip(params, grads, moments):
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad * grad - s)
                    p -= rate * left * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                for t in range(TABLES):
                    real = ids[pos, t] > 0 if t >= 2 else np.ones(len(pos), bool)
                    np.subtract.at(self.emb[t], ids[pos[real], t], rate_words * left * change[real])
        return self

    def scores_of(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.array([self.scores(t, np.zeros(len(t), np.int64), 1)[0] for t in texts])

    def calibrate(self, scores: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list, least: int = 50) -> None:
        """From scores of unseen rows: slope and offset of the log odds (logistic regression, held near 1 and 0
        by a weak prior), then for each language with rows enough the threshold with the best F1,
        midway between scores."""
        z = np.stack([np.log(scores / (1 - scores)), np.ones(len(y))], 1)
        at = np.array([1.0, 0.0])
        for _ in range(20):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
            slope = z.T @ (weight * (p - y)) + (at - [1, 0])
            at = at - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(2), slope)
        self.slope, self.offset = max(0.1, float(at[0])), float(at[1])
        scores = 1 / (1 + np.exp(-np.clip(z @ [self.slope, self.offset], -30, 30)))
        for lang in sorted({x for x in langs if x is not None}):
            at = np.array([x == lang for x in langs])
            if at.sum() < least or len(set(y[at])) < 2:
                continue
            order = np.argsort(-scores[at], kind="stable")
            s, t, w = scores[at][order], y[at][order], weight[at][order]
            hit, all_ = np.cumsum(t * w), np.cumsum(w)
            f1 = np.where(np.append(s[1:] < s[:-1], True), 2 * hit / (all_ + (t * w).sum()), -1)
            best = int(f1.argmax())
            self.thresholds[lang] = float((s[best] + (s[best + 1] if best + 1 < len(s) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, words_per_row: int = WORDS_PER_ROW, seed: int = 3) -> Net:
    """docs: (doc_id, text, lang). The driver gets 12 bytes a word of at most 2 * rows_per_class rows of
    at most words_per_row words: 123 MB at most."""
    rows, sizes = sampling.labelled(docs, labels, target, rows_per_class)
    total = sum(sizes.values())
    net = Net(sizes.get(1, 0) / total if total else 0.5, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=SLICE_BYTES):
                ids, doc = word_ids(part.column(2))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                packed = []
                for i, a, b in zip(part.column(0).to_pylist(), cut.tolist(), cut[1:].tolist()):
                    if b - a > words_per_row:
                        a += zlib.crc32(b"%d" % i) % (b - a - words_per_row + 1)
                        b = a + words_per_row
                    packed.append(ids[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary()), part.column(3)], names=["doc_id", "y", "ids", "lang"])

    def constant() -> Net:
        net.out[:] = 0
        return net

    if len(sizes) < 2:
        return constant()
    # words are hashed on the executors
    packed = rows.select("doc_id", "y", "text", "lang").mapInArrow(run, "doc_id long, y int, ids binary, lang string").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = packed["y"].to_numpy().astype(np.float32)
    if len(set(y)) < 2:
        return constant()
    texts = [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, TABLES) for x in packed["ids"]]
    share = np.array([sizes.get(c, 0) / total / max(1, (y == c).sum()) * len(y) for c in (0, 1)], np.float32)
    weight = share[y.astype(int)]
    fold = np.array([zlib.crc32(b"inner %d" % i) % INNER_FOLDS for i in packed["doc_id"].to_pylist()])
    unseen = np.full(len(y), np.nan)
    for k in range(INNER_FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(own) and len(set(y[rest])) == 2:
            part = Net(sizes[1] / total, seed).fit([texts[i] for i in rest], y[rest], weight[rest])
            unseen[own] = part.scores_of([texts[i] for i in own])
    net.fit(texts, y, weight)
    known = ~np.isnan(unseen)
    net.calibrate(unseen[known], y[known], weight[known], [x for x, k in zip(packed["lang"].to_pylist(), known) if k])
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, text, lang) -> (doc_id, score, flagged): flagged by the language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in common.slices(batch, limit=SLICE_BYTES):
                s = m.scores(*word_ids(part.column(1)), part.num_rows)
                flag = [x >= m.thresholds.get(lang, THRESHOLD) for x, lang in zip(s.tolist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(flag, pa.bool_())], names=["doc_id", "score", "flagged"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, score double, flagged boolean")


def query(spark, sf_dir: str) -> DataFrame:
    raw = common.table(spark, sf_dir, "documents")
    docs = raw.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "flagged")
