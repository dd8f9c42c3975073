import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, quality_fm, rules, sampling, toxicity


def plain_posteriors(counts):
    """{votes: count} -> {votes: probability of the good kind}, by loops over rules, kinds and patterns."""
    kinds = [(), *rules.KINDS]
    start = [[rules.SEES if j in kind else rules.MISFIRE for j in range(rules.N_RULES)] for kind in kinds]
    bad, prior = [list(row) for row in start], [rules.PRIOR] + [(1 - rules.PRIOR) / 3] * 3

    def shares(v):
        q = []
        for k in range(4):
            x = prior[k]
            for j, vote in enumerate(v):
                x *= bad[k][j] if vote == -1 else 1 - bad[k][j] if vote == 1 else 1
            q.append(x)
        return [x / sum(q) for x in q]

    for _ in range(rules.ROUNDS):
        w = {v: [n * x for x in shares(v)] for v, n in counts.items()}
        prior = [(sum(x[k] for x in w.values()) + 1) / (sum(counts.values()) + 4) for k in range(4)]
        bad = [[(sum(x[k] for v, x in w.items() if v[j] == -1) + rules.SMOOTH * start[k][j]) / (sum(x[k] for v, x in w.items() if v[j]) + rules.SMOOTH) for j in range(rules.N_RULES)] for k in range(4)]
    assert all(0 < x < 1 for row in bad for x in row)
    return {v: shares(v)[0] for v in counts}


def code_of(votes, failed=False):
    return 2 * sum((v + 1) * 3 ** (rules.N_RULES - 1 - j) for j, v in enumerate(votes)) + failed


def found_posteriors(spark, counts):
    rows = [(code_of(v, failed),) for (v, failed), n in counts.items() for _ in range(n)]
    return {r["code"]: r for r in rules.posteriors(spark.createDataFrame(rows, "code int")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_posteriors_against_plain_expectation_maximisation(spark, seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(60):
        counts[tuple(r.choice([-1, 0, 1, 1, 1]) for _ in range(rules.N_RULES))] = r.randint(1, 40)
    counts[(1,) * rules.N_RULES] = 1500
    plain, found = plain_posteriors(counts), found_posteriors(spark, {(v, i % 7 == 0): n for i, (v, n) in enumerate(counts.items())})
    for i, v in enumerate(counts):
        row = found[code_of(v, i % 7 == 0)]
        assert math.isclose(row["posterior"], plain[v], rel_tol=1e-6, abs_tol=1e-9)
        assert row["base_failed"] == (i % 7 == 0) and row["kept"] == (i % 7 != 0 and plain[v] >= 0.5)


def votes_with(*bad):
    return tuple(-1 if j in bad else 1 for j in range(rules.N_RULES))


def test_verdicts_are_not_all_must_pass(spark):
    """A rule that misfires on good texts is outvoted; votes that are kept one by one reject together."""
    counts = {votes_with(): 2000, votes_with(2): 150, votes_with(8): 120, votes_with(0, 1): 40, votes_with(0, 1, 2): 40, votes_with(6, 7): 30, votes_with(6, 7, 8): 30, votes_with(3, 4): 60}
    found = found_posteriors(spark, {(v, False): n for v, n in counts.items()})
    kept = {v for v in counts if found[code_of(v)]["kept"]}
    assert kept == {votes_with(), votes_with(2), votes_with(8)}
    assert not found[code_of(votes_with(0, 1, 2))]["kept"]


def test_a_weak_bad_vote_is_outvoted_on_whole_texts(spark):
    r = random.Random(3)
    word = lambda low, high: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(low, high)))
    text = lambda low, high: ". ".join(" ".join(word(low, high) for _ in range(9)) for _ in range(8)) + "."
    rows = [(i, text(3, 8)) for i in range(300)] + [(1000 + i, text(7, 10)) for i in range(30)] + [(2000 + i, re.sub(r"(\w+)", r"\1$$$", text(3, 8))) for i in range(20)]
    judged = {x["doc_id"]: x["kept"] for x in rules.judge(rules.statistics(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {i for i, k in judged.items() if not k} == set(range(2000, 2020))


def small_net(seed=0):
    net = toxicity.Net(0.3, seed)
    net.emb[:] = np.random.default_rng(seed).normal(0, 0.3, net.emb.shape)
    return net


TEXTS = ["one two three four five one", "", "alpha", "beta gamma", "some longer text of several words, repeated words and others"]


def plain_scores(net, texts):
    """Convolution and pooling by loops over documents, filters, places and words."""
    out = []
    for t in texts:
        ids, _ = toxicity.word_ids(pa.array([t]))
        x = [sum(net.emb[k][w[k]].astype(float) for k in range(toxicity.TABLES)) for w in ids]
        z = float(net.bias[0])
        for k, f in enumerate(net.filters):
            for c in range(toxicity.FILTERS):
                at = k * toxicity.FILTERS + c
                best = max((sum(float(x[i + o] @ f[o][:, c]) for o in range(len(f)) if i + o < len(x)) + float(net.shift[at]) for i in range(len(x))), default=0.0)
                z += max(0.0, best) * float(net.out[at])
        out.append(1 / (1 + math.exp(-(z * net.slope + net.offset))))
    return out


def test_convolution_and_pooling_against_loops():
    net = small_net()
    net.slope, net.offset = 1.3, -0.2
    ids, doc = toxicity.word_ids(pa.array(TEXTS))
    assert np.allclose(net.scores(ids, doc, len(TEXTS)), plain_scores(net, TEXTS), atol=1e-5)


def test_gradients_against_finite_differences():
    net = small_net(1)
    parts = [toxicity.word_ids(pa.array([t]))[0] for t in TEXTS]
    n, ids = np.array([len(p) for p in parts]), np.concatenate(parts)
    y, weight = np.array([1, 0, 1, 0, 1], np.float32), np.array([1, 2, 1, 0.5, 1], np.float32)

    def loss():
        p = np.array(plain_scores(net, TEXTS))
        return float((-np.where(y == 1, np.log(p), np.log(1 - p)) * weight).mean())

    grads, pos, change = net.gradients(ids, n, y, weight)
    step, r = 1e-3, np.random.default_rng(2)
    for p, g in zip([*net.filters, net.shift, net.out, net.bias], grads):
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + step
            up = loss()
            p[at] = old - step
            assert math.isclose((up - loss()) / (2 * step), g[at], abs_tol=2e-3)
            p[at] = old
    word, c = ids[pos[0], 0], int(np.abs(change[0]).argmax())
    total = sum(ch[c] for at, ch in zip(pos, change) if ids[at, 0] == word)
    old = net.emb[0][word, c]
    net.emb[0][word, c] = old + step
    up = loss()
    net.emb[0][word, c] = old - step
    assert math.isclose((up - loss()) / (2 * step), total, abs_tol=2e-3)


def test_proper_prefixes_leave_the_bare_stem_alone():
    ids, _ = toxicity.word_ids(pa.array(["abcdefg abcdefgh abcdefgi"]))
    assert ids[0, 5] == 0 and ids[1, 5] == ids[2, 5] > 0 and ids[0, 2] == ids[1, 2] > 0


@pytest.mark.parametrize("seed", range(5))
def test_toxicity_hardly_depends_on_the_seed(spark, seed):
    """Held-out AUC over five seeds of filters, output layer and order."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (common.table(spark, folder, t) for t in ("documents", "labels"))
    net = toxicity.train(docs.select("doc_id", "text", "lang"), labels, seed=seed)
    rows = toxicity.score(docs, net).join(labels, "doc_id").where(sampling.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) >= 0.9


def test_samples_are_bounded_in_rows_and_words(spark):
    """Repeated ids do not multiply the sample, and long texts give a stretch."""
    rows = [(1, "bad words here"), (1, "another text"), (2, "fine words " * 3000), (2, None), (3, ""), (4, "bad " * 5000), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, t) for i, q, t in [(1, 0, 1), (2, 1, 0), (3, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1)]], "doc_id long, quality int, toxic int")
    taken, sizes = sampling.labelled(docs, labels, "toxic", 10)
    held = {i for i in range(1, 5) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sorted(r["doc_id"] for r in taken.collect()) == sorted({1, 2, 3, 4} - held) and sum(sizes.values()) == 4 - len(held)
    net = toxicity.train(docs, labels, words_per_row=8)
    assert toxicity.score(docs, net).count() == len(rows)
    assert quality_fm.score(common.texts(docs), quality_fm.train(common.texts(docs), labels, entries_per_row=20)).count() == len(rows)
