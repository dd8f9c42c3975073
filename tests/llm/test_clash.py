"""Columns of the caller's that are called like the operators' own stay as they are."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints, line_dedup, near, rules, simhash, substring

OWN = ["k1", "k2", "_k1", "_k2", "row", "_row", "at", "_at", "lines", "_lines", "stay", "_stay", "cuts", "_cuts", "n_words", "n_lines", "n_removed", "code", "kept", "posterior", "fp", "root", "sid", "n", "buckets", "salt", "component", "bucket", "extra", "before", "x", "b"]


@pytest.fixture(scope="module")
def clashing(spark, odd):
    return odd.select("doc_id", "text").withColumns({c: F.lit(f"mine {c}") for c in OWN})


@pytest.mark.parametrize("apply", [substring.remove_repeats, line_dedup.remove_repeated_lines, simhash.deduplicate, near.deduplicate, rules.keep_good])
def test_own_columns_stay(spark, odd, clashing, apply):
    out = apply(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert all(r[c] == f"mine {c}" for r in rows for c in OWN)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in apply(odd.select("doc_id", "text")).collect())


def test_repeated_and_null_ids_are_dealt_out(spark):
    """Rows of one id, or of none, follow each other by text and spread over the ranges."""
    rows = [(i, f"text {j} of {i} " + "words " * j) for i in (None, 5) for j in range(60)] + [(9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = Counter((i, t, u) for (i, t), (_, u) in zip(order, order[1:] + order[:1]))
    pairs = Counter()
    for part in fingerprints.neighbours(df).rdd.glom().collect():
        assert len(part) < 100
        for a, b in zip(part, part[1:]):
            if not a["extra"]:
                pairs[a["doc_id"], a["text"], b["text"]] += 1
    assert pairs == expected


def test_gray_candidates_are_all_pairs_within_the_limit():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 60, np.uint64)
    sets = [np.unique(np.concatenate((base[r.permutation(60)[: r.integers(40, 61)]], r.integers(0, 1 << 62, r.integers(0, 30), np.uint64)))) for _ in range(70)]
    fp = [near.set_fingerprint(s) for s in sets]
    for s, f in zip(sets, fp):
        ones = [sum(int(x) >> b & 1 for x in s) for b in range(64)]
        assert sorted(2 * o > len(s) for o in ones) == sorted(bool(f >> b & 1) for b in range(64))
    plain = [(i, j) for i in range(70) for j in range(i + 1, 70) if (fp[i] ^ fp[j]).bit_count() <= 20]
    assert 0 < len(plain) < 70 * 69 // 2
    assert list(zip(*(x.tolist() for x in near.candidates(sets, 20)))) == plain


def test_hashes_do_not_depend_on_the_runs(monkeypatch):
    from quarry.llm import textkit

    r = np.random.default_rng(5)
    buf = r.choice(np.frombuffer(b"abcdefgh \n", np.uint8), 5000)
    off = np.array([0, 0, 700, 2500, 5000])
    s, e, doc = textkit.words(buf, off)
    for family in (0, 1):
        whole = textkit.word_hashes(buf, s, e, family)
        rolling = textkit.windows(whole, doc, 7, family)
        with monkeypatch.context() as m:
            m.setattr(textkit, "CHUNK", 13)
            assert (textkit.word_hashes(buf, s, e, family) == whole).all()
            again = textkit.windows(whole, doc, 7, family)
            assert (again[0] == rolling[0]).all() and (again[1] == rolling[1]).all()
    assert (textkit.word_hashes(buf, s, e, 0) != textkit.word_hashes(buf, s, e, 1))[e - s > 1].all()  # one byte is no polynomial
