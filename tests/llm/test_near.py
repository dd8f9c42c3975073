import random

import corpus_pipeline
import pytest

from quarry.llm import near

from .test_dedup import words


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def plain_kept(rows):
    """The smallest id of each component of pairs with a Jaccard likeness of 0.8."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    first = {}
    for (i, _), r in zip(rows, root):
        first[r] = min(i, first.get(r, i))
    return sorted(first.values())


def edited(r, n, changes):
    w = [f"w{r.randrange(10**6)}" for _ in range(n)]
    at = set(range(n // 2 - 10 * changes, n // 2 + 10 * changes, 20))
    return " ".join(w), " ".join("changed" if i in at else x for i, x in enumerate(w))


@pytest.mark.parametrize("n,changes", [(100, 1), (400, 4), (400, 8)])
def test_the_pipeline_drops_copies_with_some_words_changed(spark, n, changes):
    r = random.Random(n + changes)
    rows = [(2 * i + k, t, "en", "s", len(t)) for i in range(20) for k, t in enumerate(edited(r, n, changes))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, df, "").collect()) == list(range(0, 40, 2))


def test_near_dedup_against_brute_force(spark, docs):
    found = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert found == plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("cluster_rows", [4, 512])
def test_clusters_in_chunks_stay_exact(spark, cluster_rows):
    """A chain of texts, each like the next, and copies at, above and below the limit."""
    r = random.Random(5)
    w = [f"w{r.randrange(10**6)}" for _ in range(130)]
    rows = [(i, " ".join(w[i : i + 60])) for i in range(0, 70, 2)]
    rows += [(100 + i, " ".join(["a" + x for x in w[:100]] + [f"x{i}_{k}" for k in range(i)])) for i in range(0, 40, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near.deduplicate(df, cluster_rows=cluster_rows).collect())
    assert kept == plain_kept(rows)
