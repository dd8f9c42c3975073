"""Operators whose queries have no SQL, and library forms of the streams, against brute force."""

import itertools
import math
import random
import time
import zlib
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import plans, streaming
from quarry.functions import stats
from quarry.operators import asof, graph, order
from quarry.plans import learned, structures
from quarry.sources import io

from .conftest import SMALL


def rows(spark, name):
    return plans.QUERIES[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def vectors(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in e]), np.stack([np.array(r["embedding"], float) for r in e]), np.array([r["label"] for r in e])


@pytest.mark.parametrize("seed", range(4))
def test_prefix_map_against_a_loop(spark, seed):
    r = random.Random(seed)

    def spans():
        at, out = 0, []
        for _ in range(r.randint(0, 12)):
            end = at + r.choice([0, 1, 1, 2, 5])
            out.append((at, end))
            at = end + r.choice([0, 0, 1])
        return out

    source, target = spans(), spans()
    expected = [max([i for i, (s, e) in enumerate(target) if e > s and e <= end], default=-1) if end > start else -1 for start, end in source]
    df = spark.createDataFrame([(source, target)], "s array<struct<s:int,e:int>>, t array<struct<s:int,e:int>>")
    assert df.select(asof.prefix_map(F.col("s"), F.col("t"))).first()[0] == expected


def test_orders_and_quantiles_within_groups(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), r.choice([None, *range(20)]), i, r.random()) for i in range(400)]
    df = spark.createDataFrame(data, "g string, k int, id int, v double")
    found = {x["id"]: (x["idx"], x["before"]) for x in order.prefix_sum(order.row_index(df, "k", "idx", ["id"], ["g"]), "k", "v", "before", ["id"], ["g"]).collect()}
    for g in ("a", "b", None):
        part = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        total = 0.0
        for n, x in enumerate(part):
            assert found[x[2]][0] == n and math.isclose(found[x[2]][1], total, abs_tol=1e-9)
            total += x[3]
    q = {x["g"]: (x["a"], x["b"]) for x in order.quantiles(df, ["g"], "k", {"a": 0.3, "b": 1.0}).collect()}
    for g in ("a", "b", None):
        k = [x[1] for x in data if x[0] == g and x[1] is not None]
        assert np.allclose(q[g], np.quantile(k, [0.3, 1.0]))
    empty = df.limit(0)
    assert order.quantiles(empty, ["g"], "k", {"a": 0.5}).count() == 0 and order.row_index(empty, "k", by=["g"]).count() == 0


def test_no_window_over_a_whole_group(spark):
    """Rank statistics cumulate within ranges of the value: every window over values is partitioned by the range too."""
    e = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("s"), (F.col("id") % 3 > 0).cast("int").alias("y"))
    for d in (stats.auroc(e, ["g"], "s", "y"), stats.auprc(e, ["g"], "s", "y", "s"), stats.average_ranks(e, ["g"], "s")):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x]
        assert windows and all("_bucket" in x or "_of" in x for x in windows)


def test_matrix_ridge(spark, vectors):
    _, x, label = vectors
    y, n = (label % 2).astype(float), len(label)
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 10 * np.eye(x.shape[1]), c.T @ (y - y.mean()))
    found = {r["dim"]: r["w"] for r in rows(spark, "evl28_ridge_matrix")}
    assert np.allclose([found[i] for i in range(len(w))], w, atol=2e-6) and abs(found[-1] - (y.mean() - x.mean(0) @ w)) < 2e-6 and n


def test_shrinkage_lda(spark, vectors):
    _, x, label = vectors
    a, b = x[label % 2 == 1], x[label % 2 == 0]
    s = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / (len(x) - 2)
    s = 0.9 * s + 0.1 * np.trace(s) / len(s) * np.eye(len(s))
    w = np.linalg.solve(s, a.mean(0) - b.mean(0))
    assert np.allclose([r["w"] for r in sorted(rows(spark, "evl29_lda"))], w, rtol=1e-4, atol=1e-5)


def test_balanced_logistic_has_no_gradient_left(spark, vectors):
    _, x, label = vectors
    y = label % 2
    w = learned.balanced_logistic(spark.read.parquet(f"{SMALL}/embeddings.parquet").withColumn("y", (F.col("label") % 2).cast("int")), "embedding", "y", rounds=12)
    one = np.concatenate([x, np.ones((len(x), 1))], 1)
    k = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    g = one.T @ (k * (1 / (1 + np.exp(-one @ w)) - y)) + np.append(w[:-1], 0)
    assert np.abs(g).max() < 1e-6


def test_condition_and_rank(spark, vectors):
    _, x, _ = vectors
    e = np.linalg.eigvalsh(x.T @ x / len(x))
    r = rows(spark, "evl47_condition")[0]
    assert math.isclose(r["condition"], e.max() / e.min(), rel_tol=1e-3) and math.isclose(r["effective_rank"], e.sum() ** 2 / (e * e).sum(), abs_tol=1e-3)


@pytest.mark.parametrize("t,df,p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 2, 0.18350341907227), (12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (1.959963985, 1e7, 0.05), (-2.228138852, 10, 0.05)])
def test_p_values_of_t(t, df, p):
    assert math.isclose(learned.t_p_value(t, df), p, rel_tol=1e-5)


def test_p_value_of_the_query(spark):
    r = rows(spark, "evl22_paired_p")[0]
    assert math.isclose(r["p_value"], learned.t_p_value(r["t_"], r["n"] - 1), abs_tol=2e-6)


def test_principal_angles(spark, vectors):
    _, x, label = vectors
    for r in rows(spark, "evl26_principal_angles")[:5]:
        assert all(0 <= a <= math.pi / 2 + 1e-6 for a in r["angles"]) and list(r["angles"]) == sorted(r["angles"])


def test_nearest_length_pairs(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet").where("event_type IN ('purchase', 'click')").collect()
    expected = set()
    for user in {r["user_id"] for r in e}:
        clicks = sorted((r["value"], r["event_id"]) for r in e if r["user_id"] == user and r["event_type"] == "click")
        for v, i in sorted((r["value"], r["event_id"]) for r in e if r["user_id"] == user and r["event_type"] == "purchase"):
            if clicks:
                fits = [c for c in clicks if c[0] >= v]
                c = fits[0] if fits else clicks[-1]
                clicks.remove(c)
                expected.add((user, i, c[1]))
    assert {tuple(r) for r in rows(spark, "joi11_nearest_length")} == expected and bisect_left([1], 1) == 0


def test_documents_are_emitted_once_complete(spark, tmp_path):
    """Windows come in any order, some twice and in two batches; one document never gets its last one."""
    r = random.Random(2)
    data = [(d, w, 1 + d % 4, float(d + w)) for d in range(30) for w in range(1 + d % 4) if not (d == 7 and w == 2)]
    data += data[::3]
    r.shuffle(data)
    path = str(tmp_path / "in")
    for part in (data[:40], data[40:]):
        spark.createDataFrame(part, "doc long, w long, of long, v double").coalesce(1).write.mode("append").parquet(path)
    s = streaming.file_stream(spark, path, spark.read.parquet(path).schema)
    out = streaming.drain(streaming.complete_documents(s, "doc", "w", "of", "v"), "complete", "append", str(tmp_path / "c")).collect()
    assert sorted((x["doc"], x["n"], x["total"]) for x in out) == [(d, 1 + d % 4, sum(float(d + w) for w in range(1 + d % 4))) for d in range(30) if d != 7]


def test_uploader_blocks_and_raises():
    done = []
    u = streaming.Uploader(lambda x: (time.sleep(0.05), done.append(x)))
    began = time.perf_counter()
    for i in range(6):
        u.put(i)
    assert time.perf_counter() - began > 0.15
    u.close()
    assert done == list(range(6))

    def fail(x):
        raise OSError("no room")

    u = streaming.Uploader(fail)
    with pytest.raises(RuntimeError, match="upload failed"):
        for i in itertools.count():
            u.put(i)
            time.sleep(0.01)
            assert i < 100
    with pytest.raises(RuntimeError):
        u.close()


def test_waiting_ends():
    asked = []
    streaming.wait_until(lambda: asked.append(1) or len(asked) == 3, 0.01, 5)
    assert len(asked) == 3
    with pytest.raises(TimeoutError):
        streaming.wait_until(lambda: False, 0.01, 0.05)


def test_sections(spark):
    text = "lost\n---A---\n one\ntwo \n\n---B C---\n---not one--- here\n---D---"
    got = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(io.sections(F.col("t")).alias("s")).collect()
    assert [tuple(x) for x in got[0]["s"]] == [("A", "one\ntwo"), ("B C", "---not one--- here"), ("D", "")] and got[1]["s"] == [] and got[2]["s"] is None


def test_crc32(spark):
    assert all(r["seed"] == zlib.crc32(str(r["doc_id"]).encode()) for r in rows(spark, "hsh2_crc32_seed"))


def test_batches_of_grids_against_single_ones():
    r = np.random.default_rng(3)
    edges = structures._grid_edges()
    n = structures.SIDE**2
    conn, start, target = r.random((60, len(edges))) < 0.6, r.integers(0, n, 60), r.integers(0, n, 60)
    dist, paths = graph.batch_distances(n, edges, conn, target), graph.batch_paths(n, edges, conn, start, target)
    for c, s, t, d, p in zip(conn, start, target, dist, paths):
        own = [e for e, o in zip(edges, c) if o]
        assert d.tolist() == graph.distances(n, own, int(t)) and p == graph.shortest_path(n, own, int(s), int(t))


def test_walks_and_edits_of_the_mazes(spark):
    """Each walk goes along open edges and never onto the avoided target; each edit keeps a spanning tree."""
    edges = structures._grid_edges()
    mazes = {r["maze"]: r.asDict() for r in structures.mazes(plans.base.Tables(spark, SMALL)).collect()}
    walks = rows(spark, "gra10_random_walk")
    assert {r["maze"] for r in walks} == set(mazes)
    for r in walks:
        m = mazes[r["maze"]]
        good = {x for (a, b), o in zip(edges, m["conn"]) if o for x in ((a, b), (b, a))}
        assert r["walk"][0] == m["start"] and all(x in good for x in zip(r["walk"], r["walk"][1:])) and m["target"] not in r["walk"][1:]
    for r in rows(spark, "gra9_counterfactual_edit"):
        if r["closed"]:
            tree = [e for e in structures._tree(mazes[r["maze"]]) if sorted(e) != sorted(r["closed"])]
            assert graph.is_spanning_tree(structures.SIDE**2, tree + [tuple(r["opened"])])
    for r in rows(spark, "gra4_spanning_tree"):
        assert r["tree"] and r["steps"] >= 0
    for r in rows(spark, "gra7_rollout_judge"):
        assert 0 <= r["valid_share"] <= 1
        assert not r["clean"] or r["valid_share"] in (0, 1)  # 0: the walk began on the target


def test_degenerate_flags_against_plain(spark):
    import re

    def plain(x):
        x = x or ""
        share = sum(c.isascii() and c.isalpha() or c == " " for c in x) / max(1, len(x))
        small = len(x) >= 60 and len(zlib.compress(x.encode())) / max(1, len(x.encode())) < 0.35
        return small or share < 0.55 or bool(re.search(r"\s{5,}|(.)\1{7,}|(\.\.\..*){3}", x))

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r["doc_id"]: r["degenerate"] for r in rows(spark, "flt3_degenerate")}
    assert found == {i: plain(x) for i, x in texts.items()} and any(found.values()) and not all(found.values())


def test_match_positions_against_a_loop(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    word = lambda x, i: 0 <= i < len(x) and (x[i].isalnum() or x[i] == "_")
    for r in rows(spark, "str5_match_positions"):
        x = texts[r["doc_id"]]
        assert r["at"] == [i for i in range(len(x) - 2) if x[i : i + 3] == "the" and not word(x, i - 1) and not word(x, i + 3)]


def test_pinned_entropy(spark):
    r = rows(spark, "mth3_pinned_entropy")[0]
    p = np.array([r["ratio"] ** i for i in range(8)])
    p /= p.sum()
    assert abs(r["entropy"] - 1.5) < 1e-5 and abs(-(p * np.log(p)).sum() - 1.5) < 1e-4


def test_markov_symbols_move_by_drawn_steps(spark):
    """Fifty symbols after the first, all four occurring, and staying (weight 4 of 8) about half of the time."""
    found = rows(spark, "gra11_markov_source")
    assert len(found) == 40 and all(len(r["symbols"]) == 51 and set(r["symbols"]) <= {0, 1, 2, 3} for r in found)
    steps = [(b - a) % 4 for r in found for a, b in zip(r["symbols"], r["symbols"][1:])]
    share = np.bincount(steps, minlength=4) / len(steps)
    assert np.allclose(share, [4 / 8, 2 / 8, 1 / 8, 1 / 8], atol=0.05)


def test_dfs_roots_against_a_search(spark):
    """A root is valid if, for each closed edge, one end is on the other's path to the root."""
    mazes = {r["maze"]: r.asDict() for r in structures.mazes(plans.base.Tables(spark, SMALL)).collect()}
    n = structures.SIDE**2
    for r in rows(spark, "gra5_dfs_roots")[:20]:
        tree = structures._tree(mazes[r["maze"]])
        closed = [e for e in structures._grid_edges() if e not in tree][:2]
        fits = [root for root in range(n) if all(a in graph.shortest_path(n, tree, b, root) or b in graph.shortest_path(n, tree, a, root) for a, b in closed)]
        assert r["roots"] == fits


def test_drawn_trees_in_batches_equal_those_of_single_mazes():
    """Seeds of one and of two 32-bit words, and negative ones; the roots of a batch are those of each tree alone."""
    seeds = np.array([0, 1, 7, 14999, 899_999, 2**32 - 1, 2**32, 2**40 + 3, 2**62 + 5, -9, *range(1000, 1400)])
    n, edges = structures.SIDE**2, structures._grid_edges()
    order = graph.drawn_orders(seeds, len(edges))
    assert all(order[i].tolist() == random.Random(int(s)).sample(range(len(edges)), len(edges)) for i, s in enumerate(seeds))
    wide = graph.drawn_orders(seeds[:12], 200)  # more words than are read at once
    assert all(wide[i].tolist() == random.Random(int(s)).sample(range(200), 200) for i, s in enumerate(seeds[:12]))
    taken = graph.batch_trees(n, edges, order)
    found = graph.batch_dfs_roots(n, edges, taken, 2)
    for i, s in enumerate(seeds):
        tree = structures._tree({"maze": s})
        assert {e for e, t in zip(edges, taken[i]) if t} == set(tree)
        assert found[i] == graph.valid_dfs_roots(n, tree, [e for e in edges if e not in tree][:2])


def test_earliest_layer_at_the_limit_and_without_supplier(spark, tmp_path):
    """0.7 of the largest sum, exactly, in whichever order the discounts are added; rows without a supplier are a group too."""
    at_limit = [x for k in range(1, 9) for x in (0.01 * k, 0.1, 0.3)]
    data = []
    for c in (None, *range(30)):
        mine = random.Random(str(c)).sample(at_limit, len(at_limit))
        cents = sum(round(100 * x) for x in mine)
        data += [(c, 1, x) for x in mine] + [(c, 2, cents / 70)] + [(c, 3, cents / 70 - 1)]
    rows_ = spark.createDataFrame(data, "l_suppkey long, l_linenumber int, l_discount double")
    rows_.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.QUERIES["evl15_earliest_layer"](spark, str(tmp_path)).collect()
    assert {r["c"]: r["layer"] for r in found} == {c: 1 for c in (None, *range(30))}
