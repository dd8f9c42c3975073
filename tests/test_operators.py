"""Hand cases, round trips and properties of the library's operators."""

import json
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars, stats
from quarry.operators import alike, asof, dedup, graph, order
from quarry.plans.evaluation import isotonic
from quarry.plans.joins import hungarian
from quarry.sources import io


def test_as_of_takes_the_last_not_after(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (3, 9, "d")], "g int, at int, id string")
    right = spark.createDataFrame([(1, 5, 10), (1, 2, 20), (2, 10, 30), (3, 9, None)], "g int, at int, v int")
    found = {r["id"]: r["out"] for r in asof.as_of_backward(left, right, ["g"], "at", "v", "out").collect()}
    assert found == {"a": 10, "b": None, "c": None, "d": None}


@pytest.mark.parametrize("spec,out", [("320-322,330", [320, 321, 322, 330]), ("5,3,1", [1, 3, 5]), ("1-3,2-4", [1, 2, 3, 4])])
def test_ranges(spark, spec, out):
    assert io.parse_ranges(spec) == out
    assert spark.createDataFrame([(spec,)], "s string").select(io.expand_ranges(F.col("s"))).first()[0] == out


def test_bad_range():
    with pytest.raises(ValueError):
        io.parse_ranges("3-1")


def test_quantize_rounds_half_to_even_and_clips(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -0.5, -1.5, 500.0, -500.0)], "x double")
    assert [r[0] for r in df.select(scalars.quantize(F.col("x"), F.lit(0.0), F.lit(1.0))).collect()] == [0, 2, 2, 0, -2, 127, -127]


def test_average_ranks_and_degenerate_spearman(spark):
    df = spark.createDataFrame([(0, x, 1) for x in (1, 2, 2, 3)], "g int, x int, c int")
    assert sorted(r["rank"] for r in stats.average_ranks(df, ["g"], "x").collect()) == [1, 2.5, 4]
    assert stats.spearman(df, ["g"], "x", "c").first()["rho"] is None
    assert stats.spearman(df, ["g"], "x", "c", constant=0.0).first()["rho"] == 0


def test_missing_values_have_two_polarities(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "x double")
    x = F.col("x")
    assert [tuple(r) for r in df.select(scalars.at_least(x, 1), scalars.at_most(x, 1), scalars.check_at_least(x, 1)).collect()] == [(False, False, True)] * 2 + [(True, False, True)]


def test_order_without_one_sorted_partition(spark):
    rows = [(i * 7 % 100, i) for i in range(100)]
    found = {r["k"]: r["idx"] for r in order.row_index(spark.createDataFrame(rows, "k long, v long"), "k").collect()}
    assert found == {i: i for i in range(100)}


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(2)
    base = [[r.choice("abcdefghijklmnop") * 2 for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(w if r.random() > 0.02 else "zz" for w in base[i % 6])) for i in range(30)]
    sets = {i: {tuple(t.split()[k : k + 8]) for k in range(33)} for i, t in rows}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    ids = sorted(first.values())
    expected = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    pairs = dedup.shingle_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {(r["a"], r["b"]) for r in pairs.collect()} == expected


def alike_by_loops(rows):
    """Pairs of smallest ids of equal sets, by definition."""
    first = {}
    for i, t in sorted(rows):
        w = re.findall("[a-z0-9']+", t.lower()) if t is not None else None
        s = frozenset([None] if w is None else [tuple(w)] if len(w) <= 8 else [tuple(w[k : k + 8]) for k in range(len(w) - 7)])
        first.setdefault(s, i)
    sets = sorted((i, s) for s, i in first.items())
    return {(a, b, round(len(x & y) / len(x | y), 9)) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= 0.6}


def test_near_pairs_of_odd_texts_and_crowds(spark, monkeypatch):
    """Null, empty, short and eight-word texts, texts that are mostly one frequent passage, copies and near copies in blocks,
    and crowds split over several cells."""
    r = random.Random(11)
    word = lambda: "w%d" % r.randrange(5000)
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    texts = [None, None, "", " ", "one", "One!", "a b c d e f g h", "a b c d e f g h i", "b c d e f g h i", *["x " * k for k in (7, 8, 9, 30)]]
    texts += [" ".join(base[: r.randrange(30, 61)]) for _ in range(60)]
    texts += [" ".join(x if r.random() > 0.03 else word() for x in base) for _ in range(40)]
    texts += [" ".join([word() for _ in range(r.randrange(0, 40))] + passage) for _ in range(120)]
    texts += [" ".join(word() for _ in range(r.randrange(1, 80))) for _ in range(80)]
    rows = [(3 * i - 100, t) for i, t in enumerate(texts + texts[::3])]
    monkeypatch.setattr(alike, "CELL", 16)
    monkeypatch.setattr(alike, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(alike, "PAIRS", 500)
    found = dedup.shingle_pairs(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text").collect()
    assert sorted((r["a"], r["b"], round(r["jaccard"], 9)) for r in found) == sorted(alike_by_loops(rows))


def test_near_pairs_write_no_whole_sets(spark, tmp_path):
    """What is checkpointed is some bytes a text: whole sets of hashes were eight bytes a word."""
    import os

    r = random.Random(3)
    rows = [(i, " ".join("w%d" % r.randrange(9999) for _ in range(400))) for i in range(300)]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    df, before = spark.createDataFrame(rows, "id long, text string"), size()
    pairs = dedup.shingle_pairs(df, "id", "text")
    assert pairs.count() == 0 and size() - before < 300 * 400
    assert pairs.columns == ["a", "b", "jaccard"]

def test_sent_shingles_follow_from_the_limit():
    assert all((1 - t) ** alike.depth(t) < 2e-16 for t in (0.1, 0.3, 0.6, 0.8)) and alike.depth(0.6) == 40 and alike.depth(1.0) >= 1


def test_greedy_drops_by_kept_rows_only(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (5, 7), (6, 7)], "a long, b long")
    assert {r["b"] for r in dedup.greedy_kept(pairs).collect()} == {2, 4, 6, 7}


def test_greedy_drops_equal_sets_and_their_members(spark):
    w = [f"w{i}" for i in range(40)]
    near = " ".join([*w[:39], "other"])
    rows = [(1, " ".join(w)), (2, " ".join(w)), (3, near), (4, near), (5, "alone " * 9), (6, "alone " * 9), (7, " ".join(f"v{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r["id"], r["first"]) for r in dedup.shingle_classes(df, "id", "text").collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7)}
    assert sorted(r["id"] for r in dedup.greedy_dropped(df, "id", "text").collect()) == [2, 3, 4, 6]


def test_greedy_drop_writes_no_whole_sets(spark):
    import os

    r = random.Random(4)
    rows = [(i, " ".join("w%d" % r.randrange(9999) for _ in range(400))) for i in range(300)]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    df, before = spark.createDataFrame(rows + [(300, rows[0][1])], "id long, text string"), size()
    assert [r["id"] for r in dedup.greedy_dropped(df, "id", "text").collect()] == [300] and size() - before < 300 * 400


@pytest.mark.parametrize("sample", [8192, 20])
def test_greedy_drop_of_texts_with_a_common_passage(spark, monkeypatch, sample):
    """Texts that have only a passage in common are no candidates, whichever sample finds it; near and exact copies are
    dropped as by definition, also of texts that are mostly passage."""
    r = random.Random(5)
    word = lambda: "w%d" % r.randrange(9999)
    passage = [word() for _ in range(40)]
    texts = [" ".join([word() for _ in range(60)] + passage) for _ in range(250)] + [" ".join(passage + [word() for _ in range(r.randrange(30))]) for _ in range(50)]
    texts += [t.replace(t.split()[7], word(), 1) for t in texts[::5]] + texts[::20]
    r.shuffle(texts)
    rows, seen, released = list(enumerate(texts)), [], alike._released
    monkeypatch.setattr(alike, "SAMPLE", sample, raising=False)
    monkeypatch.setattr(alike, "_released", lambda df: seen.append(released(df)) or seen[-1])
    dropped = {x["id"] for x in dedup.greedy_dropped(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    sets = {i: {tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)} for i, t in rows}
    kept = []
    for i, x in sets.items():
        if not any(len(x & sets[k]) / len(x | sets[k]) >= 0.6 for k in kept):
            kept.append(i)
    assert dropped == sets.keys() - kept and len(dropped) > 50
    assert sample < 8192 or seen[0].count() < 4000


@pytest.mark.parametrize("links,local", [(600, 1 << 16), (110, 0)])
def test_greedy_settles_long_chains(spark, links, local):
    """Each row is like the next one only, so every second row goes."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(links)], "a long, b long")
    assert {r["b"] for r in dedup.greedy_kept(pairs, local_pairs=local).collect()} == set(range(1, links + 1, 2))


def test_json_from_text(spark):
    df = spark.createDataFrame([('{"v": 1.5}',), ('so {"v": 2.5} there',), ('[{"v": 3.5}]',), ("none",)], "s string")
    assert [r[0] for r in df.select(io.json_object(F.col("s"), "v double")["v"]).collect()] == [1.5, 2.5, 3.5, None]


def test_jsonl_skips_blank_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert sorted(r["a"] for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long").collect()) == [1, 2]
    assert io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long", keep_bad=True).count() == 3


def test_objects_paths_and_splits(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "g3-s4.json").write_text(json.dumps({"k": 1, "ref": {"x": 2.0}}, indent=1))
    assert io.read_objects(spark, str(tmp_path / "o"), "k int, ref struct<x: double>", "ref").first().asDict() == {"k": 1, "ref_x": 2.0}
    d = io.with_path_fields(spark.read.text(str(tmp_path / "o")), r"g(\d+)-s(\d+)", ["g", "s"])
    assert (d.first()["g"], d.first()["s"]) == ("3", "4")
    io.write_split(spark.createDataFrame([(1, "a"), (2, "b")], "v int, part string"), str(tmp_path / "w"), ["part"])
    assert spark.read.parquet(str(tmp_path / "w")).where("part = 'b'").first()["v"] == 2
    assert io.file_checksums(spark, str(tmp_path / "o")).first()["length"] > 0


def test_merge_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    once = io.merge_new(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, io.merge_new(once, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_hungarian_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6)):
        c = rng.normal(size=(n, m))
        got = hungarian(c)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert len(set(got)) == n and abs(sum(c[i, j] for i, j in enumerate(got)) - best) < 1e-9


def test_isotonic_rises_and_keeps_the_mean():
    y = np.array([1.0, 3, 2, 4, 3.5])
    f = isotonic(np.arange(5.0), y)
    assert (np.diff(f) >= 0).all() and abs(f.mean() - y.mean()) < 1e-12 and f.tolist() == [1, 2.5, 2.5, 3.75, 3.75]


def test_grid_paths():
    edges = [(0, 1), (1, 2), (0, 3), (3, 4), (4, 5), (2, 5)]
    assert graph.distances(6, edges, 5) == [3, 2, 1, 2, 1, 0]
    assert graph.shortest_path(6, edges, 0, 5) == [0, 1, 2, 5]
    assert not graph.is_spanning_tree(6, edges) and graph.is_spanning_tree(6, edges[:-1])
    assert graph.valid_dfs_roots(6, edges[:-1], [(2, 5)]) == [2, 5]
