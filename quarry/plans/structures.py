"""ARR, MAP, JSN, GRA, STM: nested values, small graphs, merged accumulators."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph
from .base import query, r6

_SPARSE = "(SELECT l_suppkey AS g, (l_orderkey % 20)::INT AS i, max(l_discount) AS v FROM lineitem WHERE l_orderkey % 20 < 16 GROUP BY 1, 2)"


def sparse(t):
    i = (F.col("l_orderkey") % 20).cast("int")
    return t("lineitem").where(i < 16).groupBy(F.col("l_suppkey").alias("g"), i.alias("i")).agg(F.max("l_discount").alias("v"))


@query("arr1_dense", f"SELECT g, string_agg(coalesce(v, 0)::VARCHAR, ',' ORDER BY i) AS dense FROM (SELECT g, i FROM (SELECT DISTINCT g FROM {_SPARSE}), range(16) AS r(i)) LEFT JOIN {_SPARSE} USING (g, i) GROUP BY g")
def _(t):
    """Sparse to dense with the maximum on a collision; indices out of range are dropped."""
    m = sparse(t).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return m.select("g", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)).cast("string")), ",").alias("dense"))


@query("arr2_sorted_pairs", f"SELECT g, string_agg(i || ':' || v, ',' ORDER BY i) AS pairs FROM {_SPARSE} GROUP BY g")
def _(t):
    p = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: F.concat_ws(":", x["i"].cast("string"), x["v"].cast("string")))
    return sparse(t).groupBy("g").agg(F.array_join(p, ",").alias("pairs"))


@query("arr3_path_edges", "SELECT user_id, count(*) FILTER (a <> b) AS changes FROM (SELECT user_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) GROUP BY 1")
def _(t):
    g = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("p"))
    edges = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return g.select("user_id", F.size(F.filter(edges, lambda e: e["a"] != e["b"])).cast("long").alias("changes"))


@query("map1_class_targets", "SELECT l_returnflag, list_sort(list(DISTINCT l_linenumber)) AS ks FROM lineitem GROUP BY 1")
def _(t):
    c = t("lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.max("l_discount").alias("v"))
    m = c.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "v"))).alias("m"))
    return m.select("l_returnflag", F.sort_array(F.map_keys("m")).alias("ks"))


@query("map2_first_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'none' END AS v FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    m = F.when(k == 0, F.create_map(F.lit("a"), "o_orderstatus", F.lit("b"), "o_orderpriority")).when(k == 1, F.create_map(F.lit("b"), "o_orderpriority")).otherwise(F.create_map(F.lit("z"), F.lit("x")))
    d = t("orders").select("o_orderkey", m.alias("m"))
    return d.select("o_orderkey", F.coalesce(F.try_element_at("m", F.lit("a")), F.try_element_at("m", F.lit("b")), F.lit("none")).alias("v"))


@query("jsn1_flatten", "SELECT o_orderkey, 'order/' || k AS name, v FROM (SELECT o_orderkey, unnest(['price', 'cust']) AS k, unnest([o_totalprice, o_custkey::DOUBLE]) AS v FROM orders)")
def _(t):
    m = F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("cust"), F.col("o_custkey").cast("double"))
    return t("orders").select("o_orderkey", F.explode(m).alias("k", "v")).select("o_orderkey", F.concat(F.lit("order/"), "k").alias("name"), "v")


@query("jsn2_schema_checked", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


SIDE = 5


def _grid_edges(side: int = SIDE) -> list[tuple[int, int]]:
    return [(r * side + c, r * side + c + 1) for r in range(side) for c in range(side - 1)] + [(r * side + c, (r + 1) * side + c) for r in range(side - 1) for c in range(side)]


def mazes(t):
    """(maze, conn, start, target): for each customer a grid with a hash-drawn set of open edges."""
    e = len(_grid_edges())
    ids = t("customer").select(F.col("c_custkey").alias("maze"))
    draw = lambda x: S.md5_int(F.concat_ws("|", F.col("maze").cast("string"), x))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(e - 1)), lambda i: draw(i.cast("string")) % 100 < 62)
    cell = lambda s: (draw(F.lit(s)) % (SIDE * SIDE)).cast("int")
    return ids.select("maze", drawn.alias("conn"), cell("start").alias("start"), cell("target").alias("target"))


_H = "('0x' || left(md5(c_custkey || '|' || {}), 8))::BIGINT"
_BFS = f"""
WITH RECURSIVE m AS (SELECT c_custkey AS maze, {_H.format("'start'")} % {SIDE * SIDE} AS start, {_H.format("'target'")} % {SIDE * SIDE} AS target FROM customer),
g AS (SELECT e, CASE WHEN e < 20 THEN e // 4 * 5 + e % 4 ELSE e - 20 END AS a, CASE WHEN e < 20 THEN e // 4 * 5 + e % 4 + 1 ELSE e - 15 END AS b FROM range(40) AS r(e)),
o AS (SELECT c_custkey AS maze, a, b FROM customer, g WHERE {_H.format("e")} % 100 < 62),
both_ AS MATERIALIZED (SELECT maze, a, b FROM o UNION ALL SELECT maze, b, a FROM o),
bfs AS (SELECT maze, target AS cell, 0 AS d FROM m UNION SELECT bfs.maze, x.b, d + 1 FROM bfs JOIN both_ x ON x.maze = bfs.maze AND x.a = bfs.cell WHERE d < 24),
best AS MATERIALIZED (SELECT maze, cell, min(d) AS d FROM bfs GROUP BY 1, 2)"""


def _conn(pdf):
    return np.stack(pdf.conn.to_numpy()).astype(bool)


def _joined(lists) -> list[str]:
    return [",".join(map(str, x)) for x in lists]


def _open(row) -> list[tuple[int, int]]:
    return [e for e, o in zip(_grid_edges(), row["conn"]) if o]


def _tree(row) -> list[tuple[int, int]]:
    """A spanning tree of the grid, drawn from the maze's number."""
    r, out, root = random.Random(int(row["maze"])), [], list(range(SIDE * SIDE))
    find = lambda a: a if root[a] == a else find(root[a])
    for a, b in r.sample(_grid_edges(), len(_grid_edges())):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b))
    return out


@query("gra1_bfs_distance", f"{_BFS} SELECT maze, string_agg(coalesce(d, -1)::VARCHAR, ',' ORDER BY cell) AS dist FROM (SELECT maze, cell FROM m, range({SIDE * SIDE}) AS c(cell)) LEFT JOIN best USING (maze, cell) GROUP BY 1")
def _(t):
    """Steps from each cell to the target; a batch of grids at a time."""
    f = lambda p: pd.DataFrame({"maze": p.maze, "dist": _joined(graph.batch_distances(SIDE * SIDE, _grid_edges(), _conn(p), p.target.to_numpy()))})
    return graph.per_batch(mazes(t), f, "maze long, dist string")


@query("gra2_shortest_path", f"{_BFS}, nxt AS MATERIALIZED (SELECT x.maze, x.cell, min(y.cell) AS nb FROM best x JOIN both_ e ON e.maze = x.maze AND e.a = x.cell JOIN best y ON y.maze = x.maze AND y.cell = e.b AND y.d = x.d - 1 GROUP BY 1, 2), p AS (SELECT m.maze, start AS cell, start::VARCHAR AS path, d FROM m JOIN best ON best.maze = m.maze AND cell = start UNION ALL SELECT p.maze, nb, path || ',' || nb, d - 1 FROM p JOIN nxt ON nxt.maze = p.maze AND nxt.cell = p.cell) SELECT m.maze, coalesce(path, '') AS path FROM m LEFT JOIN p ON p.maze = m.maze AND d = 0")
def _(t):
    f = lambda p: pd.DataFrame({"maze": p.maze, "path": _joined(graph.batch_paths(SIDE * SIDE, _grid_edges(), _conn(p), p.start.to_numpy(), p.target.to_numpy()))})
    return graph.per_batch(mazes(t), f, "maze long, path string")


@query("gra3_component", f"{_BFS.replace('target AS cell, 0', 'start AS cell, 0')} SELECT maze, string_agg(cell::VARCHAR, ',' ORDER BY cell) AS nodes FROM best GROUP BY 1")
def _(t):
    """The cells that the start reaches."""
    f = lambda p: pd.DataFrame({"maze": p.maze, "nodes": _joined(np.flatnonzero(d >= 0) for d in graph.batch_distances(SIDE * SIDE, _grid_edges(), _conn(p), p.start.to_numpy()))})
    return graph.per_batch(mazes(t), f, "maze long, nodes string")


@query("gra4_spanning_tree")
def _(t):
    return graph.per_row(mazes(t), lambda r: {"maze": r["maze"], "drawn": graph.is_spanning_tree(SIDE * SIDE, _open(r)), "tree": graph.is_spanning_tree(SIDE * SIDE, _tree(r)), "steps": len(graph.shortest_path(SIDE * SIDE, _tree(r), r["start"], r["target"])) - 1}, "maze long, drawn boolean, tree boolean, steps int")


@query("gra5_dfs_roots")
def _(t):
    """A batch of trees at a time; the drawn edges of a maze are not needed. A small file of ids is much work, so it is dealt out."""

    def roots(p):
        tree = graph.batch_trees(SIDE * SIDE, _grid_edges(), graph.drawn_orders(p.maze.to_numpy(), len(_grid_edges())))
        return pd.DataFrame({"maze": p.maze, "roots": graph.batch_dfs_roots(SIDE * SIDE, _grid_edges(), tree, 2)})

    tasks = max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return graph.per_batch(mazes(t).select("maze").repartition(tasks), roots, "maze long, roots array<int>")


@query("gra6_hamming", "SELECT a.vec_id, sum(CASE WHEN (x > 0) <> (y > 0) THEN 1 ELSE 0 END)::BIGINT AS d, ceil(sum(CASE WHEN (x > 0) <> (y > 0) THEN 1 ELSE 0 END) / 64 / 0.1 - 1e-9)::BIGINT AS bucket FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS y FROM embeddings) b USING (vec_id, i) GROUP BY 1")
def _(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("a"))
    d = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", graph.hamming(F.col("a"), F.col("b")).cast("long").alias("d"))
    return d.select("vec_id", "d", F.ceil(F.col("d") / 64 / 0.1 - 1e-9).alias("bucket"))


@query("gra7_rollout_judge")
def _(t):
    """A hash-drawn walk judged step by step: each step along an open edge, and whether it reaches the target."""

    def judge(r):
        walk = graph.hash_walk(SIDE * SIDE, _grid_edges(), r["start"], 40, int(r["maze"]))
        if r["target"] in walk:
            walk = walk[: walk.index(r["target"]) + 1]
        good = {e for a, b in _open(r) for e in ((a, b), (b, a))}
        steps = list(zip(walk, walk[1:]))
        valid = sum(s in good for s in steps)
        return {"maze": r["maze"], "reached": walk[-1] == r["target"], "clean": valid == len(steps), "valid_share": valid / max(1, len(steps))}

    return graph.per_row(mazes(t), judge, "maze long, reached boolean, clean boolean, valid_share double")


@query("gra8_rollout_class", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'solved' WHEN bool_or(event_type = 'error') THEN 'infraction' ELSE 'unsolved_clean' END AS cls FROM events GROUP BY 1")
def _(t):
    has = lambda v: F.bool_or(F.col("event_type") == v)
    return t("events").groupBy("user_id").agg(F.when(has("purchase"), "solved").when(has("error"), "infraction").otherwise("unsolved_clean").alias("cls"))


@query("gra9_counterfactual_edit")
def _(t):
    """Closes a tree edge on the path from start to target and opens the first edge that joins the two parts again."""

    def edit(r):
        tree, n = _tree(r), SIDE * SIDE
        path = graph.shortest_path(n, tree, r["start"], r["target"])
        if len(path) < 2:
            return {"maze": r["maze"], "closed": None, "opened": None}
        a, b = path[len(path) // 2 - 1 : len(path) // 2 + 1]
        rest = [e for e in tree if set(e) != {a, b}]
        part = graph.distances(n, rest, a)
        opened = next((e for e in _grid_edges() if (part[e[0]] < 0) != (part[e[1]] < 0) and set(e) != {a, b}), None)
        return {"maze": r["maze"], "closed": [min(a, b), max(a, b)], "opened": list(opened) if opened else None}

    return graph.per_row(mazes(t), edit, "maze long, closed array<int>, opened array<int>")


@query("gra10_random_walk")
def _(t):
    return graph.per_row(mazes(t), lambda r: {"maze": r["maze"], "walk": graph.hash_walk(SIDE * SIDE, _open(r), r["start"], 12, int(r["maze"]), r["target"])}, "maze long, walk array<int>")


@query("gra11_markov_source")
def _(t):
    """Sequences whose next symbol is drawn by a hash from a context's weights 4:2:1:1."""
    u = lambda s, i: F.pmod(F.xxhash64(F.col("seed"), i), F.lit(8))
    step = lambda s, i: (s + F.when(u(s, i) < 4, 0).when(u(s, i) < 6, 1).when(u(s, i) < 7, 2).otherwise(3)) % 4
    seeds = t.spark.range(40).select(F.col("id").alias("seed"))
    seq = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.array(F.lit(0)), lambda a, i: F.array_append(a, step(F.element_at(a, -1), i)))
    return seeds.select("seed", seq.alias("symbols"))


@query("stm1_merged_accumulators", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS m, round(max(value), 6) AS hi FROM events GROUP BY 1")
def _(t):
    """Accumulators of each day's batch, merged."""
    day = t("events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("value").alias("k"), F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("hi"))
    return day.groupBy("event_type").agg(F.sum("n").alias("n"), r6(F.sum("s") / F.sum("k")).alias("m"), r6(F.max("hi")).alias("hi"))


@query("stm4_resume_log", "SELECT user_id, event_type, count(*) AS calls, min(event_id) AS first_ FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.min("event_id").alias("first_"))


@query("conversation_pairs", "SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def _(t):
    d = t("conversations").select("conv_id", "turn", "role", F.length("text").alias("asked"))
    a = d.where("role = 'user'").select("conv_id", "turn", "asked")
    b = d.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("asked").alias("answered"))
    return a.join(b, ["conv_id", "turn"])
