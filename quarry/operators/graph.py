"""Small graphs held in one row: grids, paths, components."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours(n: int, edges: list) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        out[a].append(b)
        out[b].append(a)
    return [sorted(x) for x in out]


def distances(n: int, edges: list, target: int) -> list[int]:
    """Steps from each node to the target; -1 where there is no path."""
    near, out = neighbours(n, edges), [-1] * n
    out[target], queue = 0, deque([target])
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if out[b] < 0:
                out[b] = out[a] + 1
                queue.append(b)
    return out


def shortest_path(n: int, edges: list, start: int, target: int) -> list[int]:
    """The shortest path that takes the smallest next node; empty if there is none."""
    d, near = distances(n, edges, target), neighbours(n, edges)
    if d[start] < 0:
        return []
    path = [start]
    while path[-1] != target:
        path.append(next(b for b in near[path[-1]] if d[b] == d[path[-1]] - 1))
    return path


def batch_distances(cells: int, edges: list, conn: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Steps from each cell to the target, -1 where there is no path, of many graphs with the same possible edges: conn
    (graphs x edges) tells which are open. All graphs advance by one step at a time."""
    n = len(conn)
    dist = np.full((n, cells), -1, np.int32)
    front = np.zeros((n, cells), bool)
    front[np.arange(n), target] = True
    step = 0
    while front.any():
        dist[front] = step
        further = np.zeros_like(front)
        for k, (a, b) in enumerate(edges):
            further[:, b] |= front[:, a] & conn[:, k]
            further[:, a] |= front[:, b] & conn[:, k]
        front, step = further & (dist < 0), step + 1
    return dist


def batch_paths(cells: int, edges: list, conn: np.ndarray, start: np.ndarray, target: np.ndarray) -> list[list[int]]:
    """The shortest path of each graph that takes the smallest next cell; empty where there is none."""
    dist = batch_distances(cells, edges, conn, target)
    n = len(conn)
    rows, at = np.arange(n), start.astype(np.int64)
    steps = [np.where(dist[rows, at] >= 0, at, -1)]
    for _ in range(int(dist[rows, at].max(initial=0))):
        nxt = np.full(n, cells)
        for k, (a, b) in enumerate(edges):
            for u, v in ((a, b), (b, a)):
                fits = (at == u) & conn[:, k] & (dist[:, u] > 0) & (dist[:, v] == dist[:, u] - 1)
                nxt[fits] = np.minimum(nxt[fits], v)
        moved = nxt < cells
        at = np.where(moved, nxt, at)
        steps.append(np.where(moved, at, -1))
    return [[int(c) for c in row if c >= 0] for row in np.stack(steps, 1)] if n else []


def is_spanning_tree(n: int, edges: list) -> bool:
    return len(edges) == n - 1 and min(distances(n, edges, 0)) >= 0


def valid_dfs_roots(n: int, edges: list, closed: list) -> list[int]:
    """Roots under which each closed edge of a tree joins a node with one above or below it."""

    def fits(root: int) -> bool:
        d, near = distances(n, edges, root), neighbours(n, edges)
        up = {b: next((a for a in near[b] if d[a] == d[b] - 1), None) for b in range(n)}

        def above(a, b):
            while b is not None and d[b] > d[a]:
                b = up[b]
            return a == b

        return all(above(a, b) or above(b, a) for a, b in closed)

    return [r for r in range(n) if fits(r)]


def drawn_orders(seeds: np.ndarray, n: int) -> np.ndarray:
    """(seeds x n): random.Random(seed).sample(range(n), n) of every seed. The Mersenne Twister is seeded and read for all
    seeds at once; a seed that needs more than its first 227 words (or 64 bits) is drawn by the library itself."""
    draws, m = 227, np.uint32(1)
    out = np.empty((len(seeds), n), np.int64)
    key = np.abs(seeds.astype(np.int64)).astype(np.uint64)
    late = np.zeros(len(seeds), bool)
    with np.errstate(over="ignore"):
        first = np.empty(624, np.uint32)
        first[0] = 19650218
        for i in range(1, 624):
            first[i] = (1812433253 * (int(first[i - 1]) ^ (int(first[i - 1]) >> 30)) + i) & 0xFFFFFFFF
        for long_ in (False, True):
            rows = np.flatnonzero((key >> np.uint64(32) > 0) == long_)
            if not len(rows):
                continue
            keys = [(key[rows] >> np.uint64(32 * j)).astype(np.uint32) + np.uint32(j) for j in range(1 + long_)]
            state = np.repeat(first[:, None], len(rows), 1)
            i = 1
            for turn, factor in ((624, 1664525), (623, 1566083941)):
                for k in range(turn):
                    x = state[i] ^ ((state[i - 1] ^ (state[i - 1] >> np.uint32(30))) * np.uint32(factor))
                    state[i] = x + keys[k % len(keys)] if turn == 624 else x - np.uint32(i)
                    i += 1
                    if i == 624:
                        state[0], i = state[623], 1
            state[0] = 0x80000000
            y = (state[:draws] & np.uint32(0x80000000)) | (state[1 : draws + 1] & np.uint32(0x7FFFFFFF))
            y = state[397 : 397 + draws] ^ (y >> m) ^ ((y & m) * np.uint32(0x9908B0DF))
            y ^= y >> np.uint32(11)
            y ^= (y << np.uint32(7)) & np.uint32(0x9D2C5680)
            y ^= (y << np.uint32(15)) & np.uint32(0xEFC60000)
            y ^= y >> np.uint32(18)
            pool, at, every = np.repeat(np.arange(n)[None], len(rows), 0), np.zeros(len(rows), np.int64), np.arange(len(rows))
            for left in range(n, 0, -1):
                shift = np.uint32(32 - left.bit_length())
                pick = y[np.minimum(at, draws - 1), every] >> shift
                while (again := (pick >= left) & (at < draws)).any():
                    at[again] += 1
                    pick[again] = y[np.minimum(at[again], draws - 1), every[again]] >> shift
                late[rows] |= at >= draws
                pick = np.minimum(pick, left - 1).astype(np.int64)
                at += 1
                out[rows, n - left] = pool[every, pick]
                pool[every, pick] = pool[:, left - 1]
    for r in np.flatnonzero(late):
        out[r] = random.Random(int(seeds[r])).sample(range(n), n)
    return out


def batch_trees(cells: int, edges: list, order: np.ndarray) -> np.ndarray:
    """(graphs x edges): which edges a spanning tree takes that tries them in each graph's order."""
    n = len(order)
    part, ends, every = np.repeat(np.arange(cells)[None], n, 0), np.array(edges), np.arange(n)
    taken = np.zeros((n, len(edges)), bool)
    for e in order.T:
        a, b = part[every, ends[e, 0]], part[every, ends[e, 1]]
        taken[every, e] = a != b
        part = np.where(part == b[:, None], a[:, None], part)
    return taken


def batch_dfs_roots(cells: int, edges: list, tree: np.ndarray, closed: int) -> list[list[int]]:
    """As valid_dfs_roots, of many trees: the first `closed` edges outside each tree are the closed ones. One end is above
    the other if the distances to the root add up."""
    fits = np.ones((len(tree), cells), bool)
    every, ends, outside = np.arange(len(tree)), np.array(edges), ~tree
    rank = np.cumsum(outside, 1)
    for k in range(1, closed + 1):
        at = outside & (rank == k)
        has, e = at.any(1), at.argmax(1)
        a, b = ends[e, 0], ends[e, 1]
        da, db = (batch_distances(cells, edges, tree, x) for x in (a, b))
        apart = da[every, b][:, None]
        fits &= (da + apart == db) | (db + apart == da) | ~has[:, None]
    return [np.flatnonzero(x).tolist() for x in fits]


def hash_walk(n: int, edges: list, start: int, steps: int, seed: int, avoid: int = -1) -> list[int]:
    """A walk whose every choice is a hash of seed, step and node, so it is the same wherever it runs."""
    import hashlib

    near, at, out = neighbours(n, edges), start, [start]
    for i in range(steps):
        choices = [b for b in near[at] if b != avoid]
        if not choices:
            break
        at = choices[int(hashlib.md5(f"{seed}|{i}|{at}".encode()).hexdigest()[:8], 16) % len(choices)]
        out.append(at)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def per_row(df: DataFrame, f, schema: str) -> DataFrame:
    """Applies f(dict of a row) -> dict to each row, a batch at a time; a row is one small graph."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([f(r) for r in pdf.to_dict("records")])

    return df.mapInPandas(run, schema)


def per_batch(df: DataFrame, f, schema: str) -> DataFrame:
    """Applies f(frame) -> frame to Arrow batches of rows, each row one small graph."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield f(pdf)

    return df.mapInPandas(run, schema)
