"""EVL: fitted baselines and their metrics, with matrices of a vector's dimension and no larger."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats
from .base import query, r6
from .evaluation import _E, _TYPES, _auc, by_type, scored
from .projections import _LONG, long_vectors


def gram(df: DataFrame, vector: str, extra: list[str] = ()) -> DataFrame:
    """One row: n long, s (sums) and g (sums of products) of the vector with `extra` columns appended, row by row:
    (d + k) and (d + k)^2 numbers, whatever the number of rows. Each task adds up its own batches."""
    cols = [vector, *extra]

    def run(batches):
        n, s, g = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                x = np.concatenate([x, pdf[list(extra)].to_numpy(float)], 1)
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.reshape(-1).tolist()]})

    parts = df.select(*cols).mapInPandas(run, "n long, s array<double>, g array<double>")
    add = lambda c: F.posexplode(c).alias("i", "x")
    total = lambda c: parts.select(add(c)).groupBy("i").agg(F.sum("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias(c))
    return parts.agg(F.sum("n").alias("n")).join(total("s")).join(total("g"))


def solved(one: DataFrame, solve, schema: str) -> DataFrame:
    """Applies solve(n, s, g) -> DataFrame to the one row of gram()."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if r.n:
                    d = len(r.s)
                    yield solve(int(r.n), np.array(r.s), np.array(r.g).reshape(d, d))

    return one.coalesce(1).mapInPandas(run, schema)


def ridge(n: int, s: np.ndarray, g: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from sums over the features and, last, the target; the intercept is not penalised."""
    mean, d = s / n, len(s) - 1
    c = g / n - np.outer(mean, mean)
    w = np.linalg.solve(c[:d, :d] + penalty / n * np.eye(d), c[:d, d])
    return w, float(mean[d] - mean[:d] @ w)


@query("evl28_ridge_matrix")
def _(t):
    """Ridge of the label's parity on all elements of a vector, from accumulated normal equations."""
    e = t("embeddings").withColumn("y", (F.col("label") % 2).cast("double"))

    def solve(n, s, g):
        w, b = ridge(n, s, g, 10.0)
        return pd.DataFrame({"dim": np.arange(-1, len(w)), "w": np.concatenate(([b], w)).round(6)})

    return solved(gram(e, "embedding", ["y"]), solve, "dim int, w double")


_RIDGE2 = "SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y FROM lineitem"


@query("evl28_ridge_two", f"WITH m AS ({_RIDGE2}), r AS (SELECT *, s11 + 10.0 / n AS a, s22 + 10.0 / n AS d FROM m), w AS (SELECT *, (d * s1y - s12 * s2y) / (a * d - s12 * s12) AS w1, (a * s2y - s12 * s1y) / (a * d - s12 * s12) AS w2 FROM r) SELECT round(w1, 4) AS w1, round(w2, 3) AS w2, round(my - w1 * m1 - w2 * m2, 3) AS b FROM w")
def _(t):
    """The same solver on two features, which SQL can solve by hand."""
    l = t("lineitem").select(F.array("l_quantity", "l_discount").cast("array<double>").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))

    def solve(n, s, g):
        w, b = ridge(n, s, g, 10.0)
        return pd.DataFrame({"w1": [round(w[0], 4)], "w2": [round(w[1], 3)], "b": [round(b, 3)]})

    return solved(gram(l, "x", ["y"]), solve, "w1 double, w2 double, b double")


def lda(n: int, s: np.ndarray, g: np.ndarray, shrink: float) -> np.ndarray:
    """Direction between two classes under their common covariance, shrunk to a multiple of the identity. The last
    row and column of the sums belong to the 0/1 label."""
    d = len(s) - 1
    n1 = s[d]
    m1, m0 = g[d, :d] / n1, (s[:d] - g[d, :d]) / (n - n1)
    within = (g[:d, :d] - n1 * np.outer(m1, m1) - (n - n1) * np.outer(m0, m0)) / (n - 2)
    within = (1 - shrink) * within + shrink * np.trace(within) / d * np.eye(d)
    return np.linalg.solve(within, m1 - m0)


@query("evl29_lda")
def _(t):
    """Shrinkage LDA of the label's parity: one pass, then a solve of the vector's dimension."""
    e = t("embeddings").withColumn("y", (F.col("label") % 2).cast("double"))
    return solved(gram(e, "embedding", ["y"]), lambda n, s, g: pd.DataFrame({"dim": np.arange(len(s) - 1), "w": lda(n, s, g, 0.1).round(6)}), "dim int, w double")


def balanced_logistic(df: DataFrame, vector: str, label: str, rounds: int = 6, penalty: float = 1.0) -> np.ndarray:
    """Weights and, last, intercept of a logistic regression in which both classes weigh the same, by Newton's
    method: each round is one pass that adds up a gradient and a matrix of the vector's dimension."""
    n = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}  # two rows
    weight = {c: sum(n.values()) / (2 * k) for c, k in n.items()}
    w = None
    for _ in range(rounds):
        now = w

        def run(batches):
            total = None
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                y = pdf[label].to_numpy(float)
                p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30))) if now is not None else np.full(len(x), 0.5)
                k = np.where(y == 1, weight.get(1, 0), weight.get(0, 0))
                part = np.concatenate([(x * (k * (p - y))[:, None]).sum(0), ((x * (k * p * (1 - p))[:, None]).T @ x).reshape(-1)])
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        sums = df.select(vector, label).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # d + d^2 numbers
        v = np.array([r["v"] for r in sums])
        d = int((math.isqrt(1 + 4 * len(v)) - 1) // 2)
        w = np.zeros(d) if w is None else w
        keep = np.append(np.full(d - 1, penalty), 1e-9)
        w = w - np.linalg.solve(v[d:].reshape(d, d) + np.diag(keep), v[:d] + keep * w)
    return w


@query("evl29_balanced_logistic")
def _(t):
    w = balanced_logistic(t("embeddings").withColumn("y", (F.col("label") % 2).cast("int")), "embedding", "y")
    return t.spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "dim int, w double")


_NEAR = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id, q.label, b.label AS l, list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(b.v, b.v)) AS cos, b.vec_id AS other FROM e q JOIN e b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cos, 9) DESC, other) AS rn FROM s)"""


def nearest(t, k: int = 15, query_rows: int = 512, vector_rows: int = 8192) -> DataFrame:
    """(vec_id, label, near): for the queries (ids that 100 divides, a stated set) the k nearest of all other vectors by
    cosine, as structs (o, other, l, cos). Blocks of queries meet blocks of vectors; each pair of blocks is one small
    matrix product that keeps its best k a query, and these are merged."""
    e = t("embeddings").select("vec_id", "label", S.unit(F.col("embedding")).alias("u"))
    q, rest = e.where("vec_id % 100 = 0"), e
    blocks = lambda d, rows: max(1, -(-d.count() // rows))
    nq, nv = blocks(q, query_rows), blocks(rest, vector_rows)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("vec_id", "u", block(nq).alias("qb"), every(nv).alias("vb"))
    right = rest.select("vec_id", "label", "u", block(nv).alias("vb"), every(nq).alias("qb"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            cos = np.stack(a.u.to_numpy()) @ np.stack(b.u.to_numpy()).T
            other, label = b.vec_id.to_numpy(), b.label.to_numpy()
            for i, c in zip(a.vec_id.to_numpy(), cos):
                top = np.lexsort((other, -np.round(c, 9)))[: k + 1]
                top = top[other[top] != i][:k]  # all but itself
                out.append(pd.DataFrame({"vec_id": i, "cos": c[top], "other": other[top], "l": label[top]}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "cos": [], "other": [], "l": []})

    top = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, "vec_id long, cos double, other long, l int")
    near = top.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.round("cos", 9)).alias("o"), "other", "l", "cos"))), 1, k).alias("near"))  # k a block
    return q.select("vec_id", "label").join(near, "vec_id")


def _share(values: Column, of: Column) -> Column:
    return F.aggregate(F.transform(values, lambda x: F.when(x["l"] == of, x["w"]).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def _vote(near: DataFrame, weight) -> DataFrame:
    """Accuracy by label of the label with the largest sum of weights among the nearest (the smallest of equal ones)."""
    v = near.withColumn("v", F.transform("near", lambda x: F.struct(x["l"].alias("l"), weight(x).alias("w"))))
    best = F.array_min(F.transform(F.array_distinct(F.transform("v", lambda x: x["l"])), lambda l: F.struct((-F.round(_share(F.col("v"), l), 9)).alias("w"), l.alias("l"))))["l"]
    return v.groupBy("label").agg(r6(F.avg(F.when(F.col("label") == best, 1.0).otherwise(0.0))).alias("acc"))


@query("evl30_knn_vote", f"{_NEAR}, w AS (SELECT vec_id, label, l, count(*)::DOUBLE AS w FROM r WHERE rn <= 15 GROUP BY 1, 2, 3), b AS (SELECT vec_id, label, arg_min(l, (-round(w, 9), l)) AS best FROM w GROUP BY 1, 2) SELECT label, round(avg(CASE WHEN label = best THEN 1.0 ELSE 0 END), 6) AS acc FROM b GROUP BY 1")
def _(t):
    """The label most frequent among the fifteen nearest."""
    return _vote(nearest(t), lambda x: F.lit(1.0))


@query("evl30_temperature_vote", f"{_NEAR}, w AS (SELECT vec_id, label, l, sum(exp(cos / 0.1)) AS w FROM r WHERE rn <= 15 GROUP BY 1, 2, 3), b AS (SELECT vec_id, label, arg_min(l, (-round(w, 9), l)) AS best FROM w GROUP BY 1, 2) SELECT label, round(avg(CASE WHEN label = best THEN 1.0 ELSE 0 END), 6) AS acc FROM b GROUP BY 1")
def _(t):
    """The label with the largest sum of exp(cosine / 0.1) among the fifteen nearest."""
    return _vote(nearest(t), lambda x: F.exp(x["cos"] / 0.1))


@query("evl31_neighbour_mass", "WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), m AS (SELECT l_suppkey AS b, sum(l_quantity) AS mass FROM lineitem GROUP BY 1), own AS (SELECT l_partkey AS a, sum(l_quantity) AS own FROM lineitem GROUP BY 1) SELECT a, round(sum(mass), 6) AS neighbour, round(own / sum(mass), 6) AS share FROM e JOIN m USING (b) JOIN own USING (a) GROUP BY a, own")
def _(t):
    """For each part the mass of its neighbours (suppliers) and its own share of it."""
    l = t("lineitem")
    m = l.groupBy(F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("mass"))
    own = l.groupBy(F.col("l_partkey").alias("a")).agg(F.sum("l_quantity").alias("own"))
    e = l.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    g = e.join(m, "b").groupBy("a").agg(F.sum("mass").alias("s")).join(own, "a")
    return g.select("a", r6("s").alias("neighbour"), r6(F.col("own") / F.col("s")).alias("share"))


@query("evl27_pair_cosine", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id, a.label, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cos, sqrt(list_dot_product(a.v, a.v) / list_dot_product(b.v, b.v)) AS ratio, sqrt(list_dot_product(a.v, a.v)) AS n FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), q AS (SELECT label, quantile_cont(n, 0.9) AS q FROM p GROUP BY 1) SELECT label, round(avg(cos), 6) AS cos, round(avg(ratio), 6) AS ratio, round(avg(cos) FILTER (n >= q), 6) AS cos_top, round(avg(ratio) FILTER (n >= q), 6) AS ratio_top FROM p JOIN q USING (label) GROUP BY 1")
def _(t):
    """Cosine and norm ratio of each vector and the one with the next id; over all, and over the top tenth by norm."""
    from ..operators.order import quantiles

    e = t("embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    p = e.join(b, "vec_id").select("label", S.cosine(F.col("v"), F.col("w")).alias("cos"), S.norm(F.col("v")).alias("n"), (S.norm(F.col("v")) / S.norm(F.col("w"))).alias("ratio"))
    j = p.join(quantiles(p, ["label"], "n", {"q": 0.9}), "label")
    top = F.col("n") >= F.col("q")
    return j.groupBy("label").agg(r6(F.avg("cos")).alias("cos"), r6(F.avg("ratio")).alias("ratio"), r6(F.avg(F.when(top, F.col("cos")))).alias("cos_top"), r6(F.avg(F.when(top, F.col("ratio")))).alias("ratio_top"))


@query("evl35_reflected_kde", "WITH h AS (SELECT event_type, count(*) AS n, 0.9 * stddev_samp(u) * pow(count(*), -0.2) AS h FROM (SELECT event_type, round(value - floor(value), 2) AS u FROM events WHERE value IS NOT NULL) GROUP BY 1), v AS (SELECT event_type, round(value - floor(value), 2) AS u, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT event_type, i / 10 AS x, round(sum(c * (exp(-0.5 * pow((i / 10 - u) / h, 2)) + exp(-0.5 * pow((i / 10 + u) / h, 2)) + exp(-0.5 * pow((i / 10 - 2 + u) / h, 2)))) / (max(n) * max(h) * sqrt(2 * pi())), 5) AS density FROM v JOIN h USING (event_type), (SELECT unnest(range(0, 11)) AS i) GROUP BY 1, 2")
def _(t):
    """Density on [0, 1] of the fractional parts, with the mass beyond either end reflected."""
    u = t("events").where("value IS NOT NULL").select("event_type", F.round(F.col("value") - F.floor("value"), 2).alias("u"))
    h = u.groupBy("event_type").agg(F.count("*").alias("n"), (0.9 * F.stddev_samp("u") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"))
    v = u.groupBy("event_type", "u").agg(F.count("*").alias("c")).join(h, "event_type").withColumn("x", F.explode(F.array(*(F.lit(i / 10) for i in range(11)))))
    bump = lambda at: F.exp(-0.5 * F.pow(at / F.col("h"), 2))
    x, y = F.col("x"), F.col("u")
    return v.groupBy("event_type", "x").agg(F.round(F.sum(F.col("c") * (bump(x - y) + bump(x + y) + bump(x - 2 + y))) / (F.max("n") * F.max("h") * F.sqrt(F.lit(2 * math.pi))), 5).alias("density"))


_LONG_Y = f"(SELECT lang, 'quality' AS target, s, y AS y, p FROM {_E} UNION ALL SELECT lang, 'toxic', s, tox, p FROM {_E})"
_MASKED = f"(SELECT lang, target, s, y FROM {_LONG_Y} WHERE p >= 0.1)"


@query("evl43_macro_auroc", f"WITH k AS (SELECT lang || '|' || target AS g, s, y FROM {_MASKED}), a AS {_auc('s', 'y', 'g', 'k')}, r AS (SELECT g, avg(CASE WHEN s > 1000 THEN 1.0 ELSE 0 END) FILTER (y = 1) AS recall1, avg(CASE WHEN s > 1000 THEN 0.0 ELSE 1 END) FILTER (y = 0) AS recall0, avg(y) AS positive FROM k GROUP BY 1) SELECT split_part(g, '|', 1) AS lang, round(avg(auc), 6) AS macro_auroc, round(avg(recall1), 6) AS recall_1, round(avg(recall0), 6) AS recall_0, round(avg(positive), 6) AS positive, count(*) AS targets FROM a JOIN r USING (g) WHERE auc IS NOT NULL GROUP BY 1")
def _(t):
    """By language, over targets with both classes among the rows that the mask (p < 0.1) leaves: mean AUROC,
    recall of each class above a length of 1,000, share of positives."""
    each = F.array(F.struct(F.lit("quality").alias("target"), F.col("y").alias("v")), F.struct(F.lit("toxic").alias("target"), F.col("tox").alias("v")))
    d = scored(t).where("p >= 0.1").select("lang", "s", F.inline(each)).withColumnRenamed("v", "y")
    by = ["lang", "target"]
    hit = F.when(F.col("s") > 1000, 1.0).otherwise(0.0)
    r = d.groupBy(*by).agg(F.avg(F.when(F.col("y") == 1, hit)).alias("r1"), F.avg(F.when(F.col("y") == 0, 1 - hit)).alias("r0"), F.avg("y").alias("share"))
    j = stats.auroc(d, by, "s", "y", "auc").where("auc IS NOT NULL").join(r, by)
    return j.groupBy("lang").agg(r6(F.avg("auc")).alias("macro_auroc"), r6(F.avg("r1")).alias("recall_1"), r6(F.avg("r0")).alias("recall_0"), r6(F.avg("share")).alias("positive"), F.count("*").alias("targets"))


def condition(g: np.ndarray) -> tuple[float, float]:
    """(condition number, effective rank) of a Gram matrix: (sum of eigenvalues)^2 / sum of their squares."""
    e = np.clip(np.linalg.eigvalsh(g), 0, None)
    return float(e.max() / max(e.min(), 1e-12)), float(e.sum() ** 2 / max((e * e).sum(), 1e-300))


@query("evl47_condition")
def _(t):
    """Of the Gram matrix of all vectors' elements: of the vector's dimension, whatever the number of vectors."""

    def solve(n, s, g):
        k, r = condition(g / n)
        return pd.DataFrame({"condition": [round(k, 4)], "effective_rank": [round(r, 4)]})

    return solved(gram(t("embeddings"), "embedding"), solve, "condition double, effective_rank double")


@query("evl47_effective_rank", f"WITH p AS (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS g FROM {_LONG} a JOIN {_LONG} b USING (vec_id) GROUP BY 1, 2) SELECT round(pow(sum(g) FILTER (i = j), 2) / sum(g * g), 4) AS effective_rank FROM p")
def _(t):
    """The same rank from the trace and the sum of squares, which need no eigenvalues."""

    def solve(n, s, g):
        g = g / n
        return pd.DataFrame({"effective_rank": [round(float(np.trace(g) ** 2 / (g * g).sum()), 4)]})

    return solved(gram(t("embeddings"), "embedding"), solve, "effective_rank double")


@query("evl47_family_cosines", f"WITH c AS (SELECT label, dim, avg(x) AS m FROM {_LONG} GROUP BY 1, 2), p AS (SELECT a.label AS i, b.label AS j, abs(sum(a.m * b.m)) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS c FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2) SELECT i AS label, round(avg(c), 6) AS mean_cos, round(max(c), 6) AS max_cos FROM p GROUP BY 1")
def _(t):
    """For each label (family) the mean and largest |cosine| of its centroid with the others'."""
    c = long_vectors(t).groupBy("label", "dim").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))
    a, b = c.select(F.col("label").alias("label"), F.col("c").alias("x")), c.select(F.col("label").alias("j"), F.col("c").alias("y"))
    p = a.join(b, F.col("label") != F.col("j")).withColumn("c", F.abs(S.cosine(F.col("x"), F.col("y"))))
    return p.groupBy("label").agg(r6(F.avg("c")).alias("mean_cos"), r6(F.max("c")).alias("max_cos"))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its power series from the nearer end."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > 0.5:
        return 1 - beta_share(1 - x, b, a)
    term = total = 1.0
    for k in range(100_000):
        term *= (a + b + k) / (a + 1 + k) * x
        total += term
        if term < 1e-16 * total:
            break
    return total * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / (df + t * t), df / 2, 0.5)


@query("evl22_paired_p")
def _(t):
    """The paired t-test with its p-value: the statistic from sums, the p-value of one row."""
    d = by_type(t).where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    one = d.agg(F.count("*").alias("n"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t_"))

    @F.pandas_udf("double")
    def p(n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([round(t_p_value(x, k - 1), 6) if k > 1 and x == x else None for k, x in zip(n, s)])

    return one.select("n", r6("t_").alias("t_"), p("n", "t_").alias("p_value"))
