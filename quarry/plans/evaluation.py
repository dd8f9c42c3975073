"""EVL: statistics and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import stats
from ..operators.order import quantiles
from .aggregates import one
from .base import query, r6
from .projections import _LONG, long_vectors

_E = "(SELECT d.doc_id, d.lang, d.source, l.quality AS y, l.toxic AS tox, d.n_chars::DOUBLE AS s, ('0x' || left(md5(d.doc_id::VARCHAR), 8))::BIGINT / 4294967296 AS p FROM documents d JOIN labels l USING (doc_id))"


def scored(t):
    """Labelled documents with two scores: length s, and p, a number in [0, 1) from the id."""
    d = t("documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("s"))
    return d.join(t("labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("tox")), "doc_id").withColumn("p", stats.hash_unit(F.col("doc_id")))


def _auc(score, label, by, src=_E):
    return f"(SELECT {by}, CASE WHEN sum({label}) > 0 AND sum(1 - {label}) > 0 THEN (sum({label} * rk) - sum({label}) * (sum({label}) + 1) / 2) / (sum({label}) * sum(1 - {label})) END AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2 AS rk FROM {src}) GROUP BY {by})"


@query("evl1_auroc", f"SELECT lang, round(auc, 6) AS auroc FROM {_auc('s', 'y', 'lang')}")
def _(t):
    return stats.auroc(scored(t), ["lang"], "s", "y").select("lang", r6("auroc").alias("auroc"))


def _rho(a, b, by, src):
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"
    return f"(SELECT {by}, CASE WHEN count(*) >= 3 AND count(DISTINCT {a}) > 1 AND count(DISTINCT {b}) > 1 THEN corr(ra, rb) END AS rho FROM (SELECT *, {rank(a)} AS ra, {rank(b)} AS rb FROM {src}) GROUP BY {by})"


@query("evl2_spearman", f"SELECT lang, round(rho, 6) AS rho FROM {_rho('s', 'p', 'lang', _E)}")
def _(t):
    return stats.spearman(scored(t), ["lang"], "s", "p").select("lang", r6("rho").alias("rho"))


@query("evl2_spearman_zero", f"SELECT source, round(coalesce(rho, 0), 6) AS rho FROM {_rho('y', 'tox', 'source', _E)}")
def _(t):
    return stats.spearman(scored(t), ["source"], "y", "tox", constant=0.0).select("source", r6("rho").alias("rho"))


@query("evl3_auprc", f"SELECT lang, round(sum(tp / k * y) / nullif(sum(y), 0), 6) AS auprc FROM (SELECT lang, y, sum(y) OVER w AS tp, count(*) OVER w AS k FROM {_E} WINDOW w AS (PARTITION BY lang ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY lang")
def _(t):
    return stats.auprc(scored(t), ["lang"], "s", "y", "doc_id").select("lang", r6("auprc").alias("auprc"))


@query("evl4_ece", f"SELECT lang, round(sum(n * d) / sum(n), 6) AS ece FROM (SELECT lang, least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS d FROM {_E} GROUP BY 1, 2) GROUP BY lang")
def _(t):
    return stats.calibration_error(scored(t), ["lang"], "p", "y").select("lang", r6("ece").alias("ece"))


def isotonic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rising fit of y over x by pooling adjacent violators."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # mean, count
    for v in y[order]:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (m, n), (a, k) = blocks.pop(), blocks.pop()
            blocks.append([(m * n + a * k) / (n + k), n + k])
    out = np.empty(len(y))
    out[order] = np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])
    return out


@query("evl5_isotonic")
def _(t):
    """Fit of quality on length, by language and source: a group's rows are one task's."""

    def fit(pdf):
        return pd.DataFrame({"doc_id": pdf.doc_id.to_numpy(), "fit": isotonic(pdf.s.to_numpy(), pdf.y.to_numpy().astype(float)).round(6)})

    return scored(t).groupBy("lang", "source").applyInPandas(fit, "doc_id long, fit double")


@query("evl6_tie_ceiling", f"SELECT lang, round(rho, 6) AS ceiling FROM {_rho('j', 'y', 'lang', '(SELECT *, y + 1e-3 * p AS j FROM ' + _E + ')')}")
def _(t):
    return stats.spearman(scored(t).withColumn("j", F.col("y") + F.col("p") * 1e-3), ["lang"], "j", "y").select("lang", r6("rho").alias("ceiling"))


@query("evl7_operating_point", f"WITH e AS {_E}, tau AS (SELECT lang, quantile_cont(s, 0.95) AS tau FROM e WHERE y = 0 GROUP BY 1 HAVING count(*) >= 5) SELECT lang, round(max(tau), 6) AS tau, round(avg(CASE WHEN s > tau THEN 1.0 ELSE 0 END) FILTER (y = 1), 6) AS recall, round(avg(CASE WHEN s > tau THEN 1.0 ELSE 0 END) FILTER (y = 0), 6) AS fpr FROM e JOIN tau USING (lang) GROUP BY lang")
def _(t):
    e = scored(t)
    neutral = e.where("y = 0")
    enough = neutral.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 5").select("lang")
    tau = quantiles(neutral, ["lang"], "s", {"tau": 0.95}).join(enough, "lang")
    above = F.when(F.col("s") > F.col("tau"), 1.0).otherwise(0.0)
    return e.join(F.broadcast(tau), "lang").groupBy("lang").agg(r6(F.max("tau")).alias("tau"), r6(F.avg(F.when(F.col("y") == 1, above))).alias("recall"), r6(F.avg(F.when(F.col("y") == 0, above))).alias("fpr"))


@query("evl8_g_ratio", f"WITH e AS {_E}, n AS (SELECT lang, count(*) AS n FROM e GROUP BY 1), a AS {_auc('s', 'y', 'lang')}, b AS {_auc('p', 'y', 'lang')} SELECT lang, round(CASE WHEN n >= 10 THEN a.auc / b.auc END, 6) AS g FROM n JOIN a USING (lang) JOIN b USING (lang)")
def _(t):
    e = scored(t)
    j = e.groupBy("lang").agg(F.count("*").alias("n")).join(stats.auroc(e, ["lang"], "s", "y", "a"), "lang").join(stats.auroc(e, ["lang"], "p", "y", "b"), "lang")
    return j.select("lang", r6(F.when(F.col("n") >= 10, F.col("a") / F.col("b"))).alias("g"))


_CARD = f"(SELECT source, count(*) AS n, avg(y) AS q, avg(tox) AS x, stddev_samp(s) AS sd FROM {_E} GROUP BY source)"


def cards(t):
    return scored(t).groupBy("source").agg(F.count("*").alias("n"), F.avg("y").alias("q"), F.avg("tox").alias("x"), F.stddev_samp("s").alias("sd"))


@query("evl9_selectivity", f"SELECT source, round(least(CASE WHEN n >= 15 THEN q - x END, CASE WHEN n >= 5 THEN q - 0.5 END), 6) AS gap FROM {_CARD}")
def _(t):
    n = F.col("n")
    return cards(t).select("source", r6(F.least(F.when(n >= 15, F.col("q") - F.col("x")), F.when(n >= 5, F.col("q") - 0.5))).alias("gap"))


_VERDICT = "CASE WHEN (sd IS NULL OR sd >= 500) AND q >= 0.85 AND x <= 0.2 THEN 'deploy' WHEN q >= 0.7 THEN 'caveat' ELSE 'reject' END"


@query("evl10_verdict", f"SELECT source, {_VERDICT} AS verdict FROM {_CARD}")
def _(t):
    ok = S.check_at_least(F.col("sd"), 500) & S.at_least(F.col("q"), 0.85) & S.at_most(F.col("x"), 0.2)
    return cards(t).select("source", F.when(ok, "deploy").when(S.at_least(F.col("q"), 0.7), "caveat").otherwise("reject").alias("verdict"))


@query("evl11_failing", f"SELECT source, concat_ws('; ', CASE WHEN sd < 500 THEN 'flat' END, CASE WHEN NOT q >= 0.85 THEN 'quality' END, CASE WHEN NOT x <= 0.2 THEN 'toxic' END) AS why FROM {_CARD}")
def _(t):
    c = F.array(F.when(~S.check_at_least(F.col("sd"), 500), "flat"), F.when(~S.at_least(F.col("q"), 0.85), "quality"), F.when(~S.at_most(F.col("x"), 0.2), "toxic"))
    return cards(t).select("source", F.array_join(F.filter(c, lambda x: x.isNotNull()), "; ").alias("why"))


@query("evl12_tristate", f"SELECT source, CASE WHEN x > 0.15 AND q > 0.8 THEN 'causal' WHEN x > 0.15 THEN 'suspect' WHEN sd IS NULL THEN NULL ELSE 'read_only' END AS verdict FROM {_CARD}")
def _(t):
    return cards(t).select("source", F.when((F.col("x") > 0.15) & (F.col("q") > 0.8), "causal").when(F.col("x") > 0.15, "suspect").when(F.col("sd").isNotNull(), "read_only").alias("verdict"))


_TYPES = "(SELECT user_id, avg(value) FILTER (event_type = 'purchase') AS a, avg(value) FILTER (event_type = 'click') AS b, avg(value) FILTER (event_type = 'error') AS r, avg(value) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)"


def by_type(t):
    mean = lambda x: F.avg(F.when(F.col("event_type") == x, F.col("value")))
    return t("events").groupBy("user_id").agg(mean("purchase").alias("a"), mean("click").alias("b"), mean("error").alias("r"), mean("view").alias("v"))


@query("evl13_necessity", f"SELECT user_id, coalesce(a - 100 < -0.5 * abs(r), false) OR coalesce(b - 100 < -0.5 * abs(r), false) AS necessary FROM {_TYPES}")
def _(t):
    rule = lambda c: F.coalesce(F.col(c) - 100 < F.abs("r") * -0.5, F.lit(False))
    return by_type(t).select("user_id", (rule("a") | rule("b")).alias("necessary"))


@query("evl14_specificity", "WITH d AS (SELECT user_id, event_type, abs(avg(value) - 50) AS d FROM events GROUP BY 1, 2) SELECT user_id, round(max(d) FILTER (event_type = 'purchase') / nullif(max(d) FILTER (event_type <> 'purchase'), 0), 6) AS ratio, arg_max(event_type, (d, event_type)) FILTER (event_type <> 'purchase') AS off FROM d GROUP BY 1")
def _(t):
    d = t("events").groupBy("user_id", "event_type").agg(F.abs(F.avg("value") - 50).alias("d"))
    own = F.col("event_type") == "purchase"
    return d.groupBy("user_id").agg(r6(F.max(F.when(own, F.col("d"))) / F.nullif(F.max(F.when(~own, F.col("d"))), F.lit(0))).alias("ratio"), F.max_by("event_type", F.when(~own, F.struct("d", "event_type"))).alias("off"))


_LAYERS = "(SELECT l_suppkey AS c, l_linenumber AS layer, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2)"


def layers(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("c"), F.col("l_linenumber").alias("layer")).agg(F.sum("l_discount").alias("v"))


@query("evl15_earliest_layer", f"SELECT c, min(layer) FILTER (layer <= 6 AND v >= 0.7 * m) AS layer FROM (SELECT *, max(v) OVER (PARTITION BY c) AS m FROM {_LAYERS}) GROUP BY c")
def _(t):
    """The limit gives way by 1e-12 of itself: sums of decimals that stand exactly at it are a few last digits off, by the order of their rows."""
    d = layers(t).withColumn("m", F.max("v").over(Window.partitionBy("c")))
    return d.groupBy("c").agg(F.min(F.when((F.col("layer") <= 6) & (F.col("v") >= F.col("m") * (0.7 * (1 - 1e-12))), F.col("layer"))).alias("layer"))


@query("evl16_k50_k90", f"WITH x AS (SELECT c, layer, sum(v) OVER (PARTITION BY c ORDER BY layer) AS cum, sum(v) OVER (PARTITION BY c) AS full_ FROM {_LAYERS}) SELECT c, min(layer) FILTER (cum >= 0.5 * full_ - 1e-9) AS k50, min(layer) FILTER (cum >= 0.9 * full_ - 1e-9) AS k90 FROM x GROUP BY c")
def _(t):
    w = Window.partitionBy("c")
    d = layers(t).withColumns({"cum": F.sum("v").over(w.orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("v").over(w)})
    k = lambda p: F.min(F.when(F.col("cum") >= F.col("all") * p - 1e-9, F.col("layer")))
    return d.groupBy("c").agg(k(0.5).alias("k50"), k(0.9).alias("k90"))


@query("evl17_retention", f"SELECT user_id, round(CASE WHEN b >= 0.05 THEN a / b END, 6) AS raw, round(CASE WHEN b - 5 >= 0.05 THEN (a - 5) / (b - 5) END, 6) AS corrected FROM {_TYPES}")
def _(t):
    a, b = F.col("a"), F.col("b")
    return by_type(t).select("user_id", r6(F.when(b >= 0.05, a / b)).alias("raw"), r6(F.when(b - 5 >= 0.05, (a - 5) / (b - 5))).alias("corrected"))


@query("evl18_ols_slope", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY 1")
def _(t):
    x, y = S.finite(F.col("l_quantity")), S.finite(F.col("l_extendedprice"))
    return t("lineitem").groupBy("l_returnflag").agg(r6(F.regr_slope(y, x)).alias("slope"))


REPLICATES = 50
_U = "('0x' || left(md5({} || '|' || b), 8))::BIGINT / 4294967296"
_POISSON = "CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 ELSE 4 END"


def resampled(df, key: str):
    """Each row in REPLICATES resamples `b`, `k` times: a Poisson(1) draw from a hash of key and replicate."""
    d = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    return d.withColumn("k", draws(stats.hash_unit(F.col(key), F.col("b"))))


def draws(u):
    return F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).otherwise(4)


def resampled_sums(df, by: str, key: str, values: dict):
    """(by, b, names): the sums of each resample. The rows are repeated within the task and added up there, so the
    shuffle has a row for each group and resample; fifty weighted sums side by side took half as long again."""
    d = resampled(df.select(by, F.col(key).alias("_key"), *(v.alias(n) for n, v in values.items())), "_key")
    return d.groupBy(by, "b").agg(*(F.sum(F.col("k") * F.col(n)).alias(n) for n in values))


def bounds(df, by: str, value: str):
    return df.groupBy(by).agg(r6(F.percentile(value, 0.025)).alias("lo"), r6(F.percentile(value, 0.975)).alias("hi"))


_RE = f"(SELECT *, {_POISSON} AS k FROM (SELECT *, {_U.format('g')} AS u FROM {{}}, range({REPLICATES}) AS r(b)))"


@query("evl19_bootstrap_mean", "SELECT event_type, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT event_type, b, sum(k * value) / sum(k) AS m FROM " + _RE.format("(SELECT *, event_id AS g FROM events)") + " GROUP BY 1, 2) GROUP BY 1")
def _(t):
    s = resampled_sums(t("events"), "event_type", "event_id", {"a": F.col("value"), "n": F.lit(1.0)})
    return bounds(s.withColumn("m", F.col("a") / F.col("n")), "event_type", "m")


@query("evl20_bootstrap_ratio", "SELECT l_returnflag, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT l_returnflag, b, sum(k * a) / sum(k * n) AS m FROM " + _RE.format("(SELECT l_returnflag, l_orderkey || '|' || l_linenumber AS g, l_tax AS a, l_discount AS n FROM lineitem)") + " GROUP BY 1, 2) GROUP BY 1")
def _(t):
    """Rows are resampled, and the ratio of the sums is taken."""
    d = t("lineitem").select("l_returnflag", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("g"), F.col("l_tax").alias("a"), F.col("l_discount").alias("n"))
    s = resampled_sums(d, "l_returnflag", "g", {"a": F.col("a"), "n": F.col("n")})
    return bounds(s.withColumn("m", F.col("a") / F.col("n")), "l_returnflag", "m")


@query("evl21_clustered_bootstrap", "SELECT l_linestatus, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM (SELECT l_linestatus, b, avg(m) AS v FROM (SELECT l_linestatus, l_returnflag, b, sum(k * a) / sum(k * n) AS m FROM " + _RE.format("(SELECT l_linestatus, l_returnflag, l_suppkey AS g, sum(l_tax) AS a, sum(l_discount) AS n FROM lineitem GROUP BY 1, 2, 3)") + " GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    """Clusters (suppliers) are summed first and resampled within each inner group (return flag): replicates multiply
    clusters, not rows. The value of a replicate is the mean over the inner groups of the ratio of sums."""
    c = t("lineitem").groupBy("l_linestatus", "l_returnflag", "l_suppkey").agg(F.sum("l_tax").alias("a"), F.sum("l_discount").alias("n"))
    m = resampled(c, "l_suppkey").groupBy("l_linestatus", "l_returnflag", "b").agg((F.sum(F.col("k") * F.col("a")) / F.sum(F.col("k") * F.col("n"))).alias("m"))
    return bounds(m.groupBy("l_linestatus", "b").agg(F.avg("m").alias("v")), "l_linestatus", "v")


@query("evl22_paired_t", f"SELECT count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t_, count(*) FILTER (a > b) AS plus FROM {_TYPES} WHERE a IS NOT NULL AND b IS NOT NULL")
def _(t):
    d = by_type(t).where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    return d.agg(F.count("*").alias("n"), r6(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t_"), one(F.col("d") > 0).alias("plus"))


@query("evl23_mean_ci", "SELECT user_id, round(CASE WHEN count(*) >= 3 THEN avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)) END, 6) AS lo, round(CASE WHEN count(*) >= 3 THEN avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)) END, 6) AS hi FROM events GROUP BY 1")
def _(t):
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))
    enough = F.count("*") >= 3
    return t("events").groupBy("user_id").agg(r6(F.when(enough, F.avg("value") - half)).alias("lo"), r6(F.when(enough, F.avg("value") + half)).alias("hi"))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_RANKED = "(SELECT l_returnflag, " + ", ".join(f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2 AS {c}" for c in _COLUMNS) + " FROM lineitem)"


@query("evl24_spearman_matrix", " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS i, '{b}' AS j, round(corr({a}, {b}), 6) AS rho FROM {_RANKED} GROUP BY 1" for a in _COLUMNS for b in _COLUMNS))
def _(t):
    """Ranks of each column within a group, joined by value, then all pairs in one aggregate."""
    d = t("lineitem").select("l_returnflag", *_COLUMNS)
    for c in _COLUMNS:
        d = d.join(stats.average_ranks(d, ["l_returnflag"], c).select("l_returnflag", c, F.col("rank").alias(f"r_{c}")), ["l_returnflag", c])
    pairs = [(a, b) for a in _COLUMNS for b in _COLUMNS]
    row = d.groupBy("l_returnflag").agg(*(F.corr(f"r_{a}", f"r_{b}").alias(f"{a}_{b}") for a, b in pairs))
    return row.select("l_returnflag", F.inline(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), r6(f"{a}_{b}").alias("rho")) for a, b in pairs))))


@query("evl25_residual_medians", "WITH m AS (SELECT c_nationkey AS i, n_regionkey AS j, avg(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT round(median(v) FILTER (i % 5 = j), 6) AS diag, round(median(v) FILTER (i % 5 <> j), 6) AS off FROM m")
def _(t):
    m = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("i"), F.col("n_regionkey").alias("j")).agg(F.avg("c_acctbal").alias("v"))
    same = F.col("i") % 5 == F.col("j")
    return m.agg(r6(F.median(F.when(same, F.col("v")))).alias("diag"), r6(F.median(F.when(~same, F.col("v")))).alias("off"))


@query("evl26_principal_angles")
def _(t):
    """Angles between the spans of each two labels' first three principal directions, from second moments by label."""
    mom = long_vectors(t).groupBy("label", "vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))

    def basis(pdf):
        x = np.stack(pdf.v.to_numpy())
        return pd.DataFrame({"label": pdf.label.iloc[:1], "g": [(x.T @ x).reshape(-1)]})

    # partial Gram matrices by block of ids, then their sum: no label's vectors meet in one task
    part = mom.groupBy("label", F.expr("vec_id div 4096").alias("blk")).applyInPandas(lambda pdf: basis(pdf), "label int, g array<double>")
    gram = part.select("label", F.posexplode("g").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("g"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def angles(a: pd.Series, b: pd.Series) -> pd.Series:
        def top(g):
            n = int(len(g) ** 0.5)
            return np.linalg.eigh(np.asarray(g).reshape(n, n))[1][:, -3:]

        return pd.Series([np.arccos(np.clip(np.linalg.svd(top(x).T @ top(y), compute_uv=False), -1, 1)).round(5) for x, y in zip(a, b)])

    left, right = gram.select(F.col("label").alias("a"), F.col("g").alias("ga")), gram.select(F.col("label").alias("b"), F.col("g").alias("gb"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", angles("ga", "gb").alias("angles"))


@query("evl27_slice_stats", f"WITH n AS (SELECT vec_id, label, sqrt(sum(x * x)) AS n, sum(x) AS sx FROM {_LONG} GROUP BY 1, 2), q AS (SELECT label, quantile_cont(n, 0.9) AS q FROM n GROUP BY 1) SELECT label, round(avg(n), 6) AS mean_all, round(avg(n) FILTER (n >= q), 6) AS mean_top, count(*) FILTER (n >= q) AS n_top FROM n JOIN q USING (label) GROUP BY 1")
def _(t):
    n = t("embeddings").select("label", S.norm(F.col("embedding")).alias("n"))
    q = quantiles(n, ["label"], "n", {"q": 0.9})
    top = F.col("n") >= F.col("q")
    return n.join(F.broadcast(q), "label").groupBy("label").agg(r6(F.avg("n")).alias("mean_all"), r6(F.avg(F.when(top, F.col("n")))).alias("mean_top"), one(top).alias("n_top"))


@query("evl28_ridge", "WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem) SELECT round(sxy / (sxx + 10), 6) AS w, round(mb - sxy / (sxx + 10) * ma, 6) AS b FROM m")
def _(t):
    """Normal equations as sums, solved on one row."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    m = t("lineitem").agg(F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"))
    w = F.col("sxy") / (F.col("sxx") + 10)
    return m.select(r6(w).alias("w"), r6(F.col("mb") - w * F.col("ma")).alias("b"))


@query("evl29_mean_difference", f"WITH c AS (SELECT dim, avg(x) FILTER (label % 2 = 1) - avg(x) FILTER (label % 2 = 0) AS w FROM {_LONG} GROUP BY 1) SELECT dim, round(w, 6) AS w FROM c")
def _(t):
    odd = F.col("label") % 2 == 1
    return long_vectors(t).groupBy("dim").agg(r6(F.avg(F.when(odd, F.col("x"))) - F.avg(F.when(~odd, F.col("x")))).alias("w"))


@query("evl30_nearest_centroid", f"WITH c AS (SELECT label AS c, dim, avg(x) AS m FROM {_LONG} GROUP BY 1, 2), s AS (SELECT vec_id, label, c, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cos FROM {_LONG} JOIN c USING (dim) GROUP BY 1, 2, 3) SELECT label, round(avg(CASE WHEN label = best THEN 1.0 ELSE 0 END), 6) AS acc FROM (SELECT vec_id, label, arg_max(c, cos) AS best FROM s GROUP BY 1, 2) GROUP BY 1")
def _(t):
    """The label whose centroid is nearest; all centroids fit in one row an element."""
    c = long_vectors(t).groupBy("label", "dim").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))
    table = c.agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("cs"))
    best = F.array_max(F.transform("cs", lambda x: F.struct(S.cosine(F.col("embedding"), x["c"]).alias("cos"), x["label"].alias("l"))))["l"]
    hit = F.when(F.col("label") == best, 1.0).otherwise(0.0)
    return t("embeddings").join(F.broadcast(table)).groupBy("label").agg(r6(F.avg(hit)).alias("acc"))


@query("evl31_edge_energy", "SELECT l_suppkey, round(sum(pow(l_discount - m, 2)), 6) AS energy FROM lineitem JOIN (SELECT l_partkey, avg(l_discount) AS m FROM lineitem GROUP BY 1) USING (l_partkey) GROUP BY 1")
def _(t):
    m = t("lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("m"))
    return t("lineitem").join(m, "l_partkey").groupBy("l_suppkey").agg(r6(F.sum(F.pow(F.col("l_discount") - F.col("m"), 2))).alias("energy"))


@query("evl32_prevalence", f"SELECT lang, round(avg(CASE WHEN tox > 0 THEN 1.0 ELSE 0 END), 6) AS prevalence FROM {_E} GROUP BY 1")
def _(t):
    return scored(t).groupBy("lang").agg(r6(F.avg(F.when(F.col("tox") > 0, 1.0).otherwise(0.0))).alias("prevalence"))


@query("evl33_residual_correlation", f"SELECT lang, round((corr(y - p, y - s / 10000) + corr(y - p, tox - p) + corr(y - s / 10000, tox - p)) / 3, 6) AS r FROM {_E} GROUP BY 1")
def _(t):
    a, b, c = F.col("y") - F.col("p"), F.col("y") - F.col("s") / 10000, F.col("tox") - F.col("p")
    return scored(t).groupBy("lang").agg(r6((F.corr(a, b) + F.corr(a, c) + F.corr(b, c)) / 3).alias("r"))


@query("evl34_hash_reservoir", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR)) AS rn FROM events) WHERE rn <= 200")
def _(t):
    """A sample of 200 a group: the least hashes."""
    w = Window.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string")))
    return t("events").withColumn("rn", F.row_number().over(w)).where("rn <= 200").select("event_type", "event_id")


@query("evl35_kde", "WITH h AS (SELECT l_returnflag, count(*) AS n, 1.06 * stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY 1), v AS (SELECT l_returnflag, l_quantity AS q, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, x, round(sum(c * exp(-0.5 * pow((x - q) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM v JOIN h USING (l_returnflag), (SELECT unnest(range(0, 51, 5)) AS x) GROUP BY 1, 2")
def _(t):
    """Density on a grid, from the counts of distinct values."""
    l = t("lineitem")
    h = l.groupBy("l_returnflag").agg(F.count("*").alias("n"), (1.06 * F.stddev_samp("l_quantity") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"))
    v = l.groupBy("l_returnflag", F.col("l_quantity").alias("q")).agg(F.count("*").alias("c")).join(h, "l_returnflag").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(5))))
    return v.groupBy("l_returnflag", "x").agg(r6(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("q")) / F.col("h"), 2))) / (F.max("n") * F.max("h") * F.sqrt(F.lit(2 * np.pi)))).alias("density"))


@query("evl36_decompose", "SELECT l_returnflag, round(avg(l_tax) FILTER (l_linestatus = 'O') + avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS even, round(avg(l_tax) FILTER (l_linestatus = 'O') - avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS odd FROM lineitem GROUP BY 1")
def _(t):
    m = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_tax")))
    return t("lineitem").groupBy("l_returnflag").agg(r6(m("O") + m("F")).alias("even"), r6(m("O") - m("F")).alias("odd"))


_P = "(SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1)"


@query("evl37_wilson", f"SELECT l_suppkey, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lo, round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS hi FROM {_P}")
def _(t):
    g = t("lineitem").groupBy("l_suppkey").agg(one(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("l_suppkey", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("evl38_cluster_se", f"WITH g AS {_P}, p AS (SELECT sum(k) / sum(n) AS p, sum(n) AS nn, count(*) AS c FROM g) SELECT round(max(p), 6) AS p, round(sqrt(sum(pow(k - p * n, 2)) * max(c) / (max(c) - 1)) / max(nn), 6) AS se FROM g, p")
def _(t):
    g = t("lineitem").groupBy("l_suppkey").agg(one(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    k, n = F.col("k"), F.col("n")
    s = g.agg(F.sum(k).alias("sk"), F.sum(n).alias("sn"), F.count("*").alias("c"), F.sum(k * k).alias("kk"), F.sum(k * n).alias("kn"), F.sum(n * n).alias("nn"))
    p = F.col("sk") / F.col("sn")
    ss = F.col("kk") - 2 * p * F.col("kn") + p * p * F.col("nn")
    return s.select(r6(p).alias("p"), r6(F.sqrt(ss * F.col("c") / (F.col("c") - 1)) / F.col("sn")).alias("se"))


@query("evl39_t_interval", "SELECT n_regionkey, round(CASE WHEN count(*) = 5 THEN avg(m) - 2.776445105 * stddev_samp(m) / sqrt(5) END, 4) AS lo, round(CASE WHEN count(*) = 5 THEN avg(m) + 2.776445105 * stddev_samp(m) / sqrt(5) END, 4) AS hi FROM (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def _(t):
    m = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.avg("c_acctbal").alias("m"))
    half = 2.776445105 * F.stddev_samp("m") / F.sqrt(F.lit(5.0))
    five = F.count("*") == 5
    return m.groupBy("n_regionkey").agg(F.round(F.when(five, F.avg("m") - half), 4).alias("lo"), F.round(F.when(five, F.avg("m") + half), 4).alias("hi"))


@query("evl40_cross_fit", "WITH m AS (SELECT l_suppkey, l_linenumber, l_orderkey % 2 AS fold, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT l_suppkey, fold, arg_max(l_linenumber, (round(v, 9), l_linenumber)) AS pick FROM m GROUP BY 1, 2) SELECT b.l_suppkey, round(avg(m.v), 6) AS v FROM b JOIN m ON m.l_suppkey = b.l_suppkey AND m.fold = 1 - b.fold AND m.l_linenumber = b.pick GROUP BY 1")
def _(t):
    m = t("lineitem").groupBy("l_suppkey", "l_linenumber", (F.col("l_orderkey") % 2).alias("fold")).agg(F.avg("l_discount").alias("v"))
    b = m.groupBy("l_suppkey", "fold").agg(F.max_by("l_linenumber", F.struct(F.round("v", 9), "l_linenumber")).alias("l_linenumber")).withColumn("fold", 1 - F.col("fold"))
    return b.join(m, ["l_suppkey", "fold", "l_linenumber"]).groupBy("l_suppkey").agg(r6(F.avg("v")).alias("v"))


@query("evl41_kl_rows", "WITH l AS (SELECT l_suppkey AS g, l_linenumber AS c, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1, 2), n AS (SELECT g, c, a - max(a) OVER w - ln(sum(exp(a)) OVER w / exp(max(a) OVER w)) AS la, b - max(b) OVER w - ln(sum(exp(b)) OVER w / exp(max(b) OVER w)) AS lb FROM l WINDOW w AS (PARTITION BY g)) SELECT g, round(sum(exp(la) * (la - lb)), 6) AS kl FROM n GROUP BY g")
def _(t):
    l = t("lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("c")).agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b"))
    w = Window.partitionBy("g")
    m = l.withColumns({"a": F.col("a") - F.max("a").over(w), "b": F.col("b") - F.max("b").over(w)})
    n = m.withColumns({"a": F.col("a") - F.log(F.sum(F.exp("a")).over(w)), "b": F.col("b") - F.log(F.sum(F.exp("b")).over(w))})
    return n.groupBy("g").agg(r6(F.sum(F.exp("a") * (F.col("a") - F.col("b")))).alias("kl"))


@query("evl42_alternatives_argmax", "WITH s AS (SELECT l_orderkey, l_returnflag, max(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_max(l_returnflag, (m, l_returnflag)) AS best, arg_max(l_returnflag, (m, l_returnflag)) = 'N' AS correct FROM s GROUP BY 1 HAVING count(*) >= 2 AND bool_or(l_returnflag = 'N')")
def _(t):
    s = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_extendedprice").alias("m"))
    g = s.groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("m", "l_returnflag")).alias("best"), F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "N").alias("has"))
    return g.where("n >= 2 AND has").select("l_orderkey", "best", (F.col("best") == "N").alias("correct"))


@query("evl43_class_metrics", f"SELECT lang, round((avg(CASE WHEN s > 1000 THEN 1.0 ELSE 0 END) FILTER (y = 1) + avg(CASE WHEN s > 1000 THEN 0.0 ELSE 1 END) FILTER (y = 0)) / 2, 6) AS balanced, round(avg(y), 6) AS positive FROM {_E} GROUP BY 1 HAVING count(DISTINCT y) = 2")
def _(t):
    hit = F.when(F.col("s") > 1000, 1.0).otherwise(0.0)
    g = scored(t).groupBy("lang").agg(F.avg(F.when(F.col("y") == 1, hit)).alias("a"), F.avg(F.when(F.col("y") == 0, 1 - hit)).alias("b"), r6(F.avg("y")).alias("positive"))
    return g.where("a IS NOT NULL AND b IS NOT NULL").select("lang", r6((F.col("a") + F.col("b")) / 2).alias("balanced"), "positive")


@query("evl44_masked_r2", "SELECT l_linestatus, round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / (sum(pow(l_extendedprice, 2)) - pow(sum(l_extendedprice), 2) / count(*)), 6) AS r2, round(avg(CASE WHEN sign(l_extendedprice - 40000) = sign(l_quantity - 25) THEN 1.0 ELSE 0 END), 6) AS sign_acc FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def _(t):
    y, q = F.col("l_extendedprice"), F.col("l_quantity")
    r2 = 1 - F.sum(F.pow(y - 1500 * q, 2)) / (F.sum(F.pow(y, 2)) - F.pow(F.sum(y), 2) / F.count("*"))
    return t("lineitem").where("l_returnflag <> 'N'").groupBy("l_linestatus").agg(r6(r2).alias("r2"), r6(F.avg(F.when(F.signum(y - 40000) == F.signum(q - 25), 1.0).otherwise(0.0))).alias("sign_acc"))


@query("evl45_mirrored_auroc", f"WITH a AS {_auc('s', 'y', 'lang')}, b AS {_auc('-s', 'tox', 'lang')}, n AS (SELECT lang, count(*) AS n FROM {_E} GROUP BY 1) SELECT lang, round((a.auc + b.auc) / 2, 6) AS v FROM a JOIN b USING (lang) JOIN n USING (lang) WHERE n >= 20")
def _(t):
    e = scored(t).withColumn("m", -F.col("s"))
    j = stats.auroc(e, ["lang"], "s", "y", "a").join(stats.auroc(e, ["lang"], "m", "tox", "b"), "lang").join(e.groupBy("lang").agg(F.count("*").alias("n")), "lang")
    return j.where("n >= 20").select("lang", r6((F.col("a") + F.col("b")) / 2).alias("v"))


@query("evl46_majority_baseline", f"WITH f AS (SELECT lang, CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END AS m FROM {_E} WHERE doc_id % 2 = 0 GROUP BY 1) SELECT lang, round(avg(CASE WHEN y = m THEN 1.0 ELSE 0 END), 6) AS acc FROM {_E} JOIN f USING (lang) WHERE doc_id % 2 = 1 GROUP BY 1")
def _(t):
    """Fitted on the even ids, applied to the odd ones."""
    e = scored(t)
    f = e.where("doc_id % 2 = 0").groupBy("lang").agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("m"))
    return e.where("doc_id % 2 = 1").join(F.broadcast(f), "lang").groupBy("lang").agg(r6(F.avg(F.when(F.col("y") == F.col("m"), 1.0).otherwise(0.0))).alias("acc"))


@query("evl47_gram_diagnostics", f"WITH c AS (SELECT label, dim, avg(x) AS m FROM {_LONG} GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1) SELECT a.label AS i, b.label AS j, round(sum(a.m * b.m) / (max(na.n) * max(nb.n)), 6) AS cos FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2 ORDER BY abs(sum(a.m * b.m) / (max(na.n) * max(nb.n))) DESC, 1, 2 LIMIT 5")
def _(t):
    """The five most collinear pairs of label centroids (a report; labels are few)."""
    c = long_vectors(t).groupBy("label", "dim").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))
    a, b = c.select(F.col("label").alias("i"), F.col("c").alias("x")), c.select(F.col("label").alias("j"), F.col("c").alias("y"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", r6(S.cosine(F.col("x"), F.col("y"))).alias("cos")).orderBy(F.abs("cos").desc(), "i", "j").limit(5)


@query("evl48_integrity", "SELECT count(*) FILTER (text IS NULL) AS no_text, count(*) FILTER (length(text) <> n_chars) AS bad_length, count(*) FILTER (lang IS NULL) AS no_lang, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents")
def _(t):
    d = t("documents")
    ids = d.groupBy("doc_id").count().agg(F.sum(F.col("count") - 1).alias("repeated_ids"))
    return d.agg(one(F.col("text").isNull()).alias("no_text"), one(F.length("text") != F.col("n_chars")).alias("bad_length"), one(F.col("lang").isNull()).alias("no_lang")).join(ids)


@query("evl49_cells", "SELECT l_returnflag, l_linestatus, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n FROM (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_discount) AS m, count(*) FILTER (l_discount > 0.05) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(n) >= 1000")
def _(t):
    s = t("lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_discount").alias("m"), one(F.col("l_discount") > 0.05).alias("k"), F.count("*").alias("n"))
    return s.groupBy("l_returnflag", "l_linestatus").agg(r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m")).alias("sd"), F.sum("k").alias("k"), F.sum("n").alias("n")).where("n >= 1000")
