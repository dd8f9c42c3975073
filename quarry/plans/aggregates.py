"""AGG: aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.order import quantiles
from .base import query, r6
from .projections import _DIMS, _LONG, coded, long_vectors

_Q = f"(SELECT dim, label, vec_id, greatest(-127, least(127, round_even((x - zero) / scale, 0)))::INT AS q, zero, scale FROM {_LONG} JOIN {_DIMS} USING (dim))"


def one(c):
    return F.count(F.when(c, 1))


@query("agg1_moments", f"SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(greatest(var_pop(x), 1e-12), 6) AS var_ FROM {_LONG} GROUP BY dim")
def _(t):
    return long_vectors(t).groupBy("dim").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.greatest(F.var_pop("x"), F.lit(1e-12))).alias("var_"))


@query("agg2_merge_moments", f"SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var_ FROM {_LONG} GROUP BY dim")
def _(t):
    """Partial moments of each label, merged."""
    p = long_vectors(t).groupBy("dim", "label").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("m2"))
    total = p.groupBy("dim").agg(F.sum("n").alias("tn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("tm"))
    j = p.join(F.broadcast(total), "dim")
    return j.groupBy("dim").agg(F.max("tn").alias("n"), r6(F.max("tm")).alias("mean"), r6(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("m") - F.col("tm"), 2)) / F.max("tn")).alias("var_"))


@query("agg3_r2", "SELECT l_returnflag, round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / greatest(sum(pow(l_extendedprice, 2)) - pow(sum(l_extendedprice), 2) / count(*), 1e-8), 6) AS r2 FROM lineitem GROUP BY 1")
def _(t):
    y = F.col("l_extendedprice")
    sse = F.sum(F.pow(y - 1500 * F.col("l_quantity"), 2))
    sst = F.sum(F.pow(y, 2)) - F.pow(F.sum(y), 2) / F.count("*")
    return t("lineitem").groupBy("l_returnflag").agg(r6(1 - sse / F.greatest(sst, F.lit(1e-8))).alias("r2"))


@query("agg4_pearson_rmse", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(sqrt(avg(pow(l_quantity * 1500 - l_extendedprice, 2))), 4) AS rmse FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("r"), F.round(F.sqrt(F.avg(F.pow(F.col("l_quantity") * 1500 - F.col("l_extendedprice"), 2))), 4).alias("rmse"))


@query("agg5_column_max", f"SELECT dim, round(max(x), 6) AS m FROM {_LONG} GROUP BY dim")
def _(t):
    return long_vectors(t).groupBy("dim").agg(r6(F.max("x")).alias("m"))


@query("agg6_hist_quantiles", f"""
WITH h AS (SELECT dim, q, count(*) AS n, any_value(zero) AS zero, any_value(scale) AS scale FROM {_Q} GROUP BY dim, q),
c AS (SELECT *, sum(n) OVER (PARTITION BY dim ORDER BY q) AS cum, sum(n) OVER (PARTITION BY dim) AS total FROM h)
SELECT dim, round(min(q) FILTER (cum >= 0.5 * total) * max(scale) + max(zero), 6) AS p50, round(min(q) FILTER (cum >= 0.95 * total) * max(scale) + max(zero), 6) AS p95, round(sum(n) FILTER (abs(q) = 127) / max(total), 6) AS clipped FROM c GROUP BY dim""")
def _(t):
    """Quantiles from counts of the 255 codes: the shuffle has a row a code, not a value."""
    h = coded(t).groupBy("dim", "q").agg(F.count("*").alias("n"), F.first("zero").alias("zero"), F.first("scale").alias("scale"))
    by = Window.partitionBy("dim")
    c = h.withColumns({"cum": F.sum("n").over(by.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(by)})
    at = lambda p: r6(F.min(F.when(F.col("cum") >= p * F.col("total"), F.col("q"))) * F.max("scale") + F.max("zero"))
    return c.groupBy("dim").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), r6(F.sum(F.when(F.abs("q") == 127, F.col("n"))) / F.max("total")).alias("clipped"))


@query("agg7_exact_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(t):
    q = quantiles(t("events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    return q.select("event_type", *(r6(n).alias(n) for n in ("p25", "p50", "p99")))


@query("agg8_saturated_top", f"SELECT dim, label, count(*) AS n FROM {_Q} WHERE q >= 60 GROUP BY 1, 2 ORDER BY n DESC, dim, label LIMIT 100")
def _(t):
    return coded(t).where("q >= 60").groupBy("dim", "label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim", "label").limit(100)


@query("agg9_max_pool", "SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("m"))


@query("agg10_group_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.count("*").alias("n"))


@query("agg11_seed_nested", "SELECT event_type, round(avg(m), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(m) / sqrt(count(*)) END, 6) AS se FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    seeds = t("events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return seeds.groupBy("event_type").agg(r6(F.avg("m")).alias("mean"), r6(F.when(F.count("*") > 1, F.try_divide(F.stddev_samp("m"), F.sqrt(F.count("*"))))).alias("se"))


@query("agg12_equal_weights", "SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(m), 6) AS lo, round(max(m), 6) AS hi FROM (SELECT l_returnflag, avg(m) AS m FROM (SELECT l_returnflag, l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def _(t):
    a = t("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("m")).groupBy("l_returnflag").agg(F.avg("m").alias("m"))
    return a.agg(r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m")).alias("sd"), r6(F.min("m")).alias("lo"), r6(F.max("m")).alias("hi"))


@query("agg13_share_above", "SELECT l_suppkey, round(avg(CASE WHEN l_quantity >= 40 THEN 1.0 ELSE 0 END), 6) AS share FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(r6(F.avg(F.when(F.col("l_quantity") >= 40, 1.0).otherwise(0.0))).alias("share"))


_WEIGHTED = "(SELECT l_returnflag, l_extendedprice AS v, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_returnflag, l_suppkey) AS w, l_orderkey, l_linenumber FROM lineitem)"


def weighted(t):
    n = F.count("*").over(Window.partitionBy("l_returnflag", "l_suppkey"))
    return t("lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"), (1 / n).alias("w"), "l_orderkey", "l_linenumber")


@query("agg14_weighted_samples", f"SELECT l_returnflag, round(sum(w), 6) AS w FROM {_WEIGHTED} GROUP BY 1")
def _(t):
    return weighted(t).groupBy("l_returnflag").agg(r6(F.sum("w")).alias("w"))


def weighted_quantiles(df, by: str, value: str, weight: str, shares: dict[str, float]):
    """For each group the least value at which the weight so far reaches the share of all. Weights are
    added up by distinct value first, so a window has a row a value."""
    d = df.groupBy(by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(by)
    d = d.withColumns({"_cum": F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(w)})
    return d.groupBy(by).agg(*(F.min(F.when(F.col("_cum") >= p * F.col("_all") - 1e-9, F.col(value))).alias(n) for n, p in shares.items()))


@query("agg15_weighted_median", f"SELECT l_returnflag, min(v) FILTER (cum >= 0.5 * total - 1e-9) AS med FROM (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM {_WEIGHTED}) GROUP BY 1")
def _(t):
    return weighted_quantiles(weighted(t), "l_returnflag", "v", "w", {"med": 0.5})


@query("agg16_conditional_counts", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open_, count(*) FILTER (l_discount > 0) AS discounted, count(*) FILTER (l_linestatus = 'O' AND l_discount > 0) AS both_ FROM lineitem GROUP BY 1")
def _(t):
    o, d = F.col("l_linestatus") == "O", F.col("l_discount") > 0
    return t("lineitem").groupBy("l_returnflag").agg(one(o).alias("open_"), one(d).alias("discounted"), one(o & d).alias("both_"))


@query("agg17_quota_shortfall", "SELECT n_nationkey, 80 - coalesce(n, 0) AS short FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey WHERE 80 - coalesce(n, 0) > 0")
def _(t):
    c = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t("nation").join(c, "n_nationkey", "left").select("n_nationkey", (80 - F.coalesce("n", F.lit(0))).alias("short")).where("short > 0")


@query("agg18_rollup_report", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def _(t):
    return t("documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("agg19_span_voting", "SELECT o_custkey, c, round(sum(v) / 3, 6) AS strength FROM (SELECT o_custkey, sample, c, max(v) AS v FROM (SELECT o_custkey, o_orderkey % 3 AS sample, unnest(range(o_orderkey % 10, o_orderkey % 10 + 4)) AS c, (o_orderkey % 7) / 6 AS v FROM orders) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t):
    k = F.col("o_orderkey")
    chars = t("orders").select("o_custkey", (k % 3).alias("sample"), F.explode(F.sequence(k % 10, k % 10 + 3)).alias("c"), ((k % 7) / 6).alias("v"))
    return chars.groupBy("o_custkey", "sample", "c").agg(F.max("v").alias("v")).groupBy("o_custkey", "c").agg(r6(F.sum("v") / 3).alias("strength"))


@query("agg20_mode_vote", "SELECT l_suppkey, l_linenumber AS vote, n FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def _(t):
    n = t("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("l_linenumber").alias("vote"))).alias("b")).select("l_suppkey", "b.vote", (-F.col("b.m")).alias("n"))


@query("agg21_median_of_groups", "SELECT round(median(m), 6) AS med FROM (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_custkey)")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")).transform(lambda d: quantiles(d, [], "m", {"med": 0.5})).select(r6("med").alias("med"))


@query("agg22_wins", "SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) AS n FROM (SELECT max(l_quantity) FILTER (l_linenumber = 1) AS a, max(l_quantity) FILTER (l_linenumber = 2) AS b FROM lineitem GROUP BY l_orderkey)")
def _(t):
    at = lambda i: F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity")))
    g = t("lineitem").groupBy("l_orderkey").agg(at(1).alias("a"), at(2).alias("b"))
    return g.agg(one(F.col("a") > F.col("b")).alias("wins"), one(F.col("a") == F.col("b")).alias("ties"), F.count("*").alias("n"))


@query("agg23_micro_macro", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS micro, round(avg(l_discount), 6) AS macro FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(r6(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("micro"), r6(F.avg("l_discount")).alias("macro"))


@query("agg24_item_means", "SELECT o_orderkey, round(avg(l_tax), 6) AS m FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY 1")
def _(t):
    m = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(r6(F.avg("l_tax")).alias("m"))
    return t("orders").select("o_orderkey").join(m, "o_orderkey", "left")


@query("agg25_conditional_rate", "SELECT l_suppkey, round(count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) / greatest(count(*) FILTER (l_returnflag = 'R'), 1), 6) AS rate FROM lineitem GROUP BY 1")
def _(t):
    r = F.col("l_returnflag") == "R"
    return t("lineitem").groupBy("l_suppkey").agg(r6(one(r & (F.col("l_discount") > 0.05)) / F.greatest(one(r), F.lit(1))).alias("rate"))


@query("agg26_report", "SELECT lang, string_agg(source || ':' || n, ',' ORDER BY source) AS arms, arg_max(source, (n, source)) AS best FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang")
def _(t):
    g = t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    arms = F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws(":", x["source"], x["n"].cast("string")))
    return g.groupBy("lang").agg(F.array_join(arms, ",").alias("arms"), F.max_by("source", F.struct("n", "source")).alias("best"))


@query("agg27_seed_complete", "SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 7 AND count(*) >= count(DISTINCT l_linenumber)")
def _(t):
    g = t("lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.count_distinct("l_linenumber").alias("k"), F.count("*").alias("n"))
    return g.where("k = 7 AND n >= k").select("l_suppkey")


@query("agg28_weighted_quantiles", f"SELECT l_returnflag, min(v) FILTER (cum >= 0.1 * total - 1e-9) AS p10, min(v) FILTER (cum >= 0.9 * total - 1e-9) AS p90 FROM (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM {_WEIGHTED}) GROUP BY 1")
def _(t):
    return weighted_quantiles(weighted(t), "l_returnflag", "v", "w", {"p10": 0.1, "p90": 0.9})
