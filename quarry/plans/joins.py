"""JOI: joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof
from .base import query, r6


@query("joi1_key_audit", "SELECT count(*) FILTER (o.o_custkey IS NOT NULL AND c.c_custkey IS NOT NULL) AS both_, count(*) FILTER (o.o_custkey IS NULL) AS only_customer, count(*) FILTER (c.c_custkey IS NULL) AS only_orders FROM (SELECT DISTINCT o_custkey FROM orders) o FULL JOIN customer c ON o.o_custkey = c.c_custkey")
def _(t):
    o, c = t("orders").select("o_custkey").distinct(), t("customer").select("c_custkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "full")
    n = lambda x: F.count(F.when(x, 1))
    left, right = F.col("o_custkey").isNotNull(), F.col("c_custkey").isNotNull()
    return j.agg(n(left & right).alias("both_"), n(~left).alias("only_customer"), n(~right).alias("only_orders"))


@query("joi2_baseline_lookup", "WITH b AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), a AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS v FROM lineitem WHERE l_linenumber > 5 GROUP BY 1, 2) SELECT a.l_suppkey, a.l_returnflag, round(a.v - b.v, 6) AS delta FROM a LEFT JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag")
def _(t):
    l = t("lineitem")
    part = lambda cond, name: l.where(cond).groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias(name))
    return part("l_linenumber > 5", "a").join(part("l_linenumber = 1", "b"), ["l_suppkey", "l_returnflag"], "left").select("l_suppkey", "l_returnflag", r6(F.col("a") - F.col("b")).alias("delta"))


@query("joi3_paired_delta", "SELECT a.l_orderkey, round(a.l_extendedprice - b.l_extendedprice, 6) AS delta FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 2 AND b.l_linenumber = 1")
def _(t):
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    a, b = l.where("l_linenumber = 2").select("l_orderkey", F.col("l_extendedprice").alias("x")), l.where("l_linenumber = 1").select("l_orderkey", F.col("l_extendedprice").alias("y"))
    return a.join(b, "l_orderkey").select("l_orderkey", r6(F.col("x") - F.col("y")).alias("delta"))


@query("joi4_aligned_subtract", "WITH g AS (SELECT user_id, avg(value) FILTER (event_type = 'purchase') AS p, avg(value) FILTER (event_type = 'click') AS c FROM events GROUP BY 1) SELECT user_id, round(p - c, 6) AS d FROM g WHERE p - c IS NOT NULL")
def _(t):
    mean = lambda v: F.avg(F.when(F.col("event_type") == v, F.col("value")))
    return t("events").groupBy("user_id").agg(r6(mean("purchase") - mean("click")).alias("d")).where("d IS NOT NULL")


@query("joi5_same_query_sets", "WITH s AS (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT l_linenumber)) AS q, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a.l_orderkey, round(a.v - b.v, 6) AS d FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'N' AND a.q = b.q")
def _(t):
    s = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_set("l_linenumber")).alias("q"), F.sum("l_quantity").alias("v"))
    a, b = (s.where(F.col("l_returnflag") == x).select("l_orderkey", "q", F.col("v").alias(f"v_{x}")) for x in ("A", "N"))
    return a.join(b, ["l_orderkey", "q"]).select("l_orderkey", r6(F.col("v_A") - F.col("v_N")).alias("d"))


@query("joi6_canonical_name", "SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON replace(upper(r.r_name), ' ', '_') = (SELECT replace(upper(r2.r_name), ' ', '_') FROM region r2 WHERE r2.r_regionkey = n.n_regionkey)")
def _(t):
    canon = F.replace(F.upper("r_name"), F.lit(" "), F.lit("_"))
    n = t("nation").join(t("region").select(F.col("r_regionkey").alias("n_regionkey"), canon.alias("key")), "n_regionkey")
    return n.join(t("region").select(canon.alias("key"), "r_name"), "key").select("n_nationkey", "r_name")


@query("joi7_overlap_max", "WITH x AS (SELECT o_custkey AS g, o_orderkey AS id, (o_orderkey % 50)::BIGINT AS s, (o_orderkey % 50 + 1 + o_orderkey % 7)::BIGINT AS e FROM orders), y AS (SELECT o_custkey AS g, (o_orderkey % 41)::BIGINT AS a, (o_orderkey % 41 + 1 + o_orderkey % 5)::BIGINT AS b, o_totalprice AS v FROM orders) SELECT g, id, max(v) AS v FROM x JOIN y USING (g) WHERE s < b AND e > a GROUP BY g, id")
def _(t):
    o, k = t("orders"), F.col("o_orderkey")
    x = o.select(F.col("o_custkey").alias("g"), k.alias("id"), (k % 50).alias("s"), (k % 50 + 1 + k % 7).alias("e"))
    y = o.select(F.col("o_custkey").alias("g"), (k % 41).alias("a"), (k % 41 + 1 + k % 5).alias("b"), F.col("o_totalprice").alias("v"))
    return asof.overlap_max(x, y, ["g"], 8, "v")


_ASOF = "SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts"


@query("joi8_as_of", _ASOF)
def _(t):
    e = t("events")
    left = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return asof.as_of_backward(left, right, ["user_id"], "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query("joi9_boundary_lists", "SELECT o_custkey, o_orderkey, (total - n)::BIGINT AS first, n FROM (SELECT o_custkey, o_orderkey, n, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS total FROM (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS n FROM orders))")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("o_orderkey") % 4
    return t("orders").select("o_custkey", "o_orderkey", (F.sum(n).over(w) - n).alias("first"), n.alias("n"))


@query("joi10_crossing_rate", "WITH s AS (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 0), g AS (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 1) SELECT round(avg(CASE WHEN g.l_orderkey IS NULL THEN 1.0 ELSE 0 END), 6) AS crossing FROM s LEFT JOIN g ON s.l_orderkey = g.l_orderkey AND s.l_quantity = g.l_quantity")
def _(t):
    part = lambda m: t("lineitem").where(F.col("l_linenumber") % 2 == m).select("l_orderkey", "l_quantity").distinct()
    j = part(0).join(part(1).withColumn("hit", F.lit(1)), ["l_orderkey", "l_quantity"], "left")
    return j.agg(r6(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0))).alias("crossing"))


@query("joi11_nearest_length")
def _(t):
    """Each purchase of a user takes the unused click whose value is the least not below its own, else the largest left."""
    from bisect import bisect_left

    def pair(pdf):
        import pandas as pd

        left = sorted(pdf.loc[pdf.event_type == "click", ["value", "event_id"]].itertuples(index=False, name=None))
        out = []
        for r in pdf[pdf.event_type == "purchase"].sort_values(["value", "event_id"]).itertuples():
            if left:
                i = min(bisect_left(left, (r.value, -1)), len(left) - 1)
                out.append((r.user_id, r.event_id, left.pop(i)[1]))
        return pd.DataFrame(out, columns=["user_id", "purchase", "click"])

    return t("events").where("event_type IN ('purchase', 'click')").select("user_id", "event_id", "event_type", "value").groupBy("user_id").applyInPandas(pair, "user_id long, purchase long, click long")


@query("joi13_position_lookup", "WITH d AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start FROM documents) SELECT p, max(doc_id) AS doc_id FROM (SELECT unnest(range(0, (SELECT sum(n_chars) FROM documents)::BIGINT, 1000)) AS p) JOIN d ON d.start <= p GROUP BY p")
def _(t):
    """Every thousandth position of the concatenated corpus and its document. Documents and positions meet in
    cells of 8,192 positions, a document in each cell that it covers."""
    from ..operators.order import prefix_sum

    d = prefix_sum(t("documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n")), "doc_id", "n", "start").where("n > 0")
    total = d.agg(F.sum("n")).first()[0] or 0
    cells = d.select("doc_id", "start", "n", F.explode(F.sequence(F.expr("start div 8192"), F.expr("(start + n - 1) div 8192"))).alias("cell"))
    p = t.spark.range(0, total, 1000).select(F.col("id").alias("p"), F.expr("id div 8192").alias("cell"))
    return p.join(cells, "cell").where("start <= p AND p < start + n").select("p", "doc_id")


@query("joi14_semi_join_list", "SELECT p_partkey, p_brand, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 50) x ON p_partkey = l_partkey")
def _(t):
    top = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_partkey").limit(50)
    return t("part").join(F.broadcast(top), "p_partkey").select("p_partkey", "p_brand", "n")


@query("joi15_variants", "SELECT r_name, v FROM region, (VALUES ('a'), ('b'), ('c')) AS x(v)")
def _(t):
    return t("region").select("r_name", F.explode(F.array(*map(F.lit, "abc"))).alias("v"))


def hungarian(cost: np.ndarray) -> list[int]:
    """The column of each row in the assignment of least cost (rows <= columns); potentials and shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[col]:
            used[col] = True
            reduced = cost[match[col] - 1] - u[match[col]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], col
            nxt = int(np.where(used, np.inf, least)[1:].argmin()) + 1
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


@query("joi16_assignment")
def _(t):
    """Within each label and block of 128 ids, even vectors are assigned to odd ones by the largest sum of absolute cosines."""

    def assign(pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        a, b = pdf[pdf.vec_id % 2 == 0], pdf[pdf.vec_id % 2 == 1]
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return pd.DataFrame({"label": [], "a": [], "b": []})
        x, y = (np.stack(d.embedding.to_numpy()).astype(float) for d in (a, b))
        cos = np.abs((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T)
        return pd.DataFrame({"label": a.label.to_numpy(), "a": a.vec_id.to_numpy(), "b": b.vec_id.to_numpy()[hungarian(-cos)]})

    return t("embeddings").groupBy("label", F.expr("vec_id div 128")).applyInPandas(assign, "label int, a long, b long")


@query("joi17_resume_cache", "WITH c AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, event_id FROM c")
def _(t):
    key = F.to_json(F.array(F.col("user_id").cast("string"), "event_type"))
    last = t("events").groupBy(key.alias("k")).agg(F.max_by(F.struct("user_id", "event_type", "event_id"), F.struct("ts", "event_id")).alias("r"))
    return last.select("r.*")


_GRAMS = "(SELECT DISTINCT {id} AS id, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM {tab}), unnest(range(1, len(ws) - 6)) AS u(i))"


@query("joi18_disjoint", f"SELECT d.id AS doc_id, count(*) AS shared FROM {_GRAMS.format(id='doc_id', tab='documents')} d WHERE g IN (SELECT g FROM {_GRAMS.format(id='item_id', tab='benchmark')}) GROUP BY 1")
def _(t):
    """Documents that share an eight-word shingle with the benchmark, and how many."""
    grams = lambda df, key: df.select(key, F.explode(F.transform(S.shingles(F.col("text")), lambda x: F.xxhash64(x))).alias("g"))
    long_ = F.size(S.words(F.col("text"))) >= 8
    b = grams(t("benchmark").where(long_), "item_id").select("g").distinct()
    return grams(t("documents").where(long_), "doc_id").join(b, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query("joi19_supplement", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, c_acctbal * 2) AS bal FROM customer")
def _(t):
    c = t("customer")
    first = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("x"))
    second = c.select("c_custkey", (F.col("c_acctbal") * 2).alias("y"))
    return first.join(second, "c_custkey").select("c_custkey", F.coalesce("x", "y").alias("bal"))


@query("joi20_random_matching", "WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_linenumber::VARCHAR || '|' || l_orderkey), l_linenumber) AS rn FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_linenumber::VARCHAR || '|' || l_orderkey), l_linenumber) AS rn FROM lineitem WHERE l_linestatus = 'F') SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.rn = b.rn")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.md5(F.concat_ws("|", F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string"))), "l_linenumber")
    side = lambda s, n: t("lineitem").where(F.col("l_linestatus") == s).select("l_orderkey", F.col("l_linenumber").alias(n), F.row_number().over(w).alias("rn"))
    return side("O", "x").join(side("F", "y"), ["l_orderkey", "rn"]).select("l_orderkey", "x", "y")
