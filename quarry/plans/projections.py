"""PRJ, HSH, MTH: projections, vectors, hashes, arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.order import quantiles
from .base import query, r6


def long_vectors(t):
    """(vec_id, label, dim, x): one row an element."""
    return t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


_LONG = "(SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_DIMS = f"(SELECT dim, avg(x) AS zero, stddev_pop(x) AS sd, greatest(4 * stddev_pop(x) / 127, 1e-6) AS scale FROM {_LONG} GROUP BY dim)"


def dimensions(t):
    """(dim, zero, sd, scale): as many rows as a vector has elements."""
    d = long_vectors(t).groupBy("dim").agg(F.avg("x").alias("zero"), F.stddev_pop("x").alias("sd"))
    return d.withColumn("scale", S.quant_scale(F.col("sd")))


def coded(t):
    c = long_vectors(t).join(F.broadcast(dimensions(t)), "dim")
    return c.withColumn("q", S.quantize(F.col("x"), F.col("zero"), F.col("scale")).cast("int"))


@query("prj1_quantize", f"SELECT dim, sum(q)::BIGINT AS sum_q, min(q)::INT AS min_q, max(q)::INT AS max_q FROM (SELECT dim, greatest(-127, least(127, round_even((x - zero) / scale, 0))) AS q FROM {_LONG} JOIN {_DIMS} USING (dim)) GROUP BY dim")
def _(t):
    return coded(t).groupBy("dim").agg(F.sum("q").alias("sum_q"), F.min("q").alias("min_q"), F.max("q").alias("max_q"))


@query("prj2_dequantize", f"SELECT dim, max(abs(greatest(-127, least(127, round_even((x - zero) / scale, 0))) * scale + zero - x)) <= max(scale) / 2 + 1e-9 OR max(abs(x - zero) / scale) > 127 AS bounded FROM {_LONG} JOIN {_DIMS} USING (dim) GROUP BY dim")
def _(t):
    back = S.dequantize(F.col("q"), F.col("zero"), F.col("scale"))
    return coded(t).groupBy("dim").agg(((F.max(F.abs(back - F.col("x"))) <= F.max("scale") / 2 + 1e-9) | (F.max(F.abs(F.col("x") - F.col("zero")) / F.col("scale")) > 127)).alias("bounded"))


@query("prj3_quant_constants", f"SELECT dim, round(zero, 6) AS zero, round(scale, 6) AS scale FROM {_DIMS}")
def _(t):
    return dimensions(t).select("dim", r6("zero").alias("zero"), r6("scale").alias("scale"))


@query("prj4_standardize", f"SELECT vec_id, round(sum(abs((x - zero) / greatest(sd, 1e-6))), 6) AS l1 FROM {_LONG} JOIN {_DIMS} USING (dim) GROUP BY vec_id")
def _(t):
    z = long_vectors(t).join(F.broadcast(dimensions(t)), "dim").withColumn("z", S.standardize(F.col("x"), F.col("zero"), F.col("sd")))
    return z.groupBy("vec_id").agg(r6(F.sum(F.abs("z"))).alias("l1"))


@query("prj5_fallback_stats", f"SELECT dim, round(CASE WHEN dim % 3 = 0 THEN scale * 127 / 4 ELSE sd END, 6) AS sd FROM {_DIMS}")
def _(t):
    known = F.when(F.col("dim") % 3 != 0, F.col("sd"))
    return dimensions(t).select("dim", r6(F.coalesce(known, F.col("scale") * 127 / 4)).alias("sd"))


@query("prj6_affine_head", f"SELECT vec_id, round(sum((x - zero) / greatest(sd, 1e-6) * ((dim % 7) - 3)) + 0.5, 6) AS score FROM {_LONG} JOIN {_DIMS} USING (dim) GROUP BY vec_id")
def _(t):
    one = dimensions(t).agg(F.sort_array(F.collect_list(F.struct("dim", "zero", "sd"))).alias("d"))  # one row
    z = F.zip_with("embedding", "d", lambda x, d: S.standardize(x.cast("double"), d["zero"], d["sd"]))
    weights = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: ((i % 7) - 3).cast("double"))
    return t("embeddings").join(F.broadcast(one)).select("vec_id", r6(S.dot(z, weights) + 0.5).alias("score"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))"


@query("prj7_cosine_to_centroid", f"""
WITH c AS (SELECT label, dim, avg(x) AS c FROM {_LONG} GROUP BY label, dim),
s AS (SELECT vec_id, label, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cos FROM {_LONG} JOIN c USING (label, dim) GROUP BY vec_id, label)
SELECT vec_id, label, round(cos, 6) AS cos FROM s""")
def _(t):
    mean = long_vectors(t).groupBy("label", "dim").agg(F.avg("x").alias("c")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("c"))
    return t("embeddings").join(mean, "label").select("vec_id", "label", r6(S.cosine(F.col("embedding"), F.col("c"))).alias("cos"))


@query("prj8_unit_vectors", f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / {_NORM}, 6) AS l1 FROM embeddings WHERE {_NORM} > 0")
def _(t):
    e = t("embeddings").where(S.norm(F.col("embedding")) > 0).withColumn("u", S.unit(F.col("embedding")))
    return e.select("vec_id", r6(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("l1"))


@query("prj9_kappa", f"SELECT dim, round(sd / (SELECT sqrt(sum(zero * zero)) FROM {_DIMS}), 6) AS kappa, round(sd / (SELECT sqrt(sum(zero * zero)) FROM {_DIMS}) / (SELECT median({_NORM}) FROM embeddings), 6) AS lambda_ FROM {_DIMS}")
def _(t):
    d = dimensions(t)
    whole = d.agg(F.sqrt(F.sum(F.col("zero") * F.col("zero"))).alias("len"))
    middle = quantiles(t("embeddings").select(S.norm(F.col("embedding")).alias("n")), [], "n", {"mid": 0.5})
    k = F.col("sd") / F.col("len")
    return d.join(F.broadcast(whole)).join(F.broadcast(middle)).select("dim", r6(k).alias("kappa"), r6(k / F.col("mid")).alias("lambda_"))


@query("prj10_loudness", f"SELECT dim, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.95), 6) AS p95 FROM (SELECT dim, abs(x - zero) / n AS l FROM {_LONG} JOIN {_DIMS} USING (dim) JOIN (SELECT vec_id, {_NORM} AS n FROM embeddings) USING (vec_id)) GROUP BY dim")
def _(t):
    e = t("embeddings").select("vec_id", S.norm(F.col("embedding")).alias("n"), F.posexplode("embedding").alias("dim", "x"))
    d = e.join(F.broadcast(dimensions(t)), "dim").withColumn("l", F.abs(F.col("x").cast("double") - F.col("zero")) / F.col("n"))
    return quantiles(d, ["dim"], "l", {"p50": 0.5, "p95": 0.95}).select("dim", r6("p50").alias("p50"), r6("p95").alias("p95"))


@query("prj11_raw_fold", f"SELECT round(sum(((dim % 7) - 3) / sd), 6) AS w_sum, round(0.5 - sum(((dim % 7) - 3) / sd * zero), 6) AS bias FROM {_DIMS}")
def _(t):
    w = ((F.col("dim") % 7) - 3) / F.col("sd")
    return dimensions(t).agg(r6(F.sum(w)).alias("w_sum"), r6(0.5 - F.sum(w * F.col("zero"))).alias("bias"))


@query("prj12_harmonic_mean", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0 OR l_tax <= 0 OR l_quantity <= 0 THEN 0 ELSE round(3 / (1 / l_quantity + 1 / l_discount + 1 / l_tax), 6) END AS hm FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(S.harmonic_mean(F.array("l_quantity", "l_discount", "l_tax"))).alias("hm"))


@query("prj13_softmax_rank", "SELECT o_custkey, round(sum(p * rk), 6) AS expected FROM (SELECT o_custkey, rk, e / sum(e) OVER (PARTITION BY o_custkey) AS p FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk, exp(o_totalprice / 100000 - max(o_totalprice / 100000) OVER (PARTITION BY o_custkey)) AS e FROM orders)) GROUP BY o_custkey")
def _(t):
    key = Window.partitionBy("o_custkey")
    s = F.col("o_totalprice") / 100000
    d = t("orders").select("o_custkey", F.row_number().over(key.orderBy("o_orderkey")).alias("rk"), F.exp(s - F.max(s).over(key)).alias("e"))
    return d.groupBy("o_custkey").agg(r6(F.sum(F.col("e") * F.col("rk")) / F.sum("e")).alias("expected"))


@query("prj14_finite", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS v FROM events")
def _(t):
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return t("events").select("event_id", S.finite(odd).alias("v"))


@query("prj15_signed_features", "SELECT vec_id, count(*) FILTER (f = 1) AS plus, count(*) FILTER (f = -1) AS minus, count(*) FILTER (f = 0) AS masked FROM (SELECT vec_id, CASE WHEN i >= 40 THEN 0 WHEN x > 0 THEN 1 ELSE -1 END AS f FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)) GROUP BY vec_id")
def _(t):
    f = F.when(F.col("dim") >= 40, 0).when(F.col("x") > 0, 1).otherwise(-1)
    return long_vectors(t).withColumn("f", f).groupBy("vec_id").agg(*(F.count(F.when(F.col("f") == v, 1)).alias(n) for v, n in ((1, "plus"), (-1, "minus"), (0, "masked"))))


_WS = r"regexp_extract_all(lower(text), '[a-z0-9'']+')"


@query("prj16_windows", f"SELECT doc_id, w, len(list_slice(ws, w * 64 + 1, w * 64 + 64)) AS n, ws[w * 64 + 1] AS first_word FROM (SELECT doc_id, {_WS} AS ws FROM documents), unnest(range((len(ws) + 63) // 64)) AS u(w)")
def _(t):
    d = t("documents").select("doc_id", S.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    d = d.select("doc_id", "ws", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ws") / 64).cast("int") - 1)).alias("w"))
    return d.select("doc_id", "w", F.size(S.window_of(F.col("ws"), F.col("w"), 64)).alias("n"), F.get("ws", F.col("w") * 64).alias("first_word"))


@query("prj17_prefix", f"SELECT doc_id, len(list_slice({_WS}, 1, 100)) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(F.slice(S.words(F.col("text")), 1, 100)).alias("n"))


@query("prj18_grid_edges", "SELECT e, (e % 90) // 9 AS r1, (e % 90) % 9 AS c1, CASE WHEN e < 90 THEN (e % 90) // 9 ELSE least((e % 90) // 9 + 1, 9) END AS r2, CASE WHEN e < 90 THEN (e % 90) % 9 + 1 ELSE (e % 90) % 9 END AS c2 FROM (SELECT unnest(range(180)) AS e)")
def _(t):
    e = t.spark.range(180).select(F.col("id").alias("e"), F.expr("(id % 90) div 9").alias("r1"), (F.col("id") % 90 % 9).alias("c1"))
    across = F.col("e") < 90
    return e.select("e", "r1", "c1", F.when(across, F.col("r1")).otherwise(F.least(F.col("r1") + 1, F.lit(9))).alias("r2"), F.when(across, F.col("c1") + 1).otherwise(F.col("c1")).alias("c2"))


@query("prj19_layered_code", "SELECT o_custkey, round(sum((CASE WHEN o_totalprice > 150000 THEN 1 ELSE -1 END) * pow(3, -k)), 6) AS code FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY o_custkey")
def _(t):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    sign = F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(-1.0)
    return t("orders").withColumn("k", k).groupBy("o_custkey").agg(r6(F.sum(sign * F.pow(F.lit(3.0), -F.col("k")))).alias("code"))


@query("prj20_degree_code", "SELECT node, count(*) AS degree, sum(sign)::BIGINT AS code FROM (SELECT l_partkey AS node, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sign FROM lineitem UNION ALL SELECT l_suppkey, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END FROM lineitem) GROUP BY node")
def _(t):
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("sign")
    ends = t("lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("node"), sign)
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("sign").alias("code"))


@query("prj21_depth", "SELECT user_id, max(d)::BIGINT AS deepest, min(d)::BIGINT AS least FROM (SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN -1 WHEN 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d FROM events) GROUP BY user_id")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == "purchase", -1).when(F.col("event_type") == "click", 1).otherwise(0)
    return t("events").withColumn("d", F.sum(step).over(w)).groupBy("user_id").agg(F.max("d").alias("deepest"), F.min("d").alias("least"))


@query("hsh1_md5_seed", "SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT AS seed FROM documents")
def _(t):
    return t("documents").select("doc_id", S.md5_int(F.col("doc_id").cast("string")).alias("seed"))


@query("hsh2_crc32_seed", "SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda a, i: xor(a >> 1, (a & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS seed FROM documents")
def _(t):
    return t("documents").select("doc_id", F.crc32(F.col("doc_id").cast("string")).alias("seed"))


@query("hsh3_short_id", "SELECT doc_id, left(sha1(text), 10) AS id FROM documents")
def _(t):
    return t("documents").select("doc_id", F.substring(F.sha1("text"), 1, 10).alias("id"))


@query("hsh4_set_identity", "SELECT label, sha1(string_agg(h, ',' ORDER BY b)) AS id FROM (SELECT label, vec_id // 1024 AS b, sha1(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) AS h FROM embeddings GROUP BY 1, 2) GROUP BY label")
def _(t):
    """In two levels, so that no list holds a label's ids: a digest for each 1,024 consecutive ids, then of the digests."""
    ids = F.transform(F.sort_array(F.collect_list("vec_id")), lambda x: x.cast("string"))
    blocks = t("embeddings").groupBy("label", F.expr("vec_id div 1024").alias("b")).agg(F.sha1(F.array_join(ids, ",")).alias("h"))
    digests = F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    return blocks.groupBy("label").agg(F.sha1(F.array_join(digests, ",")).alias("id"))


@query("mth1_distance_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE ceil(l_discount / 0.03 - 1e-9)::BIGINT END AS b FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0, F.lit(0)).otherwise(F.ceil(F.col("l_discount") / 0.03 - 1e-9)).alias("b"))


@query("mth2_bits", "SELECT o_orderkey, (o_orderkey >> 2) AS shifted, (o_orderkey & 1) + ((o_orderkey >> 1) & 1) + ((o_orderkey >> 2) & 1) + ((o_orderkey >> 3) & 1) AS ones FROM orders")
def _(t):
    b = S.bits(F.col("o_orderkey"), 4)
    return t("orders").select("o_orderkey", F.shiftright("o_orderkey", 2).alias("shifted"), F.aggregate(b, F.lit(0), lambda s, x: s + x).alias("ones"))


@query("mth3_pinned_entropy")
def _(t):
    """A geometric-like distribution over eight symbols whose entropy is bisected to 1.5 nats, in one expression."""
    p = lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pow(r, i))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    entropy = lambda r: F.log(total(p(r))) - total(F.transform(p(r), lambda x: x * F.log(x))) / total(p(r))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(1e-6).alias("lo"), F.lit(1.0).alias("hi")), lambda s, _: F.when(entropy((s["lo"] + s["hi"]) / 2) < 1.5, F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))))
    d = t.spark.range(1).select(found["lo"].alias("ratio"))
    return d.select(r6("ratio").alias("ratio"), r6(entropy(F.col("ratio"))).alias("entropy"))


@query("mth4_perplexity", "SELECT event_type, round(exp(avg(ln(1 + abs(value)))), 6) AS ppl FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(r6(F.exp(F.avg(F.log1p(F.abs("value"))))).alias("ppl"))


@query("mth5_digitize", "SELECT b, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 25 THEN 2 ELSE 3 END AS b FROM lineitem) GROUP BY b")
def _(t):
    q = F.col("l_quantity")
    return t("lineitem").groupBy(F.when(q < 5, 0).when(q < 10, 1).when(q < 25, 2).otherwise(3).alias("b")).agg(F.count("*").alias("n"))


@query("mth6_rebin", "SELECT lvl, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'N' THEN 0 ELSE greatest(1, ceil(l_tax * 50))::BIGINT END AS lvl FROM lineitem) GROUP BY lvl")
def _(t):
    lvl = F.when(F.col("l_returnflag") == "N", F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("l_tax") * 50)))
    return t("lineitem").groupBy(lvl.alias("lvl")).agg(F.count("*").alias("n"))
