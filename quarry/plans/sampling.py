"""SET, SMP, SPL, MIX: set operations, sampling, splits, mixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.order import row_index
from .base import query


def md5_of(*cols):
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in cols)))


@query("set1_union_fill", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def _(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set2_key_overlap", "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')) AS both_, (SELECT count(*) FROM ((SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') EXCEPT (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'))) AS only_r")
def _(t):
    l = t("lineitem")
    r, a = (l.where(F.col("l_returnflag") == x).select("l_partkey") for x in "RA")
    return r.intersect(a).agg(F.count("*").alias("both_")).join(r.distinct().join(a, "l_partkey", "left_anti").agg(F.count("*").alias("only_r")))


@query("set3_difference", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    return t("part").select("p_partkey").join(t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("set4_sorted_distinct", "SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1")
def _(t):
    return t("lineitem").select("l_suppkey").distinct().orderBy("l_suppkey")


@query("set5_subset_membership", "SELECT s AS subset, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'high' END, CASE WHEN l_tax > 0.04 THEN 'taxed' END, CASE WHEN l_quantity < 10 THEN 'few' END], lambda x: x IS NOT NULL)) AS s FROM lineitem) GROUP BY 1")
def _(t):
    sets = F.array(F.when(F.col("l_discount") > 0.05, "high"), F.when(F.col("l_tax") > 0.04, "taxed"), F.when(F.col("l_quantity") < 10, "few"))
    return t("lineitem").select(F.explode(F.filter(sets, lambda x: x.isNotNull())).alias("subset")).groupBy("subset").agg(F.count("*").alias("n"))


@query("smp1_hash_sample", "SELECT doc_id FROM documents ORDER BY md5(lang || '|' || doc_id), doc_id LIMIT 50")
def _(t):
    return t("documents").orderBy(md5_of("lang", "doc_id"), "doc_id").limit(50).select("doc_id")


@query("smp2_md5_parity", "SELECT doc_id, CASE WHEN ('0x' || right(md5(doc_id::VARCHAR), 1))::INT % 2 = 0 THEN 'cal' ELSE 'test' END AS part FROM documents")
def _(t):
    return t("documents").select("doc_id", F.when(S.md5_parity(F.col("doc_id").cast("string")) == 0, "cal").otherwise("test").alias("part"))


@query("smp3_uniform", "SELECT event_id FROM events ORDER BY md5('7|' || event_id), event_id LIMIT 100")
def _(t):
    return t("events").orderBy(F.md5(F.concat(F.lit("7|"), F.col("event_id").cast("string"))), "event_id").limit(100).select("event_id")


def hash_order(d):
    """Adds idx: the row's number within its source in the order of md5(doc_id), in ranges of the hash."""
    h = d.withColumn("_md5", md5_of("doc_id")).withColumn("_h", F.conv(F.substring("_md5", 1, 12), 16, 10).cast("double"))
    return row_index(h, "_h", "idx", ["_md5", "doc_id"], ["source"]).drop("_md5", "_h")


@query("smp4_stride", "SELECT event_id FROM events WHERE event_id % 97 = 0 OR event_id BETWEEN (SELECT count(*) // 2 FROM events) AND (SELECT count(*) // 2 FROM events) + 63")
def _(t):
    half = t("events").agg(F.expr("count(*) div 2").alias("h"))
    return t("events").join(F.broadcast(half)).where("event_id % 97 = 0 OR event_id BETWEEN h AND h + 63").select("event_id")


@query("smp5_proportional", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, (SELECT ceil(100.0 / count(DISTINCT source)) FROM documents) AS q FROM documents) WHERE rn <= q")
def _(t):
    d = t("documents").select("doc_id", "source")
    quota = d.agg(F.ceil(100 / F.count_distinct("source")).alias("q"))
    return hash_order(d).join(F.broadcast(quota)).where("idx < q").select("doc_id")


@query("spl1_stratified", "SELECT doc_id, CASE WHEN rn <= floor(0.8 * n + 0.5) THEN 'train' WHEN rn <= floor(0.9 * n + 0.5) THEN 'test' ELSE 'val' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def _(t):
    d = hash_order(t("documents").select("doc_id", "source")).withColumn("rn", F.col("idx") + 1)
    d = d.join(t("documents").groupBy("source").agg(F.count("*").alias("n")), "source")
    upto = lambda p: F.col("rn") <= F.floor(F.col("n") * p + 0.5)
    return d.select("doc_id", F.when(upto(0.8), "train").when(upto(0.9), "test").otherwise("val").alias("split"))


@query("spl2_bernoulli", "SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT < 0.85 * 4294967296 AS train FROM documents")
def _(t):
    return t("documents").select("doc_id", (S.md5_int(F.col("doc_id").cast("string")) < 0.85 * (1 << 32)).alias("train"))


@query("spl3_contiguous", "SELECT o_orderkey, CASE WHEN rn < 1000 THEN 'a' WHEN rn < 1500 THEN 'b' ELSE 'c' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)")
def _(t):
    d = row_index(t("orders").select("o_orderkey"), "o_orderkey")
    return d.select("o_orderkey", F.when(F.col("idx") < 1000, "a").when(F.col("idx") < 1500, "b").otherwise("c").alias("part"))


@query("spl4_combination_holdout", "SELECT lang, source, ('0x' || left(md5(lang || '|' || source), 8))::BIGINT % 5 = 0 AS held FROM (SELECT DISTINCT lang, source FROM documents)")
def _(t):
    return t("documents").select("lang", "source").distinct().select("lang", "source", (S.md5_int(F.concat_ws("|", "lang", "source")) % 5 == 0).alias("held"))


_MIX = "(SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'pos' WHEN l_returnflag = 'A' AND l_discount > 0.05 THEN 'hard' WHEN l_returnflag = 'A' THEN 'sibling' ELSE 'neutral' END AS role FROM lineitem)"


@query("mix1_training_mixture", f"SELECT role, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY role, CASE WHEN role = 'sibling' THEN l_suppkey END ORDER BY md5(l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) AS rn FROM {_MIX}) WHERE role IN ('pos', 'hard') OR role = 'sibling' AND rn <= 8 OR role = 'neutral' AND rn <= 1000")
def _(t):
    """All positives and hard negatives; siblings and neutrals up to a quota by hash rank."""
    f = F.col("l_returnflag")
    role = F.when(f == "R", "pos").when((f == "A") & (F.col("l_discount") > 0.05), "hard").when(f == "A", "sibling").otherwise("neutral")
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", role.alias("role"))
    order = (md5_of("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")
    keep = ["role", "l_orderkey", "l_linenumber"]
    sib = d.where("role = 'sibling'").withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order))).where("rn <= 8").select(*keep)
    neutral = d.where("role = 'neutral'").orderBy(*order).limit(1000).select(*keep)
    return d.where("role IN ('pos', 'hard')").select(*keep).unionAll(sib).unionAll(neutral)


@query("mix2_decoys", "SELECT o_orderkey, CASE WHEN rn % 2 = 0 THEN 'none' ELSE 'decoy' END AS kind, CASE WHEN rn % 2 = 1 THEN rn // 2 % 16 END AS decoy FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders)")
def _(t):
    d = t("orders").select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("rn"))
    odd = F.col("rn") % 2 == 1
    return d.select("o_orderkey", F.when(odd, "decoy").otherwise("none").alias("kind"), F.when(odd, F.expr("rn div 2 % 16")).alias("decoy"))


@query("mix3_style_cycle", "SELECT r, l, i FROM (VALUES ('plain', 3), ('formal', 2), ('terse', 1)) AS a(r, w), (VALUES ('short'), ('long')) AS b(l), range(3) AS c(i) WHERE i < w")
def _(t):
    a = t.spark.createDataFrame([("plain", 3), ("formal", 2), ("terse", 1)], "r string, w int")
    return a.select("r", F.explode(F.array(F.lit("short"), F.lit("long"))).alias("l"), "w").select("r", "l", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("i"))


@query("mix4_quota_chunks", "SELECT n_nationkey, s AS start, least(12, total - s) AS n FROM (SELECT n_nationkey, 20 + n_nationkey AS total FROM nation), unnest(range(0, total, 12)) AS u(s)")
def _(t):
    d = t("nation").select("n_nationkey", (F.col("n_nationkey") + 20).alias("total"))
    return d.select("n_nationkey", "total", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(12))).alias("start")).select("n_nationkey", "start", F.least(F.lit(12), F.col("total") - F.col("start")).alias("n"))
