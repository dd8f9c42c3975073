"""WIN, TOP: window-style operators, sorts, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.order import prefix_sum, row_index
from .base import query, r6
from .evaluation import _LAYERS, layers
from .text import _OPENING, opening

UNBOUNDED, HERE = Window.unboundedPreceding, Window.currentRow


def user():
    """A user's events in time."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("win1_running_offset", "SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id) - n_chars)::BIGINT AS off FROM documents")
def _(t):
    return prefix_sum(t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars", "off").select("doc_id", "off")


@query("win2_running_cap", "SELECT event_id FROM (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 2")
def _(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("event_id")


@query("win3_opening_cap", f"SELECT doc_id, row_number() OVER (PARTITION BY lang, source, {_OPENING} ORDER BY doc_id) > 1 AS capped FROM documents")
def _(t):
    w = Window.partitionBy("lang", "source", "opening").orderBy("doc_id")
    return t("documents").select("doc_id", "lang", "source", opening(F.col("text")).alias("opening")).select("doc_id", (F.row_number().over(w) > 1).alias("capped"))


@query("win4_first_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("win5_last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def greedy_spans(spans):
    """Of an array of structs (s, e), by start and falling length, those that begin at or after the last kept end."""
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (x["s"] - x["e"]).alias("m"))))
    kept = F.aggregate(order, F.struct(F.array().cast("array<struct<s:bigint,e:bigint>>").alias("k"), F.lit(-1).cast("long").alias("end")), lambda a, x: F.when(x["s"] >= a["end"], F.struct(F.array_append(a["k"], F.struct(x["s"].alias("s"), (x["s"] - x["m"]).alias("e"))).alias("k"), (x["s"] - x["m"]).alias("end"))).otherwise(a))
    return kept["k"]


@query("win6_greedy_intervals", """
WITH RECURSIVE x AS (SELECT o_custkey AS g, o_orderkey % 60 AS s, o_orderkey % 60 + 1 + o_orderkey % 9 AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 60, -(1 + o_orderkey % 9), o_orderkey) AS rn FROM orders),
f AS (SELECT g, rn, s, e, 1 AS kept, e AS last FROM x WHERE rn = 1 UNION ALL SELECT x.g, x.rn, x.s, x.e, CASE WHEN x.s >= f.last THEN 1 ELSE 0 END, CASE WHEN x.s >= f.last THEN x.e ELSE f.last END FROM f JOIN x ON x.g = f.g AND x.rn = f.rn + 1)
SELECT g, sum(kept)::BIGINT AS n, max(last) AS end_ FROM f GROUP BY g""")
def _(t):
    k = F.col("o_orderkey")
    d = t("orders").groupBy(F.col("o_custkey").alias("g")).agg(F.collect_list(F.struct((k % 60).alias("s"), (k % 60 + 1 + k % 9).alias("e"))).alias("x"))
    return d.select("g", greedy_spans("x").alias("k")).select("g", F.size("k").cast("long").alias("n"), F.array_max(F.transform("k", lambda x: x["e"])).alias("end_"))


@query("win7_islands", "SELECT user_id, min(ts) AS first_ts, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) AS grp FROM events) WHERE value > 50 GROUP BY user_id, grp")
def _(t):
    high = F.col("value") > 50
    grp = F.row_number().over(user()) - F.row_number().over(Window.partitionBy("user_id", high).orderBy("ts", "event_id"))
    return t("events").withColumn("grp", grp).where(high).groupBy("user_id", "grp").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).drop("grp")


@query("win8_buffer_mask", "SELECT event_id FROM (SELECT event_id, value, rn, max(CASE WHEN value > 80 THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) WHERE value <= 80 AND rn - last <= 3")
def _(t):
    d = t("events").withColumn("rn", F.row_number().over(user()))
    last = F.last(F.when(F.col("value") > 80, F.col("rn")), ignorenulls=True).over(user().rowsBetween(UNBOUNDED, HERE))
    return d.withColumn("last", last).where("value <= 80 AND rn - last <= 3").select("event_id")


@query("win9_top_with_gap", """
WITH RECURSIVE x AS (SELECT l_suppkey AS g, l_orderkey AS pos, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_orderkey) AS rn FROM lineitem GROUP BY 1, 2),
f AS (SELECT g, rn, [pos] AS kept FROM x WHERE rn = 1 UNION ALL SELECT x.g, x.rn, CASE WHEN len(f.kept) < 3 AND list_bool_and(list_transform(f.kept, lambda k: abs(k - x.pos) >= 500)) THEN list_append(f.kept, x.pos) ELSE f.kept END FROM f JOIN x ON x.g = f.g AND x.rn = f.rn + 1 WHERE len(f.kept) < 3)
SELECT g, array_to_string(arg_max(kept, rn), ',') AS kept FROM f GROUP BY g""")
def _(t):
    """The three best positions at least 500 apart, by falling score."""
    d = t("lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("pos")).agg(F.max("l_extendedprice").alias("v"))
    order = d.groupBy("g").agg(F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("m"), "pos"))).alias("x"))
    far = lambda a, x: (F.size(a) < 3) & F.forall(a, lambda k: F.abs(k - x["pos"]) >= 500)
    kept = F.aggregate("x", F.array().cast("array<bigint>"), lambda a, x: F.when(far(a, x), F.array_append(a, x["pos"])).otherwise(a))
    return order.select("g", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query("win10_smooth_crossing", "SELECT user_id, min(ts) AS ts FROM (SELECT user_id, ts, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)) WHERE n = 5 AND m > 50 GROUP BY 1")
def _(t):
    w = user().rowsBetween(-4, 0)
    d = t("events").select("user_id", "ts", F.avg("value").over(w).alias("m"), F.count("*").over(w).alias("n"))
    return d.where("n = 5 AND m > 50").groupBy("user_id").agg(F.min("ts").alias("ts"))


@query("win11_centred_mean", "SELECT event_id, round(m, 6) AS m FROM (SELECT event_id, event_type, avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND 300000000 FOLLOWING) AS m FROM events) WHERE event_type = 'purchase'")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-300_000_000, 300_000_000)
    return t("events").select("event_id", "event_type", F.avg("value").over(w).alias("m")).where("event_type = 'purchase'").select("event_id", r6("m").alias("m"))


@query("win12_checkpoint_loss", "WITH c AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type = 'purchase') SELECT c.event_id, round(avg(e.value), 6) AS loss FROM c JOIN events e ON e.user_id = c.user_id AND e.ts <= c.ts AND (c.prev IS NULL OR e.ts > c.prev) GROUP BY 1")
def _(t):
    """The mean since the purchase before, each purchase's own time included: the next purchase names the window of a row."""
    e = t("events")
    d = e.withColumn("stop", F.when(F.col("event_type") == "purchase", F.col("ts")))
    d = d.withColumn("end", F.min("stop").over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(HERE, Window.unboundedFollowing)))
    m = d.where("end IS NOT NULL").groupBy("user_id", "end").agg(r6(F.avg("value")).alias("loss"))
    return e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("end"), "event_id").join(m, ["user_id", "end"]).select("event_id", "loss")


@query("win13_last_positions", "SELECT user_id, round(avg(value), 6) AS m FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10 GROUP BY 1")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t("events").withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("user_id").agg(r6(F.avg("value")).alias("m"))


@query("win14_sentence_neighbours", r"SELECT doc_id, i, concat_ws(' ', s[i - 1], s[i], s[i + 1]) AS span FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)")
def _(t):
    d = t("documents").select("doc_id", F.split("text", r"\. ", -1).alias("s")).select("doc_id", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i"))
    return d.select("doc_id", "i", F.concat_ws(" ", F.when(F.col("i") > 1, F.get("s", F.col("i") - 2)), F.get("s", F.col("i") - 1), F.get("s", F.col("i"))).alias("span"))


@query("win15_context_index", "SELECT event_id, coalesce(lag(k) OVER w, 0) * 16 + coalesce(lag(k, 2) OVER w, 0) * 4 + coalesce(lag(k, 3) OVER w, 0) AS ctx FROM (SELECT *, event_id % 4 AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    d = t("events").withColumn("k", F.col("event_id") % 4)
    lag = lambda i: F.coalesce(F.lag("k", i).over(user()), F.lit(0))
    return d.select("event_id", (lag(1) * 16 + lag(2) * 4 + lag(3)).alias("ctx"))


@query("win16_leak_feature", "SELECT event_id, lead(event_id % 8) OVER (PARTITION BY user_id ORDER BY ts, event_id) >> 1 AS leak FROM events")
def _(t):
    return t("events").select("event_id", F.shiftright(F.lead(F.col("event_id") % 8).over(user()), 1).alias("leak"))


@query("win17_first_vs_rest", "SELECT first_, count(*) AS n, round(avg(value), 6) AS m, round(stddev_pop(value), 6) AS sd FROM (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS first_ FROM events) GROUP BY 1")
def _(t):
    d = t("events").select("value", (F.row_number().over(user()) <= 5).alias("first_"))
    return d.groupBy("first_").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("m"), r6(F.stddev_pop("value")).alias("sd"))


@query("win18_transitions", "WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events) SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS p FROM p WHERE a IS NOT NULL GROUP BY 1, 2")
def _(t):
    d = t("events").select(F.lag("event_type").over(user()).alias("a"), F.col("event_type").alias("b")).where("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    return d.withColumn("p", r6(F.col("n") / F.sum("n").over(Window.partitionBy("a"))))


@query("win19_pattern_edges", "SELECT user_id, a, b FROM (SELECT user_id, lag(event_id) OVER w AS a, event_type, lead(event_id) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error' AND a IS NOT NULL AND b IS NOT NULL")
def _(t):
    d = t("events").select("user_id", F.lag("event_id").over(user()).alias("a"), "event_type", F.lead("event_id").over(user()).alias("b"))
    return d.where("event_type = 'error' AND a IS NOT NULL AND b IS NOT NULL").select("user_id", "a", "b")


@query("stm5_sliding_budget", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def _(t):
    """What a user spent in the last minute, entries of age under 60 s."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-59_999_999, 0)
    return t("events").select("event_id", F.count("*").over(w).alias("n"), r6(F.sum("value").over(w)).alias("used"))


@query("stm7_plateau", "SELECT user_id, min(rn) AS at FROM (SELECT user_id, rn, max(s) OVER w - min(s) OVER w AS spread, count(*) OVER w AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS 5 PRECEDING)) WHERE n = 6 AND spread < 3 GROUP BY 1")
def _(t):
    d = t("events").select("user_id", F.row_number().over(user()).alias("rn"), F.avg("value").over(user().rowsBetween(UNBOUNDED, HERE)).alias("s"))
    w = Window.partitionBy("user_id").orderBy("rn").rowsBetween(-5, 0)
    d = d.select("user_id", "rn", (F.max("s").over(w) - F.min("s").over(w)).alias("spread"), F.count("*").over(w).alias("n"))
    return d.where("n = 6 AND spread < 3").groupBy("user_id").agg(F.min("rn").cast("long").alias("at"))


@query("top1_top_n", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def _(t):
    return t("part").where("p_retailprice IS NOT NULL").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_retailprice")


@query("top2_per_column", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 10")
def _(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t("lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("top3_best_arm", f"SELECT c, arg_max(layer, (round(v, 9), -layer)) AS layer FROM {_LAYERS} WHERE layer <> 7 GROUP BY c")
def _(t):
    v = F.when(F.col("layer") == 7, F.lit(float("nan"))).otherwise(F.round("v", 9))
    return layers(t).withColumn("v", F.nanvl(v, F.lit(None))).where("v IS NOT NULL").groupBy("c").agg(F.max_by("layer", F.struct("v", -F.col("layer"))).alias("layer"))


@query("top4_argmax_nan", f"SELECT c, arg_max(layer, (CASE WHEN layer % 2 = 0 THEN -9 ELSE round(v, 9) END, -layer)) AS layer FROM {_LAYERS} GROUP BY c")
def _(t):
    v = F.when(F.col("layer") % 2 == 0, F.lit(float("nan"))).otherwise(F.round("v", 9))
    return layers(t).groupBy("c").agg(F.max_by("layer", F.struct(F.nanvl(v, F.lit(-9.0)), -F.col("layer"))).alias("layer"))


@query("top5_layer_triples", f"WITH l AS {_LAYERS}, x AS (SELECT a.c, a.layer AS l1, b.layer AS l2, d.layer AS l3, row_number() OVER (PARTITION BY a.c ORDER BY round(a.v + b.v + d.v, 6) DESC, d.layer - a.layer DESC, a.layer, b.layer) AS rn FROM l a JOIN l b ON a.c = b.c AND a.layer < b.layer JOIN l d ON d.c = b.c AND b.layer < d.layer WHERE d.layer - a.layer >= 3) SELECT c, l1, l2, l3 FROM x WHERE rn = 1")
def _(t):
    """All triples of a concept's seven layers, within its array."""
    g = layers(t).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("layer", "v"))).alias("x"))
    tr = F.flatten(F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["layer"] > a["layer"]), lambda b: F.transform(F.filter("x", lambda d: (d["layer"] > b["layer"]) & (d["layer"] - a["layer"] >= 3)), lambda d: F.struct((-F.round(a["v"] + b["v"] + d["v"], 6)).alias("s"), (a["layer"] - d["layer"]).alias("w"), a["layer"].alias("l1"), b["layer"].alias("l2"), d["layer"].alias("l3")))))))
    return g.select("c", F.array_min(tr).alias("b")).where("b IS NOT NULL").select("c", "b.l1", "b.l2", "b.l3")


@query("top6_best_then_smallest", "SELECT l_suppkey, l_tax FROM (SELECT l_suppkey, l_tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(avg(l_discount), 9) DESC, l_tax) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def _(t):
    g = t("lineitem").groupBy("l_suppkey", "l_tax").agg(F.round(F.avg("l_discount"), 9).alias("a"))
    return g.groupBy("l_suppkey").agg(F.max_by("l_tax", F.struct("a", -F.col("l_tax"))).alias("l_tax"))


@query("top7_select_then_score", "WITH d AS (SELECT l_suppkey, arg_max(l_linenumber, (round(m, 9), l_linenumber)) AS pick FROM (SELECT l_suppkey, l_linenumber, avg(l_tax) AS m FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1, 2) GROUP BY 1) SELECT d.l_suppkey, round(avg(l_tax), 6) AS held FROM lineitem l JOIN d ON l.l_suppkey = d.l_suppkey AND l.l_linenumber = d.pick WHERE l_orderkey % 4 <> 0 GROUP BY 1")
def _(t):
    l = t("lineitem")
    dev = l.where("l_orderkey % 4 = 0").groupBy("l_suppkey", "l_linenumber").agg(F.round(F.avg("l_tax"), 9).alias("m"))
    pick = dev.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("m", "l_linenumber")).alias("l_linenumber"))
    return l.where("l_orderkey % 4 <> 0").join(pick, ["l_suppkey", "l_linenumber"]).groupBy("l_suppkey").agg(r6(F.avg("l_tax")).alias("held"))


@query("top8_best_tally", f"SELECT layer, count(*) AS n FROM (SELECT c, arg_max(layer, (round(v, 9), layer)) AS layer FROM {_LAYERS} GROUP BY c) GROUP BY 1")
def _(t):
    b = layers(t).groupBy("c").agg(F.max_by("layer", F.struct(F.round("v", 9), "layer")).alias("layer"))
    return b.groupBy("layer").agg(F.count("*").alias("n"))


@query("top9_length_batches", "SELECT lang, b, count(*) AS n, (count(*) * max(n_chars) - sum(n_chars))::BIGINT AS padding FROM (SELECT lang, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 16 AS b FROM documents) GROUP BY 1, 2")
def _(t):
    d = row_index(t("documents").select("lang", "n_chars", "doc_id"), "n_chars", "idx", ["doc_id"], ["lang"])
    return d.select("lang", "n_chars", F.floor(F.col("idx") / 16).alias("b")).groupBy("lang", "b").agg(F.count("*").alias("n"), (F.count("*") * F.max("n_chars") - F.sum("n_chars")).alias("padding"))


@query("top10_longest", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3")
def _(t):
    return t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(3).select("doc_id", "n_chars")


@query("top11_stable_batch", "SELECT doc_id FROM documents ORDER BY lang, source, n_chars, md5(text), doc_id LIMIT 64")
def _(t):
    return t("documents").orderBy("lang", "source", "n_chars", F.md5("text"), "doc_id").limit(64).select("doc_id")
