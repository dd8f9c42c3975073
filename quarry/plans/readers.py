"""SRC, SNK, STM: queries that write a small export of a table in a foreign format and read it back.

The export goes to a folder of its own beside the checkpoints, which driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup
from ..operators.dedup import checkpointed
from ..sources import io
from .base import query, r6
from .text import _PAIRS, _SHINGLES


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    checkpointed(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"


def lines(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


@query("src7_jsonl_reader", "SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def _(t):
    """JSON lines with a blank and a broken line after each record, which are no rows."""
    folder = scratch(t.spark)
    records = lines(t("supplier"), "s_suppkey", "s_nationkey", "s_acctbal")
    records.select(F.concat("value", F.lit('\n\n{"s_suppkey": ')).alias("value")).write.text(folder)
    return io.read_jsonl(t.spark, folder, "s_suppkey long, s_nationkey int, s_acctbal double").select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("src8_jsonl_roots", "SELECT c_custkey, arg_min(root, p) AS root FROM (SELECT c_custkey, 'a' AS root, 0 AS p FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'b', 1 FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def _(t):
    """Two roots, one left out by name; of a key in both the first root's row counts."""
    folder, c = scratch(t.spark), t("customer").select("c_custkey")
    for name, part in (("a", c.where("c_custkey % 3 <> 0")), ("b", c.where("c_custkey % 2 = 0")), ("b/old-skip", c)):
        lines(part, "c_custkey").write.text(f"{folder}/{name}/run")
    return io.read_roots(t.spark, [f"{folder}/a", f"{folder}/b"], "c_custkey long", ["c_custkey"], exclude="skip").withColumn("root", F.substring("root", -1, 1))


@query("src9_gzip_jsonl", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def _(t):
    """Gzip batches of JSON lines; a file is one task, as gzip cannot be cut."""
    folder = scratch(t.spark)
    lines(t("lineitem"), "l_returnflag", "l_quantity").write.option("compression", "gzip").text(folder)
    d = io.read_jsonl(t.spark, folder, "l_returnflag string, l_quantity double")
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("src10_object_files", "SELECT n_nationkey AS k, n_regionkey AS ref_region, n_name AS ref_name FROM nation")
def _(t):
    """A folder of files with one indented object each, whose nested object becomes prefixed columns."""
    folder = scratch(t.spark)
    obj = F.format_string('{\n "k": %d,\n "ref": {\n  "region": %d, "name": "%s"}\n}', "n_nationkey", "n_regionkey", "n_name")
    t("nation").select(obj.alias("value"), F.col("n_nationkey").alias("part")).write.partitionBy("part").option("lineSep", "\n").text(folder)
    d = io.read_objects(t.spark, folder, "k long, ref struct<region: int, name: string>", "ref")
    return d.select("k", "ref_region", "ref_name")


@query("src11_gzip_csv", "SELECT p_partkey, p_type, round(p_retailprice, 2) AS p_retailprice FROM part")
def _(t):
    folder = scratch(t.spark)
    t("part").select("p_partkey", "p_type", "p_retailprice").write.option("header", True).option("compression", "gzip").csv(folder)
    return io.read_csv(t.spark, folder, "p_partkey long, p_type string, p_retailprice double").withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("src15_named_sections", "SELECT doc_id, 'HEAD' AS section, lang AS body FROM documents UNION ALL SELECT doc_id, 'BODY', trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) FROM documents")
def _(t):
    """Sections of a text that lines ---NAME--- begin, trimmed; what stands before the first is no section."""
    body = F.trim(F.regexp_replace("text", "[^A-Za-z ]", ""))
    d = t("documents").select("doc_id", F.concat(F.lit("preamble\n---HEAD---\n"), "lang", F.lit("\n\n---BODY---\n  "), body, F.lit(" \n")).alias("doc"))
    return d.select("doc_id", F.inline(io.sections(F.col("doc"))))


@query("snk1_atomic_write", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    """Written beside its place and renamed; a second writer leaves one whole output, not a mixture."""
    folder = scratch(t.spark)
    d = t("nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    io.write_atomic(d.withColumn("n", F.col("n") + 1), f"{folder}/out")
    io.write_atomic(d, f"{folder}/out")
    return t.spark.read.parquet(f"{folder}/out")


@query("snk3_written_by_split", "SELECT lang, doc_id % 10 = 0 AS held, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def _(t):
    """Written by language and split in one job, then read back by folder."""
    folder = scratch(t.spark)
    io.write_split(t("documents").select("doc_id", "lang", "n_chars", (F.col("doc_id") % 10 == 0).alias("held")), folder, ["lang", "held"])
    return t.spark.read.parquet(folder).groupBy("lang", F.col("held").cast("boolean").alias("held")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("joi8_prefix_map", "WITH d AS (SELECT doc_id, n_chars::INT AS n FROM documents), s AS (SELECT doc_id, i, least(n, (i + 1) * 7) AS e, i * 7 AS b, n FROM d, unnest(range(0, 12)) AS u(i)), g AS (SELECT doc_id, j, least(n, (j + 1) * 5) AS e, least(n, j * 5) AS b FROM d, unnest(range(0, 16)) AS u(j)) SELECT s.doc_id, i, CASE WHEN s.e > least(s.n, s.b) THEN coalesce(max(j) FILTER (g.e > g.b AND g.e <= s.e), -1) ELSE -1 END AS last_ FROM s JOIN g USING (doc_id) GROUP BY s.doc_id, i, s.e, s.b, s.n")
def _(t):
    """For each of twelve spans of 7 characters the last of sixteen spans of 5 that ends no later; -1 for an empty span or where there is none."""
    from ..operators.asof import prefix_map

    n = F.col("n_chars").cast("int")
    spans = lambda k, w: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.least(n, i * w).alias("s"), F.least(n, (i + 1) * w).alias("e")))
    d = t("documents").select("doc_id", spans(12, 7).alias("src"), spans(16, 5).alias("tgt"))
    return d.select("doc_id", F.posexplode(prefix_map(F.col("src"), F.col("tgt"))).alias("i", "last_"))


@query("joi12_shared_shingles", f"WITH {_PAIRS}, c AS (SELECT doc_id, e.id AS class_id FROM (SELECT doc_id, list_sort(s) AS s FROM {_SHINGLES}) d JOIN e USING (s)), l AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1) SELECT doc_id, class_id, coalesce(n, 0) AS links FROM c LEFT JOIN l ON l.id = c.class_id")
def _(t):
    """For each text the smallest id with an equal shingle set (its class), and how many other classes have a likeness of 0.6."""
    d = t("documents")
    keys = dedup.shingle_keys(d, "doc_id", "text")
    p = dedup.shingle_pairs(d, "doc_id", "text", keys=keys)
    links = p.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("n"))
    classes = dedup.shingle_classes(d, "doc_id", "text", keys=keys)
    return classes.join(links, "first", "left").select(F.col("id").alias("doc_id"), F.col("first").alias("class_id"), F.coalesce("n", F.lit(0)).alias("links"))


@query("prj18_free_edges", "SELECT o_orderkey, array_to_string(list_filter(range(0, 24), lambda e: CASE WHEN e < 12 THEN e // 3 <> o_orderkey % 4 ELSE (e - 12) % 4 <> o_orderkey % 4 END), ',') AS free FROM orders")
def _(t):
    """Of the 24 edges of a 4 x 4 grid those that touch no cell of the order's blocked row (across) or column (down)."""
    k = F.col("o_orderkey") % 4
    free = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda e: F.when(e < 12, F.floor(e / 3) != k).otherwise((e - 12) % 4 != k))
    return t("orders").select("o_orderkey", F.array_join(F.transform(free, lambda e: e.cast("string")), ",").alias("free"))


@query("prj19_rotated_code", "SELECT o_custkey, side, round(sum((CASE WHEN o_totalprice > 150000 THEN 1 ELSE -1 END) * pow(3, -((k + side) % 4))), 6) AS code FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 4 AS k FROM orders), range(4) AS s(side) GROUP BY 1, 2")
def _(t):
    """The layered code seen from each of four sides: a side rotates the order of the layers."""
    from pyspark.sql import Window

    k = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) % 4
    sign = F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(-1.0)
    d = t("orders").select("o_custkey", k.alias("k"), sign.alias("sign")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("side"))
    return d.groupBy("o_custkey", F.col("side").cast("long").alias("side")).agg(r6(F.sum(F.col("sign") * F.pow(F.lit(3.0), -((F.col("k") + F.col("side")) % 4)))).alias("code"))


@query("prj20_axis_decode", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS edge FROM lineitem")
def _(t):
    """Encode and exact decode: along an order's lines (a path of edges) each node's code is the sum of its two edges;
    the alternating running sum of the codes gives the edges back."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    e = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("e"), F.row_number().over(w).alias("i"))
    code = F.col("e") + F.coalesce(F.lag("e").over(w), F.lit(0))  # of the node before the edge
    coded = e.select("l_orderkey", "l_linenumber", "i", code.alias("code"))
    sign = F.when(F.col("i") % 2 == 0, 1).otherwise(-1)
    running = F.sum(sign * F.col("code")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return coded.select("l_orderkey", "l_linenumber", (sign * running).cast("int").alias("edge"))


@query("map1_target_maps", "SELECT l_orderkey, max(q) FILTER (l_returnflag = 'A') AS a, max(q) FILTER (l_returnflag = 'N') AS n, max(q) FILTER (l_returnflag = 'R') AS r, count(*) AS classes FROM (SELECT l_orderkey, l_returnflag, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t):
    """A map class -> target for each item, read by its keys."""
    q = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    m = q.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("l_orderkey", at("A").alias("a"), at("N").alias("n"), at("R").alias("r"), F.size("m").cast("long").alias("classes"))


@query("win2_two_caps", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS m FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 2) WHERE m <= 120")
def _(t):
    """At most two a user and type, and of these the first 120 a type (a partial top list, no window over a type)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    d = t("events").select("event_id", "event_type", F.row_number().over(w).alias("rn")).where("rn <= 2")
    types = [r[0] for r in d.select("event_type").distinct().limit(1001).collect()]
    if len(types) > 1000:
        raise ValueError("more than 1,000 types")
    tops = [d.where(F.col("event_type").eqNullSafe(x)).orderBy("event_id").limit(120) for x in types]
    out = d.limit(0)
    for top in tops:
        out = out.unionAll(top)
    return out.select("event_id")


@query("top9_padding_budget", "WITH RECURSIVE d AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS i FROM documents), r AS (SELECT lang, i, n_chars, 1 AS size, 1 AS batch FROM d WHERE i = 1 UNION ALL SELECT d.lang, d.i, d.n_chars, CASE WHEN (r.size + 1) * d.n_chars <= 16000 THEN r.size + 1 ELSE 1 END, CASE WHEN (r.size + 1) * d.n_chars <= 16000 THEN r.batch ELSE r.batch + 1 END FROM r JOIN d ON d.lang = r.lang AND d.i = r.i + 1) SELECT lang, max(batch)::BIGINT AS batches, count(*) AS n FROM r GROUP BY 1")
def _(t):
    """Greedy batches of all texts in the order of length, each of at most 16,000 characters once padded to its longest (or
    of one text). The fold is sequential, but goes over a language's distinct lengths with their counts, not its
    texts: texts of one length fill the open batch and then whole ones."""
    n = t("documents").groupBy("lang", F.coalesce("n_chars", F.lit(0)).cast("long").alias("len")).agg(F.count("*").alias("n"))
    a = n.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("len", "n"))).alias("a"), F.sum("n").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("batches"))

    def step(s, x):
        room = F.when(x["len"] == 0, F.lit(1 << 60)).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(F.lit(16000) / x["len"])))
        filled = F.when(s["batches"] == 0, F.lit(0).cast("long")).otherwise(F.least(x["n"], F.greatest(room - s["size"], F.lit(0).cast("long"))))
        rest = x["n"] - filled
        new = F.ceil(rest / room)
        size = F.when(rest == 0, s["size"] + filled).otherwise(rest - (new - 1) * room)
        return F.struct(size.cast("long").alias("size"), (s["batches"] + new).cast("long").alias("batches"))

    return a.select("lang", F.aggregate("a", start, step, lambda s: s["batches"]).alias("batches"), "n")


@query("spl4_label_coverage", "WITH c AS (SELECT DISTINCT l_returnflag || l_linestatus AS a, l_linenumber::VARCHAR AS b, l_returnflag || l_linestatus || l_linenumber AS k FROM lineitem), t AS (SELECT s, a, b, ('0x' || left(md5(k || '|' || s), 8))::BIGINT % 4 = 0 AS held FROM c, range(20) AS r(s)), ok AS (SELECT min(s) AS s FROM (SELECT s, count(DISTINCT a) FILTER (NOT held) = (SELECT count(DISTINCT a) FROM c) AND count(DISTINCT b) FILTER (NOT held) = (SELECT count(DISTINCT b) FROM c) AND bool_or(held) AS good FROM t GROUP BY 1) WHERE good) SELECT a, b, held, s::BIGINT AS seed FROM t JOIN ok USING (s)")
def _(t):
    """A fourth of the combinations is held out by hash; the first of twenty seeds counts under which every label of
    either side still occurs among the rest."""
    l = t("lineitem")
    c = l.select(F.concat("l_returnflag", "l_linestatus").alias("a"), F.col("l_linenumber").cast("string").alias("b")).distinct()
    s = c.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("held", F.conv(F.substring(F.md5(F.concat("a", "b", F.lit("|"), F.col("seed").cast("string"))), 1, 8), 16, 10).cast("long") % 4 == 0)
    rest = lambda x: F.count_distinct(F.when(~F.col("held"), F.col(x)))
    whole = c.agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    good = s.groupBy("seed").agg(rest("a").alias("x"), rest("b").alias("y"), F.bool_or("held").alias("some")).join(F.broadcast(whole)).where("x = na AND y = nb AND some").agg(F.min("seed").alias("seed"))
    return s.join(F.broadcast(good), "seed").select("a", "b", "held", F.col("seed").cast("long").alias("seed"))


@query("mix1_sibling_quota", "WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_discount <= 0.05), q AS (SELECT greatest(1, 800 // count(DISTINCT l_suppkey)) AS q FROM s) SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM s), q WHERE rn <= q")
def _(t):
    """Of each sibling (supplier) an equal part of 800, one at least."""
    from pyspark.sql import Window

    s = t("lineitem").where("l_returnflag = 'A' AND l_discount <= 0.05").select("l_orderkey", "l_linenumber", "l_suppkey")
    q = s.agg(F.greatest(F.lit(1), F.expr("800 div count(DISTINCT l_suppkey)")).alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    return s.withColumn("rn", F.row_number().over(w)).join(F.broadcast(q)).where("rn <= q").select("l_orderkey", "l_linenumber")


@query("stm2_complete_documents", "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1 HAVING count(*) = max(l_linenumber)")
def _(t):
    """Documents (orders) all of whose windows (lines 1 to the largest number) are there; the stream's form is
    streaming.complete_documents."""
    g = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("of"), F.sum("l_quantity").alias("s"))
    return g.where("n = of").select("l_orderkey", "n", F.round("s", 2).alias("total"))


@query("stm6_ready_shards", "SELECT shard FROM (SELECT user_id % 40 AS shard, count(DISTINCT event_type) AS n FROM events WHERE user_id % 7 > 1 OR event_type <> 'view' GROUP BY 1) WHERE n = (SELECT count(DISTINCT event_type) FROM events)")
def _(t):
    """Shards that have every part (event type)."""
    from ..streaming import ready_shards

    e = t("events")
    kinds = e.agg(F.count_distinct("event_type").alias("of"))
    parts = e.where("user_id % 7 > 1 OR event_type <> 'view'").select((F.col("user_id") % 40).alias("shard"), "event_type").distinct()
    return ready_shards(parts.join(F.broadcast(kinds)), "shard", "event_type", "of")
