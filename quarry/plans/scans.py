"""SRC and SNK: scans, parsers and the relational part of sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import io
from .base import query


@query("src1_text_scan", "SELECT doc_id AS doc_idx, text FROM documents WHERE length(text) > 0")
def _(t):
    return io.scan_text(t("documents"), "doc_id")


@query("src2_text_scan_all", "SELECT doc_id AS doc_idx, coalesce(text, '') AS text FROM documents")
def _(t):
    return io.scan_text(t("documents"), "doc_id", keep_empty=True)


@query("src3_row_count", "SELECT count(*) AS n FROM documents")
def _(t):
    return t("documents").agg(F.count("*").alias("n"))


@query("src4_text_column", "SELECT * FROM (VALUES ('documents', 'text'), ('pages', 'url'), ('nation', 'n_name')) AS v(tab, col)")
def _(t):
    return t.spark.createDataFrame([(n, io.text_column(t(n))) for n in ("documents", "pages", "nation")], "tab string, col string")


@query("src5_shard_ranges", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id BETWEEN 20 AND 39 OR doc_id IN (45, 7)")
def _(t):
    spec = t.spark.createDataFrame([("20-39,45,7,30-31",)], "spec string").select(F.explode(io.expand_ranges(F.col("spec"))).alias("doc_id"))
    return t("documents").join(F.broadcast(spec), "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("n"))


@query("src6_lookup_scan", "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t("documents").select("doc_id", "text").join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("src7_jsonl_fields", "SELECT event_id, user_id, event_type, CASE WHEN props IS NULL OR trim(props) = '' THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def _(t):
    return t("events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("src12_first_complete_run", """
WITH runs AS (SELECT o_custkey AS run, o_orderkey AS part, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
done AS (SELECT DISTINCT o_custkey AS run FROM orders WHERE o_orderstatus = 'F')
SELECT run, part, v FROM runs WHERE rn = 1 AND run IN (SELECT run FROM done)""")
def _(t):
    o = t("orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    done = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("run")).distinct()
    first = o.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("part"), F.col("o_totalprice").alias("v"))
    return first.join(done, "run", "left_semi")


@query("src13_row_range", "SELECT vec_id, embedding[1]::DOUBLE AS x0, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 200")
def _(t):
    return t("embeddings").where("vec_id >= 100 AND vec_id < 200").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x0"), "label")


@query("src14_concat_parts", "SELECT 'part' AS tab, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer")
def _(t):
    parts = [t(n).select(F.lit(n).alias("tab")) for n in ("part", "supplier", "customer")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("tab").agg(F.count("*").alias("n"))


@query("src15_sections", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, (length(html) - length(replace(html, '<p', ''))) // 2 AS n_p FROM pages")
def _(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.expr("(length(html) - length(replace(html, '<p', ''))) div 2").alias("n_p"))


@query("src16_coordinates", r"SELECT regexp_extract(x, '^\((\d+),(\d+)\)$', 1)::INT AS r, regexp_extract(x, '^\((\d+),(\d+)\)$', 2)::INT AS c FROM (SELECT '(' || (n_nationkey % 5) || ',' || n_regionkey || ')' AS x FROM nation)")
def _(t):
    x = t("nation").select(F.format_string("(%d,%d)", F.col("n_nationkey") % 5, "n_regionkey").alias("x"))
    part = lambda i: F.regexp_extract("x", r"^\((\d+),(\d+)\)$", i).cast("int")
    return x.select(part(1).alias("r"), part(2).alias("c"))


@query("src17_tolerant_json", "SELECT event_id, value AS v FROM events")
def _(t):
    kinds = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("value").alias("v")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so: "), F.to_json(F.struct(F.col("value").alias("v"))), F.lit(" ok"))).otherwise(F.to_json(F.array(F.struct(F.col("value").alias("v")))))
    return t("events").select("event_id", io.json_object(kinds, "v double")["v"].alias("v"))


@query("src18_key_values", "SELECT o_orderkey, o_custkey AS i, o_totalprice::DOUBLE AS d, o_orderstatus AS s FROM orders")
def _(t):
    raw = F.concat(F.lit("a="), F.col("o_custkey").cast("string"), F.lit(";b="), F.col("o_totalprice").cast("double").cast("string"), F.lit(";c="), F.col("o_orderstatus"))
    m = t("orders").select("o_orderkey", io.key_values(raw).alias("m"))
    value = lambda k: io.coerced(F.element_at("m", k))
    return m.select("o_orderkey", value("a")["i"].alias("i"), F.coalesce(value("b")["d"], value("b")["i"].cast("double")).alias("d"), value("c")["s"].alias("s"))


@query("snk2_open_shards", """
WITH m AS (SELECT user_id % 50 AS shard, count(*) AS tokens, count(value) AS rows, count(CASE WHEN event_type <> 'purchase' OR user_id % 50 > 5 THEN 1 END) AS docs_n FROM events GROUP BY 1)
SELECT shard FROM (SELECT unnest(range(60)) AS shard) WHERE shard NOT IN (SELECT shard FROM m WHERE tokens = rows AND rows = docs_n)""")
def _(t):
    kept = (F.col("event_type") != "purchase") | (F.col("user_id") % 50 > 5)
    m = t("events").groupBy((F.col("user_id") % 50).alias("shard")).agg(F.count("*").alias("tokens"), F.count("value").alias("rows"), F.count(F.when(kept, 1)).alias("docs_n"))
    return io.open_shards(t.spark.range(60).select(F.col("id").alias("shard")), m)


@query("snk3_split_manifest", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def _(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("snk4_routing", "SELECT doc_id // 25 AS repo, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy(F.expr("doc_id div 25").alias("repo")).agg(F.count("*").alias("n"))


@query("snk5_checksums", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("snk6_contiguous_chunks", "SELECT s_suppkey, ntile(7) OVER (ORDER BY s_suppkey) AS chunk FROM supplier")
def _(t):
    from ..operators.order import row_index

    d = row_index(t("supplier").select("s_suppkey"), "s_suppkey").join(F.broadcast(t("supplier").agg(F.count("*").alias("n"))), F.lit(True))
    size, larger = F.expr("n div 7"), F.col("n") % 7
    first = larger * (size + 1)
    return d.select("s_suppkey", F.when(F.col("idx") < first, F.floor(F.col("idx") / (size + 1))).otherwise(larger + F.floor((F.col("idx") - first) / F.greatest(size, F.lit(1)))).cast("long").alias("i")).select("s_suppkey", (F.col("i") + 1).alias("chunk"))


@query("snk7_idempotent_merge", "SELECT c_custkey, c_name FROM customer")
def _(t):
    c = t("customer").select("c_custkey", "c_name")
    return io.merge_new(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0"), ["c_custkey"])
