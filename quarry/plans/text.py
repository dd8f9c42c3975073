"""FLT, STR, DED: text predicates, parsing, deduplication; and the corpus audit."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import dedup
from .base import query, r6

_KEY = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_ALPHA = "length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) / greatest(length(text), 1)"
_WS = r"regexp_extract_all(lower(text), '[a-z0-9'']+')"
_FLAG = f"CASE WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 9000 THEN 'too_long' WHEN {_ALPHA} < 0.8 THEN 'degenerate' WHEN regexp_matches(text, '[#*$%]{{3}}') THEN 'symbols' END"


def flag(text):
    """The first rule that a text breaks, else null."""
    n = F.length(text)
    return F.when(n < 200, "too_short").when(n > 9000, "too_long").when(S.share_of(text, "a-zA-Z ") < 0.8, "degenerate").when(text.rlike("[#*$%]{3}"), "symbols")


@query("corpus_audit", f"""
WITH d AS (SELECT source, {_FLAG} AS flag, row_number() OVER (PARTITION BY md5({_KEY}) ORDER BY doc_id) AS rn FROM documents)
SELECT source, CASE WHEN rn > 1 THEN 'duplicate' ELSE coalesce(flag, 'ok') END AS verdict, count(*) AS n FROM d GROUP BY 1, 2""")
def corpus_audit(t):
    """Quality flags and exact duplicates of the corpus by source. The first of each text is found by a
    partial aggregate over its key, so a text that a third of the rows share is no hot task."""
    d = t("documents").select("doc_id", "source", F.md5(S.normal_key(F.col("text"))).alias("k"), flag(F.col("text")).alias("flag"))
    first = d.groupBy("k").agg(F.min("doc_id").alias("first"))
    verdict = F.when(F.col("doc_id") != F.col("first"), "duplicate").otherwise(F.coalesce("flag", F.lit("ok")))
    return d.join(first, "k").groupBy("source", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("flt1_min_length", f"SELECT doc_id FROM documents WHERE len({_WS}) >= 64")
def _(t):
    return t("documents").where(F.size(S.words(F.col("text"))) >= 64).select("doc_id")


@query("flt2_flag_chain", f"SELECT doc_id, {_FLAG} AS flag FROM documents")
def _(t):
    return t("documents").select("doc_id", flag(F.col("text")).alias("flag"))


@F.pandas_udf(T.DoubleType())
def zlib_ratio(s):
    """Compressed over raw size; 1 for an empty text."""
    return s.map(lambda x: len(zlib.compress(x.encode())) / max(1, len(x.encode())) if x else 1.0)


@query("flt3_degenerate")
def _(t):
    text = F.col("text")
    packed = (F.length(text) >= 60) & (zlib_ratio(F.coalesce(text, F.lit(""))) < 0.35)
    return t("documents").select("doc_id", (packed | (S.share_of(text, "a-zA-Z ") < 0.55) | text.rlike(r"\s{5,}") | text.rlike(r"(\.\.\..*){3}") | text.rlike(r"(.)\1{7,}")).alias("degenerate"))


@query("flt4_english_ratio", f"SELECT doc_id, round({_ALPHA}, 6) AS ratio FROM documents WHERE {_ALPHA} >= 0.6")
def _(t):
    r = S.share_of(F.col("text"), "a-zA-Z ")
    return t("documents").where(r >= 0.6).select("doc_id", r6(r).alias("ratio"))


@query("flt5_missing_polarity", "SELECT count(*) FILTER (event_id % 4 > 1 AND value >= 50) AS ge, count(*) FILTER (event_id % 4 > 1 AND value <= 50) AS le, count(*) FILTER (event_id % 4 <= 1 OR value >= 50) AS chk FROM events")
def _(t):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 > 1, F.col("value"))
    one = lambda c: F.count(F.when(c, 1))
    return t("events").select(x.alias("x")).agg(one(S.at_least(F.col("x"), 50)).alias("ge"), one(S.at_most(F.col("x"), 50)).alias("le"), one(S.check_at_least(F.col("x"), 50)).alias("chk"))


@query("flt6_whole_word", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_])licen[sc]e([^a-zA-Z0-9_]|$)')")
def _(t):
    return t("documents").where(F.col("text").rlike(r"(?i)(?<!\w)licen[sc]e(?!\w)")).select("doc_id")


@query("flt7_lexical_holdout", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND NOT contains(lower(text), 'mit ') AND NOT contains(lower(text), 'gnu ')")
def _(t):
    forms = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(F.lower("text"), x))
    return t("documents").where(forms(["license"]) & ~forms(["mit ", "gnu "])).select("doc_id")


@query("flt8_complete_shards", "SELECT o_custkey AS shard, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = count(CASE WHEN o_totalprice > 20000 THEN 1 END)")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "shard")
    a, b = o.groupBy("shard").agg(F.count("*").alias("n")), o.where("o_totalprice > 20000").groupBy("shard").agg(F.count("*").alias("m"))
    return a.join(b, "shard").where("n = m").select("shard", "n")


@query("flt9_forbidden", f"SELECT doc_id FROM documents WHERE md5({_KEY}) NOT IN (SELECT md5({_KEY}) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def _(t):
    d = t("documents").select("doc_id", F.md5(S.normal_key(F.col("text"))).alias("k"))
    bad = d.join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("k")
    return d.join(bad, "k", "left_anti").select("doc_id")


@query("flt10_region_masks", "SELECT region, count(*) AS n, round(sum(l_quantity), 2) AS q FROM (SELECT CASE WHEN l_linenumber BETWEEN 1 AND 2 THEN 'head' WHEN l_linenumber BETWEEN 3 AND 5 THEN 'body' ELSE 'tail' END AS region, l_quantity FROM lineitem) GROUP BY region")
def _(t):
    i = F.col("l_linenumber")
    return t("lineitem").groupBy(F.when(i.between(1, 2), "head").when(i.between(3, 5), "body").otherwise("tail").alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("flt11_strength_select", "SELECT o_orderkey, CASE WHEN max(l_discount) >= 0.09 THEN 'pos' ELSE 'neu' END AS role FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING max(l_discount) >= 0.09 OR max(l_discount) <= 0.05")
def _(t):
    spans = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("s"))
    d = t("orders").join(spans, F.col("o_orderkey") == F.col("l_orderkey"))
    pos, neu = F.array_max("s") >= 0.09, F.forall("s", lambda x: x <= 0.05)
    return d.where(pos | neu).select("o_orderkey", F.when(pos, "pos").otherwise("neu").alias("role"))


@query("flt12_filter_with_fallback", "WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') >= 5 AS enough FROM events GROUP BY user_id) SELECT event_id FROM events JOIN f USING (user_id) WHERE NOT enough OR event_type = 'purchase'")
def _(t):
    e = t("events")
    f = e.groupBy("user_id").agg((F.count(F.when(F.col("event_type") == "purchase", 1)) >= 5).alias("enough"))
    return e.join(f, "user_id").where(~F.col("enough") | (F.col("event_type") == "purchase")).select("event_id")


@query("flt13_source_fallback", "WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN a >= 150 THEN 'R' WHEN b >= 150 THEN 'A' ELSE 'thin' END AS origin FROM c")
def _(t):
    n = lambda v: F.count(F.when(F.col("l_returnflag") == v, 1))
    return t("lineitem").groupBy("l_suppkey").agg(F.when(n("R") >= 150, "R").when(n("A") >= 150, "A").otherwise("thin").alias("origin"))


@query("str1_offset_clamp", "SELECT l_orderkey, l_linenumber, least(a, b) AS s, greatest(a, b) AS e FROM (SELECT l_orderkey, l_linenumber, greatest(0, least(20, l_quantity - 10)) AS a, greatest(0, least(20, 25 - l_quantity)) AS b FROM lineitem)")
def _(t):
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(20.0), x))
    d = t("lineitem").select("l_orderkey", "l_linenumber", clamp(F.col("l_quantity") - 10).alias("a"), clamp(25 - F.col("l_quantity")).alias("b"))
    return d.select("l_orderkey", "l_linenumber", F.least("a", "b").alias("s"), F.greatest("a", "b").alias("e"))


@query("str2_locate", "SELECT doc_id, coalesce(nullif(instr(text, 'The'), 0), nullif(instr(lower(text), 'the'), 0)) - 1 AS pos FROM documents")
def _(t):
    return t("documents").select("doc_id", S.locate(F.col("text"), F.lit("The")).alias("pos"))


@query("str3_sentences", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]\s+'), lambda x: x <> '')) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: ~x.rlike(r"^[.!?]*$"))).alias("n"))


@query("str4_surface_forms", r"SELECT doc_id, len(regexp_extract_all(lower(text), 'gnu[- \t\n]+general[- \t\n]+public[- \t\n]+license|mit[- \t\n]+license')) AS n FROM documents")
def _(t):
    forms = sorted(["mit license", "gnu general public license"], key=len, reverse=True)
    pattern = "|".join(f.replace(" ", r"[- \t\n]+") for f in forms)
    return t("documents").select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("n"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def positions(s):
    """Where 'the' stands as a word, in code points."""
    import re

    find = re.compile(r"\bthe\b").finditer
    return s.map(lambda x: [m.start() for m in find(x or "")])


@query("str5_match_positions")
def _(t):
    return t("documents").select("doc_id", positions(F.col("text")).alias("at"))


@query("str6_template", "SELECT c_custkey, replace(replace('Dear {name} of {segment}', '{name}', c_name), '{segment}', c_mktsegment) AS letter FROM customer")
def _(t):
    out = F.lit("Dear {name} of {segment}")
    for k, c in (("{name}", "c_name"), ("{segment}", "c_mktsegment")):
        out = F.replace(out, F.lit(k), F.col(c))
    return t("customer").select("c_custkey", out.alias("letter"))


@query("str7_choice_block", "SELECT n_regionkey, string_agg(chr(65 + i::INT) || '. ' || n_name, chr(10) ORDER BY i) AS block FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY n_regionkey")
def _(t):
    names = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    lines = F.transform("c", lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    return t("nation").groupBy("n_regionkey").agg(names.alias("c")).select("n_regionkey", F.array_join(lines, "\n").alias("block"))


@query("str8_answer_parse", r"SELECT conv_id, turn, regexp_extract(text, '[ABCD]', 0) AS letter, regexp_extract(text, '[0-9]+', 0) AS digits, starts_with(text, 'The') AS the FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", F.regexp_extract("text", "[ABCD]", 0).alias("letter"), F.regexp_extract("text", "[0-9]+", 0).alias("digits"), F.startswith("text", F.lit("The")).alias("the"))


@query("str9_display_name", "SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS shown FROM part")
def _(t):
    c = F.col("p_name")
    return t("part").select("p_partkey", F.when(F.substring(c, 1, 1) == F.lower(F.substring(c, 1, 1)), F.concat(F.upper(F.substring(c, 1, 1)), F.expr("substr(p_name, 2)"))).otherwise(c).alias("shown"))


_OPENING = r"array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z'']+'), 1, 4), ' ')"


def opening(text):
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)), 1, 4), " ")


@query("str10_opening_key", f"SELECT doc_id, {_OPENING} AS opening FROM documents")
def _(t):
    return t("documents").select("doc_id", opening(F.col("text")).alias("opening"))


@query("str11_markdown_rows", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def _(t):
    return t("region").select(F.format_string("| %d | %s |", "r_regionkey", "r_name").alias("line"))


@query("str12_condition", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS mode, coalesce(nullif(split_part(o_orderpriority, '-', 2), ''), 'plain') AS variant FROM orders")
def _(t):
    p = F.split("o_orderpriority", "-", 2)
    return t("orders").select("o_orderkey", F.get(p, F.lit(0)).alias("mode"), F.coalesce(F.nullif(F.get(p, F.lit(1)), F.lit("")), F.lit("plain")).alias("variant"))


@query("str13_bank_normalise", "SELECT p_partkey, ' ' || ltrim(split_part(coalesce(p_name, p_type), ' ', 1)) AS v FROM part")
def _(t):
    return t("part").select("p_partkey", F.concat(F.lit(" "), F.ltrim(F.substring_index(F.coalesce("p_name", "p_type"), " ", 1))).alias("v"))


@query("ded1_exact", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5({_KEY}) ORDER BY doc_id) AS rn FROM documents WHERE ({_FLAG}) IS NULL) WHERE rn = 1")
def _(t):
    """Only rows without a flag claim a text."""
    d = t("documents").where(flag(F.col("text")).isNull()).select("doc_id", F.md5(S.normal_key(F.col("text"))).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_SHINGLES = f"(SELECT doc_id, CASE WHEN len(ws) > 8 THEN list_distinct(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(list_slice(ws, i, i + 7), ' '))) ELSE [array_to_string(ws, ' ')] END AS s FROM (SELECT doc_id, {_WS} AS ws FROM documents))"


@query("ded2_shingles", f"SELECT doc_id, len(s) AS n FROM {_SHINGLES}")
def _(t):
    return t("documents").select("doc_id", F.size(S.shingles(F.col("text"))).alias("n"))


_PAIRS = f"""
e AS (SELECT min(doc_id) AS id, s FROM (SELECT doc_id, list_sort(s) AS s FROM {_SHINGLES}) GROUP BY s),
x AS (SELECT id, len(s) AS n, unnest(s) AS g FROM e),
p AS (SELECT a.id AS a, b.id AS b, count(*) / (min(a.n) + min(b.n) - count(*)) AS j FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2 HAVING count(*) / (min(a.n) + min(b.n) - count(*)) >= 0.6)"""


@query("ded3_near_pairs", f"WITH {_PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM p")
def _(t):
    return dedup.shingle_pairs(t("documents"), "doc_id", "text").select("a", "b", r6("jaccard").alias("jaccard"))


@query("ded4_greedy_near")
def _(t):
    """Ids of texts dropped because an earlier kept text is alike (exact set copies first)."""
    return dedup.greedy_dropped(t("documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


@query("ded5_duplicate_audit", "SELECT text, n, n_rows = 1 AS same FROM (SELECT text, count(*) AS n, count(DISTINCT lang || '|' || n_chars) AS n_rows FROM documents GROUP BY text) WHERE n > 1")
def _(t):
    d = t("documents").groupBy("text").agg(F.count("*").alias("n"), F.count_distinct(F.to_json(F.struct("lang", "n_chars"))).alias("r")).where("n > 1")
    return d.select("text", "n", (F.col("r") == 1).alias("same"))


@query("ded6_first_run", "SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def _(t):
    e = t("events").where("event_type = 'purchase'").select("user_id", F.struct("ts", "event_id").alias("o"))
    return e.groupBy("user_id").agg(F.min("o").alias("o")).select("user_id", "o.ts", "o.event_id")
