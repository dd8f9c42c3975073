"""Removal of repeated overlapping windows of three consecutive lines.

Each line is hashed, and each window of three lines by two hashes of its line hashes (128 bits). A
window found more than once keeps its first occurrence (smallest doc_id, then position); every later
one covers its lines, and the covered lines of a document, merged, are cut. All of it is
built-in functions: counting is a partial aggregate, and finding the later occurrences an equi-join
with the windows that repeat, which adaptive execution can split on a hot window.

Defined results: a null text has one empty line; texts of fewer than three lines lose nothing;
windows without any word are no windows; nulls among the ids come last; rows with equal id and text
(whole copies) count as one document and get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW_LINES = 3


def _lines(text: str) -> F.Column:
    return F.split(F.col(text), "\n", -1)


def covered_lines(keyed: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text) -> (k1, k2, at array<int>): where the windows to remove start, from 0."""
    d = keyed.select("k1", "k2", "doc_id", _lines("text").alias("lines")).where(F.size("lines") >= WINDOW_LINES)
    d = d.select("k1", "k2", "doc_id", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), x.rlike(r"[^\x20\x09-\x0D]").alias("word"))).alias("l"))
    at = F.sequence(F.lit(0), F.size("l") - WINDOW_LINES)

    def window(i):
        x = [F.get("l", i + k) for k in range(WINDOW_LINES)]
        return F.struct(i.alias("at"), F.xxhash64(*(y["h"] for y in x)).alias("a"), F.xxhash64(*(y["h"] for y in x[::-1]), F.lit(1)).alias("b"), (x[0]["word"] | x[1]["word"] | x[2]["word"]).alias("word"))

    w = d.select("k1", "k2", "doc_id", F.inline(F.transform(at, window))).where("word")
    w = w.select("a", "b", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "at").alias("place"))
    repeated = w.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("a", "b", "first")
    later = w.join(repeated, ["a", "b"]).where("place <> first")
    return later.groupBy(F.col("place.k1").alias("k1"), F.col("place.k2").alias("k2")).agg(F.collect_set("place.at").alias("at"))


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """-> the documents' columns with `text` (null: empty) cut, then n_lines and n_removed long, each
    unless the documents have a column of that name, which stays as it is."""
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "doc_id")
    keyed = base.select("row", "text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id", F.length("text")).alias("k2"))
    both = keyed.join(covered_lines(keyed), ["k1", "k2"], "left").withColumn("lines", _lines("text"))
    covered = F.flatten(F.transform("at", lambda i: F.sequence(i, i + WINDOW_LINES - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    both = both.withColumn("stay", F.when(F.col("at").isNotNull(), stay))
    cut = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    n = F.size("lines").cast("long")
    out = [F.when(F.col("at").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    counts = {"n_lines": n, "n_removed": F.when(F.col("at").isNull(), F.lit(0)).otherwise(n - F.size("stay")).cast("long")}
    return both.select(*out, *(c.alias(name) for name, c in counts.items() if name not in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(common.texts(common.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS g FROM d, unnest(range(1, len(ls) - 1)) AS t(i)),
word AS (SELECT * FROM win WHERE regexp_matches(g, '[^\x20\x09-\x0D]')),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM word) WHERE rn > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range(3) AS r(j)),
pos AS (SELECT doc_id, p, ls[p] AS line FROM d, unnest(range(1, len(ls) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM pos ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
