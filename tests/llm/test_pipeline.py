from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quarry.llm import common, packing, rules

from .test_dedup import plain_lines, plain_removal, words
from .test_near import plain_kept


def test_each_stage_against_brute_force(spark, docs, tmp_path):
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(i)))
        out.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == docs.columns for d in out[1:5])
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in out[:5]]
    kept = {r["doc_id"] for r in rules.judge(rules.statistics(common.texts(docs))).where("kept").collect()}
    assert Counter(rows[1]) == Counter(r for r in rows[0] if r[0] in kept)
    digest = lambda d: d.select("doc_id", F.sha2("text", 256)).collect()
    lines = {(i, h) for i, n, gone, h in plain_lines(rows[1]) if gone < n}
    assert set(map(tuple, digest(out[2]))) <= lines and len(rows[2]) >= len(lines) - sum(not words(t) for _, t in rows[1]) - 5
    assert sorted(i for i, _ in rows[3]) == plain_kept(rows[2])
    gone = {i: (n, k) for i, n, k, _ in plain_removal(rows[3], 35)}
    assert {i: len(words(t)) for i, t in rows[4]} == {i: n - k for i, (n, k) in gone.items() if n > k}
    packed = Counter()
    for r in out[5].collect():
        packed[r["doc_id"]] += r["n_words"]
    assert packed == {i: len(words(t)) for i, t in rows[4]} and max(Counter({r["bin_id"]: 0 for r in out[5].collect()}).values()) <= packing.BIN_WORDS
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, out[5].collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, "").collect()
