import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zlib

from quarry.llm import common, fingerprints, licenses, packing, quality_fm, rules, sampling, sentencepiece_codec, textkit, toxicity

from .test_dedup import words


def plain_chunks(data):
    out, at = [], 0
    gear = [int(x) for x in fingerprints.GEAR]
    while at < len(data):
        h, end = 0, len(data)
        for i in range(at, min(len(data), at + fingerprints.MOST)):
            h = (h << 1) + gear[data[i]] & 0xFFFFFFFF
            size = i - at + 1
            if size >= fingerprints.LEAST and h >> (25 if size < fingerprints.NORMAL else 27) == 0:
                end = i + 1
                break
            if size == fingerprints.MOST:
                end = i + 1
        out.append((at, end))
        at = end
    return out


@pytest.mark.parametrize("size", [0, 1, 31, 32, 33, 200, 5000])
def test_chunks_against_sequential_gear(size):
    data = random.Random(size).randbytes(size)
    parts = [data, b"", data[: size // 2], data + data]
    off = np.cumsum([0, *map(len, parts)])
    s, e, doc = fingerprints.chunks(np.frombuffer(b"".join(parts), np.uint8), off)
    for d, p in enumerate(parts):
        assert [(int(a - off[d]), int(b - off[d])) for a, b, k in zip(s, e, doc) if k == d] == plain_chunks(p)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints_of_all_and_their_edits(which, request):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in request.getfixturevalue(which).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        changed = fingerprints.edited(t, u)
        a, b, c = fingerprints.fingerprint([t, changed, u])
        expected.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.text_form(a), fingerprints.text_form(b), fingerprints.containment(a, b), fingerprints.containment(a, c)))
    found = fingerprints.fingerprint_with_edits(common.texts(request.getfixturevalue(which)))
    assert Counter(map(tuple, found.collect())) == Counter(expected)


def test_fingerprint_resists_shifts():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(600))
    a, b, c = fingerprints.fingerprint([text, "some words before it " + text, " ".join(f"other{i}" for i in range(600))])
    assert fingerprints.containment(a, b) > 0.9 and fingerprints.containment(a, c) < 0.1


def naive_best_fit(sizes, bits, room):
    bins, out = [], []
    for s, c in zip(sizes, bits):
        fit = [(r, i) for i, (r, m) in enumerate(bins) if r >= s and not m & c]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append((room, 0))
        bins[i] = (bins[i][0] - s, bins[i][1] | c)
        out.append((bins[i][0], i))
    return bins, out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_tightest_compatible_bin(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 50) for _ in range(200)), reverse=True)
    bits = [1 << r.randint(0, 5) | 1 << r.randint(6, 20) for _ in sizes]
    chosen = packing.best_fit(sizes, bits, 64)
    left, carried = defaultdict(lambda: 64), defaultdict(int)
    for s, c, b in zip(sizes, bits, chosen):
        fits = [left[x] for x in left if left[x] >= s and not carried[x] & c]
        assert left[b] == min(fits, default=64) and not carried[b] & c
        left[b] -= s
        carried[b] |= c
    assert min(left.values()) >= 0


@pytest.mark.parametrize("which,room", [("docs", 256), ("odd", 64), ("docs", 2048)])
def test_packing_covers_every_word_once(which, room, request):
    df = request.getfixturevalue(which)
    out = packing.pack(df, room, shard_rows=50).collect()
    texts = defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(r)
    load = Counter()
    pieces = defaultdict(list)
    for r in out:
        load[r["bin_id"]] += r["n_words"]
        pieces[r["doc_id"]].append((r["first_word"], r["n_words"]))
    assert max(v for k, v in load.items() if k is not None) <= room
    for i, rows in texts.items():
        expected = []
        for r in rows:
            n = len(words(r["text"]))
            expected += [(a, min(room, n - a)) for a in range(0, n, room)] or [(0, 0)]
        assert Counter(pieces[i]) == Counter(expected)
    by_bin = defaultdict(list)
    for r in out:
        if r["bin_id"] is not None and r["doc_id"] in texts and len(texts[r["doc_id"]]) == 1:
            by_bin[r["bin_id"]].append(texts[r["doc_id"]][0])
    for rows in by_bin.values():
        assert len({x["source"] for x in rows if x["source"]}) == len([x for x in rows if x["source"]])
        assert len({" ".join(words(x["text"])).lower() for x in rows}) == len(rows)


MORE = ["", " ", "  two  spaces ", "a\n\nb", "größe ﬀ \U0001f600", "\t tab", "aaaaaaaaaaaa", "<0x41><s>"]


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    r = random.Random(0)
    texts = [x["text"] for x in docs.collect()] + MORE + ["".join(r.choice("abehinrst ▁é".replace("▁", "")) for _ in range(60)) for _ in range(300)]
    for t, ids in zip(texts, c.encode(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == sp.encode(t), t[:60]


def test_unigram_takes_the_largest_sum():
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    c.byte_pair = False
    r = random.Random(1)

    def best(w):
        score = [0.0] + [-1e18] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                s = c.scores.get(w[i:j], c.unknown if j - i == 1 else None)
                if s is not None:
                    score[j] = max(score[j], score[i] + s)
        return score[-1]

    words_ = ["".join(r.choice("abehinrst") for _ in range(r.randint(1, 12))) for _ in range(300)]
    for w, ids in zip(words_, c.encode(words_)):
        pieces = [c.pieces[i] for i in np.frombuffer(ids, np.int32)]
        assert "".join(pieces) == "▁" + w and sum(c.scores[p] for p in pieces) == best("▁" + w)


def test_sentencepiece_round_trip(docs, odd):
    for df in (docs, odd):
        rows = sentencepiece_codec.round_trip(common.texts(df)).collect()
        assert len(rows) == df.count() and all(r["exact"] for r in rows)
    d = common.texts(docs)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(sentencepiece_codec.encode(d)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in d.collect()}


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_licenses_against_brute_force(which, request):
    df = request.getfixturevalue(which)
    found = licenses.scan_licenses(common.texts(df)).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter((r["doc_id"], *plain_scan(r["text"])) for r in df.collect())
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)


@pytest.mark.parametrize(
    "text,ids,free",
    [
        ("MIT", ["mit"], 1.0), ("MIT OR GPL-3.0-only", ["gpl-3", "mit"], 1.0), ("MIT AND GPL-3.0", ["gpl-3", "mit"], 0.3), ("(MIT OR GPL-2.0) AND MPL-2.0", ["gpl-2", "mit", "mpl-2"], 0.6),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2"], 0.4), ("MIT AND GPL-2.0 OR Apache-2.0", ["apache-2", "gpl-2", "mit"], 0.95), ("nonsense", [], None), ("", [], None), ("MIT OR", ["mit"], 1.0), ("((MIT", ["mit"], 1.0), ("MIT (x) y", ["mit"], 1.0),
    ],
)
def test_expressions(text, ids, free):
    found, value = licenses.parse(text)
    assert found == ids and (value is None) == (free is None) and (free is None or abs(value - free) < 1e-9)


@pytest.mark.parametrize(
    "text,labels,score",
    [
        ("SPDX-License-Identifier: EPL-2.0 OR MIT", "epl-2,mit", 1.0), ("SPDX-License-Identifier: EPL-2.0", "epl-2", 0.6), ("SPDX-License-Identifier: MIT AND (0BSD OR OFL-1.1)", "0bsd,mit,ofl-1.1", 1.0), ("SPDX-License-Identifier: NOASSERTION", "", 0.0),
        ("License: EPL-2.0 OR MIT", "epl-2,mit", 1.0), ("License: (EPL-2.0 AND MPL-2.0) OR GPL-2.0", "epl-2,gpl-2,mpl-2", 0.6), ("License: EPL-2.0 WITH Classpath-exception-2.0 AND MIT", "epl-2,mit", 0.7), ("License: see the MIT file", "", 0.0),
        ("SPDX-License-Identifier: FOO-1.0", "foo-1", 0.2), ("SPDX-License-Identifier: MIT AND FOO-1.0", "foo-1,mit", 0.2), ("SPDX-License-Identifier: MIT OR FOO-1.0", "foo-1,mit", 1.0), ("License: FOO-1.0", "", 0.0),
        ("License: MIT AND FOO-1.0", "mit", 0.2), ("License: FOO-1.0 OR MIT", "mit", 1.0), ("License: MIT-approved", "", 0.0), ("SPDX-License-Identifier: MIT-approved", "mit-approved", 0.2), ("License: CC-BY-SA-4.0", "cc-by-sa,cc-by-sa-4", 0.5),
        ("license: BSD-3-Clause", "bsd,bsd-3-clause", 1.0), ("spdx license identifier = mit", "mit", 1.0), ("a licensee: MIT", "", 0.0), ("license MIT", "", 0.0), ("License: GPL-2.0 license: MIT", "gpl-2,mit", 0.3),
    ],
)
def test_identifiers_of_unknown_families(text, labels, score):
    assert licenses.scan(text.encode())[5:] == (labels, score)


def plain_statistics(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rule_statistics_against_brute_force(which, request):
    df = request.getfixturevalue(which)
    found = rules.judge(rules.statistics(common.texts(df))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    plain = [(r["doc_id"], *plain_statistics(r["text"])) for r in df.collect()]
    assert Counter(tuple(r)[:6] for r in found) == Counter(plain)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in found)


def test_rules_reject_each_fault_and_keep_the_rest(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    clean = lambda: ". ".join(" ".join(word() for _ in range(9)) for _ in range(8)) + "."
    rows = [(i, clean(), 1) for i in range(300)]
    rows += [(1000 + i, re.sub(r"(\w+)", r"\1$$$", clean()), 0) for i in range(12)] + [(2000 + i, "\n".join([clean()[:60]] * 9), 0) for i in range(12)] + [(3000 + i, clean().upper(), 0) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good int")
    kept = {r["doc_id"] for r in rules.keep_good(df).collect()}
    assert kept == {i for i, _, g in rows if g}


def test_machine_sums_pairs_in_linear_time():
    first, feature, value = quality_fm.features(pa.array(["some words and words", "", None, "Other\nlines | here"]))
    m = quality_fm.Machine(0.5)
    m.w += np.random.default_rng(0).normal(0, 1, m.w.shape).astype(np.float32)
    m.v *= 20
    z, _ = m.logits(first, feature, value)
    for d in range(4):
        f, x = feature[first[d] : first[d + 1]], value[first[d] : first[d + 1]].astype(float)
        pairs = sum(m.v[f[i]].astype(float) @ m.v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert math.isclose(z[d], m.bias + float(m.w[f] @ x) + pairs, rel_tol=1e-3, abs_tol=1e-3)


@pytest.mark.parametrize("module,target,least", [(quality_fm, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, module, target, least):
    folder = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = module.query(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc >= least


def test_classifiers_without_labels_and_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for df in (odd, none):
        d = common.texts(df)
        assert quality_fm.score(d, quality_fm.train(d, labels)).count() == df.count()
        d = df.select("doc_id", "text", "lang").fillna({"text": ""})
        assert toxicity.score(d, toxicity.train(d, labels)).count() == df.count()
    assert sampling.labelled(common.texts(odd), labels, "quality", 5)[1].keys() <= {0, 1}


def test_empty_tables(none):
    d = common.texts(none)
    assert fingerprints.fingerprint_with_edits(d).count() == 0
    assert licenses.scan_licenses(d).count() == 0
    assert packing.pack(none).count() == 0
    assert sentencepiece_codec.round_trip(d).count() == 0
    assert rules.judge(rules.statistics(d)).count() == 0
    assert rules.keep_good(none).columns == none.columns


def test_words_and_windows_do_not_cross_documents():
    arr = pa.array(["a b", None, "", "c d e", " f"])
    buf, off = textkit.flat(arr)
    s, e, doc = textkit.words(buf, off)
    assert [bytes(buf[i:j]).decode() for i, j in zip(s, e)] == list("abcdef") and doc.tolist() == [0, 0, 3, 3, 3, 4]
    h = textkit.word_hashes(buf, s, e)
    assert len(set(h.tolist())) == 6 and textkit.windows(h, doc, 2)[1].tolist() == [0, 2, 3]
