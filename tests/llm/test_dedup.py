import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, line_dedup, simhash, substring
from quarry.llm.components import components

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in SPACES:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out + [now] * bool(now)


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, limit=4):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash_against_brute_force(which, request):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root))
    found = simhash.near_duplicates(common.texts(df)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert Counter(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("seed", range(3))
def test_gray_index_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = [int(c) for c in centre]
    for _ in range(600):
        x = fp[rng.integers(len(fp))]
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fp = fp[np.argsort(rank)]
    root = simhash.GrayIndex(np.zeros(len(fp), np.int64), fp, 4).join()
    assert root.tolist() == plain_components([int(x) for x in fp])


def test_links_do_not_depend_on_how_buckets_are_split(spark):
    rng = np.random.default_rng(1)
    fp = np.unique([int(rng.integers(1 << 62)) ^ 0 for _ in range(20)] + [sum(1 << int(b) for b in rng.integers(0, 63, 4)) for _ in range(300)])
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    whole, split = (sorted(map(tuple, components(simhash.links(df, bucket_rows=n)).collect())) for n in (4096, 8))
    assert whole == split and whole


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_one_of_each_group_stays(odd):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len([x for x in found if x[0] in (7, 8)]) == 1 and (3, None) in found and len(found) == len(set(found))


def plain_removal(rows, k):
    where = Counter()
    split = [words(t) for _, t in rows]
    for w in split:
        for i in range(len(w) - k + 1):
            where[tuple(w[i : i + k])] += 1
    out = []
    for (i, _), w in zip(rows, split):
        gone = {i + j for i in range(len(w) - k + 1) if where[tuple(w[i : i + k])] > 1 for j in range(k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("which,k", [("docs", 35), ("docs", 6), ("odd", 4), ("odd", 35)])
def test_substrings_against_brute_force(which, k, request):
    df = request.getfixturevalue(which)
    found = substring.remove_repeats(common.texts(df), k, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == plain_removal([(r["doc_id"], r["text"]) for r in df.collect()], k)


def test_substring_blocks_change_nothing(docs):
    keyed = common.texts(docs).select(F.xxhash64("doc_id").alias("k1"), F.col("doc_id").alias("k2"), "text")
    one, many = (sorted((r["k2"], bytes(r["cuts"])) for r in substring.intervals(keyed, 8, n).collect()) for n in (1 << 22, 500))
    assert one == many and one


def test_substring_cut_keeps_the_rest(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a  b\n{shared}\tc"), (2, f"{shared} end"), (3, "left as\n it  is")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substring.remove_repeats(df).collect()} == {1: "a  b\nc", 2: "end", 3: "left as\n it  is"}


def plain_lines(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for j in range(len(lines) - 2):
            w = tuple(lines[j : j + 3])
            if any(words(x) for x in w):
                if w in seen:
                    gone |= {j, j + 1, j + 2}
                seen.add(w)
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((i, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_lines_against_brute_force(which, request):
    df = request.getfixturevalue(which)
    found = line_dedup.remove_repeated_lines(common.texts(df)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256))
    assert Counter(map(tuple, found.collect())) == plain_lines([(r["doc_id"], r["text"]) for r in df.collect()])


def test_empty_tables(none):
    d = common.texts(none)
    assert simhash.near_duplicates(d).count() == 0
    assert simhash.deduplicate(none).count() == 0
    assert substring.remove_repeats(d, digest=True).count() == 0
    assert line_dedup.remove_repeated_lines(none).count() == 0
