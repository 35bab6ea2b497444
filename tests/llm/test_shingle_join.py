"""Operator 5 against brute force, with groups of near copies of every degree."""

import re

import numpy as np
import pytest

from weftline.llm import common, shingle_join


def brute(docs):
    sets = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    near = {(a, b) for ks in where.values() if len(ks) < 3000 for n, a in enumerate(ks) for b in ks[n + 1 :]}
    for a, b in near:
        i = len(sets[a] & sets[b])
        if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(docs)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def edited(rng, words, share):
    return [f"w{rng.integers(0, 10**6)}" if rng.random() < share else w for w in words]


def planted(seed=1, groups=12, most=14, hot=0):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(groups):
        words = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(12, 200))]
        for _ in range(rng.integers(1, most)):
            mine = edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06]))
            docs.append(" ".join(mine[: len(mine) - rng.integers(0, 3)]))
    words = [f"h{k}" for k in range(150)]
    docs += [" ".join(edited(rng, words, rng.choice([0.01, 0.02, 0.04, 0.06, 0.1]))) for _ in range(hot)]
    common_part = " ".join(f"c{k}" for k in range(30))
    docs += [common_part + " " + " ".join(f"w{k}" for k in rng.integers(0, 5000, rng.integers(3, 40))) for _ in range(40)]
    return [(k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize(("small_run", "block"), [(32, 512), (2, 40)])
def test_planted(spark, small_run, block):
    docs = planted(hot=160)
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b"), (9004, "a B"), (9005, "a b c d e"), (9005, "a b c d e"), (None, "a b c d E"), (None, "null id"), (9006, "x " * 9000), (9007, "x " * 8000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n").repartition(4)
    want = brute(docs)
    assert len({w[2] for w in want}) > 60
    assert rows(shingle_join.components(df, small_run=small_run, block=block)) == want


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(shingle_join.components(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert rows(shingle_join.components(df.limit(0))) == []


def test_bounds():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 1 << 60, 500, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, k, replace=False)) for k in (n, m))
        same = len(np.intersect1d(x, y))
        assert shingle_join.common_count(x, y) == same
        bits = [shingle_join.bitmap(x), shingle_join.bitmap(y)]
        sizes = np.array([len(x), len(y)])
        assert shingle_join.overlap_bound(bits, sizes, np.array([0]), np.array([1]))[0] >= same
        need = shingle_join.least_overlap(len(x), len(y), 75)
        assert (100 * same >= 75 * (len(x) + len(y) - same)) == (same >= need)
        p = shingle_join.prefix_length(sizes, 75)
        assert all(len(s) - k + 1 == -(-75 * len(s) // 100) for s, k in zip((x, y), p, strict=True))


def test_components_of_links(spark):
    rng = np.random.default_rng(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 80, (60, 2))] + [(500, k) for k in range(501, 560)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(links, "u long, v long")).collect()))
    parent = {n: n for e in links for n in e}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {n: parent[n] for n in got} and set(got) == {n for a, b in links if a != b for n in (a, b)}


def test_lower_thresholds_in_large_runs(spark):
    """Sets of one shared passage and unlike sizes: all links at a threshold of 50, whose bands are wider."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    core = [word() for _ in range(100)]
    texts = [" ".join(core[: 60 + 2 * k] + [word() for _ in range(int(rng.integers(0, 70)))]) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    part = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 50 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    got = {r.doc_id: r.component_id for r in shingle_join.components(df, threshold=50, small_run=2, block=4).collect()}
    assert [got[i] for i in range(len(texts))] == part
