"""Operators 11 to 13 against brute force, on odd rows and on the small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import exact_dedup, filter_audit, importance_resampling

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "one"), (6, "word " * 4000), (7, "a" * 30000), (8, "same text here"), (8, "same text here"),
    (None, "same text here"), (9, "same  text here"), (None, None), (10, "café 漢字 é́ x_y don't\t9² 𝄞"), (11, "Café 漢字"), (12, "o n\x0be"), (13, "on\x0ce"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'c' as digest", "1 as `row`", "'s' as source", "2 as part", "3 as rank").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def like_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.select(*names)) == sorted(got.fetchall(), key=str)


# --- 11
def brute_groups(docs):
    by_text = defaultdict(list)
    for at, (i, t) in enumerate(docs):
        by_text[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at, i))
    out = []
    for bare, held in by_text.items():
        best = min(held)
        shown = hashlib.sha256(bare.encode()).hexdigest()
        out += [(h[4], best[4], len(held), shown) for h in held]
    return sorted(out, key=str), len(by_text)


def test_cuckoo_filter():
    rng = random.Random(3)
    keys = [rng.randbytes(32) for _ in range(3000)]
    held = exact_dedup.CuckooFilter.for_keys(3000)
    assert all(map(held.add, keys)) and all(k in held for k in keys)
    assert sum(rng.randbytes(32) in held for _ in range(3000)) < 10
    assert all(held.remove(k) for k in keys[:1500]) and all(k in held for k in keys[1500:]) and sum(k in held for k in keys[:1500]) < 10
    small = exact_dedup.CuckooFilter(0)
    put = [k for k in keys if small.add(k)]
    assert len(put) < 3000
    larger = small.doubled(keys)
    assert all(k in larger for k in keys) and exact_dedup.CuckooFilter.of(larger.slots.tobytes()).mask == larger.mask


def test_exact_dedup_odd(spark, odd):
    got = exact_dedup.DigestIndex.empty(spark).insert(odd).groups().collect()
    want, n = brute_groups(ODD)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert rows(exact_dedup.DigestIndex.empty(spark).insert(odd.limit(0)).groups()) == []


def test_exact_dedup_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        like_sql(exact_dedup.query(spark, sf), exact_dedup.SQL, documents=f"{sf}/documents.parquet")


def test_exact_dedup_batches_full_filters_and_false_hits(spark, monkeypatch):
    """Several batches with few bits to a mark and filters that overflow, and rows deleted: as if all were made anew."""
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "b ", " c"]) * rng.randrange(1, 4) + str(rng.randrange(700))) for i in range(1500)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(exact_dedup.CuckooFilter, "_place", lambda self, d: (int.from_bytes(d[8:16], "little") & self.mask, d[16] % 15 + 1))
    monkeypatch.setattr(exact_dedup.CuckooFilter, "for_keys", classmethod(lambda cls, n: cls(0) if n < 1000 else cls(14)))
    index = exact_dedup.DigestIndex.empty(spark, shards=3)
    for a in (0, 700, 1000):
        index = index.insert(frame(docs[a : a + (700, 300, 500)[(0, 700, 1000).index(a)]]))
        want, n = brute_groups(docs[: {0: 700, 700: 1000, 1000: 1500}[a]])
        got = index.groups().collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want and sum(r.kept for r in got) == n
    assert index.filters.selectExpr("max(length(slots))").first()[0] > 2 * 4
    gone = {i for i, _ in docs if i % 3 == 0}
    index = index.delete(frame([(i, None) for i in gone]).select("doc_id"))
    left = [d for d in docs if d[0] not in gone]
    want, n = brute_groups(left)
    got = index.groups().collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want and sum(r.kept for r in got) == n
    marks = sum(b != 0 for r in index.filters.collect() for b in np.frombuffer(r.slots, np.uint16))
    assert marks == n  # one mark for each live digest, none for the dead
    texts = {re.sub(r"\s", "", t) for _, t in left}
    asked = [(5000 + k, t) for k, (_, t) in enumerate(docs[:200])] + [(9999, "never seen")]
    assert sorted(r.doc_id for r in index.known(frame(asked)).collect()) == [i for i, t in asked if re.sub(r"\s", "", t) in texts]


# --- 12
def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(docs, target):
    seen = [(i, *brute_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in seen for b in f), Counter(b for x in target for b in brute_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in seen:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-score, i is None, i or 0) for i, n, _, _, score in out if n >= 20)
    rank = {key: k for k, key in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted(((i, f, w, score, rank.get((-score, i is None, i or 0)) if n >= 20 else None) for i, n, f, w, score in out), key=str)


def test_features_of_cut_texts(monkeypatch):
    rng = random.Random(1)
    texts = [t for _, t in ODD] + ["w" * 700 + " b " + "q" * 300 + " c", "x" * 255 + " " + "y" * 256 + " " + "z" * 257]
    texts += [" ".join(rng.choice(["aa", "B", "ccc", "dé", "9", "x" * 300, "-", "漢", "  ", "Zz,y"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    for segment in (1, 7, 40, 300, 2 << 20):
        monkeypatch.setattr(importance_resampling, "SEGMENT", segment)
        got, words = [[] for _ in texts], np.zeros(len(texts), int)
        for bucket, row, n_words in importance_resampling.features(pa.array(texts)):
            words += n_words
            for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
                got[r].append(b)
        assert [(n, sorted(g)) for n, g in zip(words.tolist(), got, strict=True)] == [(n, sorted(f)) for n, f in map(brute_features, texts)]


def test_resampling(spark, odd):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        got = rows(importance_resampling.query(spark, sf))
        assert got == brute_resample(docs, target) and sum(r[4] is not None for r in got) == 5 * sum(brute_features(t)[0] >= 20 for _, t in docs) // 100
    long_texts = [(i, " ".join(f"w{(i * k) % 17}" for k in range(25))) for i in range(90)]
    docs = ODD + long_texts + [(None, "null id " * 12)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as weight", "'x' as `rank`").repartition(6)
    target = spark.createDataFrame([("w3 w4 w5",), (None,), ("",)], "text string")
    assert rows(importance_resampling.resample(df, target)) == brute_resample(docs, ["w3 w4 w5"])
    assert rows(importance_resampling.resample(df, target.limit(0))) == brute_resample(docs, [])
    assert rows(importance_resampling.resample(df.limit(0), target)) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(importance_resampling.resample(empty, target)) == []
    assert {r[0] for r in rows(importance_resampling.resample(df.selectExpr("string(doc_id) doc_id", "text"), target))} == {None if i is None else str(i) for i, _ in docs}


# --- 13
def brute_audit(docs, labels):
    """docs: (id, text, source); every order's steps one document after the other."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails, parts = [], defaultdict(list)
    for at, (i, t, part) in enumerate(docs):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({f for f, on in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), i is not None and first[t] < i), strict=True) if on})
        parts[part or ""].append(at)
    out = []
    for part, ats in parts.items():
        share, made = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(ats)
            for step, f in enumerate(order, 1):
                gone = [a for a in left if f in fails[a]]
                left = [a for a in left if f not in fails[a]]
                share[f] += len(gone)
                redundant = sum(f in fails[a] for a in ats) - len(gone)
                made.append((part, order, step, len(left), len(gone), redundant, sum(fails[a] == {f} for a in ats), sum(docs[a][0] in good for a in gone), sum(docs[a][0] in toxic for a in gone)))
        out += [(*m, share[m[1][m[2] - 1]]) for m in made]
    return sorted(out, key=str)


def test_walk_visits_all_orders():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_filter_audit(spark):
    docs = [(i, t, ("s", None, "", "t")[k % 4]) for k, (i, t) in enumerate(ODD)] + [(20, "LOUD TEXT # one", "s"), (21, "LOUD TEXT # one", "s"), (21, "LOUD TEXT # one", "t")]
    docs += [(30 + k, " ".join(f"w{i}" for i in range(150 + 30 * k)), "long") for k in range(5)] + [(40, "𝄞 é" * 3, "t")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 42)] + [(8, 1, 1), (None, 1, 1), (20, None, None)]
    labels = [(i, q if q is None else int(q), t if t is None else int(t)) for i, q, t in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "7 as mask", "'x' as n", "'y' as id").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as good")
    assert rows(filter_audit.audit(df, lab)) == brute_audit(docs, labels)
    assert rows(filter_audit.audit(df.limit(0), lab)) == []
    assert rows(filter_audit.audit(df, lab.limit(0))) == brute_audit(docs, [])
    many = [(i, f"text {i % 7}", f"src{i % 150}") for i in range(600)]
    assert rows(filter_audit.audit(spark.createDataFrame(many, "doc_id long, text string, source string"), lab)) == brute_audit(many, labels)


def test_filter_audit_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        like_sql(filter_audit.query(spark, sf), filter_audit.SQL, documents=f"{sf}/documents.parquet", labels=f"{sf}/labels.parquet")
