"""Operators 4 and 8 against brute force."""

import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import sentence_spans, source_mixing

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 4
def test_cdf_inverts_poisson(spark):
    for mean in (0.01, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(source_mixing.poisson_cdf(F.lit(mean)).alias("c")).first().c
        want = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(len(cdf))])
        assert np.allclose(cdf, want, atol=1e-9) and cdf[-1] > 1 - 1e-9
    assert spark.range(1).select(source_mixing.poisson_cdf(F.lit(0.0)).alias("c")).first().c == []


def test_mixing_reaches_its_weights(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("source"), F.lit(1).alias("copies"))
    got = source_mixing.replicate(df, {"big": 1.0, "mid": 3.0})
    count = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(count) == {"big", "mid"}
    assert abs(count["big"] - 7500) < 400 and abs(count["mid"] - 22500) < 600
    per = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("copies"), F.max("copy").alias("copy")).where("n <> copies or copy <> copies - 1")
    assert per.count() == 0
    default = {r.source: r["count"] for r in source_mixing.replicate(df).groupBy("source").count().collect()}
    assert set(default) == {"big", "mid", None} and default["big"] / default[None] == pytest.approx(math.sqrt(7), rel=0.1)


def test_mixing_is_repeatable_and_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = source_mixing.replicate(docs)
    assert rows(got) == rows(source_mixing.replicate(docs.repartition(7)))
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", got._jdf.queryExecution().toString())
    assert rows(source_mixing.replicate(docs.limit(0))) == []
    odd = spark.createDataFrame([(None, None), (1, None), (1, None), (2, "a")], "doc_id long, source string")
    assert {r.doc_id for r in source_mixing.replicate(odd, total=400).collect()} == {None, 1, 2}


# --- 8
def brute(docs, least_sentences=2, least_words=25):
    """Texts after removal, by lists of words, for ids that differ."""
    cut = {}
    for i, text in docs:
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        opens = [
            k for k, (s, _) in enumerate(words)
            if k == 0 or "\n" in text[words[k - 1][1] : s] or text[words[k - 1][1] - 1] in ".!?" or re.match("[A-ZÀ-ÖØ-Þ]", text[s])
        ]
        cut[i] = (words, [*opens, len(words)])
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    places = {}
    for i, text in docs:
        words, bound = cut[i]
        n = len(bound) - 1
        mine = set()
        for a in range(n):
            for b in range(a + least_sentences, n + 1):
                if bound[b] - bound[a] >= least_words:
                    mine.add((a, b))
                    break
        for b in range(1, n + 1):
            for a in range(b - least_sentences, -1, -1):
                if bound[b] - bound[a] >= least_words:
                    mine.add((a, b))
                    break
        for a, b in mine:
            key = tuple(lower(text[s:e]) for s, e in words[bound[a] : bound[b]])
            places.setdefault(key, []).append((i, a, b))
    gone = {}
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone.setdefault(i, set()).update(range(a, b))
    out = {}
    for i, text in docs:
        words, bound = cut[i]
        if i in gone:
            starts = [words[k][0] for k in bound[:-1]] + [len(text)]
            keep = text[: starts[0]] if 0 not in gone[i] else text[: starts[0]]
            out[i] = keep + "".join(text[starts[k] : starts[k + 1]] for k in range(len(bound) - 1) if k not in gone[i])
        else:
            out[i] = text
    return out


def test_spans_like_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passage = " ".join(f"Sentence number {k} of a passage that many documents share word for word." for k in range(6))
    docs += [(10**6 + k, f"Début of {k} text and a fragment {k * 7} then {passage} and so on é{k} it goes.") for k in range(5)]
    docs += [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, "  \n"), (2 * 10**6 + 3, "w " * 3000), (2 * 10**6 + 4, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("removed", F.lit(1)).repartition(5)
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(df).collect()}
    want = brute(docs)
    assert {i: r.text for i, r in got.items()} == want
    assert passage in got[10**6].text and "passage" not in got[10**6 + 1].text and got[10**6 + 1].text.startswith("Début of 1")
    for i, text in docs:
        spots = got[i].removed
        kept, last = "", 0
        for s in spots:
            kept, last = kept + text[last : s.start], s.end
        assert (kept + text[last:] if text is not None else None) == got[i].text


def test_spans_odd_tables(spark):
    long = " ".join(f"Again the words of number {k} are the same in both." for k in range(9))
    df = spark.createDataFrame([(None, long), (1, long), (1, long)], "doc_id long, text string")
    assert rows(sentence_spans.remove_repeats(df).select("doc_id", "text")) == [(1, ""), (1, ""), (None, long)]
    assert rows(sentence_spans.remove_repeats(df.limit(0))) == []
    assert time.time() > 0


def test_spans_keep_one_of_repeated_rows(spark):
    long = " ".join(f"Again the words of number {k} are the same in both." for k in range(9))
    other = " ".join(f"Here the passage of number {k} has words of its own." for k in range(9))
    df = spark.createDataFrame([(1, long), (1, long), (1, long), (None, other), (None, other), (2, "Some head. " + other)], "doc_id long, text string")
    for parts in (1, 6):
        got = rows(sentence_spans.remove_repeats(df.repartition(parts)).select("doc_id", "text"))
        assert got == sorted([(1, ""), (1, ""), (1, long), (2, "Some head. "), (None, ""), (None, other)], key=str)


def test_columns_of_any_name(spark):
    text = "One of the sentences here. Another of the sentences is this one here. And a third one that makes it long enough by far, it is. "
    df = spark.createDataFrame([(1, text, 3, 4, 5, "s"), (2, "x. " + text, 3, 4, 5, "s")], "doc_id long, text string, row int, _span_row int, places int, source string")
    got = sentence_spans.remove_repeats(df)
    assert got.columns == [*df.columns, "removed"] and {r.doc_id: r.text for r in got.collect()} == {1: text, 2: "x. "}
    mixed = df.selectExpr("doc_id", "text", "source", "1 as mix_u", "2 as mix_source", "3 as mix_cdf", "4 as _mix_u")
    assert source_mixing.replicate(mixed, {"s": 1.0}, total=200).select("mix_u", "mix_source", "mix_cdf", "_mix_u").distinct().collect() == [(1, 2, 3, 4)]
