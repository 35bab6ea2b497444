"""Operators whose cases the tables don't have."""

import re

import pytest
from pyspark.sql import functions as F

from weftline import tables
from weftline.functions import scores, text
from weftline.operators import batch, evaluation, graph, log, stream, synthesis, validation
from weftline.plans.model import Pattern
from weftline.sources import records


def test_contexts_are_whole_where_the_corpus_has_enough(spark):
    for n, wanted in ((0, 2), (3, 3), (20, 20), (25, 20), (500, 20)):
        questions = spark.range(200).select(F.col("id").alias("question_id"), F.array((F.col("id") % max(n, 1)).cast("int")).alias("gold"))
        for r in synthesis.contexts(questions, spark.range(n).withColumnRenamed("id", "position"), wanted).collect():
            assert len(r.docs) == len(set(r.docs)) == max(min(n, wanted), 1) and r.question_id % max(n, 1) in r.docs


def formulas():
    pairs = [  # (as said, right answer, whether equal)
        (r"\frac12", r"\frac{1}{2}", True), (r"0.5", r"\frac{1}{2}", True), (".5", "0.5", True), ("1/2", r"\dfrac{1}{2}", True), ("01/2", r"\frac{1}{2}", False), (r"\sqrt3", r"\sqrt{3}", True),
        ("x=7", "7", True), ("xyz=7", "7", False), (r"12\text{ cm}", "12", True), (r"50\%", "50", True), (r"90^\circ", "90", True), (r"\frac", r"\frac", True), (r"\sqrt", "0", False), ("a b", "ab", True), (r"\frac1{72}", r"\frac{1}{72}", True),
    ]
    return pairs


def test_formula_scores(spark):
    pairs = formulas()
    df = spark.createDataFrame([(rf"first \boxed{{0}}, then \boxed{{{a}}}.", b, e) for a, b, e in pairs], "said string, truth string, equal boolean")
    got = df.select("said", "truth", "equal", scores.math_score(F.col("said"), F.col("truth")).alias("s")).collect()
    assert [(r.said, r.truth) for r in got if (r.s == 1.0) != r.equal] == []
    odd = spark.createDataFrame([(None,), ("",), (r"\boxed{1",), (r"\fbox{7}",), (r"so \boxed 7$ it is",)], "said string")
    assert [r.s for r in odd.select(scores.math_score(F.col("said"), F.lit("7")).alias("s")).collect()] == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert [r.s for r in odd.select(scores.competition_score(F.col("said"), F.lit("7")).alias("s")).collect()] == [-1.0] * 5
    with pytest.raises(Exception, match="no scorer"):
        odd.select(scores.by_source(F.lit("unheard of"), F.col("said"), F.array(F.lit("7")))).collect()


def test_names_and_anchors(spark):
    df = spark.createDataFrame([("Martin Lee (director)", "When was martin lee, who made Film A, born?"), ("Qqq", "zzz"), (None, "x")], "value string, question string")
    got = df.select(text.alias_score_udf("value", F.lit("martin  lee")).alias("s"), text.question_anchor_udf("value", "question").alias("a")).collect()
    assert got[0].s == 1.5 and got[0].a == "martin lee" and got[1].a is None and got[2].s is None


def test_quotes_and_spellings(spark):
    known = spark.createDataFrame([("Film A", "director", "“Martin Lee”", "s:1", 1), ("martin  lee", "born", "1948", "s:0", 0), ("Other", "born", "1950", "s:2", 2)], "subject string, relation string, object string, source_ref string, stream_position long")
    patterns = (Pattern("T1", '"film a"', "Director", "?d"), Pattern("T2", "?d", "born", "?y"))
    assert [(r.d, r.y) for r in graph.path_join(known, patterns).collect()] == [("“Martin Lee”", "1948")]
    got = {r.source_ref: (r.status, r.bound_at, r.committed_at) for r in graph.cascade(known, patterns).collect()}
    assert got == {"s:1": ("DIRECT", None, 1), "s:0": ("PROMOTED", 1, 1)}
    with pytest.raises(ValueError, match="circle"):
        graph.cascade(known, (Pattern("T1", "?a", "r", "?b"), Pattern("T2", "?b", "r", "?a")))


def test_access(spark):
    manifest = spark.createDataFrame([("s", "s:0", 0, "One here", False), ("s", "s:1", 1, "Two here", True), ("s", "s:2", 2, "Three", False)], "sample_id string, source_ref string, stream_position long, text string, context_only boolean")
    reads = spark.createDataFrame([("s", "s:0", 1), ("s", "s:1", 1), ("s", "s:2", 1), ("s", "s:9", 1)], "sample_id string, source_ref string, cursor long")
    assert sorted(map(tuple, stream.prefix_violations(manifest, reads).collect())) == [("s", "s:1", "CONTEXT_ONLY"), ("s", "s:2", "UNREAD"), ("s", "s:9", "UNKNOWN")]
    anchors = spark.createDataFrame([("s", "TWO"), ("s", "here"), ("x", "One")], "sample_id string, anchor string")
    assert sorted((r.source_ref, r.anchor) for r in stream.anchor_recall(manifest, anchors).collect()) == [("s:0", "here"), ("s:1", "TWO"), ("s:1", "here")]


def test_anchors_meet_sentences_by_their_heads(spark):
    """Anchors of all lengths, repeated sentences, other samples; no plan pairs every sentence with every anchor of its sample."""
    texts = [("s", "r0", "The  Quick-brown fox"), ("s", "r1", "é𝄞ö and ZEBRAS cross"), ("s", "r1", "zebras cross again"), ("s", "r2", None), ("s", "r3", "..."), ("x", "r4", "quick brown"), (None, "r5", "fox")]
    names = [("s", "quick brown"), ("s", "Quick  BROWN f"), ("s", "quick brown x"), ("s", "o"), ("s", "ÉX"), ("s", "zebras cross a"), ("s", "zebras"), ("s", "ebra"), ("s", "!!"), ("s", None), ("x", "fox"), ("x", "k b"), ("s", "fox"), ("s", "fox"), (None, "fox")]
    manifest, anchors = spark.createDataFrame(texts, "sample_id string, source_ref string, text string"), spark.createDataFrame(names, "sample_id string, anchor string")
    span = lambda v: " ".join(re.sub(r"[^\w]+", " ", v.lower()).split())
    want = sorted((s, r, a) for s, r, t in texts for z, a in set(names) if s and s == z and t and a and span(a) and span(a) in span(t))
    got = stream.anchor_recall(manifest, anchors)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 8
    assert "_head" in "".join(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_picks(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("v"), F.lit("a").alias("w"))
    values = lambda x: [r.v for r in batch.pick(df, 10, x).orderBy("row_id").collect()]
    assert values(3) == [30] and values(-1) == [90] and values([2, 2, -3]) == [20, 20, 70] and values([True, False] * 5) == [0, 20, 40, 60, 80]
    for s in (slice(2, 8, 3), slice(None, None, -2), slice(8, 2, -3), slice(5, 5)):
        assert values(s) == [10 * i for i in range(10)[s]], s
    assert batch.pick(df, 10, "v").columns == ["row_id", "v"] and batch.pick(df, 10, ["w"]).columns == ["row_id", "w"]
    with pytest.raises(IndexError):
        batch.pick(df, 10, [10])
    made = batch.mini_batches(df, 4, 2).collect()
    assert len(made) == 20 and all(sum(r.epoch == e and r.batch_id == b for r in made) == n for e in (0, 1) for b, n in ((0, 4), (1, 4), (2, 2)))
    assert {r.row_id for r in made if r.epoch == 1} == set(range(10))


def test_records(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k long, x string").write.parquet(f"{tmp_path}/one.parquet")
    (tmp_path / "two.jsonl").write_text('{"k": 2, "y": "b"}\n')
    both = records.read_all(spark, [f"{tmp_path}/one.parquet", f"{tmp_path}/two.jsonl"])
    assert sorted(map(tuple, both.select("k", "x", "y").collect())) == [(1, "a", None), (2, None, "b")]
    with pytest.raises(ValueError, match="unsupported"):
        records.read_all(spark, ["x.csv"])
    nested = spark.createDataFrame([(({"q": 5},),)], "a struct<m:map<string,int>>")
    assert nested.select(records.nested_key(nested, "a.m.q").alias("v"), records.nested_key(nested, "a.m.z").alias("w")).first() == (5, None)
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"))
    assert [r.id for r in records.chosen_samples(rows, "id", "id", ["3", "7"]).orderBy("id").collect()] == ["3", "7"]
    assert [r.id for r in records.chosen_samples(rows, "id", "id", start=8, count=5).collect()] == ["8", "9"]
    with pytest.raises(ValueError, match="no such"):
        records.chosen_samples(rows, "id", "id", ["3", "70"])
    with pytest.raises(ValueError, match="no sample at place 10"):
        records.chosen_samples(rows, "id", "id", start=10)
    same = [log.canonical_json(F.lit(x).cast("string")).alias(f"c{k}") for k, x in enumerate( ('{"b": [1, {"z": null, "a": 1.5}], "a": "\\u00e9"}', '{"a":"é","b":[1,{"a":1.5,"z":null}]}', "no json", None))]
    got = rows.limit(1).select(*same).first()
    assert got[0] == got[1] == '{"a":"é","b":[1,{"a":1.5,"z":null}]}' and got[2] is got[3] is None
    assert rows.limit(1).select((log.content_id(F.struct(F.lit(1).alias("b"), F.lit(2).alias("a")).alias("s")) == log.content_id(F.struct(F.lit(2).alias("a"), F.lit(1).alias("b")).alias("s"))).alias("x")).first().x


def test_set_scores_of_empty_sets(spark):
    runs = spark.createDataFrame([(k,) for k in range(4)], "run long")
    found, gold = (spark.createDataFrame(v, "run long, key string") for v in ([(1, "a"), (2, "a"), (2, "a")], [(2, "a"), (2, "b"), (3, "a")]))
    got = {r.run: (r.precision, r.recall, round(r.f1, 3)) for r in evaluation.set_scores(found, gold, runs, "run", "key").collect()}
    assert got == {0: (1.0, 1.0, 1.0), 1: (0.0, 0.0, 0.0), 2: (1.0, 0.5, 0.667), 3: (0.0, 0.0, 0.0)}


def test_draws_do_not_grow_with_prompts(spark, monkeypatch):
    """Prompts of as many responses share their draws."""
    sizes = []
    monkeypatch.setattr(validation, "stored", lambda df, tag: sizes.append(df.count()) or tables.stored(df, tag))
    for prompts in (2, 40):
        rows = spark.range(3 * prompts).select(F.lit("s").alias("source"), F.floor(F.col("id") / 3).alias("prompt"), "id", (F.col("id") % 3).alias("reward"), (F.col("id") % 2).alias("vote"))
        got = validation.prompt_metrics(rows, "source", "prompt", ["id"], ["reward"], "vote", 5)
        assert got.where("metric = 'maj@3/mean'").count() == prompts
    assert sizes[0] == sizes[1] > 0
