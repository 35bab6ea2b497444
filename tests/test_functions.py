"""Functions and driver-side algorithms whose edge cases SQL doesn't show."""

import decimal
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import arrays, text, values
from weftline.operators import balance, batch
from weftline.sources import records


def one(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("r")).first().r


def test_text(spark):
    f = lambda c, s: one(spark, c(F.col("s")), s=s)
    assert f(text.entity, " “Martin  Lee” ") == "martin lee"
    assert f(text.entity_udf, "STRAẞE") == "strasse" and f(text.span_udf, "Ｆｉｌｍ—A!") == "film a"
    assert f(text.spaced_answer, "True.") == "yes" and f(text.bare_answer, "The  cat, a dog!") == "cat dog"
    assert f(text.last_boxed, r"\boxed{a} then \boxed{b{c}d} x") == "b{c}d" and f(text.last_boxed, r"\boxed{open") is None
    assert f(text.last_boxed, r"\fbox{y}") == "y" and f(text.the_answer_is, "nothing") is None
    assert f(text.number_strict, "#### -1,234.5 x") == "-1234.5" and f(text.number_flexible, "a 7 . ") == "7" and f(text.number_flexible, "none") is None
    assert f(lambda c: text.mentions(c, "Art (x)"), "an art (x), yes") and not f(lambda c: text.mentions(c, "art"), "martin")
    assert f(text.tool_call, "<tool_call>{bad</tool_call>").name is None and f(text.tool_call, "none") is None


def test_values(spark):
    for said, day in (("1948-2-3", "1948-02-03"), ("1948/02/03", "1948-02-03"), ("1948", "1948-01-01"), ("May 3, 1948", "1948-05-03"), ("3 Sep 1948", "1948-09-03"), ("948", "None"), ("soon", "None")):
        assert str(one(spark, values.date_value(F.col("s")), s=said)) == day, said
    assert one(spark, values.compare(F.col("a"), F.col("b"), "<="), a="1948", b="1948.0") is False
    assert one(spark, values.compare(F.col("a"), F.col("b"), "GT"), a="10", b="9") is True
    with pytest.raises(ValueError, match="unsupported"):
        values.compare(F.lit(1), F.lit(2), "LIKE")
    assert values.adaptive_kl(0.1, 2.0, 1.0, 10000, 100) == pytest.approx(0.1 * 1.002)


def test_orders_of_numbers_by_their_types(spark):
    cases = [(math.inf, 1.0, False), (1, math.inf, True), (-1e300, decimal.Decimal("1.5"), True), (math.nan, math.inf, False), (1e-19, 2e-19, True), (2**53, 2**53 + 1, True), ("1e3", "999.5", False), ("NaN", "1", None)]
    for a, b, less in cases:
        more = None if less is None else not less
        for how, want in (("LT", less), ("LE", less), ("GT", more), ("GE", more)):
            assert one(spark, values.compare(F.col("a"), F.col("b"), how), a=a, b=b) is want, (a, b, how)


def test_arrays(spark):
    empty = F.expr("cast(array() as array<bigint>)")
    get = lambda c: spark.range(1).select(c.alias("r")).first().r
    assert get(arrays.chunks(empty, 3)) == [] and get(arrays.pad(empty, 2)) == [0, 0] and get(arrays.pad_mask(F.array(F.lit(5)), 3, left=True)) == [0, 0, 1]
    p, r, f = arrays.set_scores(empty, empty)
    assert (get(p), get(r), get(f)) == (1.0, 1.0, 1.0)
    assert get(arrays.until_first(F.array(*map(F.lit, (4, 9, 4, 9))), 9)) == [1, 1, 0, 0]
    with pytest.raises(Exception, match="longer than 1"):
        get(arrays.truncate(F.array(F.lit(1), F.lit(2)), 1, "error"))


def test_partitions():
    lengths = [9, 8, 7, 6, 5, 4, 3, 2]
    parts = balance.karmarkar_karp(lengths, 2, equal_size=True)
    assert sorted(sum(parts, [])) == list(range(8)) and [len(p) for p in parts] == [4, 4] and sum(lengths[i] for i in parts[0]) == 22
    assert balance.greedy([5, 4, 3], 2) == [[0], [1, 2]] and len(balance.micro_batches(lengths, 20)) == 3 and balance.karmarkar_karp([], 3) == [[], [], []]
    assert sorted(i for i in batch.graceful_padding(10, 4) if i >= 0) == list(range(10)) and batch.graceful_padding(10, 4).count(-1) == 2


def test_records(spark, tmp_path):
    shapes = [
        {"id": "q1", "question": "Who?", "answer": "Martin", "type": "bridge", "supporting_facts": [["Film A", 0]], "context": [["Film A", ["One.", "Two."]], ["B", "Single."]]},
        {"id": "q2", "question": "Who?", "golden_answers": ["x", "y"], "metadata": {"type": "inference", "supporting_facts": {"title": ["A"], "sent_id": [1]}, "context": {"title": ["A"], "content": [["S."]]}}},
        {"id": "q3", "question": "Who?", "answers": [], "context": [{"title": "A", "sentences": ["S.", "T."]}]},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, shapes)))
    (tmp_path / "a.json").write_text(json.dumps(shapes))
    for name in ("a.jsonl", "a.json"):
        got = sorted(records.canonical(records.load(spark, f"{tmp_path}/{name}")).collect())
        assert [(r.sample_id, r.question_type, r.answers) for r in got] == [("q1", "bridge", ["Martin"]), ("q2", "inference", ["x", "y"]), ("q3", None, [])]
        assert [[(d.document_id, d.title, d.sentences) for d in r.documents] for r in got] == [[("d00000", "Film A", ["One.", "Two."]), ("d00001", "B", ["Single."])], [("d00000", "A", ["S."])], [("d00000", "A", ["S.", "T."])]]
        assert [[(x.title, x.sentence_id) for x in r.supporting_facts] for r in got] == [[("Film A", 0)], [("A", 1)], []]
    with pytest.raises(ValueError, match="unsupported"):
        records.load(spark, "a.txt")


def test_partitions_join_no_lists():
    """The same parts as by lists of their members."""

    def by_lists(lengths, k, equal_size):
        order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
        step = k if equal_size else 1
        states = []
        for serial, a in enumerate(range(0, len(order), step)):
            parts = [(lengths[i], [i]) for i in order[a : a + step]] + [(0, [])] * (k - step)
            states.append((serial, sorted(parts, key=lambda p: p[0], reverse=True)))
        serial = len(states)
        while len(states) > 1:
            states.sort(key=lambda s: (s[1][-1][0] - s[1][0][0], s[0]))
            a, b = states[0][1], states[1][1]
            states = [*states[2:], (serial, sorted([(v + w, x + y) for (v, x), (w, y) in zip(a, b[::-1], strict=True)], key=lambda p: p[0], reverse=True))]
            serial += 1
        return [sorted(p) for _, p in states[0][1]]

    rng = random.Random(5)
    for trial in range(60):
        k, equal = rng.choice([1, 2, 3, 4, 7]), trial % 2 == 0
        lengths = [rng.randrange(rng.choice([1, 3, 500])) for _ in range(k * rng.randrange(1, 15))]
        assert balance.karmarkar_karp(lengths, k, equal) == by_lists(lengths, k, equal), (lengths, k, equal)


def test_each_batch_is_a_task_of_its_own_share(spark):
    """Small partitions aren't joined, which would run their batches one after the other."""
    rows = spark.range(4000).select((F.col("id") % 10).alias("batch"), F.col("id").alias("row"), (F.col("id") * 37 % 101).alias("length"))
    got = balance.partition(rows, "batch", "row", "length", 4)
    assert got.count() == 4000 and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
