"""Long-context question sets: gold documents among hashed distractors, permuted by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contexts(questions: DataFrame, corpus: DataFrame, num_docs: int, seed: int = 4) -> DataFrame:
    """(question_id, docs, evidence, is_ordered, is_reverse_ordered, min_distance).

    questions: (question_id, gold: array of corpus positions); corpus: (position), dense from 0.  Distractors are the
    hashed positions that aren't gold: num_docs documents in all with the gold ones, or as many as the corpus has.  A
    corpus of a few times as many is ordered by hash as a whole; of a larger one a question draws four times as many as
    it needs, of which enough are unlike, and never meets the whole corpus.  min_distance is null for one piece of evidence.
    """
    n = corpus.agg(F.max("position")).first()[0]
    n = 0 if n is None else n + 1
    hashed = lambda i: F.xxhash64(F.lit(seed), "question_id", i)
    if n == 0:
        draws = F.expr("cast(array() as array<bigint>)")
    elif n <= 4 * num_docs:
        places = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.struct(hashed(i).alias("k"), i.alias("i")))
        draws = F.transform(F.array_sort(places), lambda x: x["i"])
    else:
        draws = F.transform(F.sequence(F.lit(0), F.lit(4 * num_docs + 64) + F.size("gold")), lambda i: F.pmod(hashed(i), F.lit(n).cast("long")))
    others = F.slice(F.array_except(F.array_distinct(draws), F.col("gold").cast("array<bigint>")), 1, F.greatest(F.lit(num_docs) - F.size("gold"), F.lit(0)))
    picked = questions.select("question_id", "gold", F.concat(F.col("gold").cast("array<bigint>"), others).alias("picked"))
    keyed = F.transform("picked", lambda d: F.struct(F.xxhash64(F.lit(seed + 1), "question_id", d).alias("k"), d.alias("d")))
    docs = picked.select("question_id", "gold", F.transform(F.array_sort(keyed), lambda x: x["d"]).alias("docs"))
    evidence = F.transform("gold", lambda g: (F.array_position("docs", g.cast("bigint")) - 1).cast("int"))
    out = docs.select("question_id", "docs", evidence.alias("evidence"))
    up = F.array_sort("evidence")
    gaps = F.zip_with(F.slice(up, 2, F.greatest(F.size(up) - 1, F.lit(0))), F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0))), lambda b, a: b - a)
    return out.select("question_id", "docs", "evidence", (F.col("evidence") == up).alias("is_ordered"), (F.col("evidence") == F.reverse(up)).alias("is_reverse_ordered"), F.array_min(gaps).alias("min_distance"))


def spread_evidence(rows: DataFrame) -> DataFrame:
    """rows (question_id, evidence) with whether the evidence is in order, and the least distance of neighbours."""
    place = rows.select("question_id", F.posexplode("evidence").alias("i", "at"))
    by_place = Window.partitionBy("question_id").orderBy("at")
    by_order = Window.partitionBy("question_id").orderBy("i")
    steps = place.withColumns({"gap": F.lead("at").over(by_place) - F.col("at"), "next": F.lead("at").over(by_order) - F.col("at")})
    return steps.groupBy("question_id").agg(F.coalesce(F.min(F.col("next") > 0), F.lit(True)).alias("is_ordered"), F.coalesce(F.min(F.col("next") < 0), F.lit(True)).alias("is_reverse_ordered"), F.min("gap").alias("min_distance"))


def distance_buckets(rows: DataFrame, least: list[int]) -> DataFrame:
    """(bucket, question_id): rows whose min_distance reaches a bucket's least, and reverse-ordered rows as bucket 0."""
    far = rows.select("question_id", F.explode(F.filter(F.array(*map(F.lit, least)), lambda b: F.col("min_distance") >= b)).alias("bucket"))
    return far.select("bucket", "question_id").unionByName(rows.where("is_reverse_ordered").select(F.lit(0).alias("bucket"), "question_id"))


def replicated(rows: DataFrame, times: int, id_col: str) -> DataFrame:
    """Every row `times` times, each with an id of its own."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("copy_id", F.concat_ws("-", F.col(id_col), "copy"))
