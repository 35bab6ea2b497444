"""Evaluation aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, group: Sequence[str], vote: str, at: str) -> DataFrame:
    """(group, vote): the most frequent vote; of equals the one seen first."""
    counts = df.groupBy(*group, vote).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    return counts.groupBy(*group).agg(F.max_by(vote, F.struct("n", -F.col("first"))).alias(vote))


def mean_and_std_at_n(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """(source, mean_at_n, std_at_n): a prompt's mean and population deviation, then means over prompts."""
    per = df.groupBy(source, prompt).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return per.groupBy(source).agg(F.avg("m").alias("mean_at_n"), F.avg("s").alias("std_at_n"))


def best_of_n(df: DataFrame, group: Sequence[str], value: str, n: int, worst: bool = False) -> DataFrame:
    """(group, expected): the exact expectation of the best (or worst) of n draws with replacement.

    With values sorted up, the best is at most the k-th of m with probability (k / m) ** n.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(value) if worst else F.asc(value))
    m = F.count(F.lit(1)).over(Window.partitionBy(*group))
    k = F.row_number().over(w)
    weight = F.pow(k / m, F.lit(n)) - F.pow((k - 1) / m, F.lit(n))
    return df.withColumn("_w", weight).groupBy(*group).agg(F.sum(F.col("_w") * F.col(value)).alias("expected"))


def bootstrap(df: DataFrame, group: str, value: str, n: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(group, best, worst, maj): means over resamples of n values, each group with a generator of its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values, rng = rows[value].to_numpy(), np.random.RandomState(seed)
        taken = values[rng.choice(len(values), (draws, n), replace=True)]
        maj = [x[c.argmax()] for x, c in (np.unique(t, return_counts=True) for t in taken)]
        return pd.DataFrame({group: [rows[group].iloc[0]], "best": [taken.max(1).mean()], "worst": [taken.min(1).mean()], "maj": [np.mean(maj)]})

    return df.select(group, value).groupBy(group).applyInPandas(run, f"`{group}` {df.schema[group].dataType.simpleString()}, best double, worst double, maj double")


# The Poisson distribution function of mean 1 at 0, 1, 2, ... (the tail beyond 9 is 10).
POISSON_1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)


def poisson_weight(row: Column, draw: Column, seed: int) -> Column:
    """How often a row is in a resample: Poisson of mean 1, from the md5 of seed, row and draw (alike on every engine and attempt)."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), draw.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON_1), F.lit(0))


def poisson_bootstrap(df: DataFrame, group: Sequence[str], row: Column, value: Column, reducers: Mapping[str, Callable[[Column, Column], Column]], draws: int = 100, seed: int = 42) -> DataFrame:
    """(group, and for each reducer name_mean, name_std): means and deviations over resamples of whole groups.

    A reducer takes (value, weight) and gives an aggregate, such as F.sum(v * w) / F.sum(w).  Each row has a Poisson weight in
    each draw instead of being drawn, so a resample is an aggregate like any other: it is summed up where the rows are,
    and what is shuffled is a row for each task, group and draw.  Reducers that aren't sums work too, if they leave weight 0 out.
    The deviation of a mean is that of n draws with replacement, s / sqrt(n), to the first order in 1 / n.
    """
    weighed = df.select(*group, value.alias("_v"), row.alias("_row")).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    weighed = weighed.withColumn("_w", poisson_weight(F.col("_row"), F.col("_draw"), seed)).where("_w > 0")
    per = weighed.groupBy(*group, "_draw").agg(*[make(F.col("_v"), F.col("_w")).alias(name) for name, make in reducers.items()])
    return per.groupBy(*group).agg(*[f(name).alias(f"{name}_{end}") for name in reducers for end, f in (("mean", F.avg), ("std", F.stddev_pop))])


def verifier_counts(events: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """(group, tp, fp, fn, tn) of each claim's last decision; gold: claims that are right."""
    last = events.groupBy(group, "claim_id").agg(F.max_by("status", "event_seq").alias("status"))
    rows = last.join(gold.select(group, "claim_id").distinct().withColumn("right", F.lit(True)), [group, "claim_id"], "left")
    accepted, right = F.col("status") == "ACCEPT", F.coalesce("right", F.lit(False))
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(group).agg(n(accepted & right, "tp"), n(accepted & ~right, "fp"), n(~accepted & right, "fn"), n(~accepted & ~right, "tn"))


def micro_scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r))


def reduce_timings(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): keys that name something asynchronous are averaged, the others summed."""
    return df.groupBy(key).agg(F.avg(value).alias("a"), F.sum(value).alias("s")).select(key, F.when(F.contains(F.col(key), F.lit("async")), F.col("a")).otherwise(F.col("s")).alias(value))


def order_gap(df: DataFrame, method: str, order: str, value: str) -> DataFrame:
    """(method, original, reverse, gap)."""
    wide = df.groupBy(method).pivot(order, ["original", "reverse"]).agg(F.avg(value))
    return wide.withColumn("gap", F.col("reverse") - F.col("original"))


def score_by_source(df: DataFrame, source: str, scores: str) -> DataFrame:
    """(source, score): the mean over rows of a row's mean score."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    return df.groupBy(source).agg(F.avg(total / F.size(scores)).alias("score"))
