"""Column functions over arrays: padding, truncation, masks, folds, set operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(a: Column, length: int, value: int = 0, left: bool = False) -> Column:
    """An array of at least length elements."""
    fill = F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def pad_mask(a: Column, length: int, left: bool = False) -> Column:
    """1 for an element, 0 for padding."""
    ones, zeros = F.transform(a, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(zeros, ones) if left else F.concat(ones, zeros)


def truncate(a: Column, most: int, side: str = "right") -> Column:
    """side: which side goes (left, right), center keeps both ends, error raises."""
    long = F.size(a) > most
    if side == "right":
        return F.slice(a, 1, most)
    if side == "left":
        return F.when(long, F.slice(a, -most, most)).otherwise(a)
    if side == "center":
        head, tail = most // 2, most - most // 2
        return F.when(long, F.concat(F.slice(a, 1, head), F.slice(a, -tail, tail))).otherwise(a)
    if side == "error":
        return F.when(long, F.raise_error(F.lit(f"longer than {most}"))).otherwise(a)
    raise ValueError(f"unknown side: {side}")


def head_and_tail(a: Column, most: int) -> Column:
    """First and last halves of an array of more than most elements."""
    half = most // 2
    return F.when(F.size(a) > most, F.concat(F.slice(a, 1, half), F.slice(a, -half, half))).otherwise(a)


def chunks(a: Column, size: int) -> Column:
    """Consecutive pieces of size elements; none of an empty array."""
    n = F.ceil(F.size(a) / F.lit(size)).cast("int")
    return F.when(F.size(a) == 0, F.expr("array()")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * size + 1, size)))


def unpad(a: Column, value: int) -> Column:
    return F.filter(a, lambda x: x != value)


def attention_mask(a: Column, value: int) -> Column:
    return F.transform(a, lambda x: (x != value).cast("int"))


def running(a: Column) -> Column:
    """Running sums."""
    return F.aggregate(a, F.expr("cast(array() as array<bigint>)"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)))


def position_ids(mask: Column) -> Column:
    return F.transform(running(mask), lambda x: F.greatest(x - 1, F.lit(0)))


def until_first(a: Column, end: int) -> Column:
    """1 up to and with the first end id, 0 after it."""
    at = F.array_position(a, end)
    return F.transform(a, lambda _, i: ((at == 0) | (i < at)).cast("int"))


def discounted(rewards: Column, gamma: float, mask: Column | None = None) -> Column:
    """R_t = r_t + gamma * R_(t+1), the carry times the mask at t (1 without one)."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")) if mask is not None else F.transform(rewards, lambda r: F.struct(r.alias("r"), F.lit(1.0).alias("m"))))
    start = F.struct(F.lit(0.0).alias("carry"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = x["r"] + F.lit(gamma) * s["carry"]
        return F.struct((now * x["m"]).cast("double").alias("carry"), F.concat(s["out"], F.array(now.cast("double"))).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: F.reverse(s["out"]))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """A_t = delta_t + gamma * lam * A_(t+1), with delta_t = r_t + gamma * V_(t+1) - V_t and V = 0 after the end."""
    pairs = F.reverse(F.zip_with(rewards, values, lambda r, v: F.struct(r.alias("r"), v.alias("v"))))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("adv"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        adv = x["r"] + F.lit(gamma) * s["next"] - x["v"] + F.lit(gamma * lam) * s["adv"]
        return F.struct(x["v"].cast("double").alias("next"), adv.cast("double").alias("adv"), F.concat(s["out"], F.array(adv.cast("double"))).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: F.reverse(s["out"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a).cast("double")
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax_entropy(a: Column) -> Column:
    """log sum exp minus the mean of the logits under their softmax."""
    z = log_sum_exp(a)
    return z - F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x)


def log_prob(a: Column, at: Column) -> Column:
    """Log softmax of the element at a place from 0."""
    return F.element_at(a, at + 1) - log_sum_exp(a)


def set_scores(found: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; both empty: 1, one empty: 0."""
    x, y = F.array_distinct(found), F.array_distinct(gold)
    same = F.size(F.array_intersect(x, y)).cast("double")
    empty = (F.size(x) == 0) & (F.size(y) == 0)
    p = F.when(empty, 1.0).when(F.size(x) == 0, 0.0).otherwise(same / F.size(x))
    r = F.when(empty, 1.0).when(F.size(y) == 0, 0.0).otherwise(same / F.size(y))
    f = F.when(empty, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * same / (F.size(x) + F.size(y)))
    return p, r, f
