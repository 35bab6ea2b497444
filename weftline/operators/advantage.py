"""Group-relative advantages: window expressions over a group of rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grpo(score: Column, *group: str, by_std: bool = True, eps: float = 1e-6) -> Column:
    """(score - mean) / (sample deviation + eps); a group of one has mean 0 and deviation 1."""
    w = Window.partitionBy(*group)
    alone = F.count(F.lit(1)).over(w) == 1
    centred = score - F.when(alone, 0.0).otherwise(F.avg(score).over(w))
    return centred / (F.when(alone, 1.0).otherwise(F.stddev_samp(score).over(w)) + eps) if by_std else centred


def mixed(outcome: Column, step: Column, uid: str, step_id: str, alpha: float = 0.8) -> Column:
    """alpha of the outcome's advantage in its group, the rest of the step's in its group and step."""
    return alpha * grpo(outcome, uid) + (1 - alpha) * grpo(step, uid, step_id)


def rloo(score: Column, *group: str) -> Column:
    """n / (n - 1) times what a score is over its group's mean; the score itself in a group of one."""
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    return F.when(n == 1, score).otherwise((score - F.avg(score).over(w)) * n / (n - 1))


def centred(score: Column, *group: str) -> Column:
    return score - F.avg(score).over(Window.partitionBy(*group))


def varied_groups(df: DataFrame, score: str, *group: str) -> DataFrame:
    """Rows of the groups whose scores differ, and of groups of one."""
    w = Window.partitionBy(*group)
    return df.withColumns({"_std": F.stddev_pop(score).over(w), "_n": F.count(F.lit(1)).over(w)}).where("_std > 0 OR _n = 1").drop("_std", "_n")


def reward_to_go(reward: Column, mask: Column, baseline: Column, group: str, at: str | Column) -> Column:
    """Masked rewards from a place on, less the baseline."""
    ahead = Window.partitionBy(group).orderBy(at).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.sum(reward * mask).over(ahead) - baseline * mask


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(value * mask) / (F.sum(mask) + 1e-8)


def whiten(df: DataFrame, value: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """df with `whitened`: masked mean 0 and masked variance 1.  Two sums go to the driver, no row does."""
    v, m = F.col(value), F.col(mask)
    total, mean = df.agg(F.sum(m), masked_mean(v, m)).first()
    if total is None or total <= 1:
        raise ValueError("whitening needs more than one value that isn't masked")
    var = df.agg(F.sum((v - mean) * (v - mean) * m) / (F.sum(m) + 1e-8)).first()[0] * total / (total - 1)
    out = (v - mean) * (var + 1e-8) ** -0.5
    return df.withColumn("whitened", out if shift_mean else out + mean)


def aggregate_loss(df: DataFrame, row: str, loss: Column, mask: Column, mode: str, width: int | None = None) -> DataFrame:
    """One row with `loss`: the mean over tokens, the mean over rows of a row's sum or mean, or the sum of all over width.

    A row without a token in its mask has the mean NaN, and so has seq-mean-token-mean over it, as in the reference.
    """
    if mode == "token-mean":
        return df.agg(masked_mean(loss, mask).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return df.agg((F.sum(loss * mask) / F.lit(float(width or 1))).alias("loss"))
    per = {"seq-mean-token-sum": F.sum(loss * mask), "seq-mean-token-mean": F.when(F.sum(mask) == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(loss * mask), F.sum(mask)))}
    if mode not in per:
        raise ValueError(f"unknown mode: {mode}")
    return df.groupBy(row).agg(per[mode].alias("l")).agg(F.avg("l").alias("loss"))


def policy_loss(log_p: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped policy loss of a token; negative advantages are bounded once more."""
    ratio = F.exp(log_p - old)
    clipped = F.greatest(-adv * ratio, -adv * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))
    return F.when(adv < 0, F.least(-adv * dual, clipped)).otherwise(clipped)


def value_loss(value: Column, old: Column, target: Column, clip: float = 0.5) -> Column:
    near = F.greatest(F.least(value, old + clip), old - clip)
    return 0.5 * F.greatest((value - target) * (value - target), (near - target) * (near - target))


def explained_variance(returns: Column, values: Column) -> Column:
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)
