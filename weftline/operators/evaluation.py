"""Scores of runs: triples, plans, latent evidence, and summaries by method and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text


def triple(*parts: Column | str) -> Column:
    """One key of a triple, whose parts count by their normalised answers."""
    return F.array(*[text.spaced_answer(F.col(p) if isinstance(p, str) else p) for p in parts])


def set_scores(found: DataFrame, gold: DataFrame, runs: DataFrame, run: str, key: str) -> DataFrame:
    """(run, precision, recall, f1) of the distinct keys of each run; both sets empty is all right, one empty nothing."""
    f, g = found.select(run, key).distinct().withColumn("f", F.lit(1)), gold.select(run, key).distinct().withColumn("g", F.lit(1))
    n = f.join(g, [run, key], "full").groupBy(run).agg(F.count("f").alias("n_f"), F.count("g").alias("n_g"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("n"))
    rows = runs.select(run).distinct().join(n, run, "left").na.fill(0, ["n_f", "n_g", "n"])
    both_empty = (F.col("n_f") == 0) & (F.col("n_g") == 0)
    part = lambda of: F.when(both_empty, 1.0).when(F.col(of) == 0, 0.0).otherwise(F.col("n") / F.col(of))
    f1 = F.when(both_empty, 1.0).when(F.col("n") == 0, 0.0).otherwise(2.0 * F.col("n") / (F.col("n_f") + F.col("n_g")))
    return rows.select(run, part("n_f").alias("precision"), part("n_g").alias("recall"), f1.alias("f1"))


#: Which event ends a claim's verification how.
DECISIONS = {"VERIFY_NEED_MORE_CONTEXT": "NEED_MORE_CONTEXT", "VERIFY_REJECTED": "REJECT", "VERIFY_CONFLICT": "CONFLICT", "CLAIM_PROMOTED": "ACCEPT"}


def verifier_scores(events: DataFrame, gold: DataFrame, run: str) -> DataFrame:
    """(run, candidates, gold_candidates, accepted, tp, fp, fn, precision, recall, f1) of each claim's last decision.

    events: (run, event_seq, event_type, claim_id, subject, relation, object); gold: (run, subject, relation, object).
    A claim is right if its triple is a gold one; a request for more context that is accepted later counts as accepted.
    """
    status = F.element_at(F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair]), F.col("event_type"))
    key = triple("subject", "relation", "object")
    decided = events.where(F.col("event_type").isin(*DECISIONS) & F.col("claim_id").isNotNull()).select(run, "claim_id", F.struct("event_seq", status.alias("status"), key.alias("key")).alias("last"))
    last = decided.groupBy(run, "claim_id").agg(F.max("last").alias("last")).select(run, "last.status", "last.key")
    right = gold.select(run, key.alias("key")).distinct().withColumn("right", F.lit(True))
    rows = last.join(right, [run, "key"], "left")
    yes, ok = F.col("right").isNotNull(), F.col("status") == "ACCEPT"
    n = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(yes).alias("gold_candidates"), F.count_if(ok).alias("accepted"),
        F.count_if(ok & yes).alias("tp"), F.count_if(ok & ~yes).alias("fp"), F.count_if(~ok & yes).alias("fn"),
    )
    p, r = F.when(F.col("accepted") > 0, F.col("tp") / F.col("accepted")), F.when(F.col("gold_candidates") > 0, F.col("tp") / F.col("gold_candidates"))
    return n.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def answer_scores(prediction: Column, answers: Column) -> tuple[Column, Column]:
    """(exact, token F1) of a prediction, each the best over the gold answers; 0 without any."""
    said = text.spaced_answer(prediction)
    best = lambda score: F.coalesce(F.array_max(F.transform(answers, score)), F.lit(0.0))
    exact = best(lambda g: (text.spaced_answer(g) == said).cast("double"))
    return exact == 1.0, best(lambda g: text.bag_f1(text.words(said), text.words(text.spaced_answer(g))))


def score_results(results: DataFrame, events: DataFrame, gold: DataFrame, packs: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each result, with all that is measured of its run.

    results: (run, prediction, answers, predicted_refs, gold_refs, status), refs and answers as arrays; events: (run, event_seq,
    event_type, claim_id, origin, hits, subject, relation, object), hits being how many claims a lookup found; gold and
    packs: (run, subject, relation, object), the gold triples and those of the evidence pack.  A run without events counts none.
    """
    at = F.col("event_type")
    n = lambda name, c: F.count_if(c).alias(name)
    counts = events.groupBy(run).agg(
        n("callback_count", at == "DEFERRED_LOOKUP"), n("_hit", (at == "DEFERRED_LOOKUP") & (F.col("hits") > 0)), n("_deferred", at == "CLAIM_DEFERRED"), n("promoted_count", at == "CLAIM_PROMOTED"),
        n("deferred_promoted_count", (at == "CLAIM_PROMOTED") & (F.col("origin") == "DEFERRED")), n("cross_window_deferred_promoted_count", at == "CROSS_WINDOW_DEFERRED_PROMOTED"),
        n("non_early_deferred_promoted_count", at == "NON_EARLY_DEFERRED_PROMOTED"), n("conflict_count", at == "VERIFY_CONFLICT"),
    )
    key = triple("subject", "relation", "object")
    keyed = lambda df: df.select(run, key.alias("key"))
    named = lambda df, prefix: df.select(run, *[F.col(c).alias(f"{prefix}_{c}") for c in ("precision", "recall", "f1")])
    runs = results.select(run)
    parts = (
        counts, named(set_scores(keyed(packs), keyed(gold), runs, run, "key"), "graph_triple"),
        named(set_scores(keyed(events.where(at == "TRIPLE_EVENT_PROPOSED")), keyed(gold), runs, run, "key"), "triple_event"),
        verifier_scores(events, gold, run).withColumnsRenamed({c: f"verifier_{c}" for c in ("candidates", "gold_candidates", "accepted", "tp", "fp", "fn", "precision", "recall", "f1")}),
    )
    exact, f1 = answer_scores(F.col("prediction"), F.col("answers"))
    p, r, f = arrays.set_scores(F.col("predicted_refs"), F.col("gold_refs"))
    rows = results.select("*", exact.alias("answer_exact"), f1.alias("answer_token_f1"), p.alias("supporting_precision"), r.alias("supporting_recall"), f.alias("supporting_f1"), (F.col("status") == "OK").alias("run_success"))
    for part in parts:
        rows = rows.join(part, run, "left")
    rows = rows.na.fill(0, [c for c, kind in rows.dtypes if kind == "bigint" and c in {*counts.columns, *parts[3].columns} - {run}])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.withColumns({
        "callback_hit_rate": share("_hit", "callback_count"), "deferred_to_promoted": share("deferred_promoted_count", "_deferred"), "cross_window_deferred_to_promoted": share("cross_window_deferred_promoted_count", "_deferred"),
    }).drop("_hit", "_deferred")


def plan_relation_recall(predicted: DataFrame, oracle: DataFrame, runs: DataFrame, run: str, relation: str) -> DataFrame:
    """(run, recall): the share of the oracle plan's distinct relations that the predicted plan has; null for a run without an oracle plan.

    A predicted plan without any of them, or none at all, has a recall of 0.
    """
    keys = lambda df: df.select(run, text.spaced_answer(F.col(relation)).alias("k")).distinct()
    hit = keys(oracle).join(keys(predicted).withColumn("hit", F.lit(1)), [run, "k"], "left")
    recall = hit.groupBy(run).agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return runs.select(run).distinct().join(recall, run, "left")


def early_latent_recall(events: DataFrame, gold: DataFrame, positions: DataFrame, run: str) -> DataFrame:
    """(run, early, recall): of the gold sentences read before the first committed one, the share that was deferred; null without any."""
    placed = events.join(positions, [run, "source_ref"])
    first = placed.where("event_type = 'CLAIM_COMMITTED'").groupBy(run).agg(F.min("stream_position").alias("first"))
    early = gold.select(run, "source_ref").distinct().join(positions, [run, "source_ref"]).join(first, run).where("stream_position < first")
    deferred = events.where("event_type = 'CLAIM_DEFERRED'").select(run, "source_ref").distinct().withColumn("d", F.lit(1))
    return early.join(deferred, [run, "source_ref"], "left").groupBy(run).agg(F.count(F.lit(1)).alias("early"), (F.count("d") / F.count(F.lit(1))).alias("recall"))


def summary(results: DataFrame, by: Sequence[str], means: Sequence[str], status: str, statuses: Sequence[str], success: str) -> DataFrame:
    """One row a group: count, the mean of each column (nulls don't count), the share of each status, the share of failures."""
    n = F.count(F.lit(1))
    return results.groupBy(*by).agg(
        n.alias("count"), *[F.avg(F.col(c).cast("double")).alias(c) for c in means],
        *[(F.count_if(F.col(status) == s) / n).alias(f"{s.lower()}_rate") for s in statuses], (1 - F.coalesce(F.avg(F.col(success).cast("double")), F.lit(0.0))).alias("error_rate"),
    )


def metric_range(df: DataFrame, by: Sequence[str], *metrics: str) -> DataFrame:
    """Mean, greatest and least of each metric in a group, over the rows that have it; 0 where none has."""
    of = lambda f, m: F.coalesce(f(m), F.lit(0))
    return df.groupBy(*by).agg(*[of(f, m).alias(f"{m}_{name}") for m in metrics for f, name in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))])


def throughput(steps: DataFrame, by: Sequence[str], tokens: str, seconds: str, devices: int) -> DataFrame:
    """(by, total_tokens, seconds, tokens a second and device, milliseconds a token)."""
    t, s = F.sum(tokens), F.sum(seconds)
    return steps.groupBy(*by).agg(t.alias("total_tokens"), s.alias("seconds"), (t / (s * devices)).alias("throughput"), (s * 1000 / t).alias("ms_per_token"))
