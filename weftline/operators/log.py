"""Append-only event logs: idempotent appends, replays, snapshots, call caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON text in one spelling: keys of every object in order, no white space; null for what is no JSON.  Arrays keep their order."""
    return F.to_json(F.try_parse_json(text))  # a parsed object holds its keys in order


def content_id(*parts: str | Column) -> Column:
    """An id by content: the hash of the parts' canonical JSON, so that the order of fields, in nested ones too, doesn't count."""
    return F.sha2(canonical_json(F.to_json(F.struct(*parts))), 256)


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """log with those of new's events whose (run_id, event_id) it doesn't have, numbered on from each run's last.

    new needs an `at` for its order; of repeated events the first counts.
    """
    first = F.row_number().over(Window.partitionBy("run_id", "event_id").orderBy("at"))
    fresh = new.withColumn("_n", first).where("_n = 1").drop("_n").join(log.select("run_id", "event_id"), ["run_id", "event_id"], "left_anti")
    last = log.groupBy("run_id").agg(F.max("event_seq").alias("_last"))
    seq = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("run_id").orderBy("at"))
    numbered = fresh.join(last, "run_id", "left").withColumn("event_seq", seq).select(*log.columns)
    return log.unionByName(numbered)


def insert_or_ignore(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return table.unionByName(new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def upsert(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def histogram(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def replay(log: DataFrame, run: str, key: str, value: str, seq: str = "event_seq") -> DataFrame:
    """(run, key, value, changes): the last value of each key, and how many events set it."""
    return log.groupBy(run, key).agg(F.max_by(value, seq).alias(value), F.count(F.lit(1)).alias("changes"))


def replay_claims(log: DataFrame) -> DataFrame:
    """(run_id, claim_id, deferred, pending, verified, rejected, conflicts): where a log leaves each claim.

    log: (run_id, event_seq, event_type, claim_id, verification_required).  A promotion or a rejection takes a claim out of
    those deferred and pending, a rejection out of those verified as well; a rejected claim stays so.
    """
    last = lambda *types, need=None: F.coalesce(F.max(F.when(F.col("event_type").isin(*types) & (F.lit(True) if need is None else F.coalesce("verification_required", F.lit(False)) == F.lit(need)), F.col("event_seq"))), F.lit(-1))
    at = log.where("claim_id is not null").groupBy("run_id", "claim_id").agg(
        last("CLAIM_DEFERRED").alias("d"), last("CLAIM_COMMITTED", need=True).alias("p"), last("CLAIM_COMMITTED", need=False).alias("v"), last("CLAIM_PROMOTED").alias("up"),
        last("VERIFY_REJECTED").alias("no"), F.count_if(F.col("event_type") == "VERIFY_CONFLICT").alias("conflicts"),
    )
    gone = F.greatest("up", "no")
    return at.select("run_id", "claim_id", (F.col("d") > gone).alias("deferred"), (F.col("p") > gone).alias("pending"), (F.greatest("v", "up") > F.col("no")).alias("verified"), (F.col("no") >= 0).alias("rejected"), "conflicts")


#: The state that an event gives an edge.
EDGE_EVENTS = {"QUERY_EDGE_ACTIVATED": "ACTIVE", "QUERY_EDGE_DORMANT": "DORMANT", "QUERY_EDGE_SATISFIED": "SATISFIED", "QUERY_EDGE_CONFLICTED": "CONFLICTED"}


def replay_edges(log: DataFrame) -> DataFrame:
    """(run_id, edge_id, state, support): each edge's last state and, in order, the claims that satisfied it.

    log: (run_id, event_seq, event_type, edge_id, claim_id)
    """
    state = F.element_at(F.create_map(*[F.lit(x) for pair in EDGE_EVENTS.items() for x in pair]), F.col("event_type"))
    rows = log.where(F.col("event_type").isin(*EDGE_EVENTS))
    support = F.array_sort(F.collect_list(F.when(F.col("event_type") == "QUERY_EDGE_SATISFIED", F.struct("event_seq", "claim_id"))))
    return rows.groupBy("run_id", "edge_id").agg(F.max_by(state, "event_seq").alias("state"), F.transform(support, lambda s: s["claim_id"]).alias("support"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """(run_id, snapshot_id, event_seq) of each run's last snapshot."""
    return snapshots.groupBy("run_id").agg(F.max(F.struct("event_seq", "snapshot_id")).alias("s")).select("run_id", F.col("s.snapshot_id").alias("snapshot_id"), F.col("s.event_seq").alias("event_seq"))


def cached_call(calls: DataFrame) -> DataFrame:
    """The call that answers each (run_id, request_hash): attempt 0 if there is one, else the last attempt."""
    order = Window.partitionBy("run_id", "request_hash").orderBy(F.when(F.col("attempt") == 0, 0).otherwise(1), F.desc("attempt"))
    return calls.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def call_summary(calls: DataFrame, run: str) -> DataFrame:
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return calls.groupBy(run).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("request_hash").alias("requests"), F.count_if("cache_hit").alias("hits"),
        F.count_if("failed").alias("failures"), n("tokens").alias("tokens"), F.round(F.sum(F.coalesce("latency_ms", F.lit(0.0))), 4).alias("latency_ms"),
    )
