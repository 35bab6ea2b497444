"""What a run looks at next: targeted re-scans of what it has read, and a verification queue under budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from . import stream
from .fold import ordered_fold

_PAIR = ["sample_id", "edge_id", "source_ref"]


# --- targeted re-scans -----------------------------------------------------------------------------
@dataclass
class Scan:
    """Where the re-scans of all runs stand: edges known so far, how far was read, pairs that wait, and the log of those tried."""

    edges: DataFrame  # sample_id, edge_id, anchor
    cursors: DataFrame  # sample_id, cursor
    waiting: DataFrame  # sample_id, edge_id, source_ref, stream_position
    tried: DataFrame  # the same, and round
    round: int = 0


def begin_scan(manifest: DataFrame, edges: DataFrame) -> Scan:
    """Nothing read, no edge active."""
    pairs = edges.limit(0).select("sample_id", "edge_id").join(manifest.limit(0).select("sample_id", "source_ref", F.col("stream_position").cast("long").alias("stream_position")), "sample_id").select(*_PAIR, "stream_position")
    none = stored(pairs, "pairs")
    at = manifest.limit(0).select("sample_id", F.lit(0).cast("long").alias("cursor"))
    return Scan(edges.limit(0).select("sample_id", "edge_id", "anchor"), at, none, none.withColumn("round", F.lit(0)))


def rescan(scan: Scan, manifest: DataFrame, active: DataFrame, cursors: DataFrame, limit: int, requests: int | None = None) -> Scan:
    """One more round: the sentences that active edges ask for, each pair of edge and sentence once over all rounds.

    active: (sample_id, edge_id, anchor), all that are active now; cursors: (sample_id, cursor), how far each run has read.
    Edges that are new meet all that their run has read, edges known before what was read since; nothing else is looked at
    again.  Each edge takes `limit` sentences a round in reading order, the rest wait; with `requests`, only that many edges of
    a run (by edge_id) take any.  An edge that isn't active now keeps its pairs waiting.  The round's own pairs are
    those of `tried` with its number.
    """
    active = stored(active.select("sample_id", "edge_id", "anchor").distinct(), "edges")
    new = active.join(scan.edges, ["sample_id", "edge_id", "anchor"], "left_anti")
    old = active.join(scan.edges, ["sample_id", "edge_id", "anchor"], "left_semi")
    read = manifest.join(cursors, "sample_id").where("stream_position <= cursor")
    since = read.join(scan.cursors.withColumnRenamed("cursor", "_before"), "sample_id", "left").where("_before is null or stream_position > _before").drop("_before")
    met = _asked(read, new).unionByName(_asked(since, old)).distinct()
    fresh = met.join(scan.tried, _PAIR, "left_anti").unionByName(scan.waiting).distinct()
    pool = stored(fresh, "pairs")
    here = pool.join(active.select("sample_id", "edge_id").distinct(), ["sample_id", "edge_id"])
    place = F.row_number().over(Window.partitionBy("sample_id", "edge_id").orderBy("stream_position", "source_ref"))
    taken = here.withColumn("_n", place).where(F.col("_n") <= limit)
    if requests is not None:
        taken = taken.withColumn("_edge", F.dense_rank().over(Window.partitionBy("sample_id").orderBy("edge_id"))).where(F.col("_edge") <= requests).drop("_edge")
    taken = stored(taken.drop("_n"), "pairs")
    tried = scan.tried.unionByName(taken.withColumn("round", F.lit(scan.round + 1)))
    return Scan(scan.edges.unionByName(new), cursors, pool.join(taken, _PAIR, "left_anti"), tried, scan.round + 1)


def _asked(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of edges and their own run's sentences that hold the anchor, or whose title it is."""
    hits = stream.mention_hits(manifest, edges.select(F.col("anchor").alias("phrase")))
    wanted = edges.select("sample_id", "edge_id", stream.folded(F.col("anchor")).alias("phrase"))
    return hits.join(wanted, ["sample_id", "phrase"]).select(*_PAIR, F.col("stream_position").cast("long").alias("stream_position"))


# --- the verification queue ------------------------------------------------------------------------
def admit(queue: DataFrame, budgets: DataFrame) -> DataFrame:
    """(run_id, claim_id, place, calls, decision, calls_used) of each claim of the queue, once, in its order.

    queue: (run_id, claim_id, place, calls), calls being what its verification takes; of a claim that comes again the first
    place counts.  budgets: (run_id, most_calls, most_claims).  A claim is ADMITTED if its calls fit in what is left;
    one that doesn't fit (MAX_MODEL_CALLS) is passed over and later, cheaper ones may still fit; beyond most_claims none is
    (MAX_CLAIMS).  What is left depends on every claim before, so a run is a fold over its numbers.
    """
    once = queue.groupBy("run_id", "claim_id").agg(F.min(F.struct("place", "calls")).alias("q")).select("run_id", "claim_id", "q.*")
    rows = once.join(budgets, "run_id").select("run_id", "place", "claim_id", F.col("calls").cast("long").alias("calls"), F.col("most_calls").cast("long").alias("most_calls"), F.col("most_claims").cast("long").alias("most_claims"))

    def step(state: tuple[int, int], r: dict) -> tuple[tuple[int, int], list[tuple]]:
        used, n = state
        said = "MAX_CLAIMS" if n >= r["most_claims"] else "MAX_MODEL_CALLS" if used + r["calls"] > r["most_calls"] else "ADMITTED"
        if said == "ADMITTED":
            used, n = used + r["calls"], n + 1
        return (used, n), [(r["run_id"], r["claim_id"], r["place"], r["calls"], said, used)]

    kinds = dict(rows.dtypes)
    out = f"run_id {kinds['run_id']}, claim_id {kinds['claim_id']}, place {kinds['place']}, calls long, decision string, calls_used long"
    return ordered_fold(rows, ["run_id"], ["place", "claim_id"], lambda _: (0, 0), step, out)


def run_limits(admitted: DataFrame, windows: DataFrame) -> DataFrame:
    """(run_id, status, reason): RESOURCE_LIMIT or INSUFFICIENT where a run met a limit, else null.

    windows: (run_id, windows, max_windows, min_windows).  Too many windows count before too many calls, and both before too
    few windows, which say that a run read too little to count as a stream.
    """
    calls = admitted.groupBy("run_id").agg(F.max(F.col("decision") == "MAX_MODEL_CALLS").alias("over"))
    rows = windows.join(calls, "run_id", "left")
    many, short = F.col("windows") > F.col("max_windows"), F.col("windows") < F.col("min_windows")
    over = F.coalesce("over", F.lit(False))
    reason = F.when(many, "MAX_WINDOWS").when(over, "MAX_MODEL_CALLS").when(short, F.concat(F.lit("STREAMING_PROTOCOL_TOO_SHORT:"), "windows", F.lit("<"), "min_windows"))
    return rows.select("run_id", F.when(many | over, "RESOURCE_LIMIT").when(short, "INSUFFICIENT").alias("status"), reason.alias("reason"))
