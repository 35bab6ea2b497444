"""Delayed binding over a stream of facts: early facts wait until a later one binds their entity.

Events: (run_id, event_id, relation, subject, object, position, window_index).  In a run, a fact of the binding
relation binds its object; a fact of the attribute relation whose subject is bound is DIRECT, else it waits and is
PROMOTED with its distance in windows as soon as its subject is bound.  Repeated event ids count once.  A null object
binds nothing, a fact with a null subject never attaches, and a null value is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run_id string, event_id string, subject string, object string, status string, distance long"
_STATE = "seen array<string>, bound array<string>, windows array<long>, waiting array<string>"


def attach(events: DataFrame, binding: str, attribute: str) -> DataFrame:
    """The stream's DIRECT and PROMOTED facts, as they come.  State is a run's, and ends with no watermark."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, bound, windows, waiting = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        known, where = set(seen), dict(zip(bound, windows, strict=True))
        held: dict[str, list[tuple]] = {}
        for w in waiting:
            event, subject, value, window = json.loads(w)
            held.setdefault(subject, []).append((event, value, window))
        rows = pd.concat(list(batches)).sort_values(["position", "event_id"])
        out = []
        for e in rows.itertuples():
            if e.event_id in known:
                continue
            known.add(e.event_id)
            if e.relation == binding and pd.notna(e.object) and e.object not in where:
                where[e.object] = int(e.window_index)
                for event, value, window in held.pop(e.object, ()):
                    gap = int(e.window_index) - window
                    out.append((key[0], event, e.object, value, "PROMOTED" if gap > 0 else "DIRECT", max(gap, 0)))
            elif e.relation == attribute and pd.notna(e.subject):
                if e.subject in where:
                    out.append((key[0], e.event_id, e.subject, e.object, "DIRECT", 0))
                else:
                    held.setdefault(e.subject, []).append((e.event_id, e.object if pd.notna(e.object) else None, int(e.window_index)))
        state.update((list(known), list(where), list(where.values()), [json.dumps((event, s, v, w)) for s, xs in held.items() for event, v, w in xs]))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "subject", "object", "status", "distance"])

    return events.groupBy("run_id").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def attach_batch(events: DataFrame, binding: str, attribute: str) -> DataFrame:
    """The same result over a table, as joins."""
    once = events.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "event_id").orderBy("position"))).where("_n = 1").drop("_n")
    first = once.where(F.col("relation") == binding).groupBy("run_id", F.col("object").alias("subject")).agg(F.min(F.struct("position", "window_index")).alias("b"))
    rows = once.where(F.col("relation") == attribute).select("run_id", "event_id", "subject", "object", "window_index").join(first, ["run_id", "subject"])
    gap = F.col("b.window_index") - F.col("window_index")
    return rows.select("run_id", "event_id", "subject", "object", F.when(gap > 0, "PROMOTED").otherwise("DIRECT").alias("status"), F.greatest(gap, F.lit(0)).cast("long").alias("distance"))
