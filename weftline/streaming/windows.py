"""Budgeted windows and exact-once events over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def budget_windows(stream: DataFrame, budget: int, run: str = "run_id", position: str = "position", cost: str = "cost") -> DataFrame:
    """(run, position, window_index): whole items packed in order until the next one goes over the budget.

    A run's state is its open window; items of a micro-batch are put in order, later batches come later.
    """

    def pack(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, used = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(position)
        out = []
        for at, c in zip(rows[position], rows[cost], strict=True):
            if used and used + c > budget:
                window, used = window + 1, 0
            used += int(c)
            out.append((key[0], at, window))
        state.update((window, used))
        yield pd.DataFrame(out, columns=[run, position, "window_index"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(run).applyInPandasWithState(pack, f"`{run}` {kinds[run]}, `{position}` {kinds[position]}, window_index long", "window long, used long", "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, *keys: str) -> DataFrame:
    """Each event id once, however often it comes.  There is no lateness, so no state is dropped."""
    return stream.dropDuplicates(list(keys))
