"""Folds: rows of a key in their order through a step with a state of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at once.
ROWS = 256


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Callable[[tuple], Any], step: Callable[[Any, dict], tuple[Any, list[tuple]]], out: str, end: Callable[[Any], list[tuple]] | None = None
) -> DataFrame:
    """The rows that step and end give, as columns of `out`.

    begin(key) makes a key's state, step(state, row) gives (state, rows) for each row in order, end(state) rows after the last.
    Rows are dealt by key and sorted there, which spills to disk, and stream through the task: memory holds one state and
    ROWS rows, however many a key has.  Keys are independent; within one the fold is sequential by its nature, so pass
    the columns that the step needs and no others.
    """
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*made, strict=True)) or [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for row in whole.slice(at, ROWS).to_pylist():
                    here = tuple(row[k] for k in keys)
                    if here != key:
                        if key is not None and end is not None:
                            made += end(state)
                        key, state = here, begin(here)
                    state, rows = step(state, row)
                    made += rows
                if len(made) >= ROWS:
                    yield batch()
                    made = []
        if key is not None and end is not None:
            made += end(state)
        if made:
            yield batch()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
