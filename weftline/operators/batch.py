"""Row-preserving batch operators on DataFrames whose order is a row_id (dense, from 0)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW = "row_id"


def numbered(df: DataFrame, *order: str, by: str | None = None) -> DataFrame:
    """df with a dense row_id in an order, a group at a time with `by`.

    Without `by`, rows are sorted over all tasks and numbered by each task's offset; no task holds all of them.
    """
    if by is not None:
        return df.withColumn(ROW, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    ordered = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ordered = ordered.persist()  # the same split into tasks is needed twice
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_first", offset.alias("_offset"))
    return ordered.join(F.broadcast(starts), "_part").withColumn(ROW, F.col("_offset") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_offset")


def select(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(ROW, *columns)


def pop(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the columns, the rest), both with row_id."""
    return df.select(ROW, *columns), df.drop(*columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def by_mask(df: DataFrame, mask: str) -> DataFrame:
    return df.where(mask)


def by_index(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows at index's places: index has (at, row_id); repeats count, and `at` is the new row_id."""
    return index.select("at", ROW).join(df, ROW).drop(ROW).withColumnRenamed("at", ROW)


def slice_rows(df: DataFrame, n: int, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Rows of a Python slice of n rows; row_id stays what it was."""
    a, b, s = slice(start, stop, step).indices(n)
    inside = (F.col(ROW) >= a) & (F.col(ROW) < b) if s > 0 else (F.col(ROW) <= a) & (F.col(ROW) > b)
    return df.where(inside & (F.pmod(F.col(ROW) - a, F.lit(abs(s))) == 0))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both's columns side by side; a shared column has to be equal, else the row raises."""
    shared = [c for c in a.columns if c in b.columns and c != ROW]
    both = a.join(b.withColumnsRenamed({c: f"_b_{c}" for c in shared}), ROW)
    for c in shared:
        both = both.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs")))).drop(f"_b_{c}")
    return both


def concat(a: DataFrame, b: DataFrame, n_a: int) -> DataFrame:
    """b's rows after a's n_a rows."""
    return a.unionByName(b.withColumn(ROW, F.col(ROW) + n_a))


def repeat(df: DataFrame, times: int, n: int, interleave: bool = True) -> DataFrame:
    """Each row `times` times: next to itself, or the whole batch again and again."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.withColumn(ROW, F.col(ROW) * times + F.col("repeat") if interleave else F.col("repeat") * n + F.col(ROW))


def chunk(df: DataFrame, pieces: int, n: int) -> DataFrame:
    """df with chunk_id: pieces whose sizes differ by one at most, the larger ones first."""
    small, larger = divmod(n, pieces)
    edge = larger * (small + 1)
    id_col = F.when(F.col(ROW) < edge, F.floor(F.col(ROW) / (small + 1)))
    id_col = id_col.otherwise(larger + F.floor((F.col(ROW) - edge) / small)) if small else id_col
    return df.withColumn("chunk_id", id_col.cast("long"))


def pad_rows(df: DataFrame, divisor: int, n: int) -> DataFrame:
    """df with is_pad: as many rows of the start again at the end as make n divisible."""
    more = -n % divisor
    turns = -(-more // max(n, 1))
    extra = df.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(max(turns - 1, 0))))).withColumn("_at", F.col("_turn") * n + F.col(ROW)).where(F.col("_at") < more)
    extra = extra.withColumn(ROW, F.col("_at") + n).drop("_turn", "_at").withColumn("is_pad", F.lit(True))
    return df.withColumn("is_pad", F.lit(False)).unionByName(extra)


def unpad_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def reorder(df: DataFrame, order: DataFrame) -> DataFrame:
    """order has (at, row_id): the row at row_id goes to `at`."""
    return by_index(df, order)


def inverse(order: DataFrame) -> DataFrame:
    return order.select(F.col(ROW).alias("at"), F.col("at").alias(ROW))


def fold(df: DataFrame, size: int, column: str) -> DataFrame:
    """size neighbouring rows as one with an array."""
    items = F.array_sort(F.collect_list(F.struct(ROW, column)))
    return df.groupBy(F.floor(F.col(ROW) / size).cast("long").alias("fold_id")).agg(F.transform(items, lambda x: x[column]).alias(column)).withColumnRenamed("fold_id", ROW)


def unfold(df: DataFrame, size: int, column: str) -> DataFrame:
    return df.select(F.col(ROW).alias("_r"), F.posexplode(column).alias("_i", column)).select((F.col("_r") * size + F.col("_i")).alias(ROW), column)


def mini_batches(df: DataFrame, size: int, epochs: int) -> DataFrame:
    """df with epoch and batch_id: whole batches of `size` rows, in every epoch's own hashed order."""
    rows = df.withColumnRenamed(ROW, "_own").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    # every epoch has as many rows: places over all epochs give each one's own
    placed = numbered(rows.withColumn("_key", F.md5(F.concat_ws(":", "epoch", "_own"))), "epoch", "_key", "_own")
    first = placed.groupBy("epoch").agg(F.min(ROW).alias("_first"))
    placed = placed.join(F.broadcast(first), "epoch")  # one row an epoch
    return placed.withColumn("batch_id", F.floor((F.col(ROW) - F.col("_first")) / size).cast("long")).drop(ROW, "_key", "_first").withColumnRenamed("_own", ROW)


def pick(df: DataFrame, n: int, index: int | slice | Sequence[int] | Sequence[bool] | str | Sequence[str]) -> DataFrame:
    """Rows or columns of a batch of n rows by what the index is: a place, a slice, places, a mask, a column or columns.

    Places may be negative and repeat; the result is numbered anew in the order of the index.
    """
    if isinstance(index, str):
        return select(df, index)
    if isinstance(index, int):
        index = [index]
    if isinstance(index, slice):
        index = range(*index.indices(n))
        a, s = index.start, index.step
        inside = F.pmod(F.col(ROW) - a, F.lit(abs(s))) == 0
        inside &= (F.col(ROW) >= a) & (F.col(ROW) < index.stop) if s > 0 else (F.col(ROW) <= a) & (F.col(ROW) > index.stop)
        return df.where(inside).withColumn(ROW, F.floor((F.col(ROW) - a) / s).cast("long"))
    index = list(index)
    if index and isinstance(index[0], str):
        return select(df, *index)
    if index and isinstance(index[0], bool):
        if len(index) != n:
            raise ValueError("a mask has as many entries as the batch has rows")
        index = [i for i, on in enumerate(index) if on]
    if any(not -n <= i < n for i in index):
        raise IndexError("place outside the batch")
    places = df.sparkSession.createDataFrame([(at, i % n) for at, i in enumerate(index)], f"at long, {ROW} long")
    return by_index(df, places)


def graceful_padding(rows: int, groups: int) -> list[int]:
    """Row indices (-1 for padding) that deal rows into equal groups, with padding spread over the last groups."""
    per = -(-rows // groups)
    short = per * groups - rows
    out, at = [], 0
    for g in range(groups):
        take = per - (1 if g >= groups - short else 0)
        out += list(range(at, at + take)) + [-1] * (per - take)
        at += take
    return out
