"""A scan of large JSON arrays that splits within a file: any number of tasks read one array of objects.

The file goes by in pieces that end with a closing brace, which the text reader cuts at any byte range of a file.  Whether a range
begins within a string, and how deep, isn't known from the range alone; so a first pass finds for each range what it does in
either case, running sums over the ranges give where each begins, and a second pass gives the objects.  What begins in
one range and ends in a later one comes as fragments, at most two for each range, and is put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\.", re.DOTALL)


_NEST = re.compile(r"[{\[\]]")


def _outside(piece: str, within: bool) -> tuple[list[tuple[int, str]], bool]:
    """((place, text) of a piece's parts outside of strings, whether it ends within one); within: whether it begins within one.

    No escape crosses a closing brace, so none crosses a piece's ends.
    """
    plain = _ESCAPE.sub("..", piece) if "\\" in piece else piece  # as long as it was
    parts, at, out = plain.split('"'), 0, []
    for k, part in enumerate(parts):
        if within == bool(k % 2) and part:
            out.append((at, part))
        at += len(part) + 1
    return out, within != (len(parts) % 2 == 0)


def _effect(piece: str, within: bool) -> tuple[int, bool]:
    """(change of depth by a piece and the closing brace after it, whether it ends within a string)."""
    parts, last = _outside(piece, within)
    return sum(t.count("{") + t.count("[") - t.count("]") for _, t in parts) - (not last), last


def _start(piece: str, within: bool, now: int, depth: int) -> int:
    """Place of the first brace that opens an object at `depth` in a piece that begins at depth `now`, or -1."""
    for at, part in _outside(piece, within)[0]:
        for m in _NEST.finditer(part):
            if m[0] == "{" and now == depth:
                return at + m.start()
            now += -1 if m[0] == "]" else 1
    return -1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: how it changes depth and string state if it begins outside of a string (0) and within one (1)."""
    rows: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, block, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            s = rows.setdefault((file, block), [0, 0, 0, 1])
            for k in (0, 2):
                change, last = _effect(piece, bool(s[k + 1]))
                s[k], s[k + 1] = s[k] + change, int(last)
    cols = [[f for f, _ in rows], [b for _, b in rows], *(([v[k] for v in rows.values()]) for k in (0, 1, 2))]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["file", "block", "d0", "s0", "d1"])


def _pieces_to_objects(depth: int):
    """Rows (file, block, n, kind, value): WHOLE objects, and a range's first (HEAD), only (ALL) or last (TAIL) fragment of one that crosses it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, now, within, n = None, 0, False, 0
        held: list[str] = []  # of the object that is open
        mine = is_open = False  # whether it began in this range, whether there is one
        out: list[tuple] = []

        def left() -> list[tuple]:
            return [(*where, n, "TAIL" if mine else "ALL", "".join(held))] if where is not None and is_open and held else []  # type: ignore[misc]

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "block", "n", "kind", "value"])

        for batch in batches:
            for file, block, piece, d, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (file, block) != where:
                    out += left()
                    where, now, within, n, held, mine, is_open = (file, block), d, bool(s), 0, [], False, d > depth
                if is_open:
                    held += [piece, "}"]
                elif (first := _start(piece, within, now, depth)) >= 0:
                    held, mine, is_open = [piece[first:], "}"], True, True
                change, within = _effect(piece, within)
                now += change
                if is_open and now <= depth:
                    out.append((*where, n, "WHOLE" if mine else "HEAD", "".join(held)))
                    n, held, is_open = n + 1, [], False
            yield rows()
            out.clear()
        out += left()
        yield rows()

    return run


def json_objects(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(value, file, block, n) of every object of a JSON array (or, with depth 0, of objects side by side), as JSON text.

    Objects stand at `depth`: in one array by default, in an array that is an object's field with 2.  (file, block, n) is their order.
    Anything else between them is left aside, and so is an object that the file doesn't end.  Ranges are of
    spark.sql.files.maxPartitionBytes; a task holds one object, and a row for each of its ranges.
    """
    lines = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    by = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by), F.lit(0))
    ranges = lines.mapInArrow(_summaries, "file string, block long, d0 long, s0 long, d1 long")
    # a range changes the string state alike in either case: the parity of its quotes
    ranges = ranges.withColumn("s", before("s0") % 2).withColumn("d", F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1")))
    ranges = ranges.withColumn("d", before("d")).select("file", "block", "d", "s")
    pieces = lines.join(F.broadcast(ranges), ["file", "block"]).select("file", "block", "value", "d", "s")  # some 60 bytes for each range of the file
    found = pieces.mapInArrow(_pieces_to_objects(depth), "file string, block long, n long, kind string, value string")
    parts = found.where("kind <> 'WHOLE'")
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "TAIL")
    begun = F.when(F.col("kind") == "TAIL", F.struct("block", "n"))
    parts = parts.withColumn("owner", F.last(begun, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", F.col("kind").alias("k"), "value"))).alias("p"))
    ends = F.array_position("p.k", "HEAD").cast("int")  # what follows is of other nested arrays
    joined = joined.where(ends > 0).select(F.array_join(F.slice(F.col("p.value"), F.lit(1), ends), "").alias("value"), "file", F.col("owner.block").alias("block"), F.col("owner.n").alias("n"))
    return found.where("kind = 'WHOLE'").select("value", "file", "block", "n").unionByName(joined)
