"""What the operators share: materialised tables, Arrow text buffers, word hashes, components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_MASK = (1 << 64) - 1


# --- materialised tables ---------------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; one of our own only where that is unset on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jvm_dir.get() if jvm_dir.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = f"/tmp/checkpoints/weftline-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Hadoop resolves one without: workers that open it themselves then reach the same store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_all() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the shared folder's owner clears it then
            return


atexit.register(_delete_all)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a stored() table's files."""
    spark = df.sparkSession
    total = 0
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        total += target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return total


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores after them until none is among those taken (which are compared without case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for at, (_, p) in enumerate(_WRITTEN):
            if path.endswith(p.split("://")[-1].split("/", 1)[-1]):
                _delete(spark, p)
                del _WRITTEN[at]
                break


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's number (from 1) in the given order, which should tell any two rows apart.

    Rows are sorted by ranges, and a range's rows come after those of the ranges before it: one sum a range meets in one
    place, nothing else.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, part, before = fresh((*df.columns, name), "place", "part", "before")
    rows = (1 << 33) - 1  # what monotonically_increasing_id leaves for the rows of a partition
    placed = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranks")
    parts = placed.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count(F.lit(1)).alias(before))
    sums = F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(parts.select(part, sums.alias(before))), part)
    return placed.withColumn(name, F.col(before) + F.col(place).bitwiseAND(rows) + 1).drop(place, part, before)


# --- texts in Arrow batches -------------------------------------------------------------------
def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most most_bytes of text each (one row at least), so that memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_large_string(col.type):
            offsets = np.frombuffer(col.buffers()[1], np.int64)
        else:
            offsets = np.frombuffer(col.buffers()[1], np.int32)
        offsets = offsets[col.offset : col.offset + batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, int(offsets[at]) + most_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets from 0) of a string column; null texts are empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- word hashes -------------------------------------------------------------------------------
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C55 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _R, np.uint64), np.full(size, _R_INV, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word of the texts laid end to end: `[^\\x20\\x09-\\x0D]+`, or runs of the bytes marked in `word`."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    if word is None:
        word = ~SPACES[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_at = offsets[1:] - 1
    ends_at = ends_at[ends_at >= 0]
    last[ends_at] |= word[ends_at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word: a polynomial over random byte values, mixed with the word's length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up, out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` neighbouring word hashes (in order); len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, width):
            out = mix(out + h[k : k + n])
            out *= np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


class WordTable:
    """Ids of words by the words' hashes: open addressing in arrays, so that a batch's words are looked up together."""

    def __init__(self, slots_log2: int):
        self.shift, self.mask = np.uint64(64 - slots_log2), (1 << slots_log2) - 1
        self.keys = np.zeros(1 << slots_log2, np.uint64)
        self.start, self.count = np.zeros(1 << slots_log2, np.uint32), np.zeros(1 << slots_log2, np.uint32)
        self.ids = np.zeros(1 << 16, "<u4")
        self.n = self.n_ids = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash (none is 0), -1 for those that aren't here."""
        out = np.full(len(h), -1, np.int64)
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New distinct hashes with the number of their ids and the ids in a row."""
        need = self.n_ids + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), "<u4")])
        self.ids[self.n_ids : need] = ids
        first = self.n_ids + np.cumsum(counts) - counts
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            done = free & (self.keys[slot] == h[left])
            self.start[slot[done]], self.count[slot[done]] = first[left[done]], counts[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & self.mask
        self.n, self.n_ids = self.n + len(h), need

    def ids_at(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids in each slot, all their ids in a row)."""
        n = self.count[slot].astype(np.int64)
        last = np.cumsum(n)
        return n, self.ids[np.repeat(self.start[slot].astype(np.int64) - (last - n), n) + np.arange(last[-1] if len(last) else 0)]


# --- connected components ----------------------------------------------------------------------
def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest id reachable.

    Alternating large-star and small-star contraction: each round is two shuffles of at most as many rows as
    there are edges, and rounds grow with the logarithm of a component's size.  No link leaves the executors.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    e = stored(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node points at the smallest of its smaller neighbours, and so do those neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old, e = e, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(old)
        if before == state:
            break
        before = state
    roots = e.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
    return e.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
