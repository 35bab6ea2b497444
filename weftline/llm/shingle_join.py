"""Operator 5, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Texts are sets of distinct word shingles; two link when their Jaccard similarity is `threshold` per cent or more.

1. Equal sets are one node, however many texts have them: nodes, not texts, are compared from here on.
2. Shingles are put in one order, rare ones first.  How common one is comes from a table of counts by hash over all
   texts, of a fixed size; it only orders, so shared slots cost time and never a link.  Two sets that link share a
   shingle among the first n - ceil(n * threshold) + 1 of each, so these prefixes are dealt out by shingle.
3. Neighbours by size within a shingle's run that meet often are verified, and what links is joined into components.
4. What is left are runs that hold several components.  They are cut into tiles; a large run's tiles are of bands of
   sizes (of two sizes that can link, one is in the other's band or the next) and of blocks within a band.  In a tile
   every pair of unlike components meets: the bits in which two bitmap signatures differ bound the overlap from above,
   and pairs that pass are verified by exact intersection of their sorted arrays.  Signatures come in two lengths; the
   short one goes first, and only what it lets through is sent the long one, then the arrays.  Small runs send their
   pairs, each once; tiles of large runs send the sets that have a likely partner, never pairs, verify within the tile
   and give the links that join components alone.

So no link is missed, no pair is sent for a run that is one component already, and no task holds a whole hot run.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts of fewer than `width` words
have one shingle, their sequence.  component_id is the smallest id of the component (null where all are null); rows of
one id are as many texts.  Only the two columns named are read, ids must be integers or null, and an empty table stays
empty.  Sets are compared as 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, mix, slices, stored, text_bytes, window_hashes, word_hashes, word_spans

#: Slots of the table of counts (a power of two): what is broadcast has one byte each, whatever the input.
SLOTS_LOG2 = 20
SLICES = 32
#: Rows of a run up to which its pairs are sent, and rows up to which a larger one is one tile, and of a block of it.
SMALL, BLOCK = 32, 512
#: Bytes of postings or tiles that a bucket, which one task holds, has on average at most.
BUCKET_BYTES = 32 << 20
#: Ids up to which the texts to verify are picked by a broadcast (16 MB); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4")])


# --- sets ----------------------------------------------------------------------------------------
def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' distinct shingle hashes, ascending within each text; where each text's begin and end)."""
    n = len(offsets) - 1
    start, end, doc = word_spans(raw, offsets)
    h = word_hashes(raw, start, end)
    w = window_hashes(h, width)
    at = np.flatnonzero(doc[: len(w)] == doc[width - 1 :]) if len(w) else np.zeros(0, np.int64)
    shingle, of = w[at], doc[at]
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        extra = np.array([window_hashes(h[first[k] : first[k] + words[k]], int(words[k]))[0] for k in short], np.uint64)
        shingle, of = np.concatenate([shingle, extra]), np.concatenate([of, short])
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])
    shingle, of = shingle[new], of[new]
    return shingle, np.searchsorted(of, np.arange(n + 1))


def set_keys(shingle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each whole set (0 for an empty one)."""
    total = np.zeros(len(shingle) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
        size = np.diff(bounds)
        key = mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    key[size == 0] = 0
    return key.view(np.int64)


def least_overlap(a, b, threshold: int):
    """The smallest overlap with which sets of a and b elements link: 100 * i >= threshold * (a + b - i)."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_length(n, threshold: int):
    return n + 1 + (-threshold * n // 100)


def bitmap(shingle: np.ndarray) -> np.ndarray:
    """A signature of 4 to 8 bits an element (a power of two): bit h of it is set for some element of hash h."""
    words = 1 << max(0, (max(len(shingle), 1) - 1).bit_length() - 4)
    out = np.zeros(words * 64, bool)
    out[(mix(shingle) & np.uint64(words * 64 - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view("<u8")


def _fold(words: np.ndarray, to: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, to), axis=0) if len(words) > to else words


def overlap_bound(x: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of pairs of sets, from their signatures: each bit that differs is an element in one only."""
    out = np.zeros(len(i), np.int64)
    size = np.array([len(w) for w in x], np.int64)
    common = np.minimum(size[i], size[j])
    for words in np.unique(common):
        at = np.flatnonzero(common == words)
        need = np.unique(np.concatenate([i[at], j[at]]))
        place = np.zeros(len(x), np.int64)
        place[need] = np.arange(len(need))
        table = np.stack([_fold(x[k], int(words)) for k in need])
        step = max(1, (1 << 20) // int(words))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            differ = np.bitwise_count(table[place[i[part]]] ^ table[place[j[part]]]).sum(axis=1, dtype=np.int64)
            out[part] = (n[i[part]] + n[j[part]] - differ) // 2
    return out


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Exact intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


# --- steps ---------------------------------------------------------------------------------------
def _sets_and_counts(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, node) of every row, and rows of (slice, task, counts): how often each slot was hit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOTS_LOG2, np.uint32)
        names = ["id", "n", "node", "slice", "task", "counts"]
        for batch in slices(batches, "text"):
            shingle, bounds = shingle_sets(*text_bytes(batch.column(1)), width)
            counts += np.bincount((shingle >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(set_keys(shingle, bounds)), *(pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.binary()))], names=names)
        parts = counts.reshape(SLICES, -1)
        task = TaskContext.get().partitionId()
        data = [p.astype("<u4").tobytes() for p in parts] if counts.any() else []
        n = len(data)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(3)), pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array(data, pa.binary())], names=names)

    cut = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(cut.mapInArrow(run, "id long, n long, node long, slice int, task int, counts binary"), "sets")


def _levels(sets: DataFrame) -> np.ndarray:
    """How common each slot's shingles are: 0 up to the mean, then eight more for each doubling.  One byte a slot."""
    parts = sets.where("slice is not null").select("slice", "task", "counts")

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SLOTS_LOG2) // SLICES, np.uint64)
        for chunk in table.column("counts").chunks:
            for data in chunk:
                total += np.frombuffer(data.as_buffer(), "<u8" if len(data.as_buffer()) == 8 * len(total) else "<u4")
        return pa.table({"slice": table.column("slice")[:1], "task": table.column("task")[:1], "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})

    shape = "slice int, task int, counts binary"
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    groups = isqrt(tasks) + 1  # in two steps, so that a group holds as many rows as the root of the number of tasks
    parts = parts.withColumn("task", F.pmod("task", F.lit(groups))).groupBy("slice", "task").applyInArrow(add, shape)
    rows = parts.groupBy("slice").applyInArrow(add, shape).select("slice", "counts").collect()
    counts = np.zeros((SLICES, (1 << SLOTS_LOG2) // SLICES), np.uint64)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["counts"], "<u8")
    flat = counts.ravel().astype(np.float64)
    mean = max(flat.mean(), 1.0)
    return np.clip(np.floor(8 * np.log2(np.maximum(flat / mean, 1))), 0, 255).astype(np.uint8)


def prefixes(shingle: np.ndarray, bounds: np.ndarray, levels: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of the prefixes, the set of each): the first ones in the order of level, then hash."""
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((mix(shingle), levels[(shingle >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)], of))
    rank = np.arange(len(order)) - bounds[of]
    keep = rank < prefix_length(n, threshold)[of]
    return shingle[order][keep], of[keep]


def _postings(df: DataFrame, id_col: str, text_col: str, width: int, threshold: int, levels: np.ndarray, buckets: int) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingle, bounds = shingle_sets(*text_bytes(batch.column(0)), width)
            node, n = set_keys(shingle, bounds), np.diff(bounds)
            first = np.zeros(len(node), bool)  # equal sets of a batch are sent once
            first[np.unique(node, return_index=True)[1]] = True
            token, of = prefixes(shingle, bounds, held.value, threshold)
            keep = first[of]
            token, of = token[keep], of[keep]
            bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = np.empty(len(order), _POSTING)
            rows["token"], rows["node"], rows["n"] = token[order], node[of[order]], n[of[order]]
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = [*cuts[1:].tolist(), len(order)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(cuts.tolist(), ends[: len(cuts)], strict=True)], pa.binary())], names=["bucket", "data"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, data binary")


def _runs(postings: DataFrame, threshold: int) -> DataFrame:
    """Rows (token, node, n) of the runs that could hold a link, and rows (a, b, least, met): neighbours by size in them."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("data").to_pylist()), _POSTING)
        rows = rows[np.lexsort((rows["node"], rows["n"], rows["token"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
        rows = rows[new]
        near = (rows["token"][1:] == rows["token"][:-1]) & (100 * rows["n"][:-1].astype(np.int64) >= threshold * rows["n"][1:].astype(np.int64))
        keep = np.zeros(len(rows), bool)
        keep[1:] |= near
        keep[:-1] |= near
        runs = rows[keep]
        i = np.flatnonzero(near)
        a, b, least = rows["node"][i], rows["node"][i + 1], np.minimum(rows["n"][i], rows["n"][i + 1]).astype(np.int64)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        met = np.diff(np.concatenate([first, [len(a)]])) if len(first) else first
        pad = lambda values, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(values, pa.int64()), pa.nulls(after, pa.int64())])
        r, e = len(runs), len(first)
        cols = {"token": pad(np.ascontiguousarray(runs["token"]).view(np.int64), 0, e), "node": pad(runs["node"], 0, e), "n": pad(runs["n"].astype(np.int64), 0, e)}
        cols |= {"a": pad(a[first], r, 0), "b": pad(b[first], r, 0), "least": pad(least[first], r, 0), "met": pad(met, r, 0)}
        return pa.table(cols)

    return stored(postings.groupBy("bucket").applyInArrow(run, "token long, node long, n long, a long, b long, least long, met long"), "met")


class _Corpus:
    """The texts of nodes, on demand."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, width: int, classes: DataFrame):
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.width, self.classes = width, classes

    def read(self, nodes: DataFrame, arrays: bool) -> DataFrame:
        """(node, array or null, bits, short) of the nodes (distinct), as packed sorted hashes and signatures; others may be among them."""
        wanted = stored(nodes.join(self.classes.select("node", F.col("rep").alias("id")), "node"), "wanted")
        docs, width = self.docs, self.width
        ids = wanted.select("id").distinct()
        small = wanted.count() <= MOST_BROADCAST
        texts = docs.join(F.broadcast(ids) if small else ids, docs["id"].eqNullSafe(ids["id"]), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                shingle, bounds = shingle_sets(*text_bytes(batch.column(0)), width)
                sets = [shingle[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                bits = [bitmap(s) for s in sets]
                cols = [[s.tobytes() if arrays else None for s in sets], [b.tobytes() for b in bits], [_fold(b, max(1, len(b) // 4)).tobytes() for b in bits]]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(shingle, bounds)), *(pa.array(c, pa.binary()) for c in cols)], names=["node", "array", "bits", "short"])

        return stored(texts.select("text").mapInArrow(run, "node long, array binary, bits binary, short binary"), "arrays")


def _bounded(pairs: DataFrame, bits: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose long signatures let them link."""
    one = lambda end: bits.join(sizes, "node").select(F.col("node").alias(end), F.col("bits").alias(f"{end}_bits"), F.col("n").alias(f"{end}_n"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "a_bits", "b_bits", "a_n", "b_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for s, t, n, m in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                s, t = np.frombuffer(s.as_buffer(), "<u8"), np.frombuffer(t.as_buffer(), "<u8")
                words = min(len(s), len(t))
                differ = int(np.bitwise_count(_fold(s, words) ^ _fold(t, words)).sum())
                ok.append((n + m - differ) // 2 >= least_overlap(n, m, threshold))
            got = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, arrays: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) that link: signatures first, then exact intersection."""
    one = lambda end: arrays.select(F.col("node").alias(end), F.col("array").alias(f"{end}_array"), F.col("bits").alias(f"{end}_bits"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "a_array", "b_array", "a_bits", "b_bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y, s, t in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                x, y, s, t = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y, s, t))
                need, words = least_overlap(len(x), len(y), threshold), min(len(s), len(t))
                differ = int(np.bitwise_count(_fold(s, words) ^ _fold(t, words)).sum())
                ok.append((len(x) + len(y) - differ) // 2 >= need and common_count(x, y) >= need)
            got = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _tile_pairs(tile: np.ndarray, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of equal tiles (tiles are contiguous), by their distance, in bounded parts."""
    n, d = len(tile), 1
    i = np.arange(n)
    out_i, out_j, held = [], [], 0
    while d < n:
        i = i[: np.searchsorted(i, n - d)]
        i = i[tile[i] == tile[i + d]]
        if not len(i):
            break
        out_i.append(i)
        out_j.append(i + d)
        held += len(i)
        if held >= step:
            yield np.concatenate(out_i), np.concatenate(out_j)
            out_i, out_j, held = [], [], 0
        d += 1
    if held:
        yield np.concatenate(out_i), np.concatenate(out_j)


def _tiles(runs: DataFrame, labels: DataFrame, small_run: int, block: int, threshold: int) -> DataFrame:
    """(token, lo, hi, unit, node, n, label, small) of the runs with several components, as tiles."""
    labelled = runs.join(labels, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("label"))
    labelled = stored(labelled, "labelled")
    several = stored(labelled.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("m")).where("l0 < l1").select("token", "m"), "several")
    rows = labelled.join(several, "token")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / threshold))).cast("long")
    blocks = F.ceil(F.col("m") / block).cast("long")
    unit = F.lit(1 << 32) * band + F.pmod(F.xxhash64("node"), blocks)
    small = rows.where(F.col("m") <= block).withColumns({"unit": F.lit(0).cast("long"), "lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long"), "small": F.col("m") <= small_run})
    large = rows.where(F.col("m") > block).withColumns({"unit": unit, "band": band, "blocks": blocks})
    large = large.withColumn("step", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    other = F.lit(1 << 32) * (F.col("band") + F.col("step")) + F.col("salt")
    large = large.withColumns({"lo": F.least("unit", other), "hi": F.greatest("unit", other), "small": F.lit(False)})
    cols = ["token", "lo", "hi", "unit", "node", "n", "label", "small"]
    return stored(small.select(cols).unionByName(large.select(cols)), "tiles")


def _by_tile(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("token", "lo", "hi"), F.lit(buckets)).cast("int")).groupBy("bucket")


def _open_tiles(table: pa.Table) -> tuple[pa.Table, np.ndarray, dict[str, np.ndarray]]:
    names = ("token", "lo", "hi", "unit", "node", "n", "label")
    c = {k: table.column(k).to_numpy() for k in names}
    order = np.lexsort((c["n"], c["hi"], c["lo"], c["token"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])
    return table.take(pa.array(order)), np.cumsum(new), c


def _likely(tile: np.ndarray, c: dict[str, np.ndarray], bits: list[np.ndarray], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unlike components within a tile whose sizes and signatures let them link."""
    n = c["n"]
    for i, j in _tile_pairs(tile):
        ok = (c["label"][i] != c["label"][j]) & (100 * n[i] >= threshold * n[j]) & (100 * n[j] >= threshold * n[i])
        ok &= (c["lo"][i] == c["hi"][i]) | (c["unit"][i] != c["unit"][j])
        i, j = i[ok], j[ok]
        if len(i):
            ok = overlap_bound(bits, n, i, j) >= least_overlap(n[i], n[j], threshold)
            if ok.any():
                yield i[ok], j[ok]


def _compare(tiles: DataFrame, bits: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """Rows (a, b) of small runs' likely pairs; rows (token, lo, hi, unit, node, n, label) of large ones' nodes with any.  bits: (node, bits)."""

    def run(table: pa.Table) -> pa.Table:
        table, tile, c = _open_tiles(table)
        words = [np.frombuffer(v.as_buffer(), "<u8") for chunk in table.column("bits").chunks for v in chunk]
        small = np.array(table.column("small"))
        pairs, nodes = [np.zeros((0, 2), np.int64)], np.zeros(len(tile), bool)
        for i, j in _likely(tile, c, words, threshold):
            s = small[i]
            pairs.append(np.stack([np.minimum(c["node"][i[s]], c["node"][j[s]]), np.maximum(c["node"][i[s]], c["node"][j[s]])], axis=1))
            nodes[i[~s]] = nodes[j[~s]] = True
        found = np.unique(np.concatenate(pairs), axis=0)
        at, e = np.flatnonzero(nodes), len(found)
        pad = lambda v, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(v, pa.int64()), pa.nulls(after, pa.int64())])
        names = ("token", "lo", "hi", "unit", "node", "n", "label")
        return pa.table({"a": pad(found[:, 0], 0, len(at)), "b": pad(found[:, 1], 0, len(at))} | {k: pad(c[k][at], e, 0) for k in names})

    shape = "a long, b long, token long, lo long, hi long, unit long, node long, n long, label long"
    return stored(_by_tile(tiles.join(bits, "node"), buckets).applyInArrow(run, shape), "likely")


def _within(rows: DataFrame, arrays: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """(a, b): links within large runs' tiles that join components; a pair whose components are joined already isn't looked at."""

    def run(table: pa.Table) -> pa.Table:
        table, tile, c = _open_tiles(table)
        get = lambda name: [np.frombuffer(v.as_buffer(), "<u8") for chunk in table.column(name).chunks for v in chunk]
        arrays, words = get("array"), get("bits")
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        out, seen = [], set()
        for i, j in _likely(tile, c, words, threshold):
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                u, v = root(int(c["label"][p])), root(int(c["label"][q]))
                if u == v:
                    continue
                pair = (int(c["node"][p]), int(c["node"][q]))
                if pair in seen:
                    continue
                if common_count(arrays[p], arrays[q]) >= least_overlap(len(arrays[p]), len(arrays[q]), threshold):
                    parent[max(u, v)] = min(u, v)
                    out.append(pair)
                elif len(seen) < 1 << 20:
                    seen.add(pair)
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return _by_tile(rows.join(arrays.select("node", "array", "bits"), "node"), buckets).applyInArrow(run, "a long, b long")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, width: int = 5, small_run: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) of every row; threshold in per cent, from 1 to 99."""
    if not 1 <= threshold <= 99:
        raise ValueError("threshold is in per cent, from 1 to 99")
    sets = _sets_and_counts(df, id_col, text_col, width)
    rows = sets.where("slice is null").select("id", "n", "node")
    n_shingles = rows.agg(F.sum("n")).first()[0] or 0
    n_postings = n_shingles * (100 - threshold) // 100 + 1  # prefixes; one more a set
    n_buckets = max(8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_postings * _POSTING.itemsize // BUCKET_BYTES))
    classes = stored(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("rep")), "classes")
    levels = _levels(sets)
    met = _runs(_postings(df, id_col, text_col, width, threshold, levels, n_buckets), threshold)
    corpus = _Corpus(df, id_col, text_col, width, classes)

    # neighbours by size that share a good part of a prefix: nearly all of the links of near copies
    often = met.where("a is not null").groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("least").alias("least"))
    often = stored(often.where("16 * met >= least").select("a", "b"), "often")
    arrays = corpus.read(_ends(often), arrays=True)
    links = stored(_verify(often, arrays, threshold), "links")
    labels = stored(connected_components(links, "a", "b"), "labels")

    # every other pair that could link
    tiles = _tiles(met.where("token is not null").select("token", "node", "n"), labels, small_run, block, threshold)
    bits = corpus.read(tiles.select("node").distinct(), arrays=False)
    likely = _compare(tiles, bits.select("node", F.col("short").alias("bits")), threshold, n_buckets)
    sizes = tiles.select("node", "n").distinct()
    pairs = stored(_bounded(likely.where("a is not null").select("a", "b").distinct(), bits, sizes, threshold), "pairs")
    columns = ["token", "lo", "hi", "unit", "node", "n", "label"]
    large = likely.where("token is not null").select(*columns, F.lit(False).alias("small"))
    large = _compare(large, bits.select("node", "bits"), threshold, n_buckets).where("token is not null").select(columns)
    more = corpus.read(_ends(pairs).unionByName(large.select("node")).distinct(), arrays=True)
    last = _verify(pairs, more, threshold).unionByName(_within(large, more, threshold, n_buckets))
    every = connected_components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last), "a", "b")

    whole = classes.join(every, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("part"))
    whole = stored(whole, "whole")
    least = whole.groupBy("part").agg(F.min("rep").alias("component_id"))
    of = stored(whole.join(least, "part").select("node", "component_id"), "of")
    out = rows.join(of.withColumnRenamed("node", "of_node"), (F.col("node") == F.col("of_node")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
