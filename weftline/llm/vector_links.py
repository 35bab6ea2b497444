"""Operator 7, embedding near-dedup: collision-counting projections.

Equal vectors of a label are one class with a multiplicity, however many there are.  A class's values on many random
one-dimensional projections are compared: within a group of classes each projection is sorted, each class collides
with those in the window centred on its own value, and pairs that collide on enough of the projections are verified by
their cosine in double precision.  A pair with `counts` of `windows` collisions misses at most windows - counts, so it
collides on one of the first windows - counts + 1 projections: those are sorted for pairs, the others only counted.

One projection separates little (in 64 dimensions a window that near vectors share holds a quarter of all others), so
counting over whole labels would be quadratic.  So classes meet in cells first: a table cuts several more projections
into intervals, and a cell holds the classes of one label whose intervals are the same.  The cuts of a table grow with
the logarithm of the largest label, so that a cell holds few classes by chance, and the tables with them, so that the
recall stays; together the work grows as rows to the power of about 1.15, besides the links themselves.  Which pairs
are compared is thus decided by the cells; a pair counts in the first table where it meets.

Calibration, for a pair right at the least cosine c (distance d = sqrt(2 - 2c) on the unit sphere, so projections
differ by a normal deviate of d): a table keeps it with probability (1 - 0.8 d / width)^cuts, all tables miss it with
the remainder to the power of tables (at most `miss`); a window of 2.5 d is met with probability 0.9876, and `counts`
is the largest count that a pair reaches with probability 0.9995.  No cell is cut off: one with more than `block`
classes is compared block by block, and tiles are dealt by hash into buckets of bounded size.

Defined results: null labels, null ids, and vectors that are null, empty, zero or hold null or non-finite components
link with nothing: no links, their own component (null for a null id), kept.  Vectors of unlike lengths don't link.
Rows of one id and vector are as many vectors.  Labels of any type are compared as they are; ids must be integers.
Only the three columns named are read, whatever else there is; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, mix, stored

#: Logarithm by which a cut lowers the share of the vectors that fall into one interval by chance (width 6 d, c 0.98).
PER_CUT = 1.1
#: Bytes of the rows that a bucket of tiles holds on average, and pairs that are looked at together.
BUCKET_BYTES, PAIRS = 16 << 20, 1 << 16


class Plan:
    """Projections and thresholds for one least cosine."""

    def __init__(self, cosine: float = 0.98, tables: int = 12, cuts: int = 8, windows: int = 16, block: int = 1024, seed: int = 11):
        self.cosine, self.tables, self.cuts, self.windows, self.block, self.seed = cosine, tables, cuts, windows, block, seed
        d = math.sqrt(2 - 2 * cosine)
        self.width, self.window = 6 * d, 2.5 * d
        p = math.erf(2.5 / math.sqrt(2))
        tail = lambda c: sum(math.comb(windows, k) * p**k * (1 - p) ** (windows - k) for k in range(c, windows + 1))
        self.counts = max(c for c in range(windows + 1) if tail(c) >= 0.9995)
        self._lines: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def sized(cls, rows: int, miss: float = 0.005, **settings) -> Plan:
        """The plan for a largest label of so many classes, whose cells miss a pair at the threshold with probability `miss`."""
        cuts = max(2, round(math.log(max(rows, 2)) / PER_CUT))
        keeps = (1 - 0.8 / 6) ** cuts
        return cls(cuts=cuts, tables=math.ceil(math.log(miss) / math.log(1 - keeps)), **settings)

    def projections(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if dim not in self._lines:
            rng = np.random.default_rng([self.seed, dim])
            self._lines[dim] = rng.standard_normal((dim, self.tables * self.cuts)), rng.uniform(0, self.width, self.tables * self.cuts), rng.standard_normal((dim, self.windows))
        return self._lines[dim]

    def cells(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table, as a hash of the label's hash, length, table and intervals."""
        lines, shift, _ = self.projections(unit.shape[1])
        at = np.floor((unit @ lines + shift) / self.width).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.cuts)
        with np.errstate(over="ignore"):
            h = mix(label.astype(np.int64).view(np.uint64) * np.uint64(31) + np.uint64(unit.shape[1]))[:, None] + np.arange(self.tables, dtype=np.uint64)[None, :]
            h = mix(h)
            for k in range(self.cuts):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + at[:, :, k])
        return h.view(np.int64)


def collisions(tile: np.ndarray, values: np.ndarray, window: float, counts: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of one tile that collide on `counts` or more projections (columns of values), each once, in parts.

    The first projections are sorted within tiles, and each place meets those up to a window above its own value; the
    collisions on all projections are then counted for each pair.
    """
    spare = values.shape[1] - counts
    span = float(np.ptp(values)) + window + 1 if len(values) else 1.0
    for line in range(spare + 1):
        order = np.lexsort((values[:, line], tile))
        key = tile[order] * span + (values[order, line] - values.min())
        n = np.searchsorted(key, key + window, side="right") - np.arange(len(key)) - 1
        last = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(int(np.searchsorted(last, (last[at - 1] if at else 0) + most, side="right")), at + 1)
            part = n[at:to]
            if part.any():
                first = np.cumsum(part) - part
                i = np.repeat(np.arange(at, to), part)
                j = i + 1 + np.arange(len(i)) - np.repeat(first, part)
                i, j = order[i], order[j]
                if line:  # met on an earlier projection: counted there
                    new = (np.abs(values[i, :line] - values[j, :line]) > window).all(axis=1)
                    i, j = i[new], j[new]
                enough = (np.abs(values[i] - values[j]) <= window).sum(axis=1) >= counts
                if enough.any():
                    yield i[enough], j[enough]
            at = to


def links(df: DataFrame, plan: Plan | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; without a plan, one is sized for the largest label."""
    vector = F.col(vector_col)
    kind = df.schema[vector_col].dataType
    of = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    fine = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.cast(f"array<{of}>").alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    classes = stored(keyed.where("fine").groupBy("label", "k1", "k2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "classes")
    # an id may stand for several vectors: a class is known by its place
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    per_label = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"))
    most, dim = per_label.agg(F.max("n"), F.max("dim")).first()
    plan = plan or Plan.sized(most or 1, cosine=cosine)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            flat, offsets = batch.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
            for size in np.unique(np.diff(offsets)):
                at = np.flatnonzero(np.diff(offsets) == size)
                for part in np.array_split(at, -(-len(at) // 4096)):
                    x = flat[offsets[part][:, None] + np.arange(size)].astype(np.float64)
                    x = x / np.abs(x).max(axis=1)[:, None]
                    cells = plan.cells(x / np.linalg.norm(x, axis=1)[:, None], label[part])
                    same = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([same.column(0), same.column(2), same.column(3), pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), plan.tables).cast(pa.list_(pa.int64()))], names=["node", "copies", "v", "cells"])

    held = stored(classes.select("node", F.xxhash64("label").alias("h"), "copies", "v").mapInArrow(meet, f"node long, copies long, v array<{of}>, cells array<long>"), "cells")
    spots = held.select("node", F.posexplode("cells").alias("t", "cell"))
    sizes = stored(spots.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    n_blocks = F.ceil(F.col("n") / plan.block).cast("int")
    n_rows = sizes.agg(F.sum(F.col("n") * n_blocks)).first()[0] or 0
    buckets = max(1, -(-n_rows * (8 * (dim or 1) + 8 * plan.tables + 64) // BUCKET_BYTES), min(n_rows // 2048, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    tiles = (
        spots.join(sizes, "cell").withColumn("blocks", n_blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "t", "cell", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .withColumn("bucket", F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(buckets).cast("long")))
        .join(held, "node")
    )

    def verify(table: pa.Table) -> pa.Table:
        cell, lo, hi, own, t, node, copies = (table.column(c).to_numpy() for c in ("cell", "lo", "hi", "own", "t", "node", "copies"))
        vectors = table.column("v").combine_chunks()
        flat, length = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()
        begin = np.cumsum(length) - length
        seen = table.column("cells").combine_chunks().flatten().to_numpy().reshape(len(cell), -1)
        tables = np.arange(seen.shape[1])
        total, root = np.zeros(len(cell), np.int64), np.arange(len(cell))
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            at = at[np.lexsort((hi[at], lo[at], cell[at]))]
            new = np.ones(len(at), bool)
            new[1:] = (cell[at][1:] != cell[at][:-1]) | (lo[at][1:] != lo[at][:-1]) | (hi[at][1:] != hi[at][:-1])
            x = flat[begin[at][:, None] + np.arange(size)].astype(np.float64)
            x = x / np.abs(x).max(axis=1)[:, None]
            square = np.einsum("ij,ij->i", x, x)
            values = (x / np.sqrt(square)[:, None]) @ plan.projections(int(size))[2]
            for i, j in collisions(np.cumsum(new), values, plan.window, plan.counts):
                u, v = at[i], at[j]
                ok = (lo[u] == hi[u]) | (own[u] != own[v])
                ok[ok] = ~((seen[u[ok]] == seen[v[ok]]) & (tables < t[u[ok]][:, None])).any(axis=1)
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= plan.cosine * np.sqrt(square[i] * square[j])
                u, v = at[i[ok]], at[j[ok]]
                np.add.at(total, u, copies[v])
                np.add.at(total, v, copies[u])
                while (root[u] != root[v]).any():  # every root takes the least one that a link joins it to
                    least = np.minimum(root[u], root[v])
                    for end in (u, v):
                        np.minimum.at(root, root[end], least)
                        np.minimum.at(root, end, least)
                    while (root[root] != root).any():
                        root = root[root]
        hit = np.flatnonzero(total)
        # a class is in a tile of its own for each table and block: one row a class and root
        found = pa.table({"node": pa.array(node[hit]), "links": pa.array(total[hit]), "root": pa.array(node[root[hit]])})
        return found.group_by(["node", "root"]).aggregate([("links", "sum")]).rename_columns(["node", "root", "links"]).select(["node", "links", "root"])

    found = stored(tiles.groupBy("bucket").applyInArrow(verify, "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = connected_components(found.select("node", "root"), "node", "root")
    groups = part.join(classes.select(F.col("node"), "class"), "node").groupBy("component").agg(F.min("class").alias("least"))
    result = (
        classes.select("node", "label", "k1", "k2", "class", "copies").join(counts, "node", "left").join(part, "node", "left").join(groups, "component", "left")
        .select("label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "class").alias("c"))
    )
    result = stored(result, "vectors")
    out = keyed.drop("v").join(result.withColumn("fine", F.lit(True)), ["label", "k1", "k2", "fine"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
