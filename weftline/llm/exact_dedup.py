"""Operator 11, exact deduplication by an index of cuckoo filters over the digests of live texts.

The index has two tables, both cut into shards by the digest:

    filters (shard, slots)                   a cuckoo filter a shard: 16-bit fingerprints, four to a bucket, two buckets a key
    content (digest, size, chars, id, row)   one row for each live digest: how many rows hold it, and the best of them

and the rows (row, id, digest, chars) that it was built from.  A new row's digest is looked up in its shard's filter.  A
miss proves that the text is new: it goes in.  A hit may be false, so hits are verified against the content by their whole
digest; those that prove false go in as well, so that every live digest has a fingerprint of its own and can be deleted.
A filter that finds no place for a key is full: its shard takes no more rows in this round, and in the next one a filter of
twice the size is built from the shard's stored keys, before the rows that were left over are looked up.

Rows go through a small filter with content of its own in each task first, so that a text that a third of all rows hold
sends a row for each task (or MOST_HELD texts) to its shard.  A shard's rows stream through its task; memory holds one
filter, and the shard's keys while it is rebuilt.

Texts are equal when they are so after ASCII white space is deleted; they are known by the sha-256 of the rest.  Of equal
texts the row with the most code points in the original text is the best, then the smallest id (null comes last), then
the first row: of equal rows one stays.

Defined results: null counts as an empty text, and empty texts and texts of white space are equal.  Rows of one id and rows
without an id are rows like others.  An empty table makes an empty index.  Ids keep their type; other columns are left aside.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Texts that a task holds to find copies before rows are sent to their shards.
MOST_HELD = 50_000
#: Fingerprints in a bucket, and how often one is moved before the filter counts as full.
SLOTS, MOST_MOVES = 4, 500
#: Shards for each shuffle partition, so that partitions get about as much each.
SHARDS_A_PARTITION = 8

FILTER, KEY, NEW, FORCED, GONE, ASKED = range(6)  # kinds of rows that meet in a shard, in the order they are worked off


class CuckooFilter:
    """A set of digests by their fingerprints: no false misses, and what went in can be deleted."""

    def __init__(self, buckets_log2: int, slots: bytes | None = None):
        self.mask = (1 << buckets_log2) - 1
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS << buckets_log2))

    @classmethod
    def of(cls, slots: bytes) -> CuckooFilter:
        return cls((len(slots) // (2 * SLOTS)).bit_length() - 1, slots)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """Room for n keys at a load of about three quarters or less."""
        return cls(max(1, -(-n * 4 // (3 * SLOTS))).bit_length())

    def _place(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[8:16], "little") & self.mask, int.from_bytes(digest[16:18], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _find(self, bucket: int, mark: int) -> int:
        """The mark's slot in the bucket, or -1."""
        at = bucket * SLOTS
        try:
            return self.slots.index(mark, at, at + SLOTS)
        except ValueError:
            return -1

    def __contains__(self, digest: bytes) -> bool:
        bucket, mark = self._place(digest)
        return self._find(bucket, mark) >= 0 or self._find(self._other(bucket, mark), mark) >= 0

    def add(self, digest: bytes) -> bool:
        """False where no place was found; the filter has lost a mark then and must be built anew."""
        bucket, mark = self._place(digest)
        turn = mark
        for b in (bucket, self._other(bucket, mark)):
            if (at := self._find(b, 0)) >= 0:
                self.slots[at] = mark
                return True
        for _ in range(MOST_MOVES):
            turn = (turn * 1103515245 + 12345) & 0x7FFFFFFF
            at = bucket * SLOTS + (turn >> 16) % SLOTS
            mark, self.slots[at] = self.slots[at], mark
            bucket = self._other(bucket, mark)
            if (at := self._find(bucket, 0)) >= 0:
                self.slots[at] = mark
                return True
        return False

    def remove(self, digest: bytes) -> bool:
        """Takes out one mark of a digest that is in."""
        bucket, mark = self._place(digest)
        for b in (bucket, self._other(bucket, mark)):
            if (at := self._find(b, mark)) >= 0:
                self.slots[at] = 0
                return True
        return False

    def doubled(self, keys: list[bytes]) -> CuckooFilter:
        """A filter of the keys, of twice this one's size or more."""
        log2 = (self.mask + 1).bit_length()
        while True:
            out = CuckooFilter(log2)
            if all(map(out.add, keys)):
                return out
            log2 += 1


# --- steps within tasks -------------------------------------------------------------------------------
_DIGEST = pa.binary()
_BEST = "size long, chars long, id {kind}, row long"


def _best() -> list:
    """Of rows with one digest: how many there are, and the best one's columns."""
    best_first = F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"), F.col("row"))
    return [F.sum("size").alias("size"), F.min_by(F.struct("chars", "id", "row"), best_first).alias("best")]


def _within_tasks(prints: DataFrame, kind: str) -> DataFrame:
    """(digest, size, chars, id, row): rows with one digest that a task meets close together are one row, with the best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, content = CuckooFilter.for_keys(MOST_HELD), {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*((d, *v) for d, v in content.items()), strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "size", "chars", "id", "row"])

        types = None
        for batch in batches:
            types = [_DIGEST, pa.int64(), pa.int64(), batch.schema.field("id").type, pa.int64()]
            for row, id_, digest, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest in held and (have := content.get(digest)) is not None:
                    have[0] += 1
                    if (-chars, id_ is None, id_ if id_ is not None else 0, row) < (-have[1], have[2] is None, have[2] if have[2] is not None else 0, have[3]):
                        have[1:] = [chars, id_, row]
                    continue
                if len(content) >= MOST_HELD or not held.add(digest):
                    yield out()
                    held, content = CuckooFilter.for_keys(MOST_HELD), {}
                    held.add(digest)
                content[digest] = [1, chars, id_, row]
        if content:
            yield out()

    return prints.select("row", "id", "digest", "chars").mapInArrow(run, f"digest binary, {_BEST.format(kind=kind)}")


def _in_shards(rows: DataFrame, shards: int, room: int, kind: str) -> DataFrame:
    """Rows of all kinds (shard, kind, slots, digest, ...) met by shard: filters as they are after, and NEW, FORCED and ASKED rows with `hit`.

    hit is null for a row that found its shard's filter full (and for FORCED and GONE rows that did their work it is false).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filt, keys, full = None, None, [], False
        for batch in batches:
            hits, keep, ended = [], [], []

            def end() -> None:
                if shard is not None:
                    ended.append((shard, filt.slots.tobytes()))  # noqa: B023

            for at, (s, k, slots, digest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "slots", "digest")), strict=True)):
                if s != shard:
                    end()
                    shard, filt, keys, full = s, CuckooFilter.for_keys(room), [], False
                if k == FILTER:
                    filt = CuckooFilter.of(slots)
                    continue
                if k == KEY:
                    keys.append(digest)
                    continue
                if keys:  # all stored keys are here: twice the room
                    filt, keys = filt.doubled(keys), []
                hit = None
                if not full:
                    hit = k in (NEW, ASKED) and digest in filt
                    if k == GONE:
                        filt.remove(digest)
                    elif k != ASKED and not hit and not filt.add(digest):
                        full, hit = True, None
                keep.append(at)
                hits.append(hit)
            if keep:
                part = batch.take(pa.array(keep))  # from_arrays: all batches must say alike which columns may be null
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.bool_())], names=[*part.schema.names, "hit"])
            if ended:
                yield blank(batch.schema, ended)
        if shard is not None:
            if keys:
                filt = filt.doubled(keys)
            yield blank(batch.schema, [(shard, filt.slots.tobytes())])

    def blank(schema: pa.Schema, ended: list[tuple[int, bytes]]) -> pa.RecordBatch:
        cols = {"shard": [s for s, _ in ended], "kind": [FILTER] * len(ended), "slots": [b for _, b in ended]}
        return pa.RecordBatch.from_arrays([pa.array(cols.get(f.name, [None] * len(ended)), f.type) for f in schema] + [pa.nulls(len(ended), pa.bool_())], names=[*schema.names, "hit"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("shard", "kind", "slots", "digest", "size", "chars", "id", "row").repartition(n, "shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(run, f"shard int, kind int, slots binary, digest binary, {_BEST.format(kind=kind)}, hit boolean")


# --- the index ----------------------------------------------------------------------------------------
@dataclass
class DigestIndex:
    """An index and what it holds; insert and delete give a new one, whose tables are written to the shared folder."""

    shards: int
    rows: DataFrame  # row, id, digest, chars
    content: DataFrame  # digest, size, chars, id, row
    filters: DataFrame  # shard, slots
    kind: str  # the ids' type

    @classmethod
    def empty(cls, spark: SparkSession, kind: str = "bigint", shards: int | None = None) -> DigestIndex:
        none = lambda schema: spark.createDataFrame([], schema)
        n = shards or SHARDS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(n, none(f"row long, id {kind}, digest binary, chars long"), none(f"digest binary, {_BEST.format(kind=kind)}"), none("shard int, slots binary"), kind)

    def _rows(self, df: DataFrame, kind: int) -> DataFrame:
        """Rows with a digest as ones of a kind that meet in shards."""
        lacking = [F.lit(None).cast(t).alias(c) for c, t in (("slots", "binary"), ("size", "long"), ("chars", "long"), ("id", self.kind), ("row", "long")) if c not in df.columns]
        shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(self.shards)).cast("int")
        return df.select("*", *lacking, shard.alias("shard"), F.lit(kind).alias("kind")).select("shard", "kind", "slots", "digest", "size", "chars", "id", "row")

    def _met(self, todo: DataFrame, room: int) -> tuple[DataFrame, list[DataFrame]]:
        """(filters after, tables of the rows with their hits): rounds until no filter is full."""
        filters, keys, done = self.filters, None, []
        while True:
            given = filters.select("shard", F.lit(FILTER).alias("kind"), "slots", *(F.lit(None).cast(t).alias(c) for c, t in (("digest", "binary"), ("size", "long"), ("chars", "long"), ("id", self.kind), ("row", "long"))))
            both = given.unionByName(todo) if keys is None else given.unionByName(keys).unionByName(todo)
            out = stored(_in_shards(both, self.shards, room, self.kind), "shards")
            filters = out.where(F.col("kind") == FILTER).select("shard", "slots")
            done.append(out.where((F.col("kind") != FILTER) & F.col("hit").isNotNull()))
            todo = out.where((F.col("kind") != FILTER) & F.col("hit").isNull()).drop("hit")
            if todo.isEmpty():
                return filters, done
            live = self.content.select("digest")
            for d in done:
                live = live.unionByName(d.where(F.col("kind").isin(NEW, FORCED) & ~F.col("hit")).select("digest"))
            keys = self._rows(live, KEY).join(F.broadcast(todo.select("shard").distinct()), "shard", "left_semi")  # a number for each shard at most

    def insert(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
        """The index with df's rows as well."""
        bare = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")
        first = self.rows.agg(F.coalesce(F.max("row"), F.lit(-1))).first()[0] + 1  # type: ignore[index]
        prints = df.select(F.col(id_col).cast(self.kind).alias("id"), F.unhex(F.sha2(bare, 256)).alias("digest"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"))
        prints = stored(prints.select((F.monotonically_increasing_id() + first).alias("row"), "*"), "digests")
        filters, done = self._met(self._rows(_within_tasks(prints, self.kind), NEW), prints.count() // self.shards)
        looked = done[0]
        for d in done[1:]:
            looked = looked.unionByName(d)
        columns = ("digest", "size", "chars", "id", "row")
        # misses are new texts, one row each; hits are verified by the join on whole digests, and those that match nothing are new too
        sure = self.content.select(*columns).unionByName(looked.where(~F.col("hit")).select(*columns))
        hits = looked.where("hit").groupBy("digest").agg(*_best()).select("digest", F.col("size").alias("more"), F.col("best").alias("other"))
        both = sure.withColumn("best", F.struct("chars", "id", "row")).select("digest", "size", "best").join(hits, "digest", "full")
        key = lambda c: F.struct(-F.col(f"{c}.chars"), F.col(f"{c}.id").isNull(), F.col(f"{c}.id"), F.col(f"{c}.row"))
        better = F.when(F.col("best").isNull() | (F.col("other").isNotNull() & (key("other") < key("best"))), F.col("other")).otherwise(F.col("best"))
        content = both.select("digest", (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"), better.alias("best"), F.col("best").isNull().alias("false_hit"))
        content = stored(content.select("digest", "size", "best.*", "false_hit"), "content")
        after = DigestIndex(self.shards, self.rows.unionByName(prints), content.select(*columns), filters, self.kind)
        false_hits = content.where("false_hit").select("digest")
        if not false_hits.isEmpty():
            after.filters, _ = DigestIndex(self.shards, after.rows, after.content, filters, self.kind)._met(after._rows(false_hits, FORCED), 1)
        return after

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> DigestIndex:
        """The index without the rows of these ids; a digest that no row holds any more leaves its filter."""
        gone = ids.select(F.col(id_col).cast(self.kind).alias("id")).distinct()
        rows = stored(self.rows.join(gone, "id", "left_anti"), "digests")
        live = rows.withColumn("size", F.lit(1)).groupBy("digest").agg(*_best())
        content = stored(live.select("digest", "size", "best.*"), "content")
        lost = stored(self.content.select("digest").join(content, "digest", "left_anti"), "lost")
        filters, _ = self._met(self._rows(lost, GONE), 1)
        return DigestIndex(self.shards, rows, content, filters, self.kind)

    def known(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, keep_id, group_size) of df's rows whose text a live row holds; df itself is left out of the index."""
        bare = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")
        asked = df.select(F.col(id_col).cast(self.kind).alias("id"), F.unhex(F.sha2(bare, 256)).alias("digest"))
        _, done = self._met(self._rows(asked, ASKED), 1)
        held = self.content.select("digest", F.col("id").alias("keep_id"), F.col("size").alias("group_size"))
        return done[0].where("hit").select("id", "digest").join(held, "digest").select(F.col("id").alias(id_col), "keep_id", "group_size")

    def groups(self, id_col: str = "doc_id") -> DataFrame:
        """(id, keep_id, group_size, kept, text_sha256) of every row that is in; one row of each group of equal texts is kept."""
        shared = self.content.where("size > 1").select("digest", "size", F.col("id").alias("best_id"), F.col("row").alias("best_row"))
        joined = self.rows.join(shared, "digest", "left")
        alone = F.col("size").isNull()
        return joined.select(
            F.col("id").alias(id_col),
            F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return DigestIndex.empty(spark, docs.schema["doc_id"].dataType.simpleString()).insert(docs).groups()


SQL = r"""
WITH bare AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM bare WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
