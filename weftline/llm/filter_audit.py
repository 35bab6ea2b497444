"""Operator 13, filter interaction audit: what each filter removes at each step of every order, and its Shapley share.

A document fails some of five filters; the set of those is its mask.  Texts are read once, and what is left of them are
cells: for each part (source) and mask the number of documents, of good ones and of toxic ones.  A step of an order removes
the documents that fail its filter and none before it, so it depends on the filter and on the set of those before it alone.
The walk visits all 120 orders by swaps of two neighbours (a plain-changes walk): a swap changes two steps, and only those two
are counted anew from the cells, for all parts of a batch at once.  Shapley shares add up along the walk.

Filters (words: `[^\\x20\\x09-\\x0D]+`, case-sensitive): A under 200 words; B less than half of the words are distinct; C more
than 2 capitals A-Z in 100 code points; D any of `[#$%&*|]`; E the whole text is that of a row of a smaller id.

Defined results: null is an empty text (it fails A alone, and E where a smaller id has an empty one) and a null source an empty
string.  Rows of one id are rows like others and no copies of each other by E; a row without an id has no smaller one, and is
none.  A document is good or toxic if any of its labels says so, and one without an id has no label.  Parts without documents don't exist, so an empty table gives an
empty result.  Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
_MASKS = 1 << len(FILTERS)
_SPACE = r"[\x20\x09-\x0D]+"


# --- masks and cells -------------------------------------------------------------------------------
def failed(text: Column) -> Column:
    """The filters A to D that a text fails, as a sum of 1, 2, 4, 8."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail just the filters of the mask.

    Copies are known by the sha-256 of their text.  The join with the smallest id of each text that several rows hold has many
    rows of one key where a text has many copies; they stand on one side of it only, and the other side is a stored table
    (no aggregate that needs a key's rows together), so the engine can split it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed(text).alias("own"))
    seen = stored(seen, "masks")
    first = stored(seen.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first"), "firsts")
    marked = seen.join(first, "digest", "left").select("id", "part", (F.col("own") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    says = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counted = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    return marked.join(says, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), counted("good"), counted("toxic"))


# --- the walk -----------------------------------------------------------------------------------------
def plain_changes(n: int) -> Iterator[int]:
    """The places i at which i and i + 1 change, so that all n! orders are visited, each once.

    The last item goes back and forth through all places; whenever it stands at an end, the others make one change of theirs.
    """
    if n < 2:
        return
    down, others = True, plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        down = not down
        change = next(others, None)
        if change is None:
            return
        yield change + (not down)


def walk(counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """counts: (parts, masks, 3) documents, good and toxic ones.  Gives the orders, what each of their steps counts, and Shapley sums.

    The step counts are (orders, steps, parts, 6): kept, removed, redundant, unique_fails, good_lost, toxic_lost.
    """
    masks = np.arange(_MASKS)
    order = list(range(len(FILTERS)))
    now = np.zeros((len(order), len(counts), 6), np.int64)
    names, steps, share = [], [], np.zeros((len(order), len(counts)), np.int64)

    def count(step: int) -> None:
        f, before = order[step], sum(1 << x for x in order[:step])
        fails = masks >> f & 1 == 1
        lost = counts[:, fails & (masks & before == 0)].sum(1)
        now[step, :, 0] = counts[:, masks & (before | 1 << f) == 0, 0].sum(1)
        now[step, :, 1] = lost[:, 0]
        now[step, :, 2] = counts[:, fails & (masks & before != 0), 0].sum(1)
        now[step, :, 3] = counts[:, 1 << f, 0]
        now[step, :, 4:] = lost[:, 1:]

    def visit() -> None:
        names.append("".join(FILTERS[f] for f in order))
        steps.append(now.copy())
        for step, f in enumerate(order):
            share[f] += now[step, :, 1]

    for step in range(len(order)):
        count(step)
    visit()
    for i in plain_changes(len(order)):
        order[i], order[i + 1] = order[i + 1], order[i]
        count(i)
        count(i + 1)
        visit()
    return names, np.array(steps), share


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: what is counted there, and the Shapley sum of the step's filter."""
    cell = F.struct("mask", "n", "good", "toxic")
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(cell).alias("cells"))  # at most 32 a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # 64 parts make 38,400 rows
                batch = whole.slice(at, 64)
                counts = np.zeros((batch.num_rows, _MASKS, 3), np.int64)
                for p, held in enumerate(batch.column(1).to_pylist()):
                    for c in held:
                        counts[p, c["mask"]] = c["n"], c["good"], c["toxic"]
                names, steps, share = walk(counts)
                orders, n_steps, parts, _ = steps.shape
                filters = np.array([[FILTERS.index(f) for f in name] for name in names])
                each = [steps[..., k].reshape(-1) for k in range(6)]
                shapley = share[filters].reshape(-1)
                cols = {
                    "part": batch.column(0).take(pa.array(np.tile(np.arange(parts), orders * n_steps))),
                    "filter_order": pa.array(np.repeat(names, n_steps * parts)),
                    "step": pa.array(np.tile(np.repeat(np.arange(1, n_steps + 1, dtype=np.int32), parts), orders)),
                } | {name: pa.array(v) for name, v in zip(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), each, strict=True)}
                yield pa.RecordBatch.from_pydict(cols | {"shapley": pa.array(shapley)})

    numbers = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return by_part.mapInArrow(run, f"part string, filter_order string, step int, {numbers}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), marked AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, doc_id > first AS e FROM worded
), masked AS (
  SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM marked
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY ALL
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i:i] AS f, filter_order[1:i - 1] AS before FROM orders, range(1, 6) r(i)
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS fails_it, fails = f AS only_it,
         fails <> '' AND before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND fails_it), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (only_it), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
