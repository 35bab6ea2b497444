"""Operator 12, target-distribution importance resampling: documents drawn by how much likelier the target is to hold their features.

Two Arrow passes over the texts.  The first counts the features of each task in hashed buckets by np.bincount, one vector
of `buckets` numbers a task, and treeReduce adds the vectors up; the target's texts are counted in the same way.  From both
come the gains, one whole number a bucket, which are broadcast (80 KB for 10,000 buckets, whatever the tables' size).  The
second pass looks up the gain of every feature and adds them by document, as weights of np.bincount.  A document's score
is its weight and a Gumbel number of its id's hash; the highest scores are the sample (without replacement).

Features are all runs of 1 to 3 consecutive words, joined by one space, as often as they occur.  A bucket is the CRC of the
feature's bytes; a run's CRC comes from those of its words, since a CRC of joined strings is linear in the first one's.

Defined results: null and empty texts, and texts without a word, have no features, weight 0 and are never drawn; neither
are texts of fewer than `least_words` words.  A null id is hashed as an empty one and comes last among equal scores; rows
of one id are rows like others.  An empty table gives an empty result, an empty target the gains of a target without
features.  Other columns of either table are left aside.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, slices, stored, text_bytes, word_spans

BUCKETS = 10_000
#: Longest run of words that is a feature.
LONGEST = 3
#: Bytes of text that are worked on at once (up to the end of a word).
SEGMENT = 2 << 20
#: Words of fewer bytes are joined by a table of shifts (1 KB x 4 a length); longer ones by CRC of their bytes.
SHIFTS = 256

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


# --- CRCs of runs of words -----------------------------------------------------------------------
def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """(the CRC's table of bytes; what n zero bytes make of each byte of a CRC, by n, place and byte)."""
    byte = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    byte ^= byte[0]  # linear: without what the CRC's start and end add
    out = np.zeros((SHIFTS + 1, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(SHIFTS):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ byte[out[n] & np.uint32(255)]
    return byte, out.reshape(-1)


_BYTE, _SHIFT = _shift_tables()


def _joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two strings in a row, from their CRCs and the second one's bytes (at most SHIFTS)."""
    at = length.astype(np.int64) << 10
    out = second ^ _SHIFT[at + (first & np.uint32(255))]
    for place in (1, 2, 3):
        out ^= _SHIFT[at + (place << 8) + ((first >> np.uint32(8 * place)) & np.uint32(255))]
    return out


def _word_crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC of each word's bytes: byte after byte of all words at once, the longest ones by the library."""
    n = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left, step = np.flatnonzero(n < SHIFTS), 0
    while len(left):
        crc[left] = (crc[left] >> np.uint32(8)) ^ _BYTE[(crc[left] ^ low[start[left] + step]) & np.uint32(255)]
        step += 1
        left = left[n[left] > step]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n >= SHIFTS).tolist():
        crc[i] = zlib.crc32(low[start[i] : end[i]].tobytes())
    return crc


def _run_crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: (place of the run's first word, CRC of the run) of every run within a text."""
    word = _word_crcs(low, start, end)
    n = end - start
    space = np.full(len(word), zlib.crc32(b" "), np.uint32)
    short = n < SHIFTS
    led = np.zeros(len(word), np.uint32)  # of a space and the word
    led[short] = _joined(space[short], word[short], n[short])
    at, crc = np.arange(len(word)), word
    out = [(at, crc)]
    for width in range(2, longest + 1):
        on = at + width - 1 < len(word)
        at, crc = at[on], crc[on]
        on = doc[at] == doc[at + width - 1]
        at, crc = at[on], crc[on]
        last = at + width - 1
        crc = _joined(crc, led[last], np.minimum(n[last], SHIFTS - 1) + 1)
        for i in np.flatnonzero(~short[last]).tolist():  # the run's bytes themselves
            crc[i] = zlib.crc32(b" ".join(low[start[w] : end[w]].tobytes() for w in range(at[i], last[i] + 1)))
        out.append((at, crc))
    return out


def features(col: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each feature, its text's row, words of each row) of a text column, in parts of bounded size.

    A text beyond SEGMENT bytes goes by in several parts; each begins with the last words of the one before, whose own runs
    aren't counted again.
    """
    raw, offsets = text_bytes(col)
    low = _LOWER[raw]
    a = b = carried = 0
    while b < len(low):
        b = min(b + SEGMENT, len(low))
        while b < len(low) and _WORD[low[b]]:
            step = _WORD[low[b : b + (1 << 16)]]
            b += len(step) if step.all() else int(step.argmin())
        start, end, doc = word_spans(low[a:b], np.clip(offsets, a, b) - a, _WORD[low[a:b]])
        bucket, row = [], []
        for width, (at, crc) in enumerate(_run_crcs(low[a:b], start, end, doc, longest), 1):
            new = at + width > carried
            bucket.append((crc[new] % np.uint32(buckets)).astype(np.int64))
            row.append(doc[at[new]])
        yield np.concatenate(bucket), np.concatenate(row), np.bincount(doc[carried:], minlength=len(col))
        # words that runs across the cut begin with: those of the text that goes on, if it is one
        going = np.searchsorted(offsets, b, side="right") - 1
        tail = np.flatnonzero(doc == going)[-(longest - 1) :] if longest > 1 and offsets[going] < b else doc[:0]
        carried = len(tail)
        a = a + int(start[tail[0]]) if carried else b


# --- pass 1: bucket counts --------------------------------------------------------------------------
def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; one vector a task, added up along a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for bucket, _, _ in features(batch.column(0), buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    none = df.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # a table may have no task at all
    return vectors.union(none).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier the target is to hold a feature of each bucket, rounded down."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = (target + 1).astype(np.float64) * float(s_all + n) / ((corpus + 1).astype(np.float64) * float(t_all + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


# --- pass 2: weights ----------------------------------------------------------------------------------
def weigh(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    held, kind = df.sparkSession.sparkContext.broadcast(gain), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = held.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for bucket, row, n_words in features(batch.column(1), len(by_bucket), longest):
                words += n_words
                count += np.bincount(row, minlength=n)
                weight += np.bincount(row, weights=by_bucket[bucket], minlength=n).astype(np.int64)  # whole numbers below 2^53 are exact
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    Scores are put in order by ranges of (score, id) over all tasks, and numbered from each range's rows.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = stored(weigh(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + gumbel), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    k = math.floor(percent * able.count() / 100)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = ranked(able, order, "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
