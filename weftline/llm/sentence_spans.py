"""Operator 8, substring dedup: sliding spans of sentences, hashed, joined globally; what repeats later is removed.

A sentence starts at a text's start, after a line break, after `.`, `!` or `?`, and at a capital, so that a passage
put into the middle of a sentence begins one too.  From each sentence, and back from each sentence's end, the shortest
run of at least `least_sentences` sentences and `least_words` words is hashed.  Of the places with one hash, the first
by (id, row, place) stays; sentences within any later one go.

Each batch of texts sends only the first place of each hash: its later ones are known to be repeats there and then.
So however many rows share a passage, a batch sends it once.  Hashes are dealt into buckets, many a task, packed as
bytes; a bucket finds the first place of each hash and gives back the others.

Rows are stored under a number before they are read, so that rows of one id, equal ones too, are told apart and a
retried task sees the same numbers.

Defined results: null texts stay null, texts without a repeat stay as they are; rows of one id are documents of their
own, one after the other, so that of equal rows one keeps its text; null ids come first; an empty table stays empty.
Ids must be integers or null.  All columns stay, whatever their names, but for `removed`, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, slices, stored, stored_bytes, text_bytes, word_hashes, word_spans

NO_ID = -(1 << 63)
#: Bytes of stored rows for each bucket: a bucket's runs are about as many bytes, and are held by one task.
BUCKET_BYTES = 32 << 20
_PLACE = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("first", "<i4"), ("end", "<i4")])
_R = 0xD1342543DE82EF95
_POW: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        up, down = np.full(n + 1024, _R, np.uint64), np.full(n + 1024, pow(_R, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POW[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POW[0][:n], _POW[1][:n]


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each sentence, its document, start byte of each word, end byte of each word)."""
    start, end, doc = word_spans(raw, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, start, end
    opens = np.ones(len(start), bool)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    stops = np.isin(raw[end[:-1] - 1], list(b".!?"))
    lead = raw[start[1:]]
    after = raw[np.minimum(start[1:] + 1, len(raw) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
    opens[1:] = (doc[1:] != doc[:-1]) | (lines[start[1:]] > lines[end[:-1]]) | stops | capital
    first = np.flatnonzero(opens)
    return first, doc[first], start, end


def runs(raw: np.ndarray, offsets: np.ndarray, least_sentences: int, least_words: int):
    """The shortest runs: (hash, document, first sentence and end sentence within it), and the sentences."""
    first, doc, start, end = sentences(raw, offsets)
    n, n_words = len(first), len(start)
    bound = np.concatenate([first, [n_words]])
    doc_first = np.searchsorted(doc, np.arange(len(offsets)))  # first sentence of each document, then the number of sentences
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, doc_first, bound, start, end
    i = np.arange(n)
    to = np.maximum(np.searchsorted(bound, bound[:-1] + least_words), i + least_sentences)
    forward = to <= doc_first[doc + 1]
    e = np.arange(1, n + 1)
    since = np.minimum(np.searchsorted(bound, bound[1:] - least_words, side="right") - 1, e - least_sentences)
    back = since >= doc_first[doc]
    a = np.concatenate([i[forward], since[back]])
    b = np.concatenate([to[forward], e[back]])
    code = np.unique(a * (n + 1) + b)
    a, b = code // (n + 1), code % (n + 1)
    h = word_hashes(raw, start, end)
    up, down = _power(n_words)
    with np.errstate(over="ignore"):
        total = np.zeros(n_words + 1, np.uint64)
        np.cumsum(h * up, out=total[1:])
        run = mix((total[bound[b]] - total[bound[a]]) * down[bound[a]] ^ ((bound[b] - bound[a]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    d = doc[a]
    return run, d, a - doc_first[d], b - doc_first[d], doc_first, bound, start, end


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each stretch of equal keys."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)][: len(cuts)], strict=True))


def _first_of_each(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each hash, the others)."""
    order = np.lexsort((places["end"], places["first"], places["row"], places["doc"], places["hash"]))
    places = places[order]
    new = np.ones(len(places), bool)
    new[1:] = places["hash"][1:] != places["hash"][:-1]
    return places[new], places[~new]


def repeats(df: DataFrame, id_col: str, text_col: str, row_col: str, least_sentences: int = 2, least_words: int = 25) -> DataFrame:
    """(row, places): the runs, as packed (hash, id, row, first, end), that repeat an earlier one, by row.  df is stored, with numbered rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8 * n, -(-stored_bytes(df) // BUCKET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            run, doc, first, end, *_ = runs(*text_bytes(batch.column(1)), least_sentences, least_words)
            places = np.empty(len(run), _PLACE)
            places["hash"], places["doc"], places["row"], places["first"], places["end"] = run, ids[doc], numbers[doc], first, end
            unsure, sure = _first_of_each(places)
            out_bucket, out_data = [], []
            order = np.argsort(unsure["hash"] % np.uint64(buckets), kind="stable")
            unsure = unsure[order]
            where = (unsure["hash"] % np.uint64(buckets)).astype(np.int64)
            for a, b in _groups(where):
                out_bucket.append(int(where[a]))
                out_data.append(unsure[a:b].tobytes())
            if len(sure):  # bucket -1: repeats already
                out_bucket.append(-1)
                out_data.append(sure.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_data, pa.binary())], names=["bucket", "data"])

    def by_row(places: np.ndarray) -> pa.RecordBatch:
        places = places[np.argsort(places["row"], kind="stable")]
        groups = _groups(places["row"])
        return pa.RecordBatch.from_arrays([pa.array(places["row"][[a for a, _ in groups]], pa.int64()), pa.array([places[a:b].tobytes() for a, b in groups], pa.binary())], names=["row", "places"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield by_row(np.frombuffer(data, _PLACE))

    def meet(table: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(table.column("data").to_pylist()), _PLACE)
        return pa.Table.from_batches([by_row(_first_of_each(places)[1])])

    cut = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"), F.col(row_col).alias("row"))
    dealt = stored(cut.mapInArrow(deal, "bucket int, data binary"), "runs")
    shape = "row long, places binary"
    return dealt.where("bucket < 0").select("data").mapInArrow(known, shape).unionByName(dealt.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, shape))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = 2, least_words: int = 25) -> DataFrame:
    """df with the repeated sentences gone from the text, and `removed`: their places (start, end) in code points."""
    rows = df.drop("removed")
    names, at = rows.columns, rows.columns.index(text_col)
    own_names = [f"c{i}" for i in range(len(names))]
    own = stored(rows.toDF(*own_names).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = repeats(own, own_names[names.index(id_col)], own_names[at], "row", least_sentences, least_words)
    spans = found.groupBy("row").agg(F.collect_list("places").alias("places"))
    # by far most documents have none: those that have are joined, and each text is moved once
    both = own.join(spans, "row", "left").drop("row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, own_names[at]):
            cols = [batch.column(i) for i in range(len(names))]
            texts, lists = cols[at], batch.column(len(names)).to_pylist()
            if any(lists):
                raw, offsets = text_bytes(texts)
                run, doc, first, end, doc_first, bound, start, _ = runs(raw, offsets, least_sentences, least_words)
                run_from = np.searchsorted(doc, np.arange(len(offsets)))
                data, new, removed = raw.tobytes(), texts.to_pylist(), []
                for k, packed in enumerate(lists):
                    if not packed or not len(run):
                        removed.append([])
                        continue
                    gone = np.frombuffer(b"".join(packed), _PLACE)
                    mine = slice(run_from[k], run_from[k + 1])
                    have = np.rec.fromarrays([run[mine], first[mine].astype("<i4"), end[mine].astype("<i4")], names="hash,first,end")
                    want = np.rec.fromarrays([gone["hash"], gone["first"], gone["end"]], names="hash,first,end")
                    hit = have[np.isin(have, want)]
                    m = doc_first[k + 1] - doc_first[k]
                    cover = np.zeros(m + 1, np.int64)
                    np.add.at(cover, hit["first"], 1)
                    np.add.at(cover, hit["end"], -1)
                    off = np.cumsum(cover)[:m] > 0
                    edges = np.flatnonzero(np.diff(off.astype(np.int8), prepend=0, append=0))
                    spots, parts, last = [], [], int(offsets[k])
                    starts = start[bound[doc_first[k] : doc_first[k + 1]]] if m else start[:0]
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        s = int(starts[a])
                        t = int(starts[b]) if b < m else int(offsets[k + 1])
                        before = len(data[offsets[k] : s].decode())
                        spots.append({"start": before, "end": before + len(data[s:t].decode())})
                        parts.append(data[last:s])
                        last = t
                    parts.append(data[last : offsets[k + 1]])
                    new[k] = b"".join(parts).decode()
                    removed.append(spots)
                cols[at] = pa.array(new, pa.string())
            else:
                removed = [[]] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, spot)], names=[*own_names, "removed"])

    spot = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    shape = T.StructType([T.StructField(n, f.dataType) for n, f in zip(own_names, rows.schema, strict=True)] + [T.StructField("removed", spot)])
    return both.mapInArrow(cut, shape).toDF(*names, "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
