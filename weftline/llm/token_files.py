"""Operator 6, token-ID output: bit-plane shuffled blocks of ids, each plane under zstandard, with a chunk index.

File format (little-endian), one file for each range of document ids, ids in ascending document order:

    "WBP1"                              magic
    planes of block 0, of block 1, ...  each plane a zstandard frame; a plane of zeros takes no bytes
    index                               a zstandard frame over:
        u32 version, u32 ids a block, u32 planes a block, u32 bits a plane item (1: bit planes, 8: byte planes)
        u64 blocks, u64 documents, u64 ids
        u64[blocks] place of each block's first plane; u32[blocks * planes] compressed bytes of each plane
        u8[documents] 1 for a null document id; i64[documents] document ids; u64[documents] ids of each document
    u64 place of the index, u64 its compressed bytes, "WBP1"

A block holds a fixed number of ids (the last one is padded with zeros), transposed: plane k is the k-th bit (or byte)
of every id.  A reader finds any document's ids from the index and reads no block but those that hold them.

Defined results: null and empty texts have the end id alone; null document ids come first, equal ids in any order
side by side; an empty table makes one empty file at most.  Tasks may be run again: each attempt writes a file of its
own, and only the files that the committed manifest names count.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, WordTable, qualified, shared_dir, slices, stored, text_bytes, word_hashes, word_spans

MAGIC = b"WBP1"
BLOCK_IDS = 1 << 16
#: Words whose ids a Python worker keeps (about 90 MB); a full table starts anew.
MOST_KEPT = 2_000_000
#: Bytes of text that are encoded at once (up to the end of a word).
SEGMENT = 2 << 20
#: Ids that a reader hands on at once (one document at least).
READ_IDS = 1 << 20


# --- planes ------------------------------------------------------------------------------------
def to_planes(ids: np.ndarray, bits: int = 1) -> list[bytes]:
    """The 32 bit planes (bits=1) or 4 byte planes (bits=8) of a block of uint32 ids; b"" for a plane of zeros."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    out = []
    for column in range(4):
        part = np.ascontiguousarray(raw[:, column])
        if bits == 8:
            out.append(part.tobytes() if part.any() else b"")
            continue
        used = np.bitwise_or.reduce(part) if len(part) else 0
        for bit in range(8):
            out.append(np.packbits((part >> bit) & 1, bitorder="little").tobytes() if used >> bit & 1 else b"")
    return out


def from_planes(planes: Sequence[bytes], n: int, bits: int = 1) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        if bits == 8:
            raw[:, k] = np.frombuffer(plane, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (k % 8)
    return raw.reshape(-1).view("<u4")


class Writer:
    """Writes one file; memory holds one block and the index."""

    def __init__(self, sink, block_ids: int = BLOCK_IDS, bits: int = 1, level: int = 3):
        self.sink, self.block_ids, self.bits = sink, block_ids, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.place, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.at: list[int] = []
        self.sizes: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], [len(ids)], ids)

    def add_all(self, doc_ids: Sequence[int | None], counts: Sequence[int], ids: np.ndarray) -> None:
        """Several documents' ids in a row."""
        self.docs.extend(doc_ids)
        self.counts.extend(int(n) for n in counts)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) // self.block_ids * self.block_ids
        parts = [ids[i : i + self.block_ids] for i in range(0, whole, self.block_ids)]
        rest = ids[whole:]
        if last and len(rest):
            parts.append(np.concatenate([rest, np.zeros(self.block_ids - len(rest), "<u4")]))
            rest = rest[:0]
        for part in parts:
            self.at.append(self.place)
            for plane in to_planes(part, self.bits):
                data = self.zip.compress(plane) if plane else b""
                self.sizes.append(len(data))
                self.sink.write(data)
                self.place += len(data)
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> int:
        self._blocks(True)
        n = 32 // self.bits
        index = struct.pack("<4I3Q", 1, self.block_ids, n, self.bits, len(self.at), len(self.docs), sum(self.counts))
        index += np.array(self.at, "<u8").tobytes() + np.array(self.sizes, "<u4").tobytes()
        index += np.array([d is None for d in self.docs], np.uint8).tobytes()
        index += np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes()
        data = self.zip.compress(index)
        self.sink.write(data + struct.pack("<2Q", self.place, len(data)) + MAGIC)
        return sum(self.counts)


class Reader:
    """Reads a file's index, then blocks as they are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        source.seek(size - 20)
        tail = source.read(20)
        if tail[16:] != MAGIC:
            raise ValueError("not a token file, or one that wasn't finished")
        place, n = struct.unpack("<2Q", tail[:16])
        source.seek(place)
        self.unzip = zstandard.ZstdDecompressor()
        index = self.unzip.decompress(source.read(n))
        version, self.block_ids, self.planes, self.bits, blocks, docs, self.n_ids = struct.unpack_from("<4I3Q", index)
        if version != 1:
            raise ValueError(f"version {version}")
        at = struct.calcsize("<4I3Q")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, kind, count, at)
            at += out.nbytes
            return out

        self.at, self.sizes = take("<u8", blocks), take("<u4", blocks * self.planes).reshape(blocks, self.planes)
        null, ids = take("u1", docs), take("<i8", docs)
        self.docs = [None if z else int(d) for z, d in zip(null, ids, strict=True)]
        self.counts = take("<u8", docs)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self._held = (-1, np.zeros(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            self.source.seek(int(self.at[k]))
            data = self.source.read(int(self.sizes[k].sum()))
            planes, at = [], 0
            for n in self.sizes[k].tolist():
                planes.append(self.unzip.decompress(data[at : at + n]) if n else b"")
                at += n
            self._held = (k, from_planes(planes, self.block_ids, self.bits))
        return self._held[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at places start to stop of the file."""
        b, parts = self.block_ids, []
        while start < stop:
            k = start // b
            to = min(stop, (k + 1) * b)
            parts.append(self.block(k)[start - k * b : to - k * b])
            start = to
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


# --- encoding ------------------------------------------------------------------------------------
class WordEncoder:
    """The tokenizer's own ids, kept by word.

    The tokenizer's normaliser, its cuts and its special tokens don't reach across ASCII white space, so a text's ids
    are its words' ids one after another.  A new word of the plain range below is lower-cased character by character,
    and the tokenizer's own pattern cuts it into pieces, each of which is merged by itself: they go to the library's
    merging model in one string, where the ids that end a word part them again.  Any other word goes to the whole
    tokenizer, and so does a text that may hold a special token.  Known words are found by 64-bit hashes (of 10^6
    words, two are one with a probability of 3 in 10^8); a table of `most_kept` words starts anew.

    A tokenizer file of another build (`by_word` is False) gets each text whole.
    """

    PLAIN = re.compile("[\t\n\r\x0b\x0c\x20-\x7e\xa1-įı-ž]*")

    def __init__(self, path: str, most_kept: int = MOST_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_kept = most_kept
        self.slots_log2 = max(12, (most_kept + most_kept // 4 - 1).bit_length())
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        self.by_word = self._cut_by_word(plan)
        if self.by_word:
            pattern = plan["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            plain = [c for c in map(chr, range(0x180)) if self.PLAIN.fullmatch(c)]
            for kind in ("\\p{L}", "\\p{N}"):  # the standard module doesn't know them, but is faster: list their plain characters
                pattern = pattern.replace(kind, "".join(re.escape(c) for c in plain if regex.fullmatch(kind, c)))
            self.pattern = re.compile(pattern)
            bare = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            plan["normalizer"], plan["pre_tokenizer"]["pretokenizers"][0] = None, bare
            self.model = Tokenizer.from_str(json.dumps(plan))
            suffix, vocab = plan["model"]["end_of_word_suffix"], plan["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            self.table = WordTable(self.slots_log2)

    @staticmethod
    def _cut_by_word(plan: dict) -> bool:
        """Whether the file is of the build that the class describes."""
        normal = plan["normalizer"] or {}
        first, *rest = (plan["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return (
            [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]
            and len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
            and plan["post_processor"] is None and bool(plan["model"]["end_of_word_suffix"]) and not plan["model"]["dropout"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "<|" not in t["content"] for t in plan["added_tokens"])
        )

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each plain word, all ids)."""
        cut = list(map(self.pattern.findall, words))
        pieces = list(chain.from_iterable(cut))
        if not pieces:
            return np.zeros(len(words), np.int64), np.zeros(0, "<u4")
        (got,) = self.model.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces) or len(ids) != ends[-1]:  # bytes that the vocabulary lacks
            each = self._whole(words)
            return np.array([len(e) for e in each], np.int64), np.concatenate(each)
        last = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return np.diff(np.concatenate([[0], ends])[last], prepend=0), ids

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        if not self.table.n:
            self.table = WordTable(max(self.slots_log2, (2 * len(h)).bit_length()))
        plain = np.fromiter((self.PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        counts, ids = self._plain_words([w.lower() for w, p in zip(words, plain, strict=True) if p])
        self.table.add(h[plain], counts, ids)
        if not plain.all():
            each = self._whole([w for w, p in zip(words, plain, strict=True) if not p])
            self.table.add(h[~plain], np.array([len(e) for e in each], np.int64), np.concatenate(each))

    def _segment(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids) of texts laid end to end."""
        start, end, doc = word_spans(raw, offsets)
        h = np.maximum(word_hashes(raw, start, end), np.uint64(1))
        slot = self.table.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            if self.table.n and self.table.n + len(new) > self.most_kept:
                self.table = WordTable(self.slots_log2)  # starts anew, with all words of this segment
                return self._segment(raw, offsets)
            data, at = raw.tobytes(), missing[at]
            self._learn(new, [data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            slot[missing] = self.table.find(h[missing])
        n, ids = self.table.ids_at(slot)
        return np.bincount(doc, weights=n, minlength=len(offsets) - 1).astype(np.int64), ids

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all texts' ids in a row); null is empty."""
        raw, offsets = text_bytes(col)
        if not self.by_word or raw.tobytes().find(b"<|") >= 0:
            counts, parts = [], [np.zeros(0, "<u4")]
            for i, text in enumerate(col.to_pylist()):
                if text and (not self.by_word or "<|" in text):
                    (ids,) = self._whole([text])
                else:
                    _, ids = self.encode_column(col.slice(i, 1)) if text else (None, parts[0])
                counts.append(len(ids))
                parts.append(ids)
            return np.array(counts, np.int64), np.concatenate(parts)
        total, parts, a = np.zeros(len(col), np.int64), [np.zeros(0, "<u4")], 0
        while a < len(raw):  # a long text goes by in parts that end with a word
            b = min(a + SEGMENT, len(raw))
            while b < len(raw) and not SPACES[raw[b]]:
                step = SPACES[raw[b : b + (1 << 16)]]
                b += int(step.argmax()) if step.any() else len(step)
            lo, hi = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b)
            counts, ids = self._segment(raw[a:b], np.clip(offsets[lo : hi + 1], a, b) - a)
            total[lo:hi] += counts
            parts.append(ids)
            a = b
        return total, np.concatenate(parts)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        counts, ids = self.encode_column(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# --- writing and reading with Spark -----------------------------------------------------------------
def write_tokens(df: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, block_ids: int = BLOCK_IDS, bits: int = 1) -> DataFrame:
    """Writes every text's ids and end_id in ascending id order; returns the manifest (part, file, docs, ids).

    `folder` is one that all machines reach; without a scheme it is one of Hadoop's default file system, as for Spark's own tables.  Texts are dealt by ranges of their id before they are encoded, so the
    sampling for the ranges reads the id column alone and nothing is encoded twice.
    """
    cut = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, folder = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), qualified(df.sparkSession, folder)
    ordered = cut.repartitionByRange(n, "id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        writer = sink = None
        system, base = fs.FileSystem.from_uri(folder)
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.wbp"
        for batch in slices(batches, "text"):
            if writer is None:
                system.create_dir(base, recursive=True)
                sink = system.open_output_stream(f"{base}/{name}")
                writer = Writer(sink, block_ids, bits)
            counts, ids = encoder.encode_column(batch.column(1))
            writer.add_all(batch.column(0).to_pylist(), counts + 1, np.insert(ids, np.cumsum(counts), end_id))
        if writer is not None:
            ids = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": pa.array([len(writer.docs)], pa.int64()), "ids": pa.array([ids], pa.int64())})

    return stored(ordered.mapInArrow(run, "part int, file string, docs long, ids long"), "manifest")


def read_tokens(manifest: DataFrame, folder: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, and ids, or with digest their ids_crc32) of every document, read from the files."""
    # one row a file; the running sum over files is the only thing that is put in one place
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("ids").over(first), F.lit(0)).alias("before"))
    n, folder = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), qualified(manifest.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{file}") as source:
                    reader = Reader(source)
                    at = 0
                    while at < len(reader.docs):
                        to = int(np.searchsorted(reader.starts, reader.starts[at] + READ_IDS, side="right")) - 1
                        here = range(at, min(max(to, at + 1), at + 4096, len(reader.docs)))
                        at = here.stop
                        ids = [reader.document(i) for i in here]
                        cols = [pa.array([reader.docs[i] for i in here], pa.int64()), pa.array(reader.starts[here.start : here.stop] + before), pa.array([len(i) for i in ids], pa.int64())]
                        if digest:
                            cols.append(pa.array([zlib.crc32(np.ascontiguousarray(i).view(np.uint8)) for i in ids], pa.int64()))
                        else:
                            cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32" if digest else "ids"])

    last = "ids_crc32 long" if digest else "ids array<int>"
    return files.repartition(n, "file").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, {last}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/weftline-tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    from .common import _WRITTEN

    _WRITTEN.append((spark, folder))
    return read_tokens(manifest, folder, digest=True)
