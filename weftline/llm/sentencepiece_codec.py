"""Operator 2, SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A sequence of pieces is what merging yields exactly when each two neighbours, merged anew, stay apart.  So the
encoder takes the longest piece that an Aho-Corasick automaton finds at a position; where it doesn't go with the
piece before it, it tries the next shorter one and steps back when none is left, marking failed positions in a bit
field so that none is tried twice.  Pieces hold U+2581 only at their start, so text between two spaces is encoded by
itself, and its result kept in a bounded table.

Defined results: null and empty texts have no ids and decode to an empty text; characters without a piece become
their UTF-8 bytes' pieces (or the unknown id where the model has none).  Repeated rows stay repeated, only the two columns
named are read, and an empty table stays empty.  A long text goes by in parts; a long unit is cut where no piece reaches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, slices, text_bytes, word_hashes

SPACE = "▁"
_MARK = SPACE.encode()
#: Entries of each of the dictionaries that a Python worker keeps, and units of each of its two tables (8 MB); a full one
#: starts anew, but a full table of units takes the older one's place first, so that frequent units stay.
MOST_KEPT, MOST_UNITS = 80_000, 300_000
#: Bytes of text that are encoded at once (up to the end of a unit).
SEGMENT = 1 << 20


class Encoder:
    """Encodes as the model's library does, for merge models that add a leading space and change no characters."""

    def __init__(self, path: str, most_kept: int = MOST_KEPT, most_units: int = MOST_UNITS):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp, self.most_kept = sp, most_kept
        if sp.normalize("  a  ") != SPACE * 3 + "a" + SPACE * 2:
            raise ValueError("the model must add a leading space and keep white space")
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.id = {sp.id_to_piece(i): i for i in usual}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece goes across a space")
        if any("\n" in p.strip("\n") or "\n" in p and p.strip("\n") for p in self.id):
            raise ValueError("a piece goes across a line break")
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.chars = {c for p in self.id for c in p if c in self.id}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.most_units, self.slots_log2 = most_units, max(12, (most_units + most_units // 4 - 1).bit_length())
        self.table, self.older = WordTable(self.slots_log2), WordTable(4)
        # pieces that merging never yields are no candidates
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if all(c in self.chars for c in p) and self.merge(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: of each candidate, the longest other one that it starts with
        self.shorter: dict[str, str | None] = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.automaton), None) for p in self.automaton}
        self.most_chars = max(map(len, self.shorter))
        #: neighbours within a piece; merging never joins two characters that aren't among them
        self.inner = {a + b for p in self.id for a, b in zip(p, p[1:])}  # noqa: B905

    def merge(self, text: str) -> list[str]:
        """Merging itself: again and again the neighbours whose joined piece has the highest score, the first of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def goes(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.most_kept:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def longest(self, text: str, pos: int) -> str:
        """The longest candidate at a position: the automaton's longest path, then down its chain of shorter ones."""
        part = text[pos : pos + self.most_chars]
        part = part[: self.automaton.longest_prefix(part)]
        while part not in self.shorter:
            part = part[:-1]
        return part

    def run(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces."""
        shorter, pairs, n = self.shorter, self.pairs, len(text)
        if text in shorter:
            return [text]
        failed = 0  # bit i: the pieces up to position i can't be continued
        out: list[str] = []
        pos, piece = 0, self.longest(text, 0)
        while True:
            while piece is not None:
                to = pos + len(piece)
                if not failed >> to & 1:
                    if not out:
                        break
                    goes = pairs.get((out[-1], piece))
                    if self.goes(out[-1], piece) if goes is None else goes:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                pos = to
                if pos == n:
                    return out
                piece = self.longest(text, pos)
            else:
                failed |= 1 << pos
                last = out.pop()
                pos -= len(last)
                piece = shorter[last]

    def long_run(self, text: str) -> list[str]:
        """As run(), cut where no piece can reach across, so that bit fields and lists stay short."""
        if len(text) < 4096:
            return self.run(text)
        reach, cuts = 0, [0]
        spans = sorted((end + 1 - len(p), end + 1) for end, p in self.automaton.iter(text))
        for start, end in spans:
            if start >= reach and start > cuts[-1]:
                cuts.append(start)
            reach = max(reach, end)
        return [p for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) for p in self.run(text[a:b])]

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch without a space after its start."""
        stem = text.rstrip(".,!?;:%&$#*|\"')-")
        if stem and len(stem) < len(text) and stem[-1] + text[len(stem)] not in self.inner:  # most words come with and without them
            ids = self.kept.get(stem)
            if ids is None:
                ids = self.unit(stem)
                if len(stem) <= 64:
                    self.kept[stem] = ids
            return ids + self.unit(text[len(stem) :])
        if self.chars.issuperset(text):
            return tuple([self.id[p] for p in self.long_run(text)])
        out: list[int] = []
        known = ""
        for c in text:
            if c in self.chars:
                known += c
                continue
            if known:
                out += [self.id[p] for p in self.long_run(known)]
                known = ""
            out += [self.byte.get(b, self.unknown) for b in c.encode()] if self.byte else [self.unknown]
        if known:
            out += [self.id[p] for p in self.long_run(known)]
        return tuple(out)

    def _segment(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each unit, all ids) of raw; first: where units begin."""
        end = np.concatenate([first[1:], [len(raw)]])
        h = np.maximum(word_hashes(raw, first, end, lower=False), np.uint64(1))
        slot = self.table.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            if self.table.n and (self.table.n + len(new) > self.most_units or self.table.n_ids > 8 * self.most_units):
                self.older, self.table = self.table, WordTable(self.slots_log2)
                return self._segment(raw, first)
            if 2 * len(new) > len(self.table.keys):  # a segment of so many units is the table's first
                self.table = WordTable((2 * len(new)).bit_length())
            was = self.older.find(new)
            if (was >= 0).any():
                self.table.add(new[was >= 0], *self.older.ids_at(was[was >= 0]))
                new, at = new[was < 0], at[was < 0]
            data, at = raw.tobytes(), missing[at]
            ids = [self.unit(data[a:b].decode().replace(" ", SPACE)) for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]
            if len(self.kept) >= self.most_kept:
                self.kept.clear()
            self.table.add(new, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), "<u4"))
            slot[missing] = self.table.find(h[missing])
        return self.table.ids_at(slot)

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all texts' ids in a row); null is empty."""
        raw, offsets = text_bytes(col)
        # the leading space of each text that isn't empty
        sizes = np.diff(offsets)
        raw = np.insert(raw, offsets[:-1][sizes > 0], 0x20)
        offsets = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        if raw.tobytes().find(_MARK) >= 0:  # U+2581 stands for a space
            texts = [t and t.replace(SPACE, " ") for t in col.to_pylist()]
            return self.encode_column(pa.array(texts, pa.string()))
        # units: white space and what follows it up to the next, and runs of line breaks
        kind = np.where(raw == 0x20, 1, np.where(raw == 0x0A, 2, 0)).astype(np.int8)
        opens = np.zeros(len(raw), bool)
        opens[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] > 0) | (kind[:-1] == 2))
        opens[offsets[:-1][sizes > 0]] = True
        first = np.flatnonzero(opens)
        total, parts, a = np.zeros(len(col), np.int64), [np.zeros(0, "<u4")], 0
        while a < len(first):
            b = max(int(np.searchsorted(first, first[a] + SEGMENT)), a + 1)
            stop = first[b] if b < len(first) else len(raw)
            counts, ids = self._segment(raw[first[a] : stop], first[a:b] - first[a])
            np.add.at(total, np.searchsorted(offsets, first[a:b], side="right") - 1, counts)
            parts.append(ids)
            a = b
        return total, np.concatenate(parts)

    def encode_all(self, col: pa.Array) -> list[list[int]]:
        counts, ids = self.encode_column(col)
        ends, ids = np.cumsum(counts).tolist(), ids.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """(id, ids) of every row, and with round_trip also `decoded`.  model: the file's path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model)
        for batch in slices(batches, text_col, 1 << 20):
            ids = codec.encode_all(batch.column(1))
            cols = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            names = [id_col, "ids"]
            if round_trip:
                cols.append(pa.array([codec.decode(i) for i in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * round_trip)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the same encoding, digested where it is made, so that no ids are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model)
        names = [str(i) for i in range(codec.sp.get_piece_size())]
        for batch in slices(batches, text_col, 1 << 20):
            rows = []
            for ids in codec.encode_all(batch.column(1)):
                joined = ",".join([names[i] for i in ids])
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
