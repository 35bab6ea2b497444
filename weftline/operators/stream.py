"""Sentence streams: positions under five orders, budgeted windows, neighbourhoods, mentions, contexts."""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text
from ..tables import stored

ORDERS = ("original", "reverse", "shuffle", "interleaved", "distant")


def sentences(docs: DataFrame, sample: Column, document: Column, items: Column, rank: Column) -> DataFrame:
    """(sample_id, document_id, doc_rank, sentence_id, text, source_ref) of documents with arrays of sentences."""
    rows = docs.select(sample.cast("string").alias("sample_id"), document.cast("string").alias("document_id"), rank.alias("doc_rank"), F.posexplode(items).alias("sentence_id", "text"))
    return rows.withColumn("source_ref", F.concat_ws(":", "sample_id", "document_id", F.concat(F.lit("s"), F.col("sentence_id"))))


def positions(rows: DataFrame, order: str = "original", seed: int = 0, supporting: Column | None = None) -> DataFrame:
    """rows with a dense stream_position a sample.  A source_ref never changes; only its position does.

    distant: the supporting documents of even rank, all others, the supporting ones of odd rank reversed.
    """
    by_sample = Window.partitionBy("sample_id")
    if order == "original":
        keys = ["doc_rank", "sentence_id"]
    elif order == "reverse":
        keys = [F.desc("doc_rank"), "sentence_id"]
    elif order == "shuffle":
        keys = [F.md5(F.concat_ws(":", F.lit(str(seed)), "document_id")), "doc_rank", "sentence_id"]
    elif order == "interleaved":
        keys = ["sentence_id", "doc_rank"]
    elif order == "distant":
        if supporting is None:
            raise ValueError("distant needs the supporting documents")
        rows = rows.withColumn("_support", supporting.cast("int"))
        rank = F.dense_rank().over(by_sample.orderBy(F.desc("_support"), "doc_rank"))
        rows = rows.withColumn("_rank", F.when(F.col("_support") == 1, rank - 1))
        place = F.when(F.col("_support") == 0, 1).when(F.col("_rank") % 2 == 0, 0).otherwise(2)
        rows = rows.withColumns({"_place": place, "_turn": F.when(place == 2, -F.col("doc_rank")).otherwise(F.col("doc_rank"))})
        keys = ["_place", "_turn", "sentence_id"]
    else:
        raise ValueError(f"unknown order: {order}")
    return rows.withColumn("stream_position", F.row_number().over(by_sample.orderBy(*keys)) - 1).drop("_support", "_rank", "_place", "_turn")


def violations(manifest: DataFrame) -> DataFrame:
    """(sample_id, kind) of what a manifest may not have: gaps or repeats of positions, texts that their hash isn't of."""
    by = Window.partitionBy("sample_id").orderBy("stream_position")
    before = F.lag("stream_position").over(by)
    gaps = manifest.withColumn("_before", before).where(F.coalesce(F.col("stream_position") - F.col("_before"), F.col("stream_position") + 1) != 1).select("sample_id", F.lit("POSITION").alias("kind"))
    return gaps.unionByName(manifest.where(F.sha2("text", 256) != F.col("text_sha256")).select("sample_id", F.lit("HASH").alias("kind")))


def word_cost(text: Column) -> Column:
    """A sentence's cost: its white-space words, 1 at least."""
    return F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(1))


def budget_windows(rows: DataFrame, run: str, position: str, cost: Column, budget: int) -> DataFrame:
    """rows with window_index: whole items packed in order until the next one goes over the budget.

    The fold is sequential in a run, so a run's costs (not its texts) meet in one task; runs are independent.
    """
    start = F.struct(F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        opens = (s["used"] > 0) & (s["used"] + x["cost"] > budget)
        window = s["window"] + opens.cast("long")
        return F.struct(window.alias("window"), F.when(opens, x["cost"]).otherwise(s["used"] + x["cost"]).alias("used"), F.concat(s["out"], F.array(window)).alias("out"))

    items = rows.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), cost.cast("long").alias("cost")))).alias("items"))
    packed = items.select(run, F.explode(F.arrays_zip(F.col("items.at").alias("at"), F.aggregate("items", start, step, lambda s: s["out"]).alias("window"))).alias("x"))
    return rows.join(packed.select(F.col(run), F.col("x.at").alias(position), F.col("x.window").alias("window_index")), [run, position])


def read_prefix(manifest: DataFrame, cursor: int) -> DataFrame:
    """What has been read; anything later can't be reached."""
    return manifest.where(F.col("stream_position") <= cursor)


def prefix_violations(manifest: DataFrame, reads: DataFrame) -> DataFrame:
    """(sample_id, source_ref, kind) of reads (sample_id, source_ref, cursor) that a run must not make.

    UNKNOWN: no such sentence; UNREAD: it stands after the cursor; CONTEXT_ONLY: it is there for context alone.
    """
    only = F.col("context_only") if "context_only" in manifest.columns else F.lit(False)
    known = manifest.select("sample_id", "source_ref", "stream_position", only.alias("_only"))
    kind = F.when(F.col("stream_position").isNull(), "UNKNOWN").when(F.col("stream_position") > F.col("cursor"), "UNREAD").when(F.col("_only"), "CONTEXT_ONLY")
    return reads.join(known, ["sample_id", "source_ref"], "left").select("sample_id", "source_ref", kind.alias("kind")).where("kind is not null")


def uncited(decisions: DataFrame, supplied: DataFrame) -> DataFrame:
    """(decision_id, kind) of decisions whose citations don't hold.

    decisions: (decision_id, refs, supporting_text); supplied: (decision_id, source_ref, text).  NONE: no citation; FOREIGN:
    one that wasn't supplied; NOT_THERE: the supporting text is in none of the cited sentences.
    """
    cited = decisions.select("decision_id", F.explode_outer("refs").alias("source_ref"), "supporting_text").join(supplied, ["decision_id", "source_ref"], "left")
    there = text.contains_span(F.coalesce("text", F.lit("")), F.coalesce("supporting_text", F.lit("")))
    per = cited.groupBy("decision_id").agg(F.count("source_ref").alias("n"), F.count_if(F.col("source_ref").isNotNull() & F.col("text").isNull()).alias("foreign"), F.max(there).alias("there"))
    kind = F.when(F.col("n") == 0, "NONE").when(F.col("foreign") > 0, "FOREIGN").when(~F.col("there"), "NOT_THERE")
    return per.select("decision_id", kind.alias("kind")).where("kind is not null")


def ordered_events(events: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(events with `place` in reading order, (run, moved) of the runs whose order changed).

    events: (run, at, stream_position, span_hint, event_id); at is the order they came in.
    """
    w = Window.partitionBy(run)
    placed = events.withColumns({"place": F.row_number().over(w.orderBy("stream_position", F.coalesce("span_hint", F.lit("")), "event_id")) - 1, "_came": F.row_number().over(w.orderBy("at")) - 1})
    moved = placed.groupBy(run).agg(F.count_if(F.col("place") != F.col("_came")).alias("moved")).where("moved > 0")
    return placed.drop("_came"), moved


#: So many first characters of an anchor bring it to the sentences that hold them; a longer one is then looked for as a whole.
HEAD = 6
_MASK, _BASE, _MIX = (1 << 64) - 1, 0x100000001B3, 0x9E3779B97F4A7C15
#: Characters that a task takes at a time.
_PIECE = 1 << 20


def _sample_code(sample: str) -> int:
    return zlib.crc32(sample.encode()) * _MIX & _MASK


@F.pandas_udf(IntegerType())
def _head_slot(sample: pd.Series, head: pd.Series) -> pd.Series:
    """One of 2^20 slots for a sample's anchor head; `_heads_at` finds the same."""

    def slot(sample: str, head: str) -> int:
        h = 0
        for c in head:
            h = (h * _BASE + ord(c)) & _MASK
        return ((h ^ _sample_code(sample)) * _MIX & _MASK) >> 44

    return pd.Series(map(slot, sample, head), dtype="int32")


def _heads_at(samples: Sequence[str], texts: Sequence[str], slots: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, str, bool]]:
    """(text, head, whether one of its anchors is longer) of the heads whose slot is taken; once a text."""
    joined = "\n".join([*texts, ""])  # normalised texts have no line ends
    c = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype("uint64")
    ends = np.cumsum([len(t) + 1 for t in texts])
    code = np.repeat(np.array([_sample_code(s) for s in samples], "uint64"), np.diff(ends, prepend=0))
    h = np.zeros(len(c), "uint64")
    for k in range(1, max(lengths, default=0) + 1):
        h = h[: len(c) - k + 1] * np.uint64(_BASE) + c[k - 1 :]
        if k not in lengths:
            continue
        taken = slots[((h ^ code[: len(h)]) * np.uint64(_MIX)) >> np.uint64(44)]
        at = np.flatnonzero(taken)
        found = {(line, joined[i : i + k]): bool(t & 2) for line, i, t in zip(np.searchsorted(ends, at, "right").tolist(), at.tolist(), taken[at].tolist(), strict=True)}
        yield from ((line, head, long) for (line, head), long in found.items() if "\n" not in head)


def anchor_recall(manifest: DataFrame, anchors: DataFrame) -> DataFrame:
    """(sample_id, source_ref, anchor) of a sample's sentences that mention one of its own anchors; anchors: (sample_id, anchor).

    Anchors meet sentences by an equi-join on the sample and the anchor's first characters.  A sentence's places are looked up in
    one byte for each of 2^20 slots first, so that hardly more leave it than there are mentions.
    """
    asked = anchors.select("sample_id", "anchor").distinct().withColumn("_part", text.span(F.col("anchor"))).where("_part <> '' and sample_id is not null")
    asked = stored(asked.withColumns({"_head": F.left("_part", F.lit(HEAD)), "_long": F.length("_part") > HEAD}), "anchors")
    marks = asked.groupBy(_head_slot(F.col("sample_id").cast("string"), F.col("_head")).alias("slot")).agg(F.max(F.when(F.col("_long"), 2).otherwise(0)).alias("long"), F.max(F.when(F.col("_long"), 0).otherwise(1)).alias("short"))
    slots = np.zeros(1 << 20, "uint8")
    for r in marks.toLocalIterator():  # 2^20 rows at most
        slots[r["slot"]] = r["long"] | r["short"]
    lengths = [r[0] for r in asked.select(F.length("_head")).distinct().collect()]  # 1 to HEAD
    sent = manifest.sparkSession.sparkContext.broadcast(slots)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            piece = (frame["_low"].str.len() + 1).cumsum() // _PIECE
            for _, rows in frame.groupby(piece):
                low, own, refs = rows["_low"].tolist(), rows["sample_id"].tolist(), rows["source_ref"].tolist()
                hits = list(_heads_at(rows["_sample"].tolist(), low, sent.value, lengths))
                yield pd.DataFrame([(own[i], refs[i], head, low[i] if long else None) for i, head, long in hits], columns=["sample_id", "source_ref", "_head", "_low"], dtype=object)

    lines = manifest.select("sample_id", "source_ref", text.span(F.col("text")).alias("_low"), F.col("sample_id").cast("string").alias("_sample")).where("_low <> '' and sample_id is not null")
    kinds = ", ".join(f"{c} {manifest.schema[c].dataType.simpleString()}" for c in ("sample_id", "source_ref"))
    found = lines.mapInPandas(find, f"{kinds}, _head string, _low string")
    met = found.join(asked, ["sample_id", "_head"]).where(~F.col("_long") | F.contains("_low", "_part"))
    return met.select("sample_id", "source_ref", "anchor")


def neighbourhood(manifest: DataFrame, refs: DataFrame, k: int = 1) -> DataFrame:
    """(anchor, source_ref) of the sentences at most k places from an anchor, within its document: an equi-join on places."""
    at = manifest.join(refs.select("source_ref"), "source_ref", "left_semi").select("sample_id", "document_id", F.col("source_ref").alias("anchor"), F.explode(F.sequence(F.col("stream_position") - k, F.col("stream_position") + k)).alias("stream_position"))
    return at.join(manifest.select("sample_id", "document_id", "stream_position", "source_ref"), ["sample_id", "document_id", "stream_position"]).select("anchor", "source_ref")


def document_context(manifest: DataFrame, refs: DataFrame) -> DataFrame:
    """(anchor, source_ref) of every sentence of an anchor's document."""
    at = manifest.join(refs.select("source_ref"), "source_ref", "left_semi").select("sample_id", "document_id", F.col("source_ref").alias("anchor"))
    return at.join(manifest.select("sample_id", "document_id", "source_ref"), ["sample_id", "document_id"]).select("anchor", "source_ref")


#: Characters of phrases (and 64 more for each) that are sent to every task; more are joined by a shuffle.
MOST_ASKED = 1 << 22
#: Places that a task keeps as the first ones of their phrases before it hands them on.
MOST_KEPT = 1 << 17
#: Words, of 32 characters at most, that a task remembers with the phrases in them.
MOST_WORDS = 1 << 16
#: Rows that a task hands on at a time.
_ROWS = 1 << 14


def folded(c: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _finder(asked: Iterable[str]) -> Callable[[str], set[str]]:
    """The phrases that a folded text holds: those of one word anywhere in a word, others from where a word ends with their first word."""
    alone, several = set(), set()
    sizes: dict[str, set[int]] = {}  # lengths of phrases of one word, by their first three characters
    ends: dict[str, set[str]] = {}  # first words of the others, by their last three characters
    longer: dict[str, set[int]] = {}  # lengths of the others, by their first word
    for p in asked:
        first = p.split(" ", 1)[0]
        if first == p:
            alone.add(p)
            sizes.setdefault(p[:3], set()).add(len(p))
        else:
            several.add(p)
            ends.setdefault(first[-3:], set()).add(first)
            longer.setdefault(first, set()).add(len(p))
    back = {key: {len(first) for first in firsts} for key, firsts in ends.items()}
    known: dict[str, tuple[tuple[str, ...], tuple[tuple[int, set[int]], ...]]] = {}
    grams: dict[str, tuple[int, ...]] = {}  # lengths of phrases that may start where these three characters stand

    def learn(word: str) -> tuple[tuple[str, ...], tuple[tuple[int, set[int]], ...]]:
        inside = set()
        for i in range(len(word) if alone else 0):
            gram = word[i : i + 3]
            lengths = grams.get(gram)
            if lengths is None:
                if len(grams) >= MOST_WORDS:
                    grams.clear()
                lengths = grams[gram] = tuple({n for k in (1, 2, 3) for n in sizes.get(gram[:k], ())})
            for n in lengths:
                if (p := word[i : i + n]) in alone:
                    inside.add(p)
        firsts = {f for k in (1, 2, 3) for n in back.get(word[-k:], ()) if (f := word[-n:]) in longer} if several else ()
        out = tuple(inside), tuple((len(f), longer[f]) for f in firsts)
        if len(word) <= 32:
            if len(known) >= MOST_WORDS:
                known.clear()
            known[word] = out
        return out

    def find(low: str) -> set[str]:
        found: set[str] = set()
        end = -1
        for word in low.split(" "):
            end += len(word) + 1
            inside, begun = known.get(word) or learn(word)
            if inside:
                found.update(inside)
            for n, lengths in begun:
                found.update(several.intersection([low[end - n : end - n + size] for size in lengths]))
        return found

    return find


def _firsts(rows: Iterable[tuple[str, tuple, tuple]], limit: int) -> Iterator[tuple[str, tuple, tuple]]:
    """Of (phrase, key, place) the `limit` lowest keys of each phrase; more, where there are too many phrases to keep."""
    kept: dict[str, list[tuple[tuple, tuple]]] = {}
    n = 0
    for phrase, key, at in rows:
        have = kept.setdefault(phrase, [])
        if len(have) < limit:
            insort(have, (key, at), key=itemgetter(0))
            n += 1
        elif have and key < have[-1][0]:
            have.pop()
            insort(have, (key, at), key=itemgetter(0))
        if n >= MOST_KEPT:
            yield from ((p, *x) for p, xs in kept.items() for x in xs)
            kept, n = {}, 0
    yield from ((p, *x) for p, xs in kept.items() for x in xs)


def _hits_by_task(texts: DataFrame, place: Sequence[str], keys: int, asked: Sequence[str], limit: int | None) -> DataFrame:
    """(phrase, place) of each text of texts (place, low, title) that holds a phrase or has it as its title; nothing is shuffled.

    With a limit, of each task's hits those that come first by the place's first `keys` columns.
    """
    sent = texts.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, titles = _finder(sent.value), frozenset(sent.value)
        schema: pa.Schema | None = None

        def hits() -> Iterator[tuple[str, tuple, tuple]]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("phrase", batch.schema.field("low").type), *(batch.schema.field(c) for c in place)])
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("low", "title", *place)]
                for low, title, *at in zip(*columns, strict=True):
                    found = find(low) if low else set()
                    if title in titles:
                        found.add(title)
                    if found:
                        key = tuple((v is not None, v) for v in at[:keys])  # null comes first, as in Spark
                        yield from ((phrase, key, at) for phrase in found)

        rows = hits() if limit is None else _firsts(hits(), limit)
        while part := list(islice(rows, _ROWS)):
            columns = zip(*((phrase, *at) for phrase, _, at in part), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in place)
    return texts.select("low", "title", *place).mapInArrow(run, f"phrase string, {kinds}")


def _hits_by_join(texts: DataFrame, place: Sequence[str], asked: DataFrame) -> DataFrame:
    """The same for any number of phrases, by equi-joins.

    A phrase of several words that a text holds has its first word at one of the text's words' ends, so it meets texts on the
    three last characters of that word (or as many as it has); phrases of one word, which may stand inside a word, meet texts on
    three characters anywhere.  Keys travel with the sentence's place alone; the text is fetched for the pairs that met, and compared.
    """
    first = lambda c: F.element_at(F.split(c, " "), 1)
    ends = F.flatten(F.transform(F.split("low", " "), lambda w: F.array(*[F.right(w, F.lit(k)) for k in (1, 2, 3)])))
    grams = lambda k: F.when(F.length("low") >= k, F.transform(F.sequence(F.lit(1), F.length("low") - k + 1), lambda i: F.array_join(F.slice("chars", i, k), ""))).otherwise(F.expr("cast(array() as array<string>)"))
    asked = asked.withColumn("alone", ~F.contains("phrase", F.lit(" ")))
    within = asked.where("not alone").select("phrase", F.right(first(F.col("phrase")), F.lit(3)).alias("key"))
    pairs = texts.select(*place, F.explode(F.array_distinct(ends)).alias("key")).join(within, "key").select("phrase", *place)
    pairs = pairs.unionByName(texts.select(*place, F.col("title").alias("phrase")).join(asked, "phrase").select("phrase", *place))
    alone = asked.where("alone").select("phrase", F.substring("phrase", 1, 3).alias("key"))
    if not alone.isEmpty():
        spelt = texts.withColumn("chars", F.split("low", "")).select(*place, F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("key"))
        pairs = pairs.unionByName(spelt.join(alone, "key").select("phrase", *place))
    met = pairs.distinct().select("phrase", *[F.col(c).alias(f"_{c}") for c in place])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    return texts.join(met, same).where(F.contains("low", "phrase") | (F.col("title") == F.col("phrase"))).select("phrase", *place)


def mention_hits(manifest: DataFrame, phrases: DataFrame, order: Sequence[str] = ("sample_id", "stream_position"), limit: int | None = None) -> DataFrame:
    """(phrase, order, source_ref) of every sentence that holds a phrase, or whose document's title it is.

    Case and runs of white space don't count; phrases come back folded.  Titles are a column `title`, if there is one.  Phrases
    are sent to the texts and looked for there; more than MOST_ASKED are joined with them.  With a limit, hits that can't be among a
    phrase's first `limit` by `order` may be left out.
    """
    place = list(dict.fromkeys([*order, "source_ref"]))
    asked = stored(phrases.select(folded(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct(), "phrases")
    title = folded(F.col("title")) if "title" in manifest.columns else F.lit(None).cast("string")
    texts = manifest.select(*place, folded(F.col("text")).alias("low"), title.alias("title"))
    size = asked.agg(F.sum(F.length("phrase") + F.lit(64)).alias("n")).first()["n"] or 0
    if size > MOST_ASKED:
        return _hits_by_join(texts, place, asked)
    return _hits_by_task(texts, place, len(order), [r["phrase"] for r in asked.collect()], limit)  # MOST_ASKED characters at most


def mention_search(manifest: DataFrame, phrases: DataFrame, limit: int, order: Sequence[str] = ("sample_id", "stream_position")) -> DataFrame:
    """(phrase, source_ref, place) of the first `limit` sentences that hold a phrase or stand under it as their title, by `order`.

    Any columns that order the sentences will do, so a manifest without positions needs no window over its texts.
    """
    place = F.row_number().over(Window.partitionBy("phrase").orderBy(*order))
    return mention_hits(manifest, phrases, order, limit).withColumn("place", place).where(F.col("place") <= limit).select("phrase", "source_ref", "place")
