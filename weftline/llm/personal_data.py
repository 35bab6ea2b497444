"""Operator 10, personal data: base patterns, and identifiers that bootstrapped contexts give away.

One pass over the texts finds the base spans and the candidates: tokens with a digit, and any value after a key and `=`
or `:`.  Each has lexical contexts: the cue before it (the one or two words before `=`, `:`, `#`, "is", "number", ...,
with the kinds of characters that follow), its shape (runs of digits and letters with their lengths), its prefix, its
kind after a key, the word right before it and its kind; a card or phone that runs on into other numbers, so that the base
pattern drops it, has its form.  Dates, times of day and version numbers are no candidates, whatever stands before them.
Known from the start are base spans after a cue, tokens of seed formats, and values with a digit after
a seed cue.

Spark then scores the graph of contexts and instances in turns: a context is as good as the share of its distinct
instances that are known, if enough are (a bare word before a value needs a larger share of more instances); an instance of a good context becomes known and counts for its other contexts,
so that a cue leads to a shape, the shape to other cues, and those to other shapes, until no context is added.  Good
contexts mark all of their instances as `secret`; a seed is one wherever it stands.

Defined results: null and empty texts have no spans; spans are code points, end exclusive; base spans never change;
a candidate that touches a base span is none.  Rows with the same id are separate rows; an empty table stays empty.
`redact` keeps all columns whatever their names; `find` reads the two columns named.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, slices, stored

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LIKELY = re.compile(r"[0-9@]")
#: A token with a digit, of six characters or more.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{6,}+")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[0-9]+(?:[.,/][0-9]+)*")
#: What stands before a value: one or two words, then a sign or a word that says what follows.
_CUE = re.compile(
    r"(?:(?<![A-Za-z0-9-])([A-Za-z][A-Za-z0-9-]{0,30})[\x20\t_]{1,2})?(?<![A-Za-z0-9-])([A-Za-z][A-Za-z0-9-]{0,30})(?:[\x20\t]?([=:#])|[\x20\t](?:is|was|no\.?|nr\.?|number|num|code)[\x20\t]?[=:#]?)[\x20\t]?[\"'(]?\Z"
)
#: Any value after a key: groups of digits, or what has no space, quote, bracket or delimiter.
_VALUE = re.compile(r"[=:][\x20\t]?[\"']?([0-9]++(?:[\x20().-]{1,2}[0-9]++)*+(?![A-Za-z0-9_])|[^\s\"'<>,;()\[\]{}&=:]++)")
#: What is no identifier: dates, times, version numbers.
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:1[0-9]|2[01])[0-9]{2}"
_PLAIN = re.compile(
    rf"(?:{_YEAR}[-/.]{_MONTH}[-/.]{_DAY}|{_DAY}[-/.]{_MONTH}[-/.](?:{_YEAR}|[0-9]{{2}})|{_MONTH}[-/.]{_DAY}[-/.](?:{_YEAR}|[0-9]{{2}}))(?:[T ][0-9]{{2}}:?[0-9]{{2}}.*)?|[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?|[vV]?[0-9]{{1,4}}(?:\.[0-9]{{1,5}}){{1,3}}(?:[-+][A-Za-z0-9]{{1,8}})?"
)
_LAST_WORD = re.compile(r"([A-Za-z][A-Za-z-]{1,30})[\x20\t]\Z")
#: Seed formats (fixed values, public formats): access key ids; 40 hexadecimal digits after a key that names no digest.
SEEDS = (re.compile(r"AKIA[0-9A-Z]{16}"), re.compile(r"[0-9a-f]{40}"))
DIGEST_CUES = frozenset("md5 sha sha1 sha256 hash digest checksum commit rev revision etag oid tree parent fingerprint".split())
#: Seed cues (fixed values): words that name an identifier or a secret.
SEED_CUES = frozenset("password passwd passphrase pwd secret token ssn passport iban apikey".split()) | {
    "api key", "access key", "private key", "secret key", "social security", "employee id", "account number", "account no", "tax id", "national id", "licence number", "license number",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans, by kind and place.  Each search takes time in proportion to the text."""
    out = []
    if not text or not _LIKELY.search(text):
        return out
    done = 0
    for m in _AT.finditer(text):
        at = m.start()
        while at > done and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            out.append(("email", at, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def kind_of(token: str) -> str:
    """Which classes of characters a token has."""
    if re.fullmatch(r"[0-9a-f]+", token) and re.search("[a-f]", token):
        return "hex"
    kinds = (("a", r"[a-z]"), ("A", r"[A-Z]"), ("9", r"[0-9]"), ("-", r"[^A-Za-z0-9]"))
    return "".join(k for k, p in kinds if re.search(p, token))


def shape(token: str) -> str | None:
    """A token's form, None for what has none of its own."""
    if len(token) > 24 or token.isdigit() or kind_of(token) in ("hex", "a9", "9"):
        return None
    return form(token)


def form(text: str) -> str:
    """Runs of digits, small and capital letters with their lengths; other characters as they are."""
    return re.sub(r"[0-9]+|[a-z]+|[A-Z]+", lambda m: f"{'9' if m[0].isdigit() else 'a' if m[0].islower() else 'A'}{len(m[0])}", text)


def run_on(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches within a dropped card or phone match (one that runs on into other numbers) that would pass by themselves."""
    starts = {s for _, s, _ in taken}
    for pattern, least, most in ((_PHONE, 8, 15), (_CARD, 16, 19)):
        for m in pattern.finditer(text) if pattern is _CARD or "+" in text else ():
            if m.start() in starts or m.end() - m.start() <= least:
                continue
            groups = [(g.start(), g.end()) for g in _DIGITS.finditer(text, m.start(), m.end())]
            for i, (a, _) in enumerate(groups):
                if i and pattern is _PHONE:
                    break
                digits = ""
                for s, e in groups[i:]:
                    digits += text[s:e]
                    if len(digits) > most:
                        break
                    if len(digits) >= least and (pattern is _PHONE or luhn(digits)):
                        yield (a if pattern is _CARD else m.start()), e


def cues(text: str, start: int) -> tuple[list[str], bool]:
    """(the cues before a place, the shorter one first; whether `=`, `:` or `#` follows them)."""
    m = _CUE.search(text, max(0, start - 80), start)
    if m is None:
        return [], False
    last = m[2].lower().replace("_", " ")
    return [last, f"{m[1].lower()} {last}"] if m[1] else [last], m[3] is not None


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, instance, is a seed, contexts) of tokens with a digit and of all values after a key, outside the base spans.

    Base spans after a cue are seeds of that cue, without a place.  A value without a digit is an instance of its own
    key alone, so that common words carry nothing from key to key.
    """
    out = []
    if not text:
        return out
    for base, start, end in taken:
        found, assigned = cues(text, start)
        kind = kind_of(text[start:end])
        contexts = [f"cue {c} {kind}" for c in found] + [f"value {c}" for c in found if assigned] + [f"{base} {form(text[start:end])}"] * (base in ("card", "phone"))
        if contexts:
            out.append((-1, -1, text[start:end], True, contexts))
    busy = sorted((s, e) for _, s, e in taken)
    free = _Free(busy)
    for start, end in run_on(text, taken) if _LIKELY.search(text) else ():
        if free(start, end):
            kind = "phone" if text[start] == "+" else "card"
            out.append((start, end, text[start:end], False, [f"{kind} {form(text[start:end])}"]))
            busy.append((start, end))
    free = _Free(sorted(busy))
    for m in _TOKEN.finditer(text) if _LIKELY.search(text) else ():
        start, token = m.start(), m[0].rstrip("_+/-")
        end = start + len(token)
        if len(token) < 6 or _PLAIN.fullmatch(token) or not free(start, end):
            continue
        found, assigned = cues(text, start)
        kind, runs = kind_of(token), shape(token)
        contexts = [f"cue {c} {kind}" for c in found]
        if assigned:
            contexts += [f"value {c}" for c in found] + [f"assigned {kind}"]
        if runs:
            contexts.append(f"shape {runs}")
        if len(token) >= 12 and kind not in ("9", "9-"):
            contexts.append(f"prefix {token[:4]} {kind} {len(token)}")
        word = _LAST_WORD.search(text, max(0, start - 32), start)
        if word is not None:
            contexts.append(f"{PROSE}{word[1].lower()} {kind}")
        seed = SEEDS[0].fullmatch(token) is not None or not SEED_CUES.isdisjoint(found) or word is not None and word[1].lower() in SEED_CUES
        seed |= assigned and SEEDS[1].fullmatch(token) is not None and DIGEST_CUES.isdisjoint(found)
        if contexts or seed:
            out.append((start, end, token, seed, contexts))
            busy.append((start, end))
    free = _Free(sorted(busy))
    for m in _VALUE.finditer(text):
        start, value = m.start(1), m[1].rstrip(".!?")
        if not any(c.isalnum() for c in value) or _PLAIN.fullmatch(value) or not free(start, start + len(value)):
            continue
        found, assigned = cues(text, start)
        if assigned:
            digit = any(c.isdigit() for c in value)
            kind = kind_of(value)
            contexts = [f"value {c}" for c in found] + [f"cue {c} {kind}" for c in found if digit]
            seed = digit and not SEED_CUES.isdisjoint(found) and not (_NUMBER.fullmatch(value) and len(value) < 6)
            out.append((start, start + len(value), f"{found[-1]}={value}", seed, contexts))
    return out


class _Free:
    """Whether a stretch touches none of some sorted stretches."""

    def __init__(self, taken: list[tuple[int, int]]):
        self.starts, self.ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return not before or self.ends[before - 1] <= start


FOUND = "row_id long, base array<struct<kind:string,start:int,end:int>>, candidates array<struct<start:int,end:int,instance:long,seed:boolean,contexts:array<string>>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and candidates of every row, materialised under a row id (texts aren't); instances are hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("contexts", pa.list_(pa.string()))]))
        for batch in slices(batches, "text"):
            bases, found = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                found.append([{"start": s, "end": e, "instance": int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True), "seed": x, "contexts": c} for s, e, t, x, c in candidates(text or "", base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(found, cand)], names=["id", "base", "candidates"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {FOUND.split(', ', 1)[1]}")
    return stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "scan")


#: Contexts of a bare word begin with this.
PROSE = "word "


def bootstrap(found: DataFrame, min_share: float = 0.5, min_known: int = 3, prose_share: float = 0.8, prose_known: int = 5) -> DataFrame:
    """(context, share, known): the contexts that end above the thresholds.  Counts are of distinct instances.

    Contexts of a bare word have thresholds of their own.
    Rounds go on until the contexts above the thresholds stay the same: as what is known only grows, so do they.
    """
    edges = stored(
        found.select(F.explode("candidates").alias("c")).select("c.instance", "c.seed", F.explode("c.contexts").alias("context"))
        .groupBy("instance", "context").agg(F.max("seed").alias("known")), "contexts",
    )
    known = edges.where("known").select("instance").distinct()
    n_good, last = -1, None
    while True:
        held = edges.join(known.withColumn("is_known", F.lit(True)), "instance", "left")
        scores = held.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count("is_known").alias("known")).select("context", (F.col("known") / F.col("n")).alias("share"), "known")
        prose = F.startswith("context", F.lit(PROSE))
        enough = (F.col("share") >= F.when(prose, prose_share).otherwise(min_share)) & (F.col("known") >= F.when(prose, prose_known).otherwise(min_known))
        good = stored(scores.where(enough), "good")
        n = good.count()
        if last is not None:
            drop_stored(last)
        if n == n_good:
            return good
        n_good, last = n, good
        known = edges.join(good.select("context"), "context", "left_semi").select("instance").unionByName(edges.where("known").select("instance")).distinct()


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(row_id, id, spans, n_base): all spans by kind and place; the first n_base kinds' spans are the base ones."""
    found = scan(df, id_col, text_col)
    good = bootstrap(found, **settings).select("context")
    each = found.select("row_id", F.explode("candidates").alias("c")).select("row_id", "c.*").where("start >= 0")
    flat = each.select("row_id", "start", "end", F.explode("contexts").alias("context"))
    added = flat.join(good, "context", "left_semi").select("row_id", "start", "end").unionByName(each.where("seed").select("row_id", "start", "end")).distinct()
    by_row = added.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.lit("secret").alias("kind"), "start", "end"))).alias("added"))
    return found.join(by_row, "row_id", "left").select("row_id", F.col("id").alias(id_col), "base", F.concat("base", F.coalesce("added", F.expr("array()"))).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """df with each found span of the text replaced by its kind in angle brackets; needs an id that is unique or null.

    Rows of one id whose texts differ would share spans, so texts are matched by id and hash.
    """
    names = df.columns
    own = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    row_id, row_text = f"row.c{names.index(id_col)}", f"row.c{names.index(text_col)}"
    keyed = own.select(F.struct(F.col(row_id).alias("a"), F.xxhash64(row_text).alias("b")).alias("key"), F.col(row_text).alias("text"))
    got = find(keyed, "key", "text", **settings).where(F.size("spans") > 0)
    spans = got.groupBy(F.col("key.a").alias("span_id"), F.col("key.b").alias("span_key")).agg(F.first("spans").alias("spans"))
    both = own.join(spans, F.col(row_id).eqNullSafe(F.col("span_id")) & (F.xxhash64(row_text) == F.col("span_key")), "left")

    @F.pandas_udf("string")
    def cover(texts, all_spans):
        out = []
        for text, here in zip(texts, all_spans, strict=True):
            if here is not None and len(here):
                parts, at = [], 0
                for s in sorted(here, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
                        at = s["end"]
                text = "".join([*parts, text[at:]])
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    text = F.when(F.col("spans").isNull(), F.col(row_text)).otherwise(cover(F.col(row_text), "spans"))
    return both.select(*[(text if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:4]]
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return got.select("doc_id", *count, F.sha2(join("base"), 256).alias("base_sha256"), join("spans").alias("spans"))
