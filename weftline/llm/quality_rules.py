"""Operator 9, quality rules: a decision list learned from labelled statistics, emitted as ordered Spark conditions.

`statistics` measures every whole text.  `learn` grows and prunes interpretable conjunctions of thresholds by
sequential covering: a rule takes the condition of the highest information gain again and again on two thirds of the
rows, loses trailing conditions while that helps on the other third, and is kept if it is precise there; the rows
that it covers go, and the next rule is sought.  `verdict` is the list as one CASE expression.

Defined results: null and empty texts have zero statistics and fail the base rules; without labels of both kinds the
list is empty and only the base rules reject.  Rows stay as they are repeated; labels of one id count once each.
`keep` gives the rows that `apply` keeps, with all their columns whatever their names, and shuffles no texts; an empty
table stays empty.  `statistics` reads the two columns named; an id column must not be named like a statistic.
Labelled rows beyond `most` are cut by a hash threshold before they are sorted, so that the driver and the last task are
sent about as many however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, stored, text_bytes, window_hashes, word_hashes, word_spans

#: The most labelled rows that rules are learned from (those of the lowest hash of the id).
MOST_LABELLED = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "mean_word_chars", "distinct_share", "digit_share", "n_words")
_SYMBOL, _UPPER, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?")] = True
_DIGIT[48:58] = True


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each document has."""
    if not len(h):
        return np.zeros(n, np.int64)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n)


def _repeated(doc: np.ndarray, h: np.ndarray, width: int = 3) -> np.ndarray:
    """For each word, whether a window of `width` words that it is in comes twice or more in its document."""
    out = np.zeros(len(h), bool)
    w = window_hashes(h, width)
    if not len(w):
        return out
    at = np.flatnonzero(doc[: len(w)] == doc[width - 1 :])
    if not len(at):
        return out
    d, x = doc[at], w[at]
    order = np.lexsort((x, d))
    same = (d[order][1:] == d[order][:-1]) & (x[order][1:] == x[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    for k in range(width):
        out[hit + k] = True
    return out


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of the texts laid end to end in raw."""
    n = len(offsets) - 1
    start, end, doc = word_spans(raw, offsets)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    per = lambda values: np.bincount(doc, weights=values, minlength=n).astype(np.int64)
    count = lambda table: (c := np.concatenate([[0], np.cumsum(table[raw])]))[offsets[1:]] - c[offsets[:-1]]
    h = word_hashes(raw, start, end, lower=False)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    data = raw.tobytes()
    for i in np.flatnonzero(offsets[1:] > offsets[:-1]):
        text = data[offsets[i] : offsets[i + 1]]
        if b"\n" in text:
            whole = [x for x in text.split(b"\n") if x.strip()]
            lines[i], dup[i] = len(whole), len(whole) - len(set(whole))
        else:
            lines[i] = 1
    out = {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": per(points[end] - points[start]), "n_symbols": count(_SYMBOL),
        "n_dup_lines": dup, "n_repeat_words": per(_repeated(doc, h)),
    }
    words, chars = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    return out | {
        "symbol_share": out["n_symbols"] / chars, "repeat_share": out["n_repeat_words"] / words, "dup_line_share": dup / np.maximum(lines, 1),
        "upper_share": count(_UPPER) / chars, "mark_share": count(_MARK) / chars, "mean_word_chars": out["word_chars"] / words,
        "distinct_share": _distinct(doc, h, n) / words, "digit_share": count(_DIGIT) / chars,
    }


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the five counts, the shares) of every row."""
    names = [*BASE, *(f for f in FEATURES if f not in BASE)]
    if id_col in names:
        raise ValueError(f"an id column named like the statistic {id_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            got = measure(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k]) for k in names)], names=[id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{k} long" for k in BASE), *(f"{k} double" for k in names[len(BASE) :])]))


# --- learning --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>=' or '<=', threshold) that rejects."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, way, least in self.conditions:
            out &= x[name] >= least if way == ">=" else x[name] <= least
        return out

    def column(self) -> Column:
        parts = [F.col(n) >= F.lit(t) if way == ">=" else F.col(n) <= F.lit(t) for n, way, t in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {way} {t:.6g}" for n, way, t in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, steps: int = 64) -> list[tuple[str, str, float]]:
    rule: list[tuple[str, str, float]] = []
    here = np.ones(len(bad), bool)
    while len(rule) < most and (~bad & here).any():
        p0, n0 = (bad & here).sum(), (~bad & here).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, v in x.items():
            mine = v[here]
            cuts = np.unique(np.quantile(mine, np.linspace(0, 1, steps)))
            mids = (cuts[1:] + cuts[:-1]) / 2
            for way in (">=", "<="):
                for cut in mids:
                    held = mine >= cut if way == ">=" else mine <= cut
                    p = (held & bad[here]).sum()
                    if p:
                        gain = p * (np.log2(p / held.sum()) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, way, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        here &= Rule((best[1],)).holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, min_cover: int = 5, most_rules: int = 12, most_conditions: int = 4, seed: int = 7, most_tries: int = 3) -> list[Rule]:
    """Ordered rules that reject.  x: feature -> values of labelled rows; bad: which of them to reject.

    Ends when that many splits in a row into rows to grow and rows to prune on give no rule that is precise on both.
    """
    rules: list[Rule] = []
    if not len(bad):
        return rules
    left, random, failed = np.ones(len(bad), bool), np.random.default_rng(seed), 0
    while len(rules) < most_rules and failed < most_tries and (bad & left).sum() >= min_cover:
        third = random.integers(0, 3, len(bad)) == 0
        failed += 1
        if not (bad & left & ~third).any():
            continue
        grow, prune = left & ~third, left & third
        found = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if not found:
            continue
        held_out = {k: v[prune] for k, v in x.items()}

        def worth(conditions, data=held_out, is_bad=bad[prune]):
            held = Rule(tuple(conditions)).holds(data)
            p, n = (held & is_bad).sum(), (held & ~is_bad).sum()
            return (p - n) / max(1, p + n), p

        best = max((found[:k] for k in range(len(found), 0, -1)), key=worth)
        rule = Rule(tuple(best))
        held = rule.holds(x) & left
        p, n = (held & prune & bad).sum(), (held & prune & ~bad).sum()
        all_p, all_n = (held & bad).sum(), (held & ~bad).sum()
        if not p or all_p < min_cover or p < min_precision * (p + n) or all_p < min_precision * (all_p + all_n):
            continue
        rules.append(rule)
        failed = 0
        left &= ~held
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """True where no base rule and no learned rule rejects; the learned rules are tried in order."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def lowest(rows: DataFrame, hash_col: str, most: int) -> DataFrame:
    """Rows among which are the `most` of the lowest hash: about a quarter more of them, or all where there are no more."""
    n = rows.count()
    share = 1.25 * most / max(n, 1)
    while share < 1:
        cut = rows.where(F.col(hash_col) < F.lit(int(share * 2.0**64) - (1 << 63)))
        if cut.count() >= most:
            return cut
        share *= 2
    return rows


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = MOST_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """At most `most` labelled rows' features and whether each is bad (label 0): the only rows the driver sees."""
    known = labels.select(id_col, F.col(label_col).alias("label")).where(F.col("label").isNotNull())
    rows = stored(stats.join(known, id_col).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), "label", *FEATURES), "labelled")
    rows = lowest(rows, "h", most).orderBy("h", "i").limit(most).toPandas()
    return {f: rows[f].to_numpy(float) for f in FEATURES}, rows["label"].to_numpy() == 0


def apply(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> tuple[DataFrame, list[Rule]]:
    """(id, counts, shares, base_failed, kept) of every row, and the rules; texts are measured once."""
    stats = stored(statistics(df, id_col, text_col), "statistics")
    x, bad = labelled(stats, labels, id_col)
    rules = learn(x, bad, **settings)
    return stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept")), rules


def _measured_rows(df: DataFrame, text_col: str) -> DataFrame:
    """(row: every column, the five counts, the shares) of every row."""
    names, at = [*BASE, *(f for f in FEATURES if f not in BASE)], df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(at)], names=["row", "text"]) for b in batches)
        for batch in slices(both, "text"):
            got = measure(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k]) for k in names)], names=["row", *names])

    rows = df.select(F.struct("*").alias("row"))
    kinds = [T.StructField(k, T.LongType() if k in BASE else T.DoubleType()) for k in names]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *kinds]))


def rules_for(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED, **settings) -> list[Rule]:
    """The rules that `apply` learns; measures the texts of at most `most` labelled ids, picked by a broadcast of those."""
    known = labels.select(F.col(id_col), F.col(label_col)).where(F.col(label_col).isNotNull())
    present = known.join(df.select(id_col).distinct(), id_col, "left_semi")
    (h,) = fresh([id_col, label_col], "h")
    present = stored(present.withColumn(h, F.xxhash64(id_col)), "present")
    picked = stored(lowest(present, h, most).orderBy(h, id_col).limit(most).drop(h), "labelled")
    texts = df.select(id_col, text_col).join(F.broadcast(picked.select(id_col).distinct()), id_col, "left_semi")
    x, bad = labelled(statistics(texts, id_col, text_col), picked, id_col, label_col, most)
    return learn(x, bad, **settings)


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of df that neither a base rule nor a learned one rejects, with all their columns."""
    rules = rules_for(df, labels, id_col, text_col, **settings)
    return _measured_rows(df, text_col).where(verdict(rules)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _ = apply(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", *BASE, "base_failed", "kept")
