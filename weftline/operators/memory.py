"""Recurrent memory: chunks of a context go by in order, each turn rewriting a memory and recalling an earlier one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .fold import ordered_fold

# What stands where there is no memory, and how an answer asks for an earlier one.
NO_MEMORY, NOT_RECALLED = "No previous memory", "No memory was recalled."
RECALL = re.compile(r"<recall>(.+)</recall>")
RECALLS = re.compile(r"<recall>.*?</recall>", re.DOTALL)
_SIGNS = re.compile(r"[^\w\s]")


def _tokens(s: str) -> set[str]:
    return set(_SIGNS.sub("", s.lower()).split())


def nearest(query: str | None, held: dict[str, set[str]]) -> str | None:
    """The held memory of the highest Jaccard similarity to a query, above 0; of equals the earliest."""
    best, found = 0.0, None
    asked = _tokens(query) if query else set()
    for memory, tokens in held.items():
        union = len(asked | tokens)
        score = len(asked & tokens) / union if union else 0.0
        if score > best:
            best, found = score, memory
    return found


def memory_fold(chunks: DataFrame, key: str, order: str, chunk: str, respond: Callable[[str, str | None, str, str], str], keep: int = 64) -> DataFrame:
    """(key, step, final, memory, recalled, response) of every turn, the final one last.

    chunks: (key, order, chunk).  respond(key, chunk, memory, recalled) is a turn's answer (a model or any function that workers can
    run); chunk is null in the final turn alone (a null chunk counts as empty).  What it asks for in <recall> tags is looked up in the last `keep` different
    memories of its key, and the answer without those is the next memory.  `memory` and `recalled` are what the turn saw.
    A key's chunks stream through one task, which holds a memory, `keep` earlier ones and a few chunks.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def turn(state: dict, part: str | None, final: bool) -> tuple:
        said = respond(state["key"], part, state["memory"] or NO_MEMORY, state["recalled"] or NOT_RECALLED)
        row = (state["key"], state["step"], final, state["memory"] or NO_MEMORY, state["recalled"] or NOT_RECALLED, said)
        asked = RECALL.search(said)
        state["recalled"] = nearest(asked.group(1) if asked else None, state["held"])
        state["memory"] = RECALLS.sub("", said).strip()
        held = state["held"]
        if state["memory"] not in held:
            held[state["memory"]] = _tokens(state["memory"])
            if len(held) > keep:
                del held[next(iter(held))]
        state["step"] += 1
        return row

    begin = lambda k: {"key": k[0], "step": 0, "memory": None, "recalled": None, "held": {}}
    step = lambda s, r: (s, [turn(s, r[chunk] or "", False)])
    return ordered_fold(chunks.select(key, order, chunk), [key], [order], begin, step, f"`{key}` {kind}, step long, final boolean, memory string, recalled string, response string", lambda s: [turn(s, None, True)])


def recall_earlier(written: DataFrame, asked: DataFrame, least: float = 0.2) -> DataFrame:
    """(run_id, step, found, score): for each query the most alike of the memories that its run wrote in earlier steps.

    written: (run_id, step, text), asked: (run_id, step, query).  Similarity is the Jaccard index of token sets, `least` at least (above
    0); of equals the earliest step.  Tokens are put in order from the run's rarest; two sets that are alike enough share one of
    their first n - ceil(least * n) + 1, so only those are joined, by run and token, under the conditions that the memory is
    earlier and the sizes are near; what is left is compared whole.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    sets = written.select("run_id", "step", F.lit(0).alias("kind"), text.token_set(F.col("text")).alias("tokens")).unionByName(asked.select("run_id", "step", F.lit(1).alias("kind"), text.token_set(F.col("query")).alias("tokens")))
    sets = sets.where(F.size("tokens") > 0).withColumn("n", F.size("tokens"))
    rows = sets.select("run_id", "step", "kind", "n", F.explode("tokens").alias("t"))
    rows = rows.join(rows.groupBy("run_id", "t").agg(F.count(F.lit(1)).alias("df")), ["run_id", "t"])
    place = F.row_number().over(Window.partitionBy("run_id", "kind", "step").orderBy("df", "t"))
    rows = rows.withColumn("_place", place).where(F.col("_place") <= F.col("n") - F.ceil(F.col("n") * (least - 1e-12)) + 1)
    end = lambda kind, s, n: rows.where(F.col("kind") == kind).select("run_id", "t", F.col("step").alias(s), F.col("n").alias(n))
    near = (F.col("w_n") >= (least - 1e-12) * F.col("a_n")) & (F.col("a_n") >= (least - 1e-12) * F.col("w_n"))
    pairs = end(0, "found", "w_n").join(end(1, "step", "a_n"), ["run_id", "t"]).where((F.col("found") < F.col("step")) & near).select("run_id", "found", "step").distinct()
    whole = lambda kind, s, c: sets.where(F.col("kind") == kind).select("run_id", F.col("step").alias(s), F.col("tokens").alias(c))
    both = pairs.join(whole(0, "found", "x"), ["run_id", "found"]).join(whole(1, "step", "y"), ["run_id", "step"])
    same = F.size(F.array_intersect("x", "y"))
    scored = both.select("run_id", "step", "found", (same / (F.size("x") + F.size("y") - same)).alias("score")).where(F.col("score") >= least - 1e-12)
    best = scored.groupBy("run_id", "step").agg(F.max_by(F.struct("found", "score"), F.struct("score", -F.col("found"))).alias("b"))
    return best.select("run_id", "step", "b.found", "b.score")


def chunk_words(texts: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, order, chunk): texts cut into chunks of `size` words."""
    words = text.words(F.col(column))
    n = F.greatest(F.ceil(F.size(words) / size).cast("int"), F.lit(1))
    return texts.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))).alias("order", "chunk"))
