"""Graph-pattern queries over facts: path joins, delayed binding, frontier, sufficiency, evidence packs.

facts: (subject, relation, object, source_ref, stream_position, window_index).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.model import Pattern, is_variable
from ..tables import drop, stored


def keyed(facts: DataFrame) -> DataFrame:
    """facts with the normalised forms of relation, subject and object, by which spellings count: _r, _s, _o."""
    if "_r" in facts.columns:
        return facts
    return facts.withColumns({"_r": text.entity(F.col("relation")), "_s": text.entity(F.col("subject")), "_o": text.entity(F.col("object"))})


def _norm(s: str) -> str:
    """What text.entity makes of a constant."""
    return re.sub(r"\s+", " ", s.lower().strip(" \t\r\n\x0b\f" + text.QUOTES))


def matching(facts: DataFrame, pattern: Pattern) -> DataFrame:
    """Facts of a pattern's relation that its constants allow, with the fact's place, and for each variable a column and its key.

    `?a` has a column a as the fact spells it, and _key_a, on which patterns join.  Facts that are `keyed` and stored are filtered
    where they are read.
    """
    rows = keyed(facts).where(F.col("_r") == _norm(pattern.family or pattern.relation))
    for end, value, key in (("subject", pattern.subject, "_s"), ("object", pattern.object, "_o")):
        if not is_variable(value):
            rows = rows.where(F.col(key).isin(*[_norm(n) for n in (value, *pattern.aliases.get(end, ()))]))
    out = [F.col("source_ref").alias(f"ref_{pattern.id}"), F.col("stream_position").alias(f"at_{pattern.id}")]
    for end, value, key in (("subject", pattern.subject, "_s"), ("object", pattern.object, "_o")):
        if is_variable(value):
            out += [F.col(end).alias(value[1:]), F.col(key).alias(f"_key_{value[1:]}")]
    return rows.select(*out)


def path_join(facts: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """All bindings of the patterns' variables: one equi-join for each pattern, on the keys of the variables that it shares.

    Facts are normalised once, into a stored table of keys that every pattern reads with its own filter; a variable is given as the
    first pattern that has it spells it.
    """
    left = list(patterns)
    if len(left) > 1:
        facts = stored(keyed(facts.select("subject", "relation", "object", "source_ref", "stream_position")), "facts")
    bound = matching(facts, left[0])
    names = {v[1:] for v in (left[0].subject, left[0].object) if is_variable(v)}
    del left[0]
    while left:
        following = next((p for p in left if names & {v[1:] for v in (p.subject, p.object) if is_variable(v)}), None)
        if following is None:
            raise ValueError("the patterns aren't connected by variables")
        mine = {v[1:] for v in (following.subject, following.object) if is_variable(v)}
        shared = sorted(names & mine)
        bound = bound.join(matching(facts, following).drop(*shared), [f"_key_{v}" for v in shared])
        names |= mine
        left.remove(following)
    return bound.drop(*[f"_key_{v}" for v in names])


def cascade(facts: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Every fact that the patterns commit, and when: (pattern_id, subject, object, source_ref, stream_position, bound_at, committed_at, status).

    Patterns bind in turn, each from its subject to its object (subjects are constants, unbound, or objects of patterns
    before it).  A fact whose subject is bound already when it is read is DIRECT; one that is read before waits, and is
    PROMOTED where the first fact that binds its subject is committed, at once with facts that wait for its own object.
    Joins are on normalised spellings, one a pattern, whatever the number of facts.
    """
    bound: dict[str, DataFrame] = {}
    out = []
    left = list(patterns)
    while left:
        produced = {p.object for p in left if is_variable(p.object)}
        p = next((q for q in left if q.subject not in produced), None)
        if p is None:
            raise ValueError("the patterns bind in a circle")
        left.remove(p)
        rows = facts.where(text.entity(F.col("relation")) == text.entity(F.lit(p.family or p.relation)))
        for end, value in (("subject", p.subject), ("object", p.object)):
            if not is_variable(value):
                rows = rows.where(F.array_contains(F.array(*[text.entity(F.lit(n)) for n in (value, *p.aliases.get(end, ()))]), text.entity(F.col(end))))
        rows = rows.withColumns({"_s": text.entity(F.col("subject")), "_o": text.entity(F.col("object"))})
        if p.subject in bound:
            rows = rows.join(bound[p.subject].withColumnRenamed("key", "_s"), "_s")
        else:
            rows = rows.withColumn("bound_at", F.lit(None).cast("long"))
        late = F.col("bound_at") > F.col("stream_position")
        rows = rows.withColumns({"committed_at": F.greatest("bound_at", "stream_position"), "status": F.when(late, "PROMOTED").otherwise("DIRECT")})
        out.append(rows.select(F.lit(p.id).alias("pattern_id"), "subject", "object", "source_ref", "stream_position", "bound_at", "committed_at", "status"))
        if is_variable(p.object):
            first = rows.groupBy(F.col("_o").alias("key")).agg(F.min("committed_at").alias("bound_at"))
            before = bound.get(p.object)
            bound[p.object] = first if before is None else before.unionByName(first).groupBy("key").agg(F.min("bound_at").alias("bound_at"))
    return reduce(lambda a, b: a.unionByName(b), out)


def deferred_matches(waiting: DataFrame, needs: DataFrame) -> DataFrame:
    """(claim_id, variable, by_title): waiting facts that a new binding asks for, on its side and of its relation.

    waiting: (claim_id, subject, relation, object, title, text); needs: (variable, side, value, relation).  A fact meets
    a need if the end on that side is the value, or if its document's title is, and its sentence mentions that end.
    """
    ends = waiting.select("claim_id", "title", "text", text.entity(F.col("relation")).alias("r"), F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject").alias("end")), F.struct(F.lit("object").alias("side"), F.col("object").alias("end")))).alias("e")).select("claim_id", "title", "text", "r", "e.side", "e.end")
    spelt = F.struct(text.entity(F.col("end")).alias("k"), F.lit(False).alias("by_title"))
    titled = F.when(text.contains_span(F.col("text"), F.col("end")), F.struct(text.entity(F.col("title")).alias("k"), F.lit(True).alias("by_title")))
    keyed = ends.select("claim_id", "r", "side", F.explode(F.array_compact(F.array(spelt, titled))).alias("m")).select("claim_id", "r", "side", "m.k", "m.by_title")
    asked = needs.select("variable", "side", text.entity(F.col("value")).alias("k"), text.entity(F.col("relation")).alias("r"))
    return keyed.join(asked, ["r", "side", "k"]).groupBy("claim_id", "variable").agg(F.min("by_title").alias("by_title"))


def open_descendants(edges: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, edge_id, open): whether a required edge that isn't SATISFIED or CONFLICTED can be reached from an edge's object.

    edges: (run, edge_id, subject, object, required, state).  Paths of any length count, circles too: the pairs of ends with
    a path between them double their length each round, all runs together, until a round finds no new pair.
    """
    ends = edges.select(run, F.col("subject").alias("a"), F.col("object").alias("b"))
    pairs = stored(ends.where(F.startswith("b", F.lit("?"))).distinct(), "paths")
    while True:
        longer = pairs.join(pairs.select(run, F.col("a").alias("b"), F.col("b").alias("c")), [run, "b"]).select(run, "a", F.col("c").alias("b")).distinct()
        new = stored(longer.join(pairs, [run, "a", "b"], "left_anti"), "paths")
        if new.isEmpty():
            drop(new)
            break
        before, pairs = (pairs, new), stored(pairs.unionByName(new), "paths")
        drop(*before)
    here = edges.select(run, F.col("edge_id").alias("origin"), F.col("object").alias("at"))
    reached = here.unionByName(here.join(pairs.withColumnRenamed("a", "at"), [run, "at"]).select(run, "origin", F.col("b").alias("at"))).distinct()
    unfinished = edges.where(F.col("required") & ~F.col("state").isin("SATISFIED", "CONFLICTED")).select(run, F.col("subject").alias("at"), F.col("edge_id").alias("via"))
    hit = reached.join(unfinished, [run, "at"]).where("via <> origin").select(run, F.col("origin").alias("edge_id")).distinct().withColumn("open", F.lit(True))
    return edges.select(run, "edge_id").join(hit, [run, "edge_id"], "left").select(run, "edge_id", F.coalesce("open", F.lit(False)).alias("open"))


def selected_path(claims: DataFrame, bindings: DataFrame) -> DataFrame:
    """Claims of which each end that a variable stands for is that variable's binding.

    claims: (run_id, claim_id, subject_var, subject, object_var, object), a null variable for a constant end.
    """
    for end in ("subject", "object"):
        b = bindings.select("run_id", F.col("variable").alias(f"{end}_var"), text.entity(F.col("value")).alias("_bound"))
        held = claims.join(b, ["run_id", f"{end}_var"], "left")
        claims = held.where(F.col(f"{end}_var").isNull() | (F.col("_bound") == text.entity(F.col(end)))).drop("_bound")
    return claims


def deferred(attributes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Attribute facts by how they meet the binding of their subject: DEFERRED if read in an earlier window, else DIRECT.

    bindings: (entity, window_index); the first window that binds an entity counts.  distance is in windows.
    """
    first = bindings.groupBy(F.col("entity").alias("subject")).agg(F.min("window_index").alias("bound_window"))
    gap = F.col("bound_window") - F.col("window_index")
    return attributes.join(first, "subject").select(*attributes.columns, "bound_window", F.when(gap > 0, "DEFERRED").otherwise("DIRECT").alias("status"), F.greatest(gap, F.lit(0)).alias("distance"))


def first_binding(candidates: DataFrame, key: str, order: Sequence[str | Column], survivors: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """One candidate a key: those that a later pattern confirms come first, then the earliest read."""
    rows = candidates
    if survivors is not None:
        rows = rows.join(survivors.select(on).distinct().withColumn("_confirmed", F.lit(1)), on, "left")
    else:
        rows = rows.withColumn("_confirmed", F.lit(1))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_confirmed").desc_nulls_last(), *order))
    return rows.withColumn("_place", place).where("_place = 1").select(*candidates.columns, F.col("_confirmed").isNotNull().alias("confirmed"))


def edge_states(edges: DataFrame, bindings: DataFrame, supports: DataFrame, flat: bool = False) -> DataFrame:
    """edges (run_id, edge_id, subject, object) with SATISFIED, ACTIVE (one unbound variable at most, or flat) or DORMANT."""
    names = bindings.groupBy("run_id").agg(F.collect_set("variable").alias("bound"))
    done = supports.select("run_id", "edge_id").distinct().withColumn("satisfied", F.lit(True))
    open_end = lambda c: (F.startswith(c, F.lit("?")) & ~F.array_contains(F.coalesce("bound", F.expr("cast(array() as array<string>)")), F.col(c))).cast("int")
    rows = edges.join(names, "run_id", "left").join(done, ["run_id", "edge_id"], "left")
    unbound = open_end("subject") + open_end("object")
    return rows.select("run_id", "edge_id", unbound.alias("unbound"), F.when(F.col("satisfied"), "SATISFIED").when(F.lit(flat) | (unbound <= 1), "ACTIVE").otherwise("DORMANT").alias("state"))


def sufficiency(runs: DataFrame, required: DataFrame, supports: DataFrame, conflicts: DataFrame, target_bound: DataFrame) -> DataFrame:
    """(run_id, status, missing): CONFLICTED before INSUFFICIENT before COMPLETE."""
    missing = required.join(supports, ["run_id", "edge_id"], "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("missing"))
    rows = runs.join(missing, "run_id", "left").join(conflicts.select("run_id").distinct().withColumn("c", F.lit(1)), "run_id", "left").join(target_bound.select("run_id").distinct().withColumn("t", F.lit(1)), "run_id", "left")
    missing_or_0 = F.coalesce("missing", F.lit(0))
    return rows.select("run_id", F.when(F.col("c").isNotNull(), "CONFLICTED").when((missing_or_0 > 0) | F.col("t").isNull(), "INSUFFICIENT").otherwise("COMPLETE").alias("status"), missing_or_0.alias("missing"))


def evidence_pack(bound: DataFrame, run: str, answer: str, patterns: Sequence[Pattern]) -> DataFrame:
    """(run, answer, support): the answer with each edge's source."""
    pairs = reduce(lambda a, b: [*a, *b], [[F.lit(p.id), F.col(f"ref_{p.id}")] for p in patterns], [])
    return bound.select(run, F.col(answer).alias("answer"), F.create_map(*pairs).alias("support"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) by the smallest reachable id: labels spread over the edges until none changes.

    For plans and other graphs of small diameter, whose rounds they are.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")).select("node", "component"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        following = stored(labels.join(near, "node").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved")), "labels")
        moved = not following.where("moved").isEmpty()
        drop(labels)
        labels = following
        if not moved:
            return labels.select("node", "component")


def terminal_objects(patterns: DataFrame) -> DataFrame:
    """Objects that no pattern has as its subject: where an answer comes from if nothing else names it."""
    subjects = patterns.select(F.col("subject").alias("object")).distinct()
    return patterns.select("object").distinct().join(subjects, "object", "left_anti")


def source_local(facts: DataFrame) -> DataFrame:
    """Facts whose span, if any, is in their sentence, and of whose ends at least one is mentioned in text or title."""
    span_ok = F.col("span").isNull() | text.contains_span(F.col("text"), F.col("span"))
    mentioned = lambda c: text.contains_span(F.col("text"), F.col(c)) | text.contains_span(F.col("title"), F.col(c))
    return facts.where(span_ok & (mentioned("subject") | mentioned("object")))


def gold_refs(facts: DataFrame, titles: DataFrame) -> DataFrame:
    """Supporting facts (title, sentence_id) as source refs; of documents with one title the last counts."""
    key = lambda c: F.trim(F.lower(c))
    last = titles.groupBy("sample_id", key("title").alias("k")).agg(F.max_by("document_id", "doc_rank").alias("document_id"))
    return facts.withColumn("k", key("title")).join(last, ["sample_id", "k"]).select("sample_id", F.concat_ws(":", "sample_id", "document_id", F.concat(F.lit("s"), "sentence_id")).alias("source_ref")).distinct()
