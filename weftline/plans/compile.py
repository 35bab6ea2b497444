"""From a plan to a graph of nodes and edges, and to the joins and expressions that answer it."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from .model import Operator, Plan, is_variable, variables_in
from .validate import ALIASES, operator_kind

#: What the two ends of known relations are.
RELATIONS = {
    "child": ("PERSON", "PERSON"), "country": ("ENTITY", "COUNTRY"), "country of citizenship": ("PERSON", "NATIONALITY"),
    "date of birth": ("PERSON", "DATE"), "date of death": ("PERSON", "DATE"), "director": ("FILM", "PERSON"),
    "father": ("PERSON", "PERSON"), "mother": ("PERSON", "PERSON"), "performer": ("CREATIVE_WORK", "AGENT"),
    "place of birth": ("PERSON", "LOCATION"), "place of death": ("PERSON", "LOCATION"), "publication date": ("CREATIVE_WORK", "DATE"),
}
#: Of two types for one node, the narrower one.
NARROWER = {frozenset(("AGENT", "PERSON")): "PERSON", frozenset(("CREATIVE_WORK", "FILM")): "FILM"}


def signature(relation: str) -> tuple[str, str]:
    return RELATIONS.get(" ".join(relation.lower().split()), ("ENTITY", "ENTITY"))


def narrow(a: str | None, b: str | None) -> str | None:
    if a in (None, "ENTITY"):
        return b or a
    if b in (None, "ENTITY", a):
        return a
    return NARROWER.get(frozenset((a, b)), a)


def answer_target(plan: Plan) -> str | None:
    """The contract's target, else the last operator's output, else the only object that is no subject."""
    if plan.answer is not None and plan.answer.target:
        return plan.answer.target
    for o in reversed(plan.operators):
        if o.output:
            return o.output
    subjects = {p.subject for p in plan.patterns}
    ends = list(dict.fromkeys(p.object for p in plan.patterns if is_variable(p.object) and p.object not in subjects))
    return ends[0] if len(ends) == 1 else None


def graph(plan: Plan) -> dict[str, Any]:
    """Nodes by symbol (kind, type), edges in the plan's order, the target, and a hash of all of it."""
    target = answer_target(plan)
    nodes: dict[str, dict[str, Any]] = {}

    def node(symbol: str, kind_of: str | None = None) -> None:
        kind = "ANSWER" if symbol == target else "VARIABLE" if is_variable(symbol) else "CONSTANT"
        held = nodes.setdefault(symbol, {"kind": kind, "type": None})
        held["type"] = narrow(held["type"], kind_of)

    edges = []
    for p in plan.patterns:
        a, b = signature(p.family or p.relation)
        node(p.subject, a)
        node(p.object, b)
        edges.append({"id": p.id, "subject": p.subject, "relation": p.relation, "object": p.object, "required": p.required})
    for o in plan.operators:
        for v in variables_in(o.inputs):
            node(v)
        if o.output:
            node(o.output)
    if target:
        node(target)
    else:
        nodes["lambda_answer"] = {"kind": "ANSWER", "type": plan.answer.type if plan.answer else None}
    out = {"nodes": nodes, "edges": edges, "target": target}
    return out | {"id": hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()[:16]}


def operator_column(o: Operator) -> Column | None:
    """An operator as an expression over columns named like its variables; None for those that are only declared."""
    name = ALIASES.get(o.type.upper(), o.type.upper())
    if operator_kind(name) == "DECLARED":
        return None
    arg = lambda v: F.col(v[1:]) if is_variable(v) else F.array(*map(arg, v)) if isinstance(v, (list, tuple)) else F.lit(v)
    args = [arg(v) for v in o.inputs]
    if name == "PROJECT":
        return args[0]
    if name in ("EARLIER", "LATER", "YOUNGER", "OLDER"):
        return getattr(values, name.lower())(*args[:2])
    if name == "COMPARE":
        return values.compare(args[0], args[1], str(o.params.get("comparison", o.params.get("op", "EQ"))))
    if name == "COUNT":
        return F.size(F.array_distinct(args[0]))
    if name in ("INTERSECTION", "UNION"):
        return (F.array_intersect if name == "INTERSECTION" else F.array_union)(args[0], args[1])
    if name in ("ARGMIN", "ARGMAX"):
        keyed = F.transform(F.arrays_zip(args[0].alias("v"), args[1].alias("c")), lambda x, i: F.struct(values.order_key(x["v"]).alias("k"), (i if name == "ARGMIN" else -i).alias("i"), x["c"].alias("c")))
        return (F.array_min if name == "ARGMIN" else F.array_max)(keyed)["c"]
    raise ValueError(f"unsupported operator: {o.type}")


def execute(plan: Plan, facts: DataFrame) -> DataFrame:
    """The plan's bindings over facts, then its operators' outputs, with `answer` where there is a target."""
    from ..operators.graph import path_join

    out = path_join(facts, plan.patterns)
    for o in plan.operators:
        column = operator_column(o)
        if column is not None and o.output:
            out = out.withColumn(o.output[1:] if is_variable(o.output) else o.output, column)
    target = answer_target(plan)
    return out.withColumn("answer", F.col(target[1:])) if target and is_variable(target) else out
