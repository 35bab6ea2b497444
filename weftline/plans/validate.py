"""What is wrong with a plan, as (code, place) pairs."""

from __future__ import annotations

import re

from .model import VARIABLE, Plan, is_variable, variables_in

#: Operators that are executed, those that are only declared, and names that stand for others.
EXECUTED = ("EARLIER", "LATER", "YOUNGER", "OLDER", "COMPARE", "COUNT", "INTERSECTION", "UNION", "ARGMIN", "ARGMAX", "PROJECT")
DECLARED = ("DIRECT", "PATH_JOIN", "REGISTERED_RULE", "RULE", "FILTER")
ALIASES = {"JOIN": "PATH_JOIN"}
OUTPUTS = ("output", "output_var", "result", "target")
#: Words that, alone or before a dash or an underscore, stand for an entity that nobody named.
PLACEHOLDERS = ("unknown", "entity", "person", "object", "value")
_PLACEHOLDER = re.compile(rf"({'|'.join(PLACEHOLDERS)})([_-].*)?\Z", re.I | re.S)


def operator_kind(name: str) -> str | None:
    name = ALIASES.get(name.upper(), name.upper())
    return "EXECUTED" if name in EXECUTED else "DECLARED" if name in DECLARED else None


def _said(value: str, question: str) -> bool:
    return bool(value.strip()) and re.search(rf"(?<!\w){re.escape(value.strip())}(?!\w)", question, re.I) is not None


def _anchored(plan: Plan, question: str | None) -> list[int]:
    """The first pattern of each component, joined by shared variables, that no constant ties to the question."""
    group: list[set[int]] = []
    seen: list[set[str]] = []
    for i, p in enumerate(plan.patterns):
        names = {v for v in (p.subject, p.object) if VARIABLE.match(v)}
        touching = [k for k, s in enumerate(seen) if s & names]
        members, all_names = {i}, set(names)
        for k in reversed(touching):
            members |= group.pop(k)
            all_names |= seen.pop(k)
        group.append(members)
        seen.append(all_names)

    def tied(i: int) -> bool:
        p = plan.patterns[i]
        fixed = [v for v in (p.subject, p.object) if not is_variable(v) and not _PLACEHOLDER.match(v.strip())]
        return bool(fixed) if question is None else any(_said(v, question) for v in [*fixed, *p.anchors.values()])

    return sorted(min(g) for g in group if not any(map(tied, g)))


def issues(plan: Plan, question: str | None = None, need_answer: bool = True, need_target: bool = True) -> list[tuple[str, str]]:
    """All of a plan's problems.  With a question, constants have to be in it."""
    out: list[tuple[str, str]] = []
    declared: set[str] = set()
    ids = [p.id for p in plan.patterns]
    for i, p in enumerate(plan.patterns):
        at = f"patterns[{i}]"
        if p.id in ids[:i]:
            out.append(("DUPLICATE_PATTERN_ID", at))
        for end in ("subject", "object"):
            value = getattr(p, end)
            if VARIABLE.match(value):
                declared.add(value)
            elif is_variable(value):
                out.append(("INVALID_VARIABLE", f"{at}.{end}"))
            elif _PLACEHOLDER.match(value.strip()):
                out.append(("INVENTED_PLACEHOLDER", f"{at}.{end}"))
            elif question and not _said(value, question) and not _said(p.anchors.get(end, ""), question):
                out.append(("CONSTANT_NOT_IN_QUESTION", f"{at}.{end}"))
            names = p.aliases.get(end)
            if names is not None and (not 1 <= len(names) <= 4 or any(not isinstance(n, str) or not n.strip() or is_variable(n) for n in names)):
                out.append(("INVALID_PATTERN_ALIASES", f"{at}.{end}"))
        if is_variable(p.subject) and p.subject == p.object:
            out.append(("SELF_LOOP_PATTERN", at))
        if not p.relation.strip():
            out.append(("EMPTY_RELATION", f"{at}.relation"))
    out += [("UNANCHORED_PATTERN_COMPONENT", f"patterns[{i}]") for i in _anchored(plan, question)]
    for i, o in enumerate(plan.operators):
        for key in OUTPUTS:
            value = o.params.get(key)
            if isinstance(value, str) and is_variable(value):
                (declared.add(value) if VARIABLE.match(value) else out.append(("INVALID_OPERATOR_OUTPUT_VARIABLE", f"operators[{i}].params.{key}")))
    for i, o in enumerate(plan.operators):
        if operator_kind(o.type) is None:
            out.append(("UNSUPPORTED_OPERATOR", f"operators[{i}].type"))
        used = variables_in(o.inputs) + variables_in({k: v for k, v in o.params.items() if k not in OUTPUTS})
        out += [("OPERATOR_UNKNOWN_VARIABLE", f"operators[{i}]") for v in used if v not in declared]
    if plan.answer is None:
        if need_answer:
            out.append(("MISSING_ANSWER_CONTRACT", "answer"))
    elif plan.answer.target is None:
        if need_target and plan.answer.type != "BOOLEAN":
            out.append(("MISSING_ANSWER_TARGET", "answer.target"))
    elif VARIABLE.match(plan.answer.target) and plan.answer.target not in declared:
        out.append(("ANSWER_TARGET_UNKNOWN_VARIABLE", "answer.target"))
    return out
