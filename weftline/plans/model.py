"""Query plans: patterns, relation types, operators and an answer contract, as plain data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

VARIABLE = re.compile(r"\?[A-Za-z_][A-Za-z0-9_]*\Z")


def is_variable(value: Any) -> bool:
    return isinstance(value, str) and value.startswith("?")


@dataclass(frozen=True)
class Pattern:
    id: str
    subject: str
    relation: str
    object: str
    family: str | None = None
    required: bool = True
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    anchors: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Operator:
    type: str
    inputs: tuple = ()
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def output(self) -> str | None:
        return next((v for k in ("output", "output_var", "result", "target") if isinstance(v := self.params.get(k), str)), None)


@dataclass(frozen=True)
class Answer:
    target: str | None = None
    type: str = "SHORT_TEXT"


@dataclass(frozen=True)
class Plan:
    patterns: tuple[Pattern, ...]
    operators: tuple[Operator, ...] = ()
    answer: Answer | None = None
    id: str = "plan"


def variables_in(value: Any) -> list[str]:
    """Variables anywhere within nested inputs, in order."""
    if is_variable(value):
        return [value]
    if isinstance(value, dict):
        return [v for x in value.values() for v in variables_in(x)]
    if isinstance(value, (list, tuple)):
        return [v for x in value for v in variables_in(x)]
    return []
