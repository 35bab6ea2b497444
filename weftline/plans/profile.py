"""What a question asks for: the operators it needs and its answer's type, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first pattern that a question fits gives the type of its answer.
ANSWER_TYPES = (
    ("BOOLEAN", r"^(is|are|was|were|did|does|do) "),
    ("NUMBER", r"\bhow many\b|\bnumber of\b|\bcount\b"),
    ("DATE", r"^\s*when\b|\b(?:what|which)\s+(?:date|year)\b|\bdate (?:of|was|is)\b"),
    ("NATIONALITY", r"\bnationalit(?:y|ies)\b"),
    ("COUNTRY", r"\b(?:which|what) country\b|\bcountry (?:is|was|are|were|does|did)\b"),
    ("LOCATION", r"^\s*where\b|\bplace of (?:birth|death)\b|\b(?:which|what) (?:city|place|location)\b"),
    ("ENTITY", r"\bwho\b|\bwhich (person|film|movie|company)\b"),
)
EARLIER = r"\b(first|earlier|before|oldest|born first)\b"
LATER = r"\b(last|later|after|youngest|younger)\b"


def answer_type(question: Column) -> Column:
    low = F.lower(question)
    out = F.when(low.rlike(ANSWER_TYPES[0][1]), ANSWER_TYPES[0][0])
    for name, pattern in ANSWER_TYPES[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("SHORT_TEXT")


def required_operators(question: Column, kind: Column) -> Column:
    """Operators that a question of a kind needs, each once, in a fixed order."""
    kind, low = F.lower(F.coalesce(kind, F.lit(""))), F.lower(question)
    order = F.when(low.rlike(EARLIER), F.array(F.lit("COMPARE"), F.lit("EARLIER"))).when(low.rlike(LATER), F.array(F.lit("COMPARE"), F.lit("LATER"))).otherwise(F.array(F.lit("COMPARE")))
    return (
        F.when(kind.isin("compositional", "bridge", "bridge-composition"), F.array(F.lit("PATH_JOIN")))
        .when(kind == "inference", F.array(F.lit("REGISTERED_RULE"))).when(kind.isin("comparison", "bridge-comparison"), order).otherwise(F.expr("cast(array() as array<string>)"))
    )
