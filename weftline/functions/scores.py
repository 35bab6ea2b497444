"""Scores of a solution against right answers, and the scorer that each data source has.  All stay in the JVM.

A score is a column of doubles; a null solution scores 0.  Scorers that run code or a symbolic solver aren't here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Fixed values of the answer normaliser: what is replaced, then what is deleted, in this order.
REPLACED = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
DELETED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often it is used: an expression that repeats its input grows with every step."""
    return F.element_at(F.transform(F.array(c), use), 1)


def boxed(c: Column) -> Column:
    r"""What the last box holds: `\boxed x` up to a dollar sign where there is one, else the last balanced `\boxed{x}`; null without one."""
    spaced = lambda s: F.substring_index(F.substring_index(s, "\\boxed ", -1), "$", 1)
    return _let(c, lambda s: F.when(F.contains(s, F.lit("\\boxed ")), spaced(s)).when(F.contains(s, F.lit("\\boxed{")), text.last_boxed(s)))


def _latex(c: Column) -> Column:
    """Spellings of one formula brought together, as far as they need no look at its whole."""
    c = _swap(c, ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
    return c


def plain_latex(c: Column) -> Column:
    """A short answer's formula without marks that don't count."""
    return _swap(_latex(c), ("\\%", ""), (" .", " 0."), ("{.", "{0."), (" ", ""))


def clean_latex(c: Column) -> Column:
    r"""A formula in one spelling: no unit after it, no `x=` before it, braces around fractions' and roots' arguments; null if it breaks off."""
    unit = F.lit("\\text{ ")
    c = _latex(c)
    c = _let(c, lambda s: F.when(F.contains(s, unit), F.substring_index(s, "\\text{ ", 1)).otherwise(s))
    c = _swap(c, ("\\%", ""), (" .", " 0."), ("{.", "{0."))
    c = F.regexp_replace(c, r"^\.", "0.")
    c = _let(c, lambda s: F.when(s.rlike(r"^[^=]{0,2}=[^=]*$"), F.substring_index(s, "=", -1)).otherwise(s))
    c = _let(c, lambda s: F.when(~s.rlike(r"\\sqrt$"), F.replace(F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))))
    two = lambda s: F.regexp_replace(F.regexp_replace(s, r"\\frac([^{])\{", r"\\frac{$1}{"), r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    c = _let(c, lambda s: F.when(s.rlike(r"\\frac($|\\frac)"), F.lit(None)).when(s.rlike(r"\\frac[^{]($|\\frac)"), s).otherwise(two(s)))
    c = F.regexp_replace(c, r"^0\.5$", r"\\frac{1}{2}")
    return F.regexp_replace(c, r"^(-?[1-9][0-9]*|0)/(-?[1-9][0-9]*|0)$", r"\\frac{$1}{$2}")


def same_latex(a: Column, b: Column, clean: Callable[[Column], Column] = clean_latex) -> Column:
    """Whether two formulas are one; where one of them breaks off, letter by letter."""
    both = F.struct(clean(a).alias("x"), clean(b).alias("y"))
    return F.coalesce(_let(both, lambda s: F.when(s["x"].isNotNull() & s["y"].isNotNull(), s["x"] == s["y"]).otherwise(a == b)), F.lit(False))


def math_score(solution: Column, truth: Column) -> Column:
    return same_latex(boxed(solution), truth).cast("double")


def number_score(solution: Column, truth: Column, strict: bool = False, wrong: float = 0.0) -> Column:
    """1 where the solution's number is the truth's text; `wrong` for another number, 0 for none."""
    found = text.number_strict(solution) if strict else text.number_flexible(solution)
    return _let(found, lambda n: F.when(n.isNull(), 0.0).when(n == truth, 1.0).otherwise(F.lit(float(wrong))))


def answer_score(solution: Column, truths: Column, metric: str = "em") -> Column:
    """The best score over the truths of what is boxed in the last 300 characters, in lower case."""
    if metric not in ("em", "f1"):
        raise ValueError(f"no such metric: {metric}")
    found = boxed(F.lower(F.right(solution, F.lit(300))))
    score = lambda found: F.array_max(F.transform(truths, lambda t: F.coalesce(one(found, t), F.lit(0.0))))
    one = (lambda found, t: same_latex(found, F.lower(t), plain_latex).cast("double")) if metric == "em" else (lambda found, t: text.bag_f1(text.words(found), text.words(F.lower(t))))
    return F.coalesce(_let(found, score), F.lit(0.0))


def final_answer(c: Column) -> Column:
    """A competition answer in one spelling: what follows the last `=`, without units, marks and text around it."""
    c = _swap(F.substring_index(c, "=", -1), *REPLACED, *((d, "") for d in DELETED))
    c = F.regexp_replace(c, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for mark, inner in (("text", ".*?"), ("textbf", ".*?"), ("overline", ".*?"), ("boxed", ".*")):
        c = F.regexp_replace(c, rf"\\{mark}\{{({inner})\}}", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    c = F.replace(c, F.lit("$"), F.lit(""))
    return F.trim(_let(c, lambda s: F.when(s.rlike("^,*[0-9][0-9,]*$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)))


def competition_answer(solution: Column, strict_box: bool = False) -> Column:
    """What a solution answers: after the last "Answer:" of its last 300 characters, or strictly what its last 100 have in a box."""
    if strict_box:
        return text.last_boxed(F.right(solution, F.lit(100)))
    found = F.regexp_extract_all(F.right(solution, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1)
    return final_answer(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]")))


def competition_score(solution: Column, truth: Column, strict_box: bool = False) -> Column:
    """1 where right, else -1."""
    found = competition_answer(solution, strict_box)
    return F.when(found == (truth if strict_box else final_answer(truth)), 1.0).otherwise(-1.0)


# How much of a geometry score is the answer and how much the form; the form.
ANSWER_SHARE, FORM_SHARE = 0.9, 0.1
GEOMETRY_FORM = r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"


def geometry_score(solution: Column, truth: Column) -> Column:
    """0.9 for the boxed answer, 0.1 for thoughts in <think> tags before a box."""
    right = F.coalesce(same_latex(boxed(solution), truth), F.lit(False)).cast("double")
    return ANSWER_SHARE * right + FORM_SHARE * F.coalesce(solution.rlike(GEOMETRY_FORM), F.lit(False)).cast("double")


#: Names of sources that are scored as formulas.
FORMULA_SOURCES = ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "AIME", "AMC", "MINERVA", "MATH", "math_dapo")


def by_source(source: Column, solution: Column, truths: Column, metric: str = "em", more: Mapping[str, Column] | None = None) -> Column:
    """Each row's score by its data source; `more` adds scorers by name; the row of an unknown source raises."""
    first = F.try_element_at(truths, F.lit(1))
    out = F.when(source == "openai/gsm8k", number_score(solution, first))
    out = out.when(source.isin(*FORMULA_SOURCES) | F.contains(source, F.lit("MATH")), math_score(solution, first))
    out = out.when(F.startswith(source, F.lit("aime")), competition_score(solution, first)).when(source == "hotpotqa", answer_score(solution, truths, metric))
    out = out.when(source == "hiyouga/geometry3k", geometry_score(solution, first))
    for name, score in (more or {}).items():
        out = out.when(source == name, score)
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for the source "), F.coalesce(source, F.lit("null")))).cast("double"))
