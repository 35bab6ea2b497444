"""Column functions over text: normalisers, mentions, extraction, rewards.  All but those named *_udf stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

QUOTES = "\"'“”‘’"
_EDGE = rf"^[\s{QUOTES}]+|[\s{QUOTES}]+$"


def entity(c: Column) -> Column:
    """Entity normaliser: lower case, no white space or quotes at the ends, single spaces.

    Lower case stands for case folding; use entity_udf where texts hold characters that fold to several (such as ß).
    """
    return F.regexp_replace(F.regexp_replace(F.lower(c), _EDGE, ""), r"\s+", " ")


@F.pandas_udf(StringType())
def entity_udf(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else " ".join(s.casefold().strip(" \t\r\n\x0b\f" + QUOTES).split()))


@F.pandas_udf(StringType())
def span_udf(c: pd.Series) -> pd.Series:
    """Span normaliser: NFKC, case folding, everything but word characters to spaces."""
    return c.map(lambda s: None if s is None else " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", s).casefold()).split()))


def span(c: Column) -> Column:
    """The same for texts that NFKC and case folding leave as lower case does."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def contains_span(text: Column, part: Column) -> Column:
    """Whether the normalised part is in the normalised text, not bound to words; an empty part isn't."""
    return F.contains(span(text), span(part)) & (span(part) != "")


def mentions(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in a text as whole words, whatever their case."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", phrase.strip())
    return text.rlike(rf"(?iU)(?<!\w){quoted}(?!\w)") if phrase.strip() else F.lit(False)


def entity_key(c: Column) -> Column:
    """Entity without the quotes around it and a parenthesis at its end, punctuation as spaces."""
    unquoted = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^[\"']+|[\"']+$", "")
    bare = F.regexp_replace(unquoted, r"\s*\([^()]*\)\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"(?U)[^\w\s]", " "), r"\s+", " "))


def disambiguator(c: Column) -> Column:
    """What stands in the parenthesis at an entity's end; null if none."""
    got = F.regexp_extract(c, r"\(([^()]*)\)\s*$", 1)
    return F.when(got != "", got)


def spaced_answer(c: Column) -> Column:
    """Answer normaliser with punctuation as spaces; true and false are yes and no; null is empty."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[^\w\s]", " "), r"\s+", " "))
    return F.when(flat == "true", "yes").when(flat == "false", "no").otherwise(flat)


def bare_answer(c: Column) -> Column:
    """Answer normaliser that deletes ASCII punctuation, then drops a, an and the."""
    kept = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(a: Column, b: Column) -> Column:
    return bare_answer(a) == bare_answer(b)


def either_contains(a: Column, b: Column) -> Column:
    x, y = bare_answer(a), bare_answer(b)
    return F.contains(x, y) | F.contains(y, x)


def words(c: Column) -> Column:
    """White-space words; an empty array for a blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(words(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags of tokens."""
    times = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(times(a, t), times(b, t)))


def bag_f1(a: Column, b: Column) -> Column:
    """Token F1 of two bags; 0 where nothing is shared."""
    same = bag_overlap(a, b)
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(a) + F.size(b)))


def after_think(c: Column) -> Column:
    """What follows the last </think>; the whole text without one."""
    return F.trim(F.substring_index(c, "</think>", -1))


def the_answer_is(c: Column) -> Column:
    """What follows the last "the answer is", without stars and full stops at its ends; null without one."""
    plain = F.regexp_replace(c, r"\*", "")
    got = F.regexp_replace(F.trim(F.substring_index(plain, "the answer is", -1)), r"^\.+|\.+$", "")
    return F.when(F.contains(plain, F.lit("the answer is")), F.trim(got))


def last_boxed(c: Column) -> Column:
    r"""Content of the last \boxed{...} with balanced braces, else of the last \fbox{...}; null if there is none whole."""

    def content(mark: str) -> Column:
        rest = F.when(F.instr(c, mark) > 0, F.substring_index(c, mark, -1))
        start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

        def step(s: Column, ch: Column) -> Column:
            depth = F.when(s["done"], s["depth"]).when(ch == "{", s["depth"] + 1).when(ch == "}", s["depth"] - 1).otherwise(s["depth"])
            done = s["done"] | (depth == 0)
            return F.struct(depth.alias("depth"), F.when(done, s["out"]).otherwise(F.concat(s["out"], ch)).alias("out"), done.alias("done"))

        return F.aggregate(F.split(rest, ""), start, step, lambda s: F.when(s["done"], s["out"]))

    return F.coalesce(content("\\boxed{"), content("\\fbox{"))


def tags(c: Column, name: str, greedy: bool = False) -> Column:
    """Contents of each <name>...</name> on one line."""
    return F.regexp_extract_all(c, F.lit(f"<{name}>({'.+' if greedy else '.*?'})</{name}>"), 1)


def first_tag(c: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(tags(c, name), F.lit(1)), F.lit(""))


def one_tag(c: Column, name: str) -> Column:
    """1.0 where exactly one tag isn't blank, else 0.0."""
    return (F.size(F.filter(tags(c, name), lambda t: F.trim(t) != "")) == 1).cast("double")


def format_reward(response: Column, action: Column) -> Column:
    """By action: 1 recall, 2 update, 0 final answer; exactly one tag that isn't blank."""
    boxed = F.filter(F.regexp_extract_all(response, F.lit(r"\\boxed\{(.+)\}"), 1), lambda t: F.trim(t) != "")
    return F.when(action == 1, one_tag(response, "recall")).when(action == 2, one_tag(response, "update")).when(action == 0, (F.size(boxed) == 1).cast("double"))


def word_recall(text: Column, truths: Column) -> Column:
    """Mean over the truths of the share of a truth's words that are in the text; a blank truth counts 0."""
    share = lambda t: F.when(F.size(words(t)) == 0, 0.0).otherwise(F.size(F.filter(words(t), lambda w: F.contains(text, w))) / F.size(words(t)))
    return F.aggregate(truths, F.lit(0.0).cast("double"), lambda s, t: s + share(t)) / F.size(truths)


def number_strict(c: Column) -> Column:
    """The first number after "#### ", without commas; null if there is none."""
    got = F.regexp_extract(c, r"#### (-?[0-9.,]+)", 1)
    return F.when(got != "", F.regexp_replace(got, ",", ""))


def number_flexible(c: Column) -> Column:
    """The last number that isn't a mere full stop (the first one if all are); null if there is none."""
    found = F.regexp_extract_all(c, F.lit(r"(-?[0-9.,]+)"), 1)
    good = F.filter(found, lambda x: x != ".")
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def clip_middle(c: Column, most: int, mark: str = "...") -> Column:
    """A text of more than most characters as its first and last halves around a mark."""
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(half)), F.lit(mark), F.right(c, F.lit(half)))).otherwise(c)


def safe_id(c: Column, most: int = 80) -> Column:
    """An id of letters, digits, dot, dash and underscore; a hash where nothing is left."""
    slug = F.left(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit(most))
    return F.when(slug == "", F.left(F.sha2(c, 256), F.lit(16))).otherwise(slug)


def tool_call(c: Column) -> Column:
    """JSON within the first <tool_call>: its name and arguments; null without one or where it can't be parsed."""
    inner = F.regexp_extract(c, r"(?s)<tool_call>(.*?)</tool_call>", 1)
    return F.from_json(F.when(inner != "", inner), "name string, arguments map<string,string>", {"mode": "PERMISSIVE"})


def callback_count(response: Column) -> Column:
    """1 where a response recalls exactly one thing, else 0."""
    return one_tag(response, "recall")


def update_count(response: Column) -> Column:
    return one_tag(response, "update")


def action_reward(prompt: Column, response: Column, recalled: Column, truths: Column, action: Column) -> Column:
    """What a memory turn (action 2) adds: the recall that its update gains over the memory before, and that what it recalled gains over the prompt."""
    gained = word_recall(first_tag(response, "update"), truths) - word_recall(first_tag(prompt, "memory"), truths)
    revisit = word_recall(F.concat(recalled, F.lit(" "), prompt), truths) - word_recall(prompt, truths)
    return F.when(action == 2, gained + F.greatest(revisit, F.lit(0.0))).when(action.isin(0, 1), 0.0)


def action_weight(prompt: Column, truths: Column, action: Column) -> Column:
    """A turn's weight: 1, or for a memory turn a half more than the truths' words that its prompt has."""
    return F.when(action == 2, word_recall(prompt, truths) + 0.5).when(action.isin(0, 1), 1.0)


def token_template(before: Column, *parts: Column) -> Column:
    """Token ids of a template and its parts in turn, as one array."""
    return F.concat(before, *parts)


# What a name's key loses, and the weights of shared words in an alias's and an anchor's score.
_QUOTES, _PARENTHESIS, _NO_WORD = "\"'", r"\s*\([^)]*\)\s*$", r"[^\w]+"
ALIAS_WORDS, ANCHOR_WORDS, ANCHOR_LEAST, ANCHOR_MORE_WORDS = 0.5, 0.35, 0.35, 4


def _key(s: str) -> str:
    """A name without the quotes around it, a parenthesis at its end, case and signs."""
    bare = re.sub(_PARENTHESIS, "", s.strip().strip(_QUOTES))
    return " ".join(re.sub(_NO_WORD, " ", bare.casefold()).split())


@F.pandas_udf(DoubleType())
def alias_score_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two names are: the matching ratio of their keys, and half the share of the shorter one's words that both have."""

    def score(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        x, y = _key(x), _key(y)
        p, q = set(x.split()), set(y.split())
        return SequenceMatcher(None, x, y).ratio() + ALIAS_WORDS * len(p & q) / max(1, min(len(p), len(q)))

    return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def question_anchor_udf(value: pd.Series, question: pd.Series) -> pd.Series:
    """The run of a question's words that is most like a value: matching ratio, and 0.35 times the Jaccard index of the words.

    Runs have four words more than the value at most; of equal ones the longer wins; null below 0.35.
    """

    def best(v: str | None, q: str | None) -> str | None:
        if v is None or q is None:
            return None
        spans, target = [m.span() for m in re.finditer(r"\w+(?:['’-]\w+)*", q)], _key(v)
        mine, matcher, found = set(target.split()), SequenceMatcher(None, "", ""), (0.0, 0, None)
        for i in range(len(spans)):
            for j in range(i, min(len(spans), i + max(1, len(mine) + ANCHOR_MORE_WORDS))):
                phrase = q[spans[i][0] : spans[j][1]]
                key = _key(phrase)
                matcher.set_seqs(target, key)
                theirs = set(key.split())
                score = matcher.ratio() + ANCHOR_WORDS * len(mine & theirs) / max(1, len(mine | theirs))
                if (score, len(phrase)) > found[:2]:
                    found = (score, len(phrase), phrase)
        return found[2] if found[0] >= ANCHOR_LEAST else None

    return pd.Series([best(v, q) for v, q in zip(value, question, strict=True)], dtype=object)


def callback_distance(prompt: Column) -> Column:
    """Steps between the first recalled and the first current memory in a prompt; 0 without either."""
    first = lambda name: F.try_element_at(F.filter(F.transform(F.regexp_extract_all(prompt, F.lit(rf"<{name}> \(step=(\d+)\)"), 1), lambda x: x.cast("int")), lambda x: x >= 1), F.lit(1))
    return F.coalesce(F.abs(first("recalled_memory") - first("current_memory")), F.lit(0))
