"""Plans from gold triples planted in the customer table: questions whose answers the plans must not tell."""

from pyspark.sql import functions as F

from ..plans import gold
from . import query
from .graphs import _ANSWER_CASE

# k: 0 two hops; 1 the same, the middle spelled otherwise; 2 and 3 comparisons; 4 a title that the question has for a name that it hasn't
_QUESTIONS = (
    "'Which part of the world is the home of ' || c_name || ' in?'", "'Which part of the world is the home of ' || c_name || ' in?'", "'Are ' || c_name || ' and ' || b || ' at home in one place?'",
    "'Who came later, ' || c_name || ' or ' || b || '?'", "'Where is the account no ' || c_custkey || ' held?'",
)
_KINDS = ("compositional", "compositional", "comparison", "bridge-comparison", "compositional")
_SAMPLES = f"""q AS (SELECT c_custkey AS sample_id, c_custkey % 5 AS k, c_name, b, CASE c_custkey % 5 {' '.join(f"WHEN {k} THEN {q}" for k, q in enumerate(_QUESTIONS))} END AS text FROM (SELECT *, 'Second ' || c_name AS b FROM customer))"""


def _samples(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.withColumns({"b": F.concat(F.lit("Second "), "c_name"), "k": (F.col("c_custkey") % 5).cast("int"), "home": F.concat("n_name", F.lit(" Land")), "world": F.concat(F.lit("Part "), "r_name")})
    call = lambda *parts: F.array(*[F.col(p) if p in ("c_name", "b", "home", "world") else F.lit(p) for p in parts])
    other = F.array(F.concat(F.lit('"The '), "home", F.lit(' (country)"')), F.lit("continent"), F.col("world"))
    pair = lambda r, x, y: F.array(F.array(F.col("c_name"), F.lit(r), x), F.array(F.col("b"), F.lit(r), y))
    evidence = F.get(F.array(
        F.array(call("c_name", "home country", "home"), call("home", "continent", "world")), F.array(call("c_name", "home country", "home"), other),
        pair("country", F.col("home"), F.col("home")), pair("date of birth", F.lit("1 May 1950"), F.lit("2 May 1950")), F.array(call("c_name", "bank", "world")),
    ), F.col("k"))
    fact = F.struct(F.concat(F.lit("Account No "), "c_custkey").alias("title"), F.lit(0).alias("sentence_id"))
    question = F.expr(f"CASE k {' '.join(f'WHEN {k} THEN {q}' for k, q in enumerate(_QUESTIONS))} END")
    return c.select(
        F.col("c_custkey").alias("sample_id"), question.alias("question"), F.get(F.array(*map(F.lit, _KINDS)), F.col("k")).alias("question_type"), F.when(~F.col("k").isin(2, 3), F.col("world")).otherwise("yes").alias("answer"),
        evidence.alias("evidences"), F.when(F.col("k") == 4, F.array(fact)).otherwise(F.array().cast("array<struct<title:string,sentence_id:int>>")).alias("supporting_facts"),
    )


@query(
    "gold_patterns",
    f"""WITH {_SAMPLES}, p AS (SELECT sample_id, 'p01' AS pattern_id, c_name AS subject, 'home country' AS relation, '?home_country' AS object, '' AS aliases, '?home_country' AS candidate_output FROM q WHERE k < 2
UNION ALL SELECT sample_id, 'p02', '?home_country', 'continent', '?continent', '', NULL FROM q WHERE k < 2
UNION ALL SELECT sample_id, 'p01', c_name, 'country', '?country', '', NULL FROM q WHERE k = 2 UNION ALL SELECT sample_id, 'p02', b, 'country', '?country_2', '', NULL FROM q WHERE k = 2
UNION ALL SELECT sample_id, 'p01', c_name, 'date of birth', '?date_of_birth', '', NULL FROM q WHERE k = 3 UNION ALL SELECT sample_id, 'p02', b, 'date of birth', '?date_of_birth_2', '', NULL FROM q WHERE k = 3
UNION ALL SELECT sample_id, 'p01', 'Account No ' || sample_id, 'bank', '?bank', c_name, NULL FROM q WHERE k = 4) SELECT * FROM p""",
)
def _(t):
    patterns, _plans = gold.compile_plans(_samples(t))
    return patterns.select("sample_id", "pattern_id", "subject", "relation", "object", F.coalesce(F.array_join("subject_aliases", "|"), F.lit("")).alias("aliases"), "candidate_output")


@query(
    "gold_plans",
    f"""WITH {_SAMPLES} SELECT sample_id, CASE WHEN k = 3 THEN 'ENTITY' ELSE {_ANSWER_CASE} END AS answer_type, CASE WHEN k < 2 THEN '?continent' WHEN k = 4 THEN '?bank' ELSE '?answer' END AS target,
CASE k WHEN 2 THEN 'COMPARE' WHEN 3 THEN 'ARGMAX' END AS operator, CASE k WHEN 2 THEN '?country|?country_2' WHEN 3 THEN '?date_of_birth|?date_of_birth_2' END AS inputs, CASE WHEN k = 3 THEN c_name || '|' || b END AS candidates, NULL AS error FROM q""",
)
def _(t):
    _patterns, plans = gold.compile_plans(_samples(t))
    return plans.select("sample_id", "answer_type", "target", "operator", F.array_join("inputs", "|").alias("inputs"), F.array_join("candidates", "|").alias("candidates"), "error")
