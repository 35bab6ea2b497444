"""Plans: problems, graphs, execution."""

from weftline.plans import compile as plan_compile
from weftline.plans.model import Answer, Operator, Pattern, Plan
from weftline.plans.validate import issues

QUESTION = "Who directed Film A?"
GOOD = Plan((Pattern("T1", "Film A", "director", "?d"),), answer=Answer("?d", "ENTITY"))


def codes(plan, question=QUESTION, **more):
    return {c for c, _ in issues(plan, question, **more)}


def test_issues():
    assert codes(GOOD) == set()
    assert codes(Plan((Pattern("T1", "Film B", "director", "?d"),), answer=Answer("?d"))) == {"CONSTANT_NOT_IN_QUESTION", "UNANCHORED_PATTERN_COMPONENT"}
    assert "DUPLICATE_PATTERN_ID" in codes(Plan(GOOD.patterns * 2, answer=Answer("?d")))
    assert "INVALID_VARIABLE" in codes(Plan((Pattern("T1", "Film A", "director", "?1 x"),), answer=Answer("?d")))
    assert "SELF_LOOP_PATTERN" in codes(Plan((Pattern("T1", "?d", "director", "?d"),), answer=Answer("?d")))
    assert "EMPTY_RELATION" in codes(Plan((Pattern("T1", "Film A", " ", "?d"),), answer=Answer("?d")))
    assert "INVALID_PATTERN_ALIASES" in codes(Plan((Pattern("T1", "Film A", "director", "?d", aliases={"subject": ()}),), answer=Answer("?d")))
    assert codes(Plan(GOOD.patterns)) == {"MISSING_ANSWER_CONTRACT"} and codes(Plan(GOOD.patterns), need_answer=False) == set()
    assert codes(Plan(GOOD.patterns, answer=Answer())) == {"MISSING_ANSWER_TARGET"} and codes(Plan(GOOD.patterns, answer=Answer(None, "BOOLEAN"))) == set()
    assert codes(Plan(GOOD.patterns, answer=Answer("?z"))) == {"ANSWER_TARGET_UNKNOWN_VARIABLE"}
    ops = (Operator("NOPE", ("?q",), {"output": "?out"}), Operator("COUNT", (["?d"],), {"output": "?9"}))
    assert codes(Plan(GOOD.patterns, ops, Answer("?out"))) == {"UNSUPPORTED_OPERATOR", "OPERATOR_UNKNOWN_VARIABLE", "INVALID_OPERATOR_OUTPUT_VARIABLE"}
    free = Pattern("T2", "?a", "child", "?b")
    assert ("UNANCHORED_PATTERN_COMPONENT", "patterns[1]") in issues(Plan((*GOOD.patterns, free), answer=Answer("?d")), QUESTION)
    assert codes(Plan((*GOOD.patterns, Pattern("T2", "?d", "child", "?b")), answer=Answer("?b"))) == set()
    assert codes(Plan(GOOD.patterns, (Operator("JOIN", ("?d",)),), Answer("?d"))) == set()


def test_graph_and_target():
    plan = Plan((Pattern("T1", "Film A", "director", "?d"), Pattern("T2", "?d", "date of birth", "?t")))
    g = plan_compile.graph(plan)
    assert g["target"] == "?t" and g["nodes"]["?d"] == {"kind": "VARIABLE", "type": "PERSON"} and g["nodes"]["?t"]["kind"] == "ANSWER"
    assert g["id"] == plan_compile.graph(plan)["id"] and plan_compile.narrow("AGENT", "PERSON") == "PERSON"
    assert plan_compile.answer_target(Plan(plan.patterns, (Operator("COUNT", ("?d",), {"output": "?n"}),))) == "?n"


def test_execute(spark):
    facts = spark.createDataFrame(
        [("Film A", "Director", "Martin Lee", "s:1", 1), ("film  B", "director", "Ann Ray", "s:2", 2), ("“Martin Lee”", "date of birth", "May 3, 1948", "s:0", 0), ("Ann Ray", "date of birth", "1950", "s:3", 3)],
        "subject string, relation string, object string, source_ref string, stream_position long",
    )
    both = Plan(
        (Pattern("T1", "Film A", "director", "?a"), Pattern("T2", "?a", "date of birth", "?x")),
        (Operator("EARLIER", ("?x", "1949-01-01"), {"output": "?e"}), Operator("COMPARE", ("?x", "1950", ), {"output": "?c", "comparison": "LT"}), Operator("FILTER", ("?x",), {"output": "?no"})), Answer("?e"),
    )
    got = plan_compile.execute(both, facts).collect()
    assert [(r.a, r.e, r.c, r.answer, r.ref_T2) for r in got] == [("Martin Lee", True, True, True, "s:0")] and "no" not in got[0].asDict()
    alias = Plan((Pattern("T1", "The first film", "director", "?a", aliases={"subject": ("Film A",)}),))
    assert [r.answer for r in plan_compile.execute(alias, facts).collect()] == ["Martin Lee"]
