"""Plans from gold triples: hidden values, aliases, titles, comparisons, odd samples; bundles of plans."""

import json

import pytest

from weftline.plans import gold

SHAPE = "sample_id string, question string, question_type string, answer string, evidences array<array<string>>, supporting_facts array<struct<title:string,sentence_id:int>>"
SAMPLES = [
    ("mother", "When did Lothair II's mother die?", "compositional", "20 March 851", [["Lothair II", "mother", "Ermengarde of Tours"], ["Ermengarde of Tours", "date of death", "20 March 851"]], []),
    ("title", "Where did Maurice, Prince Of Orange's father die?", "compositional", "Delft", [["Maurice of Nassau", "father", "William the Silent"], ["William the Silent", "place of death", "Delft"]], [("Maurice, Prince of Orange", 0), ("William the Silent", 0)]),
    ("anchor", "Where did Maurice, Prince Of Orange's father die?", "compositional", "Delft", [["Maurice of Nassau", "father", "William the Silent"], ["William the Silent", "place of death", "Delft"]], []),
    ("paren", "Which country is Aleksander Koniecpolski (1620–1659)'s father from?", "compositional", "Poland", [["Aleksander Koniecpolski", "father", "Stanisław Koniecpolski"], ["Stanisław Koniecpolski", "country of citizenship", "Poland"]], []),
    ("both", "Are A and B both located in the same country?", "comparison", "yes", [["A", "country", "France"], ["B", "country", "France"]], []),
    ("alias", "What nationality is the composer of song Make The World Move?", "compositional", "British", [["Make the World Move", "composer", "Alexander Grant"], ["Alex da Kid", "country of citizenship", "British"]], []),
    ("deep", "Which film's director was born first, Film A or Film B?", "bridge_comparison", "Film B", [["Film A", "director", "Ann"], ["Film B", "director", "Bob"], ["Ann", "date of birth", "1950"], ["Bob", "date of birth", "1940"]], []),
    ("names", "What comes of Start?", "inference", "z", [["Start", "a", "p"], ["p", "a 2", "q"], ["q", "a", "r"], ["r", "!!", "z"], ["p", "a very long relation name that goes on", "w"]], []),
    ("few", "Is A larger?", "comparison", "yes", [["A", "size", "3"]], []), ("none", "Who?", "compositional", "x", [], []), ("null", None, None, None, None, None), ("short", "Who is A?", None, "x", [["A", "b"], ["A", "is", "x"]], None),
    ("lost", "zzz", "compositional", "v", [["Qwertyuiop", "r", "v"]], []), ("quote", "Who is \\E$1 of?", "compositional", "v", [["\\E$1", "r", "v"]], []),
]


@pytest.fixture(scope="module")
def compiled(spark):
    samples = spark.createDataFrame(SAMPLES, SHAPE)
    patterns, plans = gold.compile_plans(samples)
    by = {}
    for r in patterns.orderBy("sample_id", "pattern_id").collect():
        by.setdefault(r.sample_id, []).append(r)
    return samples, patterns, plans, by, {r.sample_id: r for r in plans.collect()}


def slots(rows):
    return [(r.subject, r.relation, r.object) for r in rows]


def test_patterns(compiled):
    by = compiled[3]
    assert slots(by["mother"]) == [("Lothair II", "mother", "?mother"), ("?mother", "date of death", "?date_of_death")]
    assert [r.candidate_output for r in by["mother"]] == ["?mother", None]
    assert by["title"][0].subject == "Maurice, Prince of Orange" and "Maurice of Nassau" in by["title"][0].subject_aliases and by["title"][0].candidate_output == "?father"
    anchor = by["anchor"][0]
    assert anchor.subject == "Maurice of Nassau" and anchor.subject_anchor.startswith("Maurice") and anchor.subject_anchor in anchor.subject_aliases
    assert by["paren"][0].subject_anchor == "Aleksander Koniecpolski (1620–1659)"
    assert slots(by["both"]) == [("A", "country", "?country"), ("B", "country", "?country_2")]
    assert by["alias"][0].object == by["alias"][1].subject == "?composer" and by["alias"][0].subject_aliases == ["Make The World Move"] or by["alias"][0].subject_aliases is None
    # ?a is taken by the first, ?a_2 by the second relation's own name, so the third is ?a_3
    assert slots(by["names"]) == [("Start", "a", "?a"), ("?a", "a 2", "?a_2"), ("?a_2", "a", "?a_3"), ("?a_3", "!!", "?value"), ("?a", "a very long relation name that goes on", "?a_very_long_relation_nam")]
    assert slots(by["short"]) == [("A", "is", "?is")] and slots(by["quote"]) == [("\\E$1", "r", "?r")]


def test_plans(compiled):
    plans = compiled[4]
    assert {k: r.error for k, r in plans.items() if r.error} == {"few": "TOO_FEW_VALUES", "none": "NO_EVIDENCE", "null": "NO_EVIDENCE", "lost": "NO_ANCHOR"}
    assert len(plans) == len(SAMPLES) and not {"few", "none", "lost"} & set(compiled[3])
    assert plans["mother"].target == "?date_of_death" and plans["alias"].answer_type == "NATIONALITY" and plans["mother"].answer_type == "DATE"
    assert (plans["both"].operator, plans["both"].inputs, plans["both"].target) == ("COMPARE", ["?country", "?country_2"], "?answer")
    assert (plans["deep"].operator, plans["deep"].inputs, plans["deep"].candidates) == ("ARGMIN", ["?date_of_birth", "?date_of_birth_2"], ["Film A", "Film B"])
    assert plans["names"].target == "?value"


def test_no_gold_value_is_told(compiled):
    samples, patterns, plans = compiled[:3]
    assert gold.leaks(samples, patterns, plans).collect() == []
    told = patterns.union(patterns.where("sample_id = 'both'").selectExpr(*[f"{c}" if c != "object" else "'france' as object" for c in patterns.columns]))
    assert [tuple(r) for r in gold.leaks(samples, told, plans).collect()] == [("both", "France")]


def test_empty(spark):
    patterns, plans = gold.compile_plans(spark.createDataFrame([], SHAPE))
    assert patterns.count() == plans.count() == 0


def test_bundles(spark, tmp_path):
    plan = lambda n: {"plan_id": f"p{n}", "patterns": [{"id": "T1", "subject": "A", "relation": "r", "object": f"?{n}"}], "answer_contract": {"target": f"?{n}", "type": "ENTITY"}}
    forms = {
        "map.json": {"s1": plan("x"), "s2": plan("y")}, "list.json": [{"sample_id": "s1", "plan": plan("x")}, {"id": "s2", **plan("y")}],
        "plans.json": {"plans": [{"sample_id": "s1", **plan("x")}, {"sample_id": "s2", "plan": plan("y")}]}, "one.json": {"sample_id": "s1", **plan("x")},
    }
    for name, value in forms.items():
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(e) for e in forms["list.json"]) + "\n\n")
    read = lambda name: {r.sample_id: (r.plan.plan_id, r.plan.patterns[0].object, r.plan.answer_contract.target) for r in gold.plan_bundle(spark, f"{tmp_path}/{name}").collect()}
    both = {"s1": ("px", "?x", "?x"), "s2": ("py", "?y", "?y")}
    assert all(read(n) == both for n in ("map.json", "list.json", "plans.json", "lines.jsonl")) and read("one.json") == {"s1": both["s1"]}
    (tmp_path / "twice.jsonl").write_text((json.dumps(forms["list.json"][0]) + "\n") * 2)
    (tmp_path / "nameless.jsonl").write_text(json.dumps({"plan": plan("x")}))
    for name, said in (("twice.jsonl", "two plans for s1"), ("nameless.jsonl", "without sample_id")):
        with pytest.raises(Exception, match=said):
            read(name)
