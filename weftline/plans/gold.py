"""Plans from gold evidence: triples to patterns whose hidden values are variables, so that a plan can't give the answer away.

    samples   sample_id, question, question_type, answer, evidences array<array<string>>, supporting_facts array<struct<title, sentence_id>>

Everything is a join, window or aggregate over a table of triples (a row for each, with its place in its sample), so that any number
of samples compile together.  A sample's entities are keys: names without quotes, parenthesis, case and signs.  A subject that
the question doesn't mention and that no earlier object is called takes the most alike of the earlier objects, from a score of
ALIAS_LEAST on; such aliases are followed to their end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..tables import drop, stored
from . import profile

# From which score on a name is another's alias; words that ask for the largest of several values.
ALIAS_LEAST = 0.25
LARGEST = r"\b(younger|later|last|after|newer|latest|most recent)\b"
STEM_LENGTH = 24


def _whole(value: Column) -> Column:
    """A pattern for a value as whole words."""
    return F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))


def _mentioned(value: Column, question: Column) -> Column:
    return F.rlike(question, _whole(value))


def _surface(value: Column, question: Column) -> Column:
    """A value as the question spells it, with a parenthesis that follows it; null if it doesn't stand there."""
    return F.regexp_substr(question, F.concat(_whole(value), F.lit(r"(\s*\([^)]{1,80}\))?")))


def _stem(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.substring(F.when(bare == "", "value").otherwise(bare), 1, STEM_LENGTH)


def triples(samples: DataFrame) -> DataFrame:
    """(sample_id, i, s, r, o, s_raw, o_raw, title, question, comparison): a sample's triples in their order; shorter lists are left out."""
    facts = F.col("supporting_facts")
    rows = samples.select("sample_id", F.coalesce("question", F.lit("")).alias("question"), F.contains(F.lower(F.coalesce("question_type", F.lit(""))), F.lit("comparison")).alias("comparison"), facts, F.posexplode(F.filter("evidences", lambda e: F.size(e) >= 3)).alias("i", "e"))
    title = F.get(F.col("supporting_facts"), F.col("i"))["title"]
    rows = rows.select("sample_id", "i", F.col("e")[0].alias("s"), F.col("e")[1].alias("r"), F.col("e")[2].alias("o"), title.alias("title"), "question", "comparison")
    return rows.withColumns({"s_raw": text.entity_key(F.col("s")), "o_raw": text.entity_key(F.col("o"))})


def aliases(rows: DataFrame) -> DataFrame:
    """(sample_id, raw, key): keys of subjects that stand for an earlier object, with that object's key in the end.

    Only subjects that the question doesn't mention and no earlier object is called meet the earlier objects of their sample.
    """
    earlier = rows.select("sample_id", F.col("i").alias("j"), F.col("o").alias("other"), F.col("o_raw").alias("other_raw"))
    strange = rows.where("i > 0").where(~_mentioned(F.col("s"), F.col("question")))
    same = strange.join(earlier, (strange["sample_id"] == earlier["sample_id"]) & (strange["s_raw"] == earlier["other_raw"]) & (F.col("j") < F.col("i")), "left_semi").select("sample_id", "i")
    strange = strange.join(same, ["sample_id", "i"], "left_anti").select("sample_id", "i", "s", "s_raw")
    met = strange.join(earlier, "sample_id").where("j < i").withColumn("score", text.alias_score_udf("s", "other"))
    best = met.groupBy("sample_id", "i", "s_raw").agg(F.max_by(F.struct("other_raw", "score"), F.struct("score", -F.col("j"))).alias("b")).where(F.col("b.score") >= ALIAS_LEAST)
    last = best.groupBy("sample_id", F.col("s_raw").alias("raw")).agg(F.max_by("b.other_raw", "i").alias("key")).where("raw <> key")
    found = stored(last, "aliases")
    while True:  # each round halves what is left of every chain
        onward = found.select("sample_id", F.col("raw").alias("key"), F.col("key").alias("further"))
        longer = stored(found.join(onward, ["sample_id", "key"], "left").select("sample_id", "raw", F.coalesce("further", "key").alias("key"), F.col("further").isNotNull().alias("moved")).where("raw <> key"), "aliases")
        drop(found)
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        found = longer.drop("moved")
        found._stored_at = longer._stored_at  # type: ignore[attr-defined]


def _named(wanted: DataFrame) -> DataFrame:
    """(sample_id, phase, i, side, name): a variable for each row (sample_id, phase, i, side, stem), in that order: ?stem, ?stem_2, ...

    A name that another stem has already (as ?a_2 may be) is passed over, round by round.
    """
    order = ["phase", "i", "side"]
    rows = wanted.withColumn("k", F.row_number().over(Window.partitionBy("sample_id", "stem").orderBy(*order)))
    name = F.concat(F.lit("?"), "stem", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k"))).otherwise(""))
    while True:
        rows = stored(rows.withColumn("name", name).withColumn("twin", F.row_number().over(Window.partitionBy("sample_id", "name").orderBy(*order)) > 1), "names")
        if rows.where("twin").isEmpty():
            return rows.select("sample_id", *order, "name")
        rows = rows.withColumn("k", F.col("k") + F.col("twin").cast("int")).drop("name", "twin")


def compile_plans(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, plans) of all samples.

    patterns: sample_id, pattern_id, subject, relation, object, subject_anchor, subject_aliases, object_anchor, object_aliases,
    candidate_output.  plans: sample_id, plan_id, answer_type, target, operator, inputs, candidates, error; error is NO_EVIDENCE,
    TOO_FEW_VALUES (a comparison of fewer than two) or NO_ANCHOR (a constant that nothing in the question is like), else null, and
    a plan with an error has no patterns.
    """
    rows = stored(triples(samples), "triples")
    known = aliases(rows)
    for end in "so":
        rows = rows.join(known.select("sample_id", F.col("raw").alias(f"{end}_raw"), F.col("key").alias(f"{end}_alias")), ["sample_id", f"{end}_raw"], "left")
        rows = rows.withColumn(f"{end}_key", F.coalesce(f"{end}_alias", f"{end}_raw")).drop(f"{end}_alias")
    rows = stored(rows, "triples")

    # what each end is: a row for each end of each triple, subjects first
    titled = rows.where("title is not null").groupBy("sample_id", "s_raw").agg(F.max_by("title", "i").alias("s_title"))
    asked = F.concat(F.lit(" "), text.entity_key(F.col("question")), F.lit(" "))
    called = F.contains(asked, F.concat(F.lit(" "), text.entity_key(F.col("s_title")), F.lit(" ")))
    ends = rows.join(titled, ["sample_id", "s_raw"], "left").select(
        "sample_id", "i", "question", "comparison",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("s_key").alias("key"), F.col("s").alias("value"), F.lit("entity").alias("hint"), F.when(called, F.col("s_title")).otherwise(F.col("s")).alias("shown")),
            F.struct(F.lit(1).alias("side"), F.col("o_key").alias("key"), F.col("o").alias("value"), F.col("r").alias("hint"), F.col("o").alias("shown")),
        )).alias("x"),
    ).select("sample_id", "i", "question", "comparison", "x.*")
    roles = ends.groupBy("sample_id", "key").agg(F.max((F.col("side") == 0).cast("int")).alias("is_s"), F.max("side").alias("is_o"), F.min_by("shown", F.struct("i", "side")).alias("shown"))
    ends = ends.drop("shown").join(roles, ["sample_id", "key"])
    root = (F.col("is_s") == 1) & (F.col("is_o") == 0)
    own = F.col("comparison") & (F.col("side") == 1) & (F.col("is_s") == 0)  # compared values stay apart, even where they are equal
    constant = F.when(root, F.col("shown")).when(_mentioned(F.col("value"), F.col("question")), F.col("value"))
    ends = ends.withColumn("constant", constant)
    ends = stored(ends.withColumn("apart", F.col("constant").isNull() & own), "ends")
    first = ends.where(~F.col("apart")).groupBy("sample_id", "key").agg(F.min_by(F.struct("constant", "hint", "i", "side"), F.struct("i", "side")).alias("f")).select("sample_id", "key", "f.*")
    first = stored(first, "slots")
    mine = first.where("constant is null").select("sample_id", F.lit(0).alias("phase"), "i", "side", "hint")
    alone = ends.where("apart").join(first.select("sample_id", "key"), ["sample_id", "key"], "left_anti").select("sample_id", F.lit(1).alias("phase"), "i", "side", "hint")
    names = _named(mine.unionByName(alone).select("sample_id", "phase", "i", "side", _stem(F.col("hint")).alias("stem")))
    slots = first.join(names.where("phase = 0").drop("phase"), ["sample_id", "i", "side"], "left").select("sample_id", "key", F.coalesce("constant", "name").alias("slot"))
    slots = stored(slots, "slots")

    # patterns
    at = lambda end: slots.select("sample_id", F.col("key").alias(f"{end}_key"), F.col("slot").alias(f"{end}_slot"))
    single = names.where("phase = 1").select("sample_id", "i", F.col("name").alias("o_own"))
    made = rows.join(at("s"), ["sample_id", "s_key"]).join(at("o"), ["sample_id", "o_key"], "left").join(single, ["sample_id", "i"], "left").withColumn("o_slot", F.coalesce("o_slot", "o_own"))
    variable = lambda c: F.startswith(c, F.lit("?"))
    consumed = made.where(variable("s_slot")).select("sample_id", F.col("s_slot").alias("o_slot"), F.lit(True).alias("_used")).distinct()
    made = made.join(consumed, ["sample_id", "o_slot"], "left")
    bare = lambda c: F.lower(F.trim(c))
    for end in "so":
        slot, q = F.col(f"{end}_slot"), F.col("question")
        spelt = _surface(slot, q)
        unlike = F.when(bare(spelt) != bare(slot), spelt)
        near = text.question_anchor_udf(slot, F.when(~variable(slot) & ~_mentioned(slot, q), q))
        if end == "s":
            near = F.coalesce(_surface(F.col("title"), q), near)
        constant = ~variable(slot)
        made = made.withColumn(f"{end}_anchor", F.when(constant, F.when(_mentioned(slot, q), unlike).otherwise(near)))
        made = made.withColumn(f"{end}_lost", constant & ~_mentioned(slot, q) & F.col(f"{end}_anchor").isNull())
    more = F.filter(F.array("s_anchor", "s", "title"), lambda v: v.isNotNull() & ((v == F.col("s_anchor")) | ((bare(v) != bare(F.col("s_slot"))) & (v != ""))))
    others = F.when(~variable("s_slot") & (F.size(more) > 0), F.array_distinct(more))
    patterns = made.select(
        "sample_id", "i", F.format_string("p%02d", F.col("i") + 1).alias("pattern_id"), F.col("s_slot").alias("subject"), F.col("r").alias("relation"), F.col("o_slot").alias("object"), F.col("s_anchor").alias("subject_anchor"),
        others.alias("subject_aliases"), F.col("o_anchor").alias("object_anchor"), F.when(F.col("o_anchor").isNotNull(), F.array("o_anchor")).alias("object_aliases"), F.when(F.col("_used"), F.col("o_slot")).alias("candidate_output"),
        (F.col("s_lost") | F.col("o_lost")).alias("lost"), "s_key", "o_key",
    )
    patterns = stored(patterns, "patterns")
    plans = stored(_plans(samples, patterns, slots, known, ends), "plans")
    right = plans.where("error is null").select("sample_id")
    return patterns.join(right, "sample_id", "left_semi").drop("i", "lost", "s_key", "o_key"), plans


def _plans(samples: DataFrame, patterns: DataFrame, slots: DataFrame, known: DataFrame, ends: DataFrame) -> DataFrame:
    kind = profile.answer_type(F.coalesce("question", F.lit("")))
    comparison = F.contains(F.lower(F.coalesce("question_type", F.lit(""))), F.lit("comparison"))
    base = samples.select("sample_id", "question", comparison.alias("comparison"), kind.alias("kind"), text.entity_key(F.col("answer")).alias("a_raw"))
    # the answer's slot, else the last object's
    answer = base.join(known.select("sample_id", F.col("raw").alias("a_raw"), F.col("key").alias("a_alias")), ["sample_id", "a_raw"], "left").withColumn("key", F.coalesce("a_alias", "a_raw"))
    answer = answer.join(slots, ["sample_id", "key"], "left").select("sample_id", "comparison", "kind", "question", F.when(F.startswith("slot", F.lit("?")), F.col("slot")).alias("named"))
    per = patterns.groupBy("sample_id").agg(F.max_by("object", "i").alias("last"), F.max("lost").alias("lost"))
    # values to compare: objects that are no subject, and the constants that they come from
    subjects = patterns.select("sample_id", F.col("s_key").alias("o_key")).distinct()
    values = patterns.join(subjects, ["sample_id", "o_key"], "left_anti").join(base.where("comparison").select("sample_id"), "sample_id", "left_semi")
    roots = _roots(values.select("sample_id", "i", F.col("s_key").alias("key")), patterns, slots)
    listed = values.join(roots, ["sample_id", "i"], "left").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("i", "object", "from"))).alias("v"))
    rows = answer.join(per, "sample_id", "left").join(listed, "sample_id", "left")
    error = F.when(F.col("last").isNull(), "NO_EVIDENCE").when(F.col("comparison") & (F.coalesce(F.size("v"), F.lit(0)) < 2), "TOO_FEW_VALUES").when(F.col("lost"), "NO_ANCHOR")
    truth = F.col("kind") == "BOOLEAN"
    operator = F.when(F.col("comparison"), F.when(truth, "COMPARE").when(F.lower("question").rlike(LARGEST), "ARGMAX").otherwise("ARGMIN"))
    inputs = F.when(F.col("comparison"), F.when(truth, F.slice(F.col("v.object"), 1, 2)).otherwise(F.col("v.object")))
    right = lambda c: F.when(F.col("error").isNull(), c)
    return rows.withColumn("error", error).select(
        "sample_id", F.concat(F.lit("oracle-"), F.substring(F.sha2(F.col("sample_id").cast("string"), 256), 1, 12)).alias("plan_id"), right(F.when(F.col("comparison") & ~truth, "ENTITY").otherwise(F.col("kind"))).alias("answer_type"),
        right(F.when(F.col("comparison"), "?answer").otherwise(F.coalesce("named", "last"))).alias("target"), right(operator).alias("operator"), right(inputs).alias("inputs"), right(F.when(F.col("comparison") & ~truth, F.col("v.from"))).alias("candidates"), "error",
    )


def _roots(asked: DataFrame, patterns: DataFrame, slots: DataFrame) -> DataFrame:
    """(sample_id, i, from): the constant from which a key is reached, by the first of the paths back through the triples.

    Steps go back from objects to subjects, all samples together, as long as a path stands at a variable; a path doesn't come
    to a key twice.
    """
    at = slots.select("sample_id", "key", "slot")
    here = stored(asked.select("sample_id", "i", "key", F.array("key").alias("seen"), F.expr("cast(array() as array<int>)").alias("path")).join(at, ["sample_id", "key"]), "roots")
    back = patterns.select("sample_id", F.col("o_key").alias("key"), F.col("s_key").alias("to"), F.col("i").alias("step"))
    done = [here]
    while True:
        further = here.where(F.startswith("slot", F.lit("?"))).join(back, ["sample_id", "key"]).where(~F.array_contains("seen", F.col("to")))
        further = further.select("sample_id", "i", F.col("to").alias("key"), F.concat("seen", F.array("to")).alias("seen"), F.concat("path", F.array("step")).alias("path")).join(at, ["sample_id", "key"])
        here = stored(further, "roots")
        if here.isEmpty():
            drop(here)
            break
        done.append(here)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    # the first path to a constant, else the variable it began at
    best = F.min_by("slot", F.struct(F.startswith("slot", F.lit("?")), "path"))
    return every.groupBy("sample_id", "i").agg(best.alias("from"))


def leaks(samples: DataFrame, patterns: DataFrame, plans: DataFrame) -> DataFrame:
    """(sample_id, value): gold values that the question doesn't mention and yet stand in a plan; none should.

    Values are the objects of triples, and where they come up as subjects the subjects.  A value that is a pattern's constant by
    way of its document's title or the question is no leak.
    """
    rows = triples(samples)
    hidden = rows.select("sample_id", F.col("o").alias("value"), "question").where(~_mentioned(F.col("value"), F.col("question"))).distinct()
    said = patterns.select("sample_id", F.explode(F.array("subject", "object")).alias("value")).unionByName(plans.select("sample_id", F.explode(F.concat(F.coalesce("inputs", F.array()), F.coalesce("candidates", F.array()))).alias("value")))
    key = lambda df: df.withColumn("k", text.entity_key(F.col("value")))
    return key(hidden).join(key(said).select("sample_id", "k"), ["sample_id", "k"], "left_semi").select("sample_id", "value")


# --- bundles ------------------------------------------------------------------------------------------
PLAN = "struct<plan_id:string,patterns:array<struct<id:string,subject:string,relation:string,object:string>>,operators:array<struct<id:string,type:string,inputs:string,params:string>>,answer_contract:struct<target:string,type:string>>"


def plan_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, plan) of a bundle: JSON lines {sample_id, plan}, which are split over tasks, or one JSON document.

    A document is {sample_id: plan}, [{sample_id, plan}], {plans: either of them} or one plan; an entry may hold the plan's own fields in place of
    `plan`.  An entry without an id, or an id that comes twice, raises when the rows are read.
    """
    one = f"struct<sample_id:string,id:string,plan:{PLAN},{PLAN.removeprefix('struct<').removesuffix('>')}>"
    if path.endswith(".jsonl"):
        entries = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", one).alias("e"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
        inner = F.coalesce(F.get_json_object("value", "$.plans"), F.col("value"))
        whole = whole.select(inner.alias("value"))
        alone = F.when(F.get_json_object("value", "$.patterns").isNotNull(), F.array(F.from_json("value", one)))
        listed = F.when(F.startswith("value", F.lit("[")), F.from_json("value", f"array<{one}>"))
        keyed = F.transform(F.map_entries(F.from_json("value", f"map<string,{one}>")), lambda m: m["value"].withField("sample_id", m["key"]))
        entries = whole.select(F.explode(F.coalesce(alone, listed, keyed)).alias("e"))
    own = F.struct("e.plan_id", "e.patterns", "e.operators", "e.answer_contract")
    sample = F.coalesce("e.sample_id", "e.id", F.raise_error(F.lit("a plan without sample_id")))
    rows = entries.select(sample.alias("sample_id"), F.coalesce("e.plan", own).alias("plan"))
    twice = F.when(F.count(F.lit(1)).over(Window.partitionBy("sample_id")) > 1, F.raise_error(F.concat(F.lit("two plans for "), "sample_id"))).otherwise(F.col("sample_id"))
    return rows.select(twice.alias("sample_id"), "plan")
