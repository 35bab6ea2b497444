"""Scores of solutions and runs, log replay, delayed binding and access checks, over the test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import balance, evaluation, graph, log, stream
from ..plans.model import Pattern
from ..sources import records
from . import query
from .graphs import facts
from .streams import manifest

# --- scores of solutions: a spelling of d / (d + 1) or of a count, right or wrong by the document's number
_SPELT = r"""s AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 9 + 1 AS d, doc_id % 4 <> 0 AS ok FROM documents)"""


@query("math_score", f"WITH {_SPELT} SELECT doc_id, ok::INTEGER::DOUBLE AS score FROM s")
def _(t):
    d, k = F.col("doc_id") % 9 + 1, F.col("doc_id") % 6
    n = F.when(F.col("doc_id") % 4 != 0, d).otherwise(d + 100)
    both = lambda f, *more: F.format_string(f, n, *more)
    spelt = F.when(k == 0, both(r"\frac{%d}{%d}", d + 1)).when(k == 1, both("%d/%d", d + 1)).when(k == 2, both(r"\dfrac{ %d }{%d}", d + 1)).when(k == 3, both(r"x=\tfrac{%d}{%d}", d + 1))
    spelt = spelt.when(k == 4, both(r"\left\frac{%d}{%d}\right", d + 1)).otherwise(both(r"\frac{%d}{%d}\text{ metres}", d + 1))
    solution = F.concat(F.regexp_replace(F.col("text"), r"\\boxed", ""), F.lit(r" \boxed{1} so \boxed{"), spelt, F.lit("} end"))
    return t("documents").select("doc_id", scores.math_score(solution, F.format_string(r"\frac{%d}{%d}", d, d + 1)).alias("score"))


@query("number_score", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.0 WHEN doc_id % 3 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS score FROM documents")
def _(t):
    n = F.format_number(F.col("n_chars") * 1000, 0)
    right = F.concat(F.lit("we get 7, then #### "), n)
    wrong = F.concat(F.lit("we get #### "), (F.col("n_chars") * 1000 + 1).cast("string"))
    solution = F.when(F.col("doc_id") % 5 == 0, "no figure").when(F.col("doc_id") % 3 == 0, wrong).otherwise(right)
    return t("documents").select("doc_id", scores.number_score(solution, (F.col("n_chars") * 1000).cast("string"), strict=True, wrong=0.25).alias("score"))


@query("competition_score", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS score FROM documents")
def _(t):
    n = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    k = F.col("doc_id") % 4
    spelt = F.when(k == 0, F.concat(F.lit("x = $"), n, F.lit("$ dollars"))).when(k == 1, F.concat(F.lit(r"\text{"), n, F.lit(r"} cm"))).when(k == 2, F.format_number(n, 0)).otherwise(F.concat(n, F.lit(r"^\circ")))
    solution = F.concat(F.lit("Answer: 5\nmore\nanswer : "), spelt)
    return t("documents").select("doc_id", scores.competition_score(solution, F.col("doc_id").cast("string")).alias("score"))


_WORDS3 = "string_split(lang || ' of ' || source, ' ')"


@query(
    "answer_score",
    f"""WITH a AS (SELECT doc_id, {_WORDS3} AS gold, {_WORDS3} || CASE WHEN doc_id % 2 = 0 THEN ['more', 'words'] ELSE [] END AS said FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, (doc_id % 2 <> 0)::INTEGER::DOUBLE AS em, round(2.0 * len(gold) / (len(gold) + len(said)), 6) AS f1 FROM a""",
)
def _(t):
    gold = F.concat_ws(" of ", "lang", "source")
    said = F.concat(F.lit(r"So \boxed{"), F.upper(gold), F.when(F.col("doc_id") % 2 == 0, " More words").otherwise(""), F.lit("}"))
    rows = t("documents").where("lang is not null and source is not null")
    truths = F.array(F.lit("none of it"), gold)
    return rows.select("doc_id", scores.answer_score(said, truths).alias("em"), F.round(scores.answer_score(said, truths, "f1"), 6).alias("f1"))


@query("scores_by_source", "SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN -1.0 WHEN doc_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 1.0 FROM documents WHERE doc_id % 4 = 0")
def _(t):
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    source = F.when(k == 0, "openai/gsm8k").when(k == 1, "some/MATH-500").when(k == 2, "aime24").otherwise("hotpotqa")
    solution = F.when(k == 0, F.concat(F.lit("it is "), n)).when(k == 2, "Answer: none").otherwise(F.concat(F.lit(r"\boxed{"), n, F.lit("}")))
    return t("documents").select("doc_id", scores.by_source(source, solution, F.array(n)).alias("score"))


# --- evaluation of runs: a user's events as a run's log
_TYPES = "CASE user_id % 5 + event_id % 4 WHEN 0 THEN 'CLAIM_PROMOTED' WHEN 1 THEN 'VERIFY_REJECTED' WHEN 2 THEN 'CLAIM_DEFERRED' WHEN 3 THEN 'CLAIM_COMMITTED' WHEN 4 THEN 'VERIFY_CONFLICT' WHEN 5 THEN 'VERIFY_NEED_MORE_CONTEXT' ELSE 'CLAIM_PROMOTED' END"
_LOG = f"g AS (SELECT user_id AS run_id, event_id AS event_seq, {_TYPES} AS event_type, event_id % 7 AS claim_id, event_id % 3 = 0 AS req, 'Item ' || event_id % 5 AS subject, event_type AS relation FROM events)"


def _log(t):
    k = F.col("user_id") % 5 + F.col("event_id") % 4
    names = ("CLAIM_PROMOTED", "VERIFY_REJECTED", "CLAIM_DEFERRED", "CLAIM_COMMITTED", "VERIFY_CONFLICT", "VERIFY_NEED_MORE_CONTEXT")
    kind = F.coalesce(F.get(F.array(*map(F.lit, names)), k.cast("int")), F.lit("CLAIM_PROMOTED"))
    return t("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("event_seq"), kind.alias("event_type"), (F.col("event_id") % 7).alias("claim_id"), (F.col("event_id") % 3 == 0).alias("verification_required"),
        F.concat(F.lit("Item "), F.col("event_id") % 5).alias("subject"), F.col("event_type").alias("relation"), F.lit("yes").alias("object"),
    )


@query(
    "verifier_scores",
    f"""WITH {_LOG}, l AS (SELECT run_id, claim_id, max_by(event_type, event_seq) AS s, max_by(subject || '|' || relation, event_seq) AS k FROM g WHERE event_type NOT IN ('CLAIM_DEFERRED', 'CLAIM_COMMITTED') GROUP BY 1, 2),
r AS (SELECT run_id, s = 'CLAIM_PROMOTED' AS ok, k LIKE 'Item 0%' OR k LIKE 'Item 3%' AS y FROM l), c AS (SELECT run_id, count(*) AS candidates, count_if(y)::BIGINT AS gold_candidates, count_if(ok)::BIGINT AS accepted, count_if(ok AND y)::BIGINT AS tp, count_if(ok AND NOT y)::BIGINT AS fp, count_if(NOT ok AND y)::BIGINT AS fn FROM r GROUP BY 1)
SELECT *, round(tp / nullif(accepted, 0), 6) AS precision, round(tp / nullif(gold_candidates, 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (accepted + gold_candidates) END, 6) AS f1 FROM c""",
)
def _(t):
    events = _log(t)
    gold = events.where("subject in ('Item 0', 'Item 3')").select("run_id", F.concat(F.lit("  the "), F.upper("subject"), F.lit("!")).alias("subject"), "relation", "object").distinct()
    gold = gold.withColumn("subject", F.regexp_replace("subject", "the ", ""))
    got = evaluation.verifier_scores(events, gold, "run_id")
    return got.select(*[c for c in got.columns if c not in ("precision", "recall", "f1")], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "triple_scores",
    """WITH o AS (SELECT o_custkey AS run, count(DISTINCT o_orderkey % 6) AS n_f, count(DISTINCT o_orderkey % 6) FILTER (o_orderkey % 6 IN (1, 2, 4)) AS n FROM orders GROUP BY 1)
SELECT run, round(n / n_f, 6) AS precision, round(n / 3, 6) AS recall, round(CASE WHEN n = 0 THEN 0 ELSE 2.0 * n / (n_f + 3) END, 6) AS f1 FROM o""",
)
def _(t):
    found = t("orders").select(F.col("o_custkey").alias("run"), evaluation.triple(F.concat(F.lit("The-Item "), F.col("o_orderkey") % 6), F.lit("Is."), F.lit(True)).alias("key"))
    gold = found.select("run").distinct().withColumn("key", F.explode(F.array(*[evaluation.triple(F.lit(f"the item {k}"), F.lit("is"), F.lit("yes")) for k in (1, 2, 4)])))
    got = evaluation.set_scores(found, gold, found, "run", "key")
    return got.select("run", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("plan_relation_recall", "SELECT l_orderkey AS run, round(CASE WHEN count(*) FILTER (l_linenumber > 1) > 0 THEN count(DISTINCT l_partkey % 5) FILTER (l_linenumber > 1 AND l_partkey % 5 < 3) / count(DISTINCT l_partkey % 5) FILTER (l_linenumber > 1) END, 6) AS recall FROM lineitem GROUP BY 1")
def _(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", F.concat(F.lit("relation "), F.col("l_partkey") % 5).alias("relation"))
    predicted = rows.select("run", F.explode(F.array(*[F.lit(f"Relation, {k}!") for k in range(3)])).alias("relation"))
    got = evaluation.plan_relation_recall(predicted, rows.where("l_linenumber > 1"), rows, "run", "relation")
    return got.select("run", F.round("recall", 6).alias("recall"))


@query(
    "early_latent_recall",
    f"""WITH {_LOG}, e AS (SELECT run_id, event_seq, event_type, event_seq // 3 AS ref FROM g), f AS (SELECT run_id, min(ref) AS first FROM e WHERE event_type = 'CLAIM_COMMITTED' GROUP BY 1),
q AS (SELECT DISTINCT e.run_id, e.ref FROM e JOIN f USING (run_id) WHERE e.ref < f.first AND e.ref % 2 = 0), d AS (SELECT DISTINCT run_id, ref FROM e WHERE event_type = 'CLAIM_DEFERRED')
SELECT q.run_id, count(*) AS early, round(count(d.ref) / count(*), 6) AS recall FROM q LEFT JOIN d ON q.run_id = d.run_id AND q.ref = d.ref GROUP BY 1""",
)
def _(t):
    events = _log(t).withColumn("source_ref", F.floor(F.col("event_seq") / 3))
    positions = events.select("run_id", "source_ref", F.col("source_ref").alias("stream_position")).distinct()
    got = evaluation.early_latent_recall(events, events.where("source_ref % 2 = 0"), positions, "run_id")
    return got.select("run_id", "early", F.round("recall", 6).alias("recall"))


@query(
    "result_summary",
    """SELECT event_type AS method, CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'reverse' END AS ord, count(*) AS count, round(avg(CASE WHEN user_id % 3 = 0 THEN value END), 5) AS f1, round(avg((value > 50)::INTEGER), 6) AS exact,
round(count_if(user_id % 4 = 1) / count(*), 6) AS insufficient_rate, round(count_if(user_id % 4 = 2) / count(*), 6) AS conflicted_rate, round(1 - avg((user_id % 7 <> 0)::INTEGER), 6) AS error_rate FROM events GROUP BY 1, 2""",
)
def _(t):
    rows = t("events").select(F.col("event_type").alias("method"), F.when(F.col("event_id") % 2 == 0, "original").otherwise("reverse").alias("ord"), F.when(F.col("user_id") % 3 == 0, F.col("value")).alias("f1"), (F.col("value") > 50).cast("int").alias("exact"), F.get(F.array(*map(F.lit, ("COMPLETE", "INSUFFICIENT", "CONFLICTED", "UNSUPPORTED"))), (F.col("user_id") % 4).cast("int")).alias("status"), (F.col("user_id") % 7 != 0).cast("int").alias("ok"))
    got = evaluation.summary(rows, ["method", "ord"], ["f1", "exact"], "status", ["INSUFFICIENT", "CONFLICTED"], "ok")
    return got.select("method", "ord", "count", F.round("f1", 5).alias("f1"), *[F.round(c, 6).alias(c) for c in ("exact", "insufficient_rate", "conflicted_rate", "error_rate")])


@query(
    "action_metrics",
    """WITH r AS (SELECT role, CASE WHEN turn % 3 = 0 AND trim(text) <> '' AND NOT contains(text, chr(10)) THEN 1.0 ELSE 0.0 END AS callback FROM conversations)
SELECT role, round(avg(callback), 6) AS callback_mean, max(callback) AS callback_max, min(callback) AS callback_min FROM r GROUP BY 1""",
)
def _(t):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<recall>"), F.regexp_replace("text", "</?recall>", ""), F.lit("</recall>"))).otherwise(F.col("text"))
    rows = t("conversations").select("role", text.callback_count(said).alias("callback"))
    return evaluation.metric_range(rows, ["role"], "callback").withColumn("callback_mean", F.round("callback_mean", 6))


@query("throughput", "SELECT event_type, sum(user_id)::BIGINT AS total_tokens, round(sum(value), 3) AS seconds, round(sum(user_id) / (sum(value) * 8), 6) AS throughput, round(sum(value) * 1000 / sum(user_id), 4) AS ms_per_token FROM events GROUP BY 1")
def _(t):
    got = evaluation.throughput(t("events"), ["event_type"], "user_id", "value", 8)
    return got.select("event_type", "total_tokens", F.round("seconds", 3).alias("seconds"), F.round("throughput", 6).alias("throughput"), F.round("ms_per_token", 4).alias("ms_per_token"))


# --- logs
@query(
    "replay_claims",
    f"""WITH {_LOG}, a AS (SELECT run_id, claim_id, coalesce(max(event_seq) FILTER (event_type = 'CLAIM_DEFERRED'), -1) AS d, coalesce(max(event_seq) FILTER (event_type = 'CLAIM_COMMITTED' AND req), -1) AS p, coalesce(max(event_seq) FILTER (event_type = 'CLAIM_COMMITTED' AND NOT req), -1) AS v,
coalesce(max(event_seq) FILTER (event_type = 'CLAIM_PROMOTED'), -1) AS up, coalesce(max(event_seq) FILTER (event_type = 'VERIFY_REJECTED'), -1) AS rej, count(*) FILTER (event_type = 'VERIFY_CONFLICT') AS conflicts FROM g GROUP BY 1, 2)
SELECT run_id, claim_id, d > up AND d > rej AS deferred, p > up AND p > rej AS pending, v > rej OR up > rej AS verified, rej >= 0 AS rejected, conflicts FROM a""",
)
def _(t):
    return log.replay_claims(_log(t))


@query(
    "replay_edges",
    """WITH g AS (SELECT user_id AS run_id, event_id, event_id % 6 AS edge_id, CASE event_id % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'DORMANT' WHEN 2 THEN 'SATISFIED' ELSE NULL END AS s FROM events)
SELECT run_id, edge_id, max_by(s, event_id) AS state, coalesce(string_agg('c' || event_id, ',' ORDER BY event_id) FILTER (s = 'SATISFIED'), '') AS support FROM g WHERE s IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    kind = F.get(F.array(*map(F.lit, ("QUERY_EDGE_ACTIVATED", "QUERY_EDGE_DORMANT", "QUERY_EDGE_SATISFIED", "OPERATOR_EXECUTED"))), (F.col("event_id") % 4).cast("int"))
    rows = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("event_seq"), (F.col("event_id") % 6).alias("edge_id"), kind.alias("event_type"), F.concat(F.lit("c"), "event_id").alias("claim_id"))
    return log.replay_edges(rows).withColumn("support", F.array_join("support", ","))


@query(
    "content_ids",
    """WITH k AS (SELECT event_id, event_type, user_id, event_id % 3 AS v FROM events)
SELECT event_id, sha256('{"a":' || user_id || ',"m":{"x":[2,1],"z":"' || event_type || '"},"z":"' || v || '"}') AS id, count(*) OVER (PARTITION BY user_id, event_type, v) AS same FROM k""",
)
def _(t):
    """One content in three orders of its fields, nested ones too, and spacings has one id."""
    v = F.col("event_id") % 3
    form = F.when(v == 0, '{"z": "%3$s", "a": %1$s, "m": {"z": "%2$s", "x": [2, 1]}}').when(v == 1, '{"m":{"x":[2,1],"z":"%2$s"},"z":"%3$s","a":%1$s}').otherwise('{ "a" : %1$s , "z" : "%3$s" , "m" : { "z" : "%2$s" , "x" : [ 2 , 1 ] } }')
    spelt = F.replace(F.replace(F.replace(form, F.lit("%1$s"), F.col("user_id").cast("string")), F.lit("%2$s"), F.col("event_type")), F.lit("%3$s"), v.cast("string"))
    rows = t("events").withColumn("id", F.sha2(log.canonical_json(spelt), 256))
    return rows.select("event_id", "id", F.count(F.lit(1)).over(Window.partitionBy("id")).alias("same"))


# --- graphs
_SEEN = "(SELECT n_nationkey AS k, n_nationkey * 37 % 50 AS p FROM nation)"


@query(
    "binding_cascade",
    """WITH a AS (SELECT 'T1' AS pattern_id, 'ordered by:' || o_orderkey AS source_ref, o_orderkey AS pos, NULL::BIGINT AS bound_at, o_orderkey AS w, o_custkey AS o FROM orders),
b1 AS (SELECT o AS k, min(w) AS bound FROM a GROUP BY 1), b AS (SELECT 'T2' AS pattern_id, 'lives in:' || c_custkey AS source_ref, c_custkey AS pos, bound AS bound_at, greatest(c_custkey, bound) AS w, c_nationkey AS o FROM customer JOIN b1 ON k = c_custkey),
b2 AS (SELECT o AS k, min(w) AS bound FROM b GROUP BY 1), c AS (SELECT 'T3' AS pattern_id, 'part of:' || n_nationkey AS source_ref, n_nationkey::BIGINT AS pos, bound AS bound_at, greatest(n_nationkey, bound) AS w, n_regionkey AS o FROM nation JOIN b2 ON k = n_nationkey)
SELECT pattern_id, source_ref, bound_at, w AS committed_at, CASE WHEN bound_at > pos THEN 'PROMOTED' ELSE 'DIRECT' END AS status FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""",
)
def _(t):
    patterns = (Pattern("T3", "?n", "part of", "?r"), Pattern("T1", "?o", "Ordered  by", "?c"), Pattern("T2", "?c", "lives in", "?n"))
    return graph.cascade(facts(t), patterns).select("pattern_id", "source_ref", "bound_at", "committed_at", "status")


@query(
    "path_join_spellings",
    "SELECT 'order:' || o_orderkey AS o, n_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
)
def _(t):
    """Facts of one entity in several spellings: capitals, quotes and white space don't count, in constants neither."""
    known = facts(t)
    other = F.when(F.col("relation") == "lives in", F.concat(F.lit(' “'), F.upper("subject"), F.lit('”  '))).when(F.col("relation") == "part of", F.concat(F.lit("'"), F.initcap("subject"), F.lit("'"))).otherwise(F.col("subject"))
    spelt = known.withColumns({"subject": other, "object": F.when(F.col("relation") == "part of", F.concat(F.lit('"'), F.col("object"), F.lit('"'))).otherwise(F.col("object"))})
    bound = graph.path_join(spelt, [Pattern("T1", "?o", "ordered by", "?c"), Pattern("T2", "?c", "lives in", "?n"), Pattern("T3", "?n", "part of", "“Region:2”")])
    return bound.select("o", F.substring_index("n", ":", -1).cast("int").alias("n"))


@query(
    "deferred_matches",
    """WITH w AS (SELECT c_custkey AS claim_id, lower(c_name) AS s, c_nationkey AS o FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 5 = 0)
SELECT claim_id, 'subject' AS variable, c.claim_id % 3 = 0 AS by_title FROM w c JOIN b ON k = claim_id UNION ALL SELECT claim_id, 'object', false FROM w WHERE o = 3""",
)
def _(t):
    named = F.col("c_custkey") % 3 != 0
    waiting = t("customer").select(
        F.col("c_custkey").alias("claim_id"), F.when(named, F.upper("c_name")).otherwise(F.lit("She")).alias("subject"), F.lit("Lives in").alias("relation"), F.concat(F.lit("nation "), "c_nationkey").alias("object"),
        F.col("c_name").alias("title"), F.lit("She lives there.").alias("text"),
    )
    bound = t("orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct().join(t("customer"), "c_custkey")
    needs = bound.select(F.lit("subject").alias("variable"), F.lit("subject").alias("side"), F.concat(F.lit(" "), "c_name").alias("value"), F.lit("lives in").alias("relation"))
    other = t("region").limit(1).select(F.lit("object").alias("variable"), F.lit("object").alias("side"), F.lit("Nation 3").alias("value"), F.lit("lives  in").alias("relation"))
    return graph.deferred_matches(waiting, needs.unionByName(other))


@query(
    "open_descendants",
    """WITH e AS (SELECT l_orderkey AS run_id, l_linenumber AS edge_id, l_returnflag = 'A' AS unfinished FROM lineitem)
SELECT a.run_id, a.edge_id, coalesce(bool_or(b.unfinished), false) AS open FROM e a LEFT JOIN e b ON a.run_id = b.run_id AND b.edge_id > a.edge_id AND NOT EXISTS (SELECT 1 FROM generate_series(1, 7) g(i) WHERE i > a.edge_id AND i <= b.edge_id AND NOT EXISTS (SELECT 1 FROM e x WHERE x.run_id = a.run_id AND x.edge_id = i)) GROUP BY 1, 2""",
)
def _(t):
    at = lambda k: F.concat(F.lit("?v"), k)
    edges = t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("edge_id"), at(F.col("l_linenumber")).alias("subject"), at(F.col("l_linenumber") + 1).alias("object"), F.lit(True).alias("required"), F.when(F.col("l_returnflag") == "A", "ACTIVE").otherwise("SATISFIED").alias("state"))
    return graph.open_descendants(edges).groupBy("run_id", "edge_id").agg(F.max("open").alias("open"))


@query("selected_path", "SELECT o_orderkey AS claim_id FROM orders JOIN (SELECT o_custkey % 50 AS run, max(o_custkey) AS v FROM orders GROUP BY 1) b ON run = o_custkey % 50 WHERE o_custkey = v OR o_orderkey % 10 = 0")
def _(t):
    run = (F.col("o_custkey") % 50).alias("run_id")
    claims = t("orders").select(run, F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 10 != 0, "?c").alias("subject_var"), F.concat(F.lit("Customer "), "o_custkey").alias("subject"), F.lit(None).cast("string").alias("object_var"), F.col("o_orderstatus").alias("object"))
    bindings = t("orders").groupBy(run).agg(F.concat(F.lit('"customer  '), F.max("o_custkey"), F.lit('"')).alias("value")).withColumn("variable", F.lit("?c"))
    return graph.selected_path(claims, bindings).select("claim_id")


# --- access and citations
_LINES = """l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"""


@query(
    "prefix_violations",
    "SELECT source AS sample_id, source || ':' || doc_id || ':x' AS source_ref, 'UNKNOWN' AS kind FROM documents WHERE doc_id % 50 = 7 UNION ALL SELECT sample_id, source_ref, 'UNREAD' FROM (SELECT source AS sample_id, source || ':' || doc_id AS source_ref, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents WHERE doc_id % 50 <> 7) WHERE p > 20",
)
def _(t):
    docs = t("documents")
    place = stream.positions(stream.sentences(docs, F.col("source"), F.col("doc_id"), F.array("text"), F.col("doc_id"))).select("sample_id", F.concat_ws(":", "sample_id", "document_id").alias("source_ref"), "doc_rank")
    rows = place.where("doc_rank % 50 <> 7").withColumn("stream_position", F.row_number().over(_by("sample_id", "doc_rank")) - 1)
    reads = docs.select(F.col("source").alias("sample_id"), F.concat_ws(":", "source", "doc_id", F.when(F.col("doc_id") % 50 == 7, "x")).alias("source_ref"), F.lit(20).alias("cursor"))
    return stream.prefix_violations(rows, reads)


def _by(group, order):
    return Window.partitionBy(group).orderBy(order)


@query("uncited", "SELECT doc_id AS decision_id, CASE doc_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'FOREIGN' ELSE 'NOT_THERE' END AS kind FROM documents WHERE doc_id % 4 < 3")
def _(t):
    k = F.col("doc_id") % 4
    refs = F.when(k == 0, F.expr("cast(array() as array<string>)")).when(k == 1, F.array(F.lit("a"), F.lit("other"))).otherwise(F.array(F.lit("a")))
    decisions = t("documents").select(F.col("doc_id").alias("decision_id"), refs.alias("refs"), F.when(k == 2, "never said").otherwise("“Said” HERE").alias("supporting_text"))
    supplied = t("documents").select(F.col("doc_id").alias("decision_id"), F.lit("a").alias("source_ref"), F.concat(F.lit("It was said, here: "), "doc_id").alias("text"))
    return stream.uncited(decisions, supplied)


@query("events_in_order", "WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 1000, event_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS came FROM events) SELECT user_id AS run_id, count_if(place <> came)::BIGINT AS moved FROM w GROUP BY 1 HAVING count_if(place <> came) > 0")
def _(t):
    rows = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("at"), (F.col("event_id") * 7919 % 1000).alias("stream_position"), F.lit(None).cast("string").alias("span_hint"), "event_id")
    return stream.ordered_events(rows)[1]


# --- records and turns
@query("preference_pairs", "SELECT o_orderkey AS prompt, 'Q ' || o_orderkey || ' A ' || CASE WHEN p THEN o_orderpriority ELSE o_orderstatus END AS answer, p AS preferred FROM orders, (VALUES (true), (false)) v(p)")
def _(t):
    rows = t("orders").select(F.col("o_orderkey").cast("string").alias("prompt"), F.col("o_orderpriority").alias("chosen"), F.col("o_orderstatus").alias("rejected"))
    return records.preference_pairs(rows, template="Q {} A {}").withColumn("prompt", F.col("prompt").cast("long"))


@query("labelled_turns", "SELECT conv_id, turn, row_number() OVER w - 1 AS step_id, lead(1) OVER w IS NULL AS final, CASE WHEN lead(1) OVER w IS NULL THEN 0 ELSE 2 END AS action_type FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t):
    return records.labelled_turns(t("conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("step_id").cast("long").alias("step_id"), "final", "action_type")


@query("final_turns", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1")
def _(t):
    return records.final_turns(t("conversations"), "conv_id", "turn").select("conv_id", "turn")


@query("short_prompts", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 200".replace("\\\\", "\\"))
def _(t):
    return records.short_prompts(t("documents"), F.size(text.words(F.col("text"))), 200).select("doc_id")


@query(
    "action_rewards",
    """WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(lang || ' ' || source, ' '), lambda x: x <> '')) AS ws FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, CASE WHEN doc_id % 3 = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM w""",
)
def _(t):
    rows = t("documents").where("lang is not null and source is not null")
    truths, action = F.array(F.concat_ws(" ", "lang", "source")), (F.col("doc_id") % 3).cast("int")
    response = F.concat(F.lit("<update>it is "), F.concat_ws(" and ", "lang", "source"), F.lit("</update>"))
    prompt = F.lit("<memory>0</memory> 1")
    return rows.select("doc_id", text.action_reward(prompt, response, F.lit("2"), truths, action).alias("reward"), text.action_weight(prompt, truths, action).alias("weight"))


# --- partitions
@query(
    "greedy_partition",
    """WITH RECURSIVE r AS (SELECT o_custkey % 10 AS batch, o_orderkey AS row, CAST(trunc(o_totalprice / 1000) AS BIGINT) AS length, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS i FROM orders),
g AS (SELECT DISTINCT batch, 0::BIGINT AS i, NULL::BIGINT AS row, 0::BIGINT AS length, [0, 0, 0, 0]::BIGINT[] AS sums, 0 AS part FROM r UNION ALL
SELECT g.batch, r.i, r.row, r.length, list_transform(g.sums, lambda s, j: CASE WHEN j = list_position(g.sums, list_min(g.sums)) THEN s + r.length ELSE s END), list_position(g.sums, list_min(g.sums)) - 1 FROM g JOIN r ON r.batch = g.batch AND r.i = g.i + 1)
SELECT batch, row, length, part::INTEGER AS part FROM g WHERE row IS NOT NULL""",
)
def _(t):
    lengths = t("orders").select((F.col("o_custkey") % 10).alias("batch"), F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 1000).cast("long").alias("length"))
    return balance.partition(lengths, "batch", "row", "length", 4, "greedy")
