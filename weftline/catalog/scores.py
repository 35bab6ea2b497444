"""Evaluation aggregates over events, line items, labels and conversations."""

from pyspark.sql import functions as F

from ..operators import metrics, retrieval
from . import query


@query("mean_std_at_n", "WITH p AS (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(avg(m), 5) AS mean_at_n, round(avg(s), 5) AS std_at_n FROM p GROUP BY 1")
def _(t):
    got = metrics.mean_and_std_at_n(t("lineitem"), "l_returnflag", "l_orderkey", "l_quantity")
    return got.select("l_returnflag", F.round("mean_at_n", 5).alias("mean_at_n"), F.round("std_at_n", 5).alias("std_at_n"))


@query("majority_vote", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def _(t):
    return metrics.majority(t("events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type")


for _worst in (False, True):

    @query(
        "worst_of_n" if _worst else "best_of_n",
        f"WITH k AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity {'DESC' if _worst else ''}) AS k, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) SELECT l_orderkey, round(sum((pow(k / m, 3) - pow((k - 1) / m, 3)) * l_quantity), 5) AS expected FROM k GROUP BY 1",
    )
    def _(t, worst=_worst):
        return metrics.best_of_n(t("lineitem"), ["l_orderkey"], "l_quantity", 3, worst).select("l_orderkey", F.round("expected", 5).alias("expected"))


@query("bootstrap")
def _(t):
    return metrics.bootstrap(t("lineitem"), "l_returnflag", "l_quantity", 4)


_U = "('0x' || substr(md5('42:' || o_orderkey || ':' || d), 1, 8))::UBIGINT / 4294967296.0"
_WEIGHT = " + ".join(f"(u >= {p!r})::INTEGER" for p in metrics.POISSON_1)


@query(
    "poisson_bootstrap",
    f"""WITH u AS (SELECT o_orderstatus, o_totalprice AS v, o_custkey AS c, d, {_U} AS u FROM orders, range(40) r(d)), w AS (SELECT *, {_WEIGHT} AS w FROM u),
per AS (SELECT o_orderstatus, d, sum(v * w) / sum(w) AS mean, max(v) AS best, min(v) AS worst, sum(w) FILTER (c % 2 = 0) / sum(w) AS even FROM w WHERE w > 0 GROUP BY 1, 2)
SELECT o_orderstatus, {', '.join(f"round(avg({n}), 4) AS {n}_mean, round(stddev_pop({n}), 4) AS {n}_std" for n in ('mean', 'best', 'worst', 'even'))} FROM per GROUP BY 1""",
)
def _(t):
    rows = t("orders")
    pair = F.struct(F.col("o_totalprice").alias("v"), (F.col("o_custkey") % 2 == 0).alias("even"))
    reducers = {
        "mean": lambda x, w: F.sum(x["v"] * w) / F.sum(w), "best": lambda x, w: F.max(x["v"]), "worst": lambda x, w: F.min(x["v"]),
        "even": lambda x, w: F.sum(F.when(x["even"], w)) / F.sum(w),
    }
    got = metrics.poisson_bootstrap(rows, ["o_orderstatus"], F.col("o_orderkey"), pair, reducers, 40)
    return got.select("o_orderstatus", *[F.round(c, 4).alias(c) for c in got.columns[1:]])


@query("best_of_gold", "SELECT l_orderkey, first(l_partkey ORDER BY l_quantity DESC, l_linenumber, l_partkey DESC) AS part, max(l_quantity) AS f1 FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_linenumber"), "l_partkey")).alias("part"), F.max("l_quantity").alias("f1"))


@query(
    "verifier_counts",
    """WITH l AS (SELECT event_type, user_id AS claim_id, max_by(CASE WHEN value > 50 THEN 'ACCEPT' ELSE 'REJECT' END, event_id) AS s FROM events GROUP BY 1, 2)
SELECT event_type, count_if(s = 'ACCEPT' AND claim_id % 2 = 0)::BIGINT AS tp, count_if(s = 'ACCEPT' AND claim_id % 2 <> 0)::BIGINT AS fp, count_if(s <> 'ACCEPT' AND claim_id % 2 = 0)::BIGINT AS fn, count_if(s <> 'ACCEPT' AND claim_id % 2 <> 0)::BIGINT AS tn FROM l GROUP BY 1""",
)
def _(t):
    e = t("events").select("event_type", F.col("user_id").alias("claim_id"), F.when(F.col("value") > 50, "ACCEPT").otherwise("REJECT").alias("status"), F.col("event_id").alias("event_seq"))
    return metrics.verifier_counts(e, e.where("claim_id % 2 = 0"), "event_type")


@query(
    "verifier_micro",
    """WITH l AS (SELECT user_id AS claim_id, event_type, max_by(value > 50, event_id) AS a FROM events GROUP BY 1, 2), c AS (SELECT event_type, count_if(a AND claim_id % 2 = 0) AS tp, count_if(a AND claim_id % 2 <> 0) AS fp, count_if(NOT a AND claim_id % 2 = 0) AS fn FROM l GROUP BY 1)
SELECT event_type, round(tp / nullif(tp + fp, 0), 6) AS p, round(tp / nullif(tp + fn, 0), 6) AS r, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f FROM c""",
)
def _(t):
    e = t("events").select("event_type", F.col("user_id").alias("claim_id"), F.when(F.col("value") > 50, "ACCEPT").otherwise("REJECT").alias("status"), F.col("event_id").alias("event_seq"))
    p, r, f = metrics.micro_scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return metrics.verifier_counts(e, e.where("claim_id % 2 = 0"), "event_type").select("event_type", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f"))


@query("timings", "SELECT k AS name, round(CASE WHEN contains(k, 'async') THEN avg(value) ELSE sum(value) END, 3) AS value FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'async_' ELSE 'sync_' END || event_type AS k, value FROM events) GROUP BY 1".replace("'sync_'", "'plain_'"))
def _(t):
    named = t("events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "async_").otherwise("plain_"), "event_type").alias("name"), "value")
    return metrics.reduce_timings(named, "name", "value").select("name", F.round("value", 3).alias("value"))


@query("reverse_forward_gap", "SELECT event_type, round(avg(value) FILTER (event_id % 2 = 0), 5) AS original, round(avg(value) FILTER (event_id % 2 = 1), 5) AS reverse, round(avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0), 5) AS gap FROM events GROUP BY 1")
def _(t):
    rows = t("events").withColumn("ord", F.when(F.col("event_id") % 2 == 0, "original").otherwise("reverse"))
    return metrics.order_gap(rows, "event_type", "ord", "value").select("event_type", *[F.round(c, 5).alias(c) for c in ("original", "reverse", "gap")])


@query("method_order_summary", "SELECT event_type AS method, event_id % 5 AS ord, count(*) AS n, round(avg(CASE WHEN user_id % 3 = 0 THEN value END), 5) AS f1, round(avg((value > 50)::INTEGER), 6) AS complete FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy(F.col("event_type").alias("method"), (F.col("event_id") % 5).alias("ord")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("user_id") % 3 == 0, F.col("value"))), 5).alias("f1"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("complete"))


@query("score_by_source", "WITH r AS (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(avg(s), 5) AS score FROM r GROUP BY 1")
def _(t):
    rows = t("lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return metrics.score_by_source(rows, "l_returnflag", "q").select("l_returnflag", F.round("score", 5).alias("score"))


@query("data_metrics", "SELECT round(avg(l_extendedprice), 2) AS score_mean, round(max(l_extendedprice), 2) AS score_max, round(min(l_extendedprice), 2) AS score_min, round(avg((l_quantity >= 50)::INTEGER), 6) AS clip_ratio, round(avg((l_discount > 0.05)::INTEGER), 6) AS pass_rate FROM lineitem")
def _(t):
    return t("lineitem").agg(F.round(F.avg("l_extendedprice"), 2).alias("score_mean"), F.round(F.max("l_extendedprice"), 2).alias("score_max"), F.round(F.min("l_extendedprice"), 2).alias("score_min"), F.round(F.avg((F.col("l_quantity") >= 50).cast("int")), 6).alias("clip_ratio"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("pass_rate"))


@query("experiment_matrix", "SELECT b.item_id, o AS ord, m AS method FROM benchmark b, (VALUES ('original'), ('reverse')) x(o), (VALUES ('direct'), ('open')) y(m) WHERE NOT (b.item_id % 4 = 0 AND o = 'original' AND m = 'direct')")
def _(t):
    items = t("benchmark").select("item_id", F.explode(F.array(F.lit("original"), F.lit("reverse"))).alias("ord")).withColumn("method", F.explode(F.array(F.lit("direct"), F.lit("open"))))
    done = t("benchmark").where("item_id % 4 = 0").select("item_id", F.lit("original").alias("ord"), F.lit("direct").alias("method"))
    return items.join(done, ["item_id", "ord", "method"], "left_anti")


_TOK = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')".replace("\\\\", "\\")


@query(
    "tfidf_top3",
    f"""WITH d AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM raw GROUP BY 1), q AS (SELECT item_id, unnest({_TOK}) AS term FROM benchmark), qt AS (SELECT item_id, term, count(*) * any_value(idf) AS qw FROM q JOIN idf USING (term) GROUP BY 1, 2),
qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS n FROM qt GROUP BY 1), s AS (SELECT item_id, doc_id, sum(w / nrm.n * qw / qn.n) AS score FROM raw JOIN nrm USING (doc_id) JOIN qt USING (term) JOIN qn USING (item_id) GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s) WHERE place <= 3""",
)
def _(t):
    asked = t("benchmark").select("item_id", F.col("text").alias("query"))
    return retrieval.tfidf_top(t("documents").select("doc_id", "text"), asked, 3, query_id="item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "place")


_SET = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_\\s]', '', 'g'), '\\s+'), lambda w: w <> ''))".replace("\\\\", "\\")


@query(
    "jaccard_top1",
    f"""WITH a AS (SELECT doc_id, {_SET} AS s FROM documents), b AS (SELECT item_id, {_SET} AS q FROM benchmark),
p AS (SELECT item_id, doc_id, len(list_intersect(s, q)) AS i, len(s) AS n, len(q) AS m FROM a, b)
SELECT item_id, doc_id, round(i / (n + m - i), 6) AS score FROM p WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i / (n + m - i) DESC, doc_id) = 1""",
)
def _(t):
    return retrieval.jaccard_top(t("documents"), t("benchmark").select("item_id", F.col("text").alias("q")), "doc_id", "text", "item_id", "q").select("item_id", "doc_id", F.round("score", 6).alias("score"))
