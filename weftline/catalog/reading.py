"""What a reader does while it reads: re-scans, verification under budgets, memory that is rewritten and recalled."""

from pyspark.sql import functions as F

from ..operators import frontier, memory, stream
from ..sources import objects
from ..tables import new_path, stored
from . import query
from .streams import _LINES, _PHRASES, _phrases, manifest, sentences

_M = f"{_LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY doc_rank, sentence_id) - 1 AS p FROM refs)"
_FOLDED = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query(
    "mention_titles",
    f"""WITH {_M}, asked AS (SELECT DISTINCT lower(source) AS phrase FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT {_FOLDED.format("string_split(text, ' ')[1]")} FROM benchmark),
hits AS (SELECT phrase, source_ref, row_number() OVER (PARTITION BY phrase ORDER BY sample_id, p) AS place FROM m JOIN asked ON phrase <> '' AND (contains({_FOLDED.format('text')}, phrase) OR lower(sample_id) = phrase))
SELECT phrase, source_ref, place FROM hits WHERE place <= 4""",
)
def _(t):
    """Titles (here a sample's name in capitals) count as mentions of every sentence under them."""
    phrases = t("documents").where("source is not null").select(F.concat(F.lit("  "), F.upper("source")).alias("phrase")).unionByName(t("benchmark").select(F.element_at(F.split("text", " "), 1).alias("phrase")))
    return stream.mention_search(sentences(t).withColumn("title", F.upper("sample_id")), phrases, 4, ["sample_id", "doc_rank", "sentence_id"])


@query(
    "targeted_rescan",
    f"""WITH {_M}, c AS (SELECT sample_id, count(*) AS n FROM m GROUP BY 1), a AS (SELECT item_id AS edge_id, {_FOLDED.format("array_to_string(string_split(text, ' ')[1:2], ' ')")} AS phrase, item_id % 3 + 1 AS born FROM benchmark),
h AS (SELECT m.sample_id, edge_id, source_ref, p, greatest(born, CASE WHEN p < n // 3 THEN 1 WHEN p < n * 2 // 3 THEN 2 ELSE 3 END) AS found FROM m JOIN c ON m.sample_id = c.sample_id JOIN a ON contains({_FOLDED.format('text')}, phrase)),
t1 AS (SELECT * FROM h WHERE found = 1 QUALIFY row_number() OVER (PARTITION BY sample_id, edge_id ORDER BY p) <= 1),
t2 AS (SELECT * FROM h WHERE found <= 2 AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.source_ref = h.source_ref AND t1.edge_id = h.edge_id) QUALIFY row_number() OVER (PARTITION BY sample_id, edge_id ORDER BY p) <= 1),
t3 AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM (FROM t1 UNION ALL FROM t2) t WHERE t.source_ref = h.source_ref AND t.edge_id = h.edge_id) QUALIFY row_number() OVER (PARTITION BY sample_id, edge_id ORDER BY p) <= 1)
SELECT sample_id, edge_id, source_ref, 1 AS round FROM t1 UNION ALL SELECT sample_id, edge_id, source_ref, 2 FROM t2 UNION ALL SELECT sample_id, edge_id, source_ref, 3 FROM t3""",
)
def _(t):
    """Three rounds: a third of each stream is read in each, a third of the edges wakes up in each, and each edge looks at one sentence a round."""
    m = manifest(t)
    edges = t("benchmark").select(F.col("item_id").alias("edge_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("anchor"))
    edges = m.select("sample_id").distinct().crossJoin(F.broadcast(edges))  # every run asks for the benchmark's items, some forty
    lengths = m.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    scan = frontier.begin_scan(m, edges)
    for r in (1, 2, 3):
        scan = frontier.rescan(scan, m, edges.where(F.col("edge_id") % 3 < r), lengths.select("sample_id", (F.floor(F.col("n") * r / 3) - 1).alias("cursor")), 1)
    return scan.tried.select("sample_id", "edge_id", "source_ref", "round")


# --- budgets
_QUEUE = """q AS (SELECT user_id AS run_id, event_id % 40 AS claim_id, min(event_id) AS place, min_by(event_id % 5 + 1, event_id) AS calls, 20 + any_value(user_id) % 17 AS most_calls, 6 + any_value(user_id) % 5 AS most_claims FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place, claim_id) AS i FROM q),
r AS (SELECT run_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS n, NULL::BIGINT AS claim_id, NULL::BIGINT AS place, NULL::BIGINT AS calls, '' AS decision FROM o GROUP BY 1
UNION ALL SELECT o.run_id, o.i, CASE WHEN d = 'ADMITTED' THEN r.used + o.calls ELSE r.used END, CASE WHEN d = 'ADMITTED' THEN r.n + 1 ELSE r.n END, o.claim_id, o.place, o.calls, d
FROM r JOIN o ON r.run_id = o.run_id AND o.i = r.i + 1, LATERAL (SELECT CASE WHEN r.n >= o.most_claims THEN 'MAX_CLAIMS' WHEN r.used + o.calls > o.most_calls THEN 'MAX_MODEL_CALLS' ELSE 'ADMITTED' END AS d))"""


def _admitted(t):
    e = t("events")
    items = e.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 40).alias("claim_id"), F.col("event_id").alias("place"), (F.col("event_id") % 5 + 1).alias("calls"))
    runs = e.select(F.col("user_id").alias("run_id")).distinct()
    return frontier.admit(items, runs.select("run_id", (20 + F.col("run_id") % 17).alias("most_calls"), (6 + F.col("run_id") % 5).alias("most_claims")))


@query("verification_queue", f"WITH RECURSIVE {_QUEUE} SELECT run_id, claim_id, place, calls, decision, used AS calls_used FROM r WHERE i > 0")
def _(t):
    return _admitted(t)


@query(
    "run_limits",
    f"""WITH RECURSIVE {_QUEUE}, w AS (SELECT user_id AS run_id, count(DISTINCT event_type) AS windows, 3 + user_id % 4 AS max_windows, user_id % 7 AS min_windows FROM events GROUP BY user_id),
x AS (SELECT w.*, coalesce((SELECT bool_or(decision = 'MAX_MODEL_CALLS') FROM r WHERE r.run_id = w.run_id AND i > 0), false) AS over FROM w)
SELECT run_id, CASE WHEN windows > max_windows OR over THEN 'RESOURCE_LIMIT' WHEN windows < min_windows THEN 'INSUFFICIENT' END AS status,
CASE WHEN windows > max_windows THEN 'MAX_WINDOWS' WHEN over THEN 'MAX_MODEL_CALLS' WHEN windows < min_windows THEN 'STREAMING_PROTOCOL_TOO_SHORT:' || windows || '<' || min_windows END AS reason FROM x""",
)
def _(t):
    windows = t("events").groupBy(F.col("user_id").alias("run_id")).agg(F.count_distinct("event_type").alias("windows"))
    return frontier.run_limits(_admitted(t), windows.withColumns({"max_windows": 3 + F.col("run_id") % 4, "min_windows": F.col("run_id") % 7}))


# --- memory
def count_words(_key, chunk: str | None, seen: str, _recalled: str) -> str:
    """A stand-in for a model: its memory is a running number of all chunks in order and the most spaces of one."""
    h, most = (7, 0) if seen == memory.NO_MEMORY else map(int, seen.split())
    if chunk is None:
        return f"total {h} {most}"
    n = chunk.count(" ")
    return f"{(h * 31 + n) % 1000003} {max(most, n)}"


@query(
    "memory_fold",
    """WITH RECURSIVE c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, coalesce(length(text) - length(replace(text, ' ', '')), 0) AS n FROM documents WHERE source IS NOT NULL),
r AS (SELECT source, -1::BIGINT AS i, 7::BIGINT AS h, 0::BIGINT AS most FROM c GROUP BY 1 UNION ALL SELECT c.source, c.i, (r.h * 31 + c.n) % 1000003, greatest(r.most, c.n) FROM r JOIN c ON c.source = r.source AND c.i = r.i + 1),
s AS (SELECT source, i + 1 AS step, CASE WHEN i < 0 THEN 'No previous memory' ELSE h || ' ' || most END AS memory, lead(h || ' ' || most) OVER w AS said, h, most FROM r WINDOW w AS (PARTITION BY source ORDER BY i))
SELECT source, step, said IS NULL AS final, memory, coalesce(said, 'total ' || h || ' ' || most) AS response FROM s""",
)
def _(t):
    return memory.memory_fold(t("documents").where("source is not null"), "source", "doc_id", "text", count_words).select("source", "step", "final", "memory", "response")


_TOKENS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+'), lambda w: w <> ''))"


@query(
    "recall_earlier",
    f"""WITH s AS (SELECT conv_id AS run_id, turn AS step, {_TOKENS} AS x FROM conversations),
p AS (SELECT a.run_id, a.step, b.step AS found, len(list_intersect(a.x, b.x)) AS same, len(a.x) + len(b.x) AS total FROM s a JOIN s b ON a.run_id = b.run_id AND b.step < a.step)
SELECT run_id, step, found, round(same / (total - same), 9) AS score FROM p WHERE total > same AND same >= 0.05 * (total - same) QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY same / (total - same) DESC, found) = 1""",
)
def _(t):
    """Each turn asks for the most alike of its conversation's earlier ones."""
    turns = t("conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), "text")
    return memory.recall_earlier(turns, turns.withColumnRenamed("text", "query"), 0.05).withColumn("score", F.round("score", 9))


@query("json_array_scan", """SELECT c_custkey, c_name || ' }"{[\\\\' || chr(10) || c_mktsegment AS name, c_acctbal, 3 AS n FROM customer""".replace("\\\\", "\\"))
def _(t):
    """Customers written as JSON objects side by side, with braces, quotes and escapes in strings, and scanned in ranges of 16 KB."""
    c = t("customer")
    spark = c.sparkSession
    name = F.concat("c_name", F.lit(' }"{[\\\n'), "c_mktsegment")
    nested = F.struct(F.col("c_custkey"), name.alias("name"), F.struct(F.col("c_acctbal"), F.array(F.lit("]"), F.lit("}"), F.lit("")).alias("list")).alias("inner"))
    path = new_path(spark, "json")
    c.select(F.to_json(nested).alias("value")).write.option("lineSep", ",").text(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = objects.json_objects(spark, path, 0)
        shape = "c_custkey long, name string, inner struct<c_acctbal:double,list:array<string>>"
        rows = found.select(F.from_json("value", shape).alias("v")).select("v.c_custkey", "v.name", "v.inner.c_acctbal", F.size("v.inner.list").alias("n"))
        return stored(rows, "objects")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
