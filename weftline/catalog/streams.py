"""Streams of sentences: a sample is a source, a document a document, a sentence a line."""

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import stream, synthesis
from ..sources import records
from . import query

_LINES = """
lines AS (
  SELECT source AS sample_id, doc_id::VARCHAR AS document_id, doc_id AS doc_rank, unnest(range(0, len(string_split(text, chr(10))))) AS sentence_id,
         unnest(string_split(text, chr(10))) AS text FROM documents
), refs AS (SELECT *, sample_id || ':' || document_id || ':s' || sentence_id AS source_ref FROM lines)
"""


def sentences(t):
    return stream.sentences(t("documents"), F.col("source"), F.col("doc_id"), F.split("text", "\n"), F.col("doc_id"))


def manifest(t, order="original", **more):
    return stream.positions(sentences(t), order, **more)


_OUT = ("sample_id", "source_ref", "stream_position")


def _order(keys: str, extra: str = "") -> str:
    return f"WITH {_LINES} {extra} SELECT sample_id, source_ref, row_number() OVER (PARTITION BY sample_id ORDER BY {keys}) - 1 AS stream_position FROM refs"


@query("manifest_original", _order("doc_rank, sentence_id"))
def _(t):
    return manifest(t).select(*_OUT)


@query("manifest_reverse", _order("doc_rank DESC, sentence_id"))
def _(t):
    return manifest(t, "reverse").select(*_OUT)


@query("manifest_interleaved", _order("sentence_id, doc_rank"))
def _(t):
    return manifest(t, "interleaved").select(*_OUT)


@query("manifest_shuffle", _order("md5('3:' || document_id), doc_rank, sentence_id"))
def _(t):
    return manifest(t, "shuffle", seed=3).select(*_OUT)


@query(
    "manifest_distant",
    f"""WITH {_LINES}, ranked AS (
  SELECT *, doc_rank % 7 = 0 AS support, CASE WHEN doc_rank % 7 = 0 THEN dense_rank() OVER (PARTITION BY sample_id, doc_rank % 7 = 0 ORDER BY doc_rank) - 1 END AS r FROM refs
), placed AS (SELECT *, CASE WHEN NOT support THEN 1 WHEN r % 2 = 0 THEN 0 ELSE 2 END AS place FROM ranked)
SELECT sample_id, source_ref, row_number() OVER (PARTITION BY sample_id ORDER BY place, CASE WHEN place = 2 THEN -doc_rank ELSE doc_rank END, sentence_id) - 1 AS stream_position FROM placed""",
)
def _(t):
    return manifest(t, "distant", supporting=F.col("doc_rank") % 7 == 0).select(*_OUT)


@query(
    "budget_windows",
    """WITH RECURSIVE costs AS (
  SELECT conv_id, turn, greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations
), packed AS (
  SELECT conv_id, turn, n, 0::BIGINT AS w, cost::BIGINT AS used FROM costs WHERE n = 1
  UNION ALL
  SELECT c.conv_id, c.turn, c.n, CASE WHEN p.used + c.cost > 60 THEN p.w + 1 ELSE p.w END, CASE WHEN p.used + c.cost > 60 THEN c.cost ELSE p.used + c.cost END
  FROM packed p JOIN costs c ON c.conv_id = p.conv_id AND c.n = p.n + 1
) SELECT conv_id, turn, w AS window_index FROM packed""".replace("\\\\", "\\"),
)
def _(t):
    return stream.budget_windows(t("conversations"), "conv_id", "turn", stream.word_cost(F.col("text")), 60).select("conv_id", "turn", "window_index")


@query(
    "neighbourhood_k1",
    f"""WITH {_LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY doc_rank, sentence_id) - 1 AS p FROM refs)
SELECT a.source_ref AS anchor, b.source_ref FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.document_id = b.document_id AND abs(a.p - b.p) <= 1""",
)
def _(t):
    m = manifest(t)
    return stream.neighbourhood(m, m, 1)


@query(
    "document_context",
    f"""WITH {_LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY doc_rank, sentence_id) - 1 AS p FROM refs)
SELECT a.source_ref AS anchor, b.source_ref FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.document_id = b.document_id WHERE a.sentence_id = 0""",
)
def _(t):
    m = manifest(t)
    return stream.document_context(m, m.where("sentence_id = 0"))


_PHRASES = "asked AS (SELECT DISTINCT trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '\\s+', ' ', 'g')) AS phrase FROM benchmark)"
_HITS = f"""{_LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY doc_rank, sentence_id) - 1 AS p FROM refs), {_PHRASES},
hits AS (SELECT phrase, source_ref, row_number() OVER (PARTITION BY phrase ORDER BY sample_id, p) AS place FROM m JOIN asked ON contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), phrase))"""


def _phrases(t):
    return t("benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("phrase"))


@query("mention_search", f"WITH {_HITS} SELECT phrase, source_ref, place FROM hits WHERE place <= 5")
def _(t):
    return stream.mention_search(manifest(t), _phrases(t), 5)


@query(
    "expanded_context",
    f"""WITH {_HITS}, top AS (SELECT * FROM hits WHERE place <= 2), near AS (
  SELECT t.phrase, b.source_ref FROM top t JOIN m a ON a.source_ref = t.source_ref JOIN m b ON a.sample_id = b.sample_id AND a.document_id = b.document_id
  UNION SELECT phrase, source_ref FROM top)
SELECT phrase, source_ref FROM near""",
)
def _(t):
    m = manifest(t)
    top = stream.mention_search(m, _phrases(t), 2)
    near = stream.document_context(m, top).join(top.select("phrase", F.col("source_ref").alias("anchor")), "anchor").select("phrase", "source_ref")
    return near.unionByName(top.select("phrase", "source_ref")).distinct()


@query(
    "read_prefix",
    f"""WITH {_LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY doc_rank, sentence_id) - 1 AS p FROM refs)
SELECT sample_id, count(*) AS n, max(p) AS last FROM m WHERE p <= 40 GROUP BY sample_id""",
)
def _(t):
    return stream.read_prefix(manifest(t), 40).groupBy("sample_id").agg(F.count("*").alias("n"), F.max("stream_position").alias("last"))


@query(
    "manifest_violations",
    """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents), kept AS (SELECT * FROM p WHERE doc_id % 13 <> 5 UNION ALL SELECT * FROM p WHERE doc_id % 17 = 3 AND doc_id % 13 <> 5)
SELECT source AS sample_id, 'HASH' AS kind FROM kept WHERE doc_id % 11 = 0
UNION ALL SELECT source, 'POSITION' FROM (SELECT source, p, lag(p) OVER (PARTITION BY source ORDER BY p) AS before FROM kept) WHERE p - coalesce(before, -1) <> 1""",
)
def _(t):
    """Some positions are missing, some come twice, and some hashes are of other texts."""
    rows = stream.positions(stream.sentences(t("documents"), F.col("source"), F.col("doc_id"), F.array("text"), F.col("doc_id")))
    rows = rows.where("doc_rank % 13 <> 5")
    rows = rows.unionByName(rows.where("doc_rank % 17 = 3"))
    hashed = rows.withColumn("text_sha256", F.when(F.col("doc_rank") % 11 == 0, "wrong").otherwise(F.sha2("text", 256)))
    return stream.violations(hashed)


_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)".replace("\\\\", "\\")


@query(
    "token_chunks",
    f"""WITH {_WORDS}, c AS (SELECT doc_id, ws, unnest(range(0, (len(ws) + 99) // 100)) AS step FROM w)
SELECT doc_id, step::INTEGER AS step, len(ws[step * 100 + 1 : step * 100 + 100])::INTEGER AS n, md5(array_to_string(ws[step * 100 + 1 : step * 100 + 100], ' ')) AS digest FROM c""",
)
def _(t):
    pieces = t("documents").select("doc_id", F.posexplode(arrays.chunks(text.words(F.col("text")), 100)).alias("step", "chunk"))
    return pieces.select("doc_id", "step", F.size("chunk").alias("n"), F.md5(F.array_join("chunk", " ")).alias("digest"))


@query(
    "head_tail_truncate",
    f"""WITH {_WORDS} SELECT doc_id, md5(array_to_string(CASE WHEN len(ws) > 80 THEN list_concat(ws[1:40], ws[len(ws) - 39 : len(ws)]) ELSE ws END, ' ')) AS digest FROM w""",
)
def _(t):
    return t("documents").select("doc_id", F.md5(F.array_join(arrays.head_and_tail(text.words(F.col("text")), 80), " ")).alias("digest"))


_EVIDENCE = "e AS (SELECT l_orderkey AS question_id, list(l_partkey % 997 ORDER BY l_linenumber, l_partkey % 997) AS evidence FROM lineitem GROUP BY l_orderkey)"
_SPREAD = f"""{_EVIDENCE}, p AS (SELECT question_id, unnest(evidence) AS pos, unnest(range(0, len(evidence))) AS i FROM e),
g AS (SELECT question_id, lead(pos) OVER (PARTITION BY question_id ORDER BY pos) - pos AS gap, lead(pos) OVER (PARTITION BY question_id ORDER BY i) - pos AS nxt FROM p),
s AS (SELECT question_id, coalesce(bool_and(nxt > 0) FILTER (nxt IS NOT NULL), true) AS is_ordered, coalesce(bool_and(nxt < 0) FILTER (nxt IS NOT NULL), true) AS is_reverse_ordered, min(gap) AS min_distance FROM g GROUP BY question_id)"""


def _spread(t):
    ev = t("lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 997).alias("p")))).alias("x"))
    return synthesis.spread_evidence(ev.select("question_id", F.col("x.p").alias("evidence")))


@query("evidence_spread", f"WITH {_SPREAD} SELECT question_id, is_ordered, is_reverse_ordered, coalesce(min_distance, -1) AS min_distance FROM s")
def _(t):
    return _spread(t).withColumn("min_distance", F.coalesce("min_distance", F.lit(-1)))


@query(
    "distance_buckets",
    f"WITH {_SPREAD} SELECT b::INTEGER AS bucket, question_id FROM s, (VALUES (10), (50), (100), (200)) v(b) WHERE min_distance >= b UNION ALL SELECT 0, question_id FROM s WHERE is_reverse_ordered",
)
def _(t):
    return synthesis.distance_buckets(_spread(t), [10, 50, 100, 200])


@query("context_synthesis")
def _(t):
    asked = t("benchmark").select(F.col("item_id").alias("question_id"), F.array((F.col("item_id") % 7).cast("int"), (F.col("item_id") % 11 + 20).cast("int")).alias("gold"))
    corpus = t("documents").select(F.col("doc_id").alias("position"))
    return synthesis.contexts(asked, corpus, 20)


@query("replicated_samples", "SELECT item_id, c::INTEGER AS copy, item_id || '-' || c AS copy_id FROM benchmark, range(1, 4) r(c)")
def _(t):
    return synthesis.replicated(t("benchmark"), 3, "item_id").select("item_id", "copy", "copy_id")


@query("conversation_messages", "SELECT conv_id, count(*)::INTEGER AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def _(t):
    rows = records.conversations(t("conversations"))
    return rows.select("conv_id", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["text"])), "\n")).alias("digest"))


@query(
    "global_corpus",
    """WITH d AS (SELECT DISTINCT source || chr(10) || replace(text, chr(10), ' ') AS doc FROM documents)
SELECT md5(doc) AS digest, row_number() OVER (ORDER BY doc) - 1 AS position FROM d""",
)
def _(t):
    docs = t("documents").select("source", F.split("text", "\n").alias("lines"))
    return records.corpus(docs, "source", "lines").select(F.md5("doc").alias("digest"), "position")


@query(
    "record_canonical",
    "SELECT doc_id::VARCHAR AS sample_id, 'd00000' AS document_id, source AS title, len(string_split(text, chr(10)))::INTEGER AS n, 1 AS answers FROM documents",
)
def _(t):
    docs = t("documents").withColumn("lines", F.split("text", "\n"))
    pair = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.array(F.struct(F.col("source").alias("title"), F.col("lines").alias("sentences"))).alias("context"), F.col("lang").alias("answer")))
    lists = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(F.struct(F.array("source").alias("title"), F.array("lines").alias("content")).alias("context")).alias("metadata"), F.array("lang").alias("golden_answers")))
    got = records.canonical(docs.select(F.when(F.col("doc_id") % 2 == 0, pair).otherwise(lists).alias("value")))
    one = got.select("sample_id", F.explode("documents").alias("d"), F.size("answers").alias("answers"))
    return one.select("sample_id", "d.document_id", "d.title", F.size("d.sentences").alias("n"), "answers")
