"""Text functions over documents, conversations and benchmark items."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, values
from . import query


@query("entity_norm", """SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '^[\\s"''“”‘’]+|[\\s"''“”‘’]+$', '', 'g'), '\\s+', ' ', 'g')) AS digest FROM documents""".replace("\\\\", "\\"))
def _(t):
    return t("documents").select("doc_id", F.md5(text.entity(F.col("text"))).alias("digest"))


@query("span_norm", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g'))) AS digest FROM documents".replace("\\\\", "\\"))
def _(t):
    return t("documents").select("doc_id", F.md5(text.span(F.col("text"))).alias("digest"))


@query("span_contains", "SELECT doc_id FROM documents WHERE contains(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g'), 'the of')".replace("\\\\", "\\"))
def _(t):
    return t("documents").where(text.contains_span(F.col("text"), F.lit("The, of"))).select("doc_id")


@query("spaced_answer", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS answer FROM conversations".replace("\\\\", "\\"))
def _(t):
    return t("conversations").select("conv_id", "turn", text.spaced_answer(F.col("text")).alias("answer"))


@query("bare_answer", "SELECT item_id, trim(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('a', 'an', 'the')), ' '), '\\s+', ' ', 'g')) AS answer FROM benchmark".replace("\\\\", "\\"))
def _(t):
    return t("benchmark").select("item_id", text.bare_answer(F.col("text")).alias("answer"))


_BARE = r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"""


@query(
    "exact_and_sub_match",
    f"""WITH p AS (SELECT conv_id, turn, text AS x, CASE turn % 4 WHEN 0 THEN 'The ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!' WHEN 1 THEN text || ' and, more' WHEN 2 THEN reverse(text) ELSE lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS y FROM conversations),
b AS (SELECT conv_id, turn, y IS NULL AS none, {_BARE.format('x')} AS x, {_BARE.format('y')} AS y FROM p)
SELECT conv_id, turn, CASE WHEN NOT none THEN x = y END AS same, CASE WHEN NOT none THEN contains(x, y) OR contains(y, x) END AS part FROM b""",
)
def _(t):
    """A turn against itself in another spelling, itself and more, itself backwards, and the turn after it."""
    k, following = F.col("turn") % 4, F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    other = F.when(k == 0, F.concat(F.lit("The "), F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("!"))).when(k == 1, F.concat("text", F.lit(" and, more"))).when(k == 2, F.reverse("text")).otherwise(following)
    rows = t("conversations").withColumn("y", other)
    return rows.select("conv_id", "turn", text.exact_match(F.col("text"), F.col("y")).alias("same"), text.either_contains(F.col("text"), F.col("y")).alias("part"))


@query("phrase_mentions", "SELECT doc_id, regexp_matches(' ' || lower(replace(text, chr(10), ' ')) || ' ', '[^\\p{L}\\p{N}\\p{M}_]the of[^\\p{L}\\p{N}\\p{M}_]') AS found FROM documents".replace("\\\\", "\\"))
def _(t):
    return t("documents").select("doc_id", text.mentions(F.regexp_replace("text", "\n", " "), "The of").alias("found"))


@query("entity_key", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, p_brand AS inner FROM part".replace("\\\\", "\\"))
def _(t):
    full = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t("part").select("p_partkey", text.entity_key(full).alias("key"), text.disambiguator(full).alias("inner"))


@query("token_sets", "SELECT item_id, len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_\\s]', '', 'g'), '\\s+'), lambda w: w <> '')))::INTEGER AS n FROM benchmark".replace("\\\\", "\\"))
def _(t):
    return t("benchmark").select("item_id", F.size(text.token_set(F.col("text"))).alias("n"))


@query(
    "bag_f1",
    """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS x FROM benchmark), c AS (SELECT item_id, x, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT item_id, sum(n)::BIGINT AS total FROM c GROUP BY 1),
o AS (SELECT a.item_id, sum(least(a.n, b.n))::BIGINT AS same FROM c a JOIN c b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark) AND a.x = b.x GROUP BY 1)
SELECT a.item_id, round(CASE WHEN same IS NULL THEN 0 ELSE 2.0 * same / (a.total + b.total) END, 6) AS f1 FROM s a JOIN s b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark) LEFT JOIN o ON o.item_id = a.item_id""",
)
def _(t):
    rows = t("benchmark").select("item_id", F.split("text", " ").alias("w"))
    n = rows.count()
    other = rows.select(F.col("item_id").alias("k"), F.col("w").alias("v"))
    return rows.join(other, (F.col("item_id") + 1) % n == F.col("k")).select("item_id", F.round(text.bag_f1(F.col("w"), F.col("v")), 6).alias("f1"))


def _responses(t):
    full = F.concat(F.lit("<think>x</think> The answer: <update>"), "text", F.lit("</update> so \\boxed{"), "conv_id", F.lit("{"), "turn", F.lit("}} done"))
    return t("conversations").withColumn("r", full)


@query("boxed_answers", "SELECT conv_id, turn, conv_id || '{' || turn || '}' AS boxed FROM conversations")
def _(t):
    return _responses(t).select("conv_id", "turn", text.last_boxed(F.col("r")).alias("boxed"))


@query("after_think", "SELECT conv_id, turn, md5('The answer: <update>' || text || '</update> so \\boxed{' || conv_id || '{' || turn || '}} done') AS digest FROM conversations".replace("\\\\", "\\"))
def _(t):
    return _responses(t).select("conv_id", "turn", F.md5(text.after_think(F.col("r"))).alias("digest"))


@query(
    "the_answer_is",
    """WITH s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' so the answer is **no ' || turn || '**. ' WHEN 1 THEN 'the answer is 5. No: the answer is  .' || text || '.. ' ELSE text || ' The Answer is 7' END AS said FROM conversations),
p AS (SELECT *, replace(said, '*', '') AS plain FROM s)
SELECT conv_id, turn, CASE WHEN contains(plain, 'the answer is') THEN trim(regexp_replace(trim(list_last(string_split(plain, 'the answer is')), ' '), '^\\.+|\\.+$', '', 'g'), ' ') END AS answer FROM p""".replace("\\\\", "\\"),
)
def _(t):
    """One phrase, two of them (the last counts), and another spelling that is none; texts may have the phrase themselves."""
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat("text", F.lit(" so the answer is **no "), "turn", F.lit("**. "))).when(k == 1, F.concat(F.lit("the answer is 5. No: the answer is  ."), "text", F.lit(".. "))).otherwise(F.concat("text", F.lit(" The Answer is 7")))
    return t("conversations").select("conv_id", "turn", text.the_answer_is(said).alias("answer"))


@query("update_tags", "SELECT conv_id, turn, CASE WHEN contains(text, chr(10)) THEN '' ELSE text END AS memory, CASE WHEN contains(text, chr(10)) OR trim(text) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS reward FROM conversations")
def _(t):
    r = F.col("r")
    return _responses(t).select("conv_id", "turn", text.first_tag(r, "update").alias("memory"), text.format_reward(r, F.lit(2)).alias("reward"))


@query(
    "word_recall",
    """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM benchmark)
SELECT d.doc_id, round(len(list_filter(ws, lambda x: contains(d.text, x))) / len(ws), 6) AS recall FROM documents d JOIN w ON w.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""",
)
def _(t):
    gold = t("benchmark").select("item_id", F.array("text").alias("gold"))
    docs = t("documents").withColumn("item_id", F.col("doc_id") % gold.count())
    return docs.join(gold, "item_id").select("doc_id", F.round(text.word_recall(F.col("text"), F.col("gold")), 6).alias("recall"))


@query("number_answers", "SELECT o_orderkey, replace(o_totalprice::DECIMAL(18, 2)::VARCHAR, ',', '') AS strict, o_custkey::VARCHAR AS flexible FROM orders")
def _(t):
    said = F.concat(F.lit("so 12 #### "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" or "), "o_custkey", F.lit(" . "))
    return t("orders").select("o_orderkey", text.number_strict(said).alias("strict"), text.number_flexible(said).alias("flexible"))


@query("tool_calls", "SELECT event_id, event_type AS name, user_id::VARCHAR AS user FROM events")
def _(t):
    said = F.concat(F.lit('x <tool_call>{"name": "'), "event_type", F.lit('", "arguments": {"user": '), "user_id", F.lit("}}</tool_call>"))
    got = t("events").select("event_id", text.tool_call(said).alias("c"))
    return got.select("event_id", "c.name", F.col("c.arguments")["user"].alias("user"))


@query("clip_middle", "SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN left(text, 100) || '...' || right(text, 100) ELSE text END) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(text.clip_middle(F.col("text"), 200)).alias("digest"))


@query("safe_ids", "SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 80) AS id FROM pages")
def _(t):
    return t("pages").select("page_id", text.safe_id(F.col("url")).alias("id"))


@query("date_values", "SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN date_trunc('year', o_orderdate)::DATE ELSE o_orderdate::DATE END, '%Y-%m-%d') AS day FROM orders")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.date_format(d, "yyyy-M")).when(k == 2, F.date_format(d, "yyyy")).otherwise(F.date_format(d, "d MMM yyyy"))
    return t("orders").select("o_orderkey", F.date_format(values.date_value(said), "yyyy-MM-dd").alias("day"))


@query("callback_distance", "SELECT conv_id, turn, CASE WHEN turn >= 1 THEN abs(turn - 4) ELSE 0 END::INTEGER AS distance FROM conversations")
def _(t):
    said = F.concat(F.lit("<recalled_memory> (step="), "turn", F.lit(") <current_memory> (step=4)"))
    return t("conversations").select("conv_id", "turn", text.callback_distance(said).alias("distance"))
