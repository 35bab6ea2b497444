"""Batch operators and group-relative windows over line items: a group is an order, a reward a price."""

from pyspark.sql import functions as F

from ..functions import arrays, values
from ..operators import advantage, balance, batch
from . import query


def _rows(t):
    """Orders as a batch: row_id is the place by key, which is dense from 0 or shifted to be."""
    return batch.numbered(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


_ROWS = "r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"


@query("batch_select", f"WITH {_ROWS} SELECT row_id, o_custkey FROM r")
def _(t):
    return batch.select(_rows(t), "o_custkey")


@query("batch_pop", f"WITH {_ROWS} SELECT row_id, o_orderkey, o_totalprice FROM r")
def _(t):
    return batch.pop(_rows(t), "o_custkey")[1].select("row_id", "o_orderkey", "o_totalprice")


@query("batch_rename", f"WITH {_ROWS} SELECT row_id, o_custkey AS uid FROM r")
def _(t):
    return batch.rename(_rows(t), ["o_custkey"], ["uid"]).select("row_id", "uid")


@query("batch_slice", f"WITH {_ROWS} SELECT row_id, o_orderkey FROM r WHERE row_id >= 5 AND row_id < (SELECT count(*) FROM r) - 7 AND (row_id - 5) % 3 = 0")
def _(t):
    rows = _rows(t)
    return batch.slice_rows(rows, rows.count(), 5, -7, 3).select("row_id", "o_orderkey")


@query("batch_mask", f"WITH {_ROWS} SELECT row_id FROM r WHERE o_totalprice > 100000")
def _(t):
    return batch.by_mask(_rows(t), "o_totalprice > 100000").select("row_id")


@query("batch_index", f"WITH {_ROWS}, i AS (SELECT 2 * row_id + c AS dst, (row_id * 7 + c) % (SELECT count(*) FROM r) AS k FROM r, (VALUES (0), (1)) v(c)) SELECT dst::BIGINT AS row_id, o_orderkey FROM i JOIN r ON row_id = k")
def _(t):
    rows = _rows(t)
    n = rows.count()
    index = rows.select("row_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).select((2 * F.col("row_id") + F.col("c")).alias("at"), ((F.col("row_id") * 7 + F.col("c")) % n).alias("row_id"))
    return batch.by_index(rows, index).select("row_id", "o_orderkey")


@query("batch_union_columns", f"WITH {_ROWS} SELECT row_id, o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM r")
def _(t):
    rows = _rows(t)
    return batch.union_columns(rows.select("row_id", "o_orderkey", "o_custkey"), rows.select("row_id", "o_custkey", F.round("o_totalprice", 2).alias("price")))


@query("batch_concat", f"WITH {_ROWS} SELECT row_id, o_orderkey FROM r UNION ALL SELECT row_id + (SELECT count(*) FROM r), o_orderkey FROM r")
def _(t):
    rows = _rows(t).select("row_id", "o_orderkey")
    return batch.concat(rows, rows, rows.count())


@query("batch_repeat_interleave", f"WITH {_ROWS} SELECT row_id * 3 + c AS row_id, o_orderkey FROM r, range(0, 3) v(c)")
def _(t):
    return batch.repeat(_rows(t), 3, 0).select("row_id", "o_orderkey")


@query("batch_repeat_tile", f"WITH {_ROWS} SELECT c * (SELECT count(*) FROM r) + row_id AS row_id, o_orderkey FROM r, range(0, 3) v(c)")
def _(t):
    rows = _rows(t)
    return batch.repeat(rows, 3, rows.count(), interleave=False).select("row_id", "o_orderkey")


@query("batch_chunk", f"WITH {_ROWS} SELECT row_id, ntile(7) OVER (ORDER BY row_id) - 1 AS chunk_id FROM r")
def _(t):
    rows = _rows(t)
    return batch.chunk(rows, 7, rows.count()).select("row_id", "chunk_id")


@query("batch_pad_rows", f"WITH {_ROWS}, n AS (SELECT count(*) AS n FROM r) SELECT row_id, o_orderkey, false AS is_pad FROM r UNION ALL SELECT row_id + n, o_orderkey, true FROM r, n WHERE row_id < (64 - n % 64) % 64")
def _(t):
    rows = _rows(t).select("row_id", "o_orderkey")
    return batch.pad_rows(rows, 64, rows.count())


@query("batch_fold", f"WITH {_ROWS} SELECT row_id // 4 AS row_id, string_agg(o_custkey::VARCHAR, ',' ORDER BY row_id) AS items FROM r GROUP BY row_id // 4")
def _(t):
    return batch.fold(_rows(t), 4, "o_custkey").select("row_id", F.array_join(F.col("o_custkey").cast("array<string>"), ",").alias("items"))


@query("batch_unfold", f"WITH {_ROWS} SELECT row_id, o_custkey FROM r")
def _(t):
    return batch.unfold(batch.fold(_rows(t), 4, "o_custkey"), 4, "o_custkey")


@query("mini_batches", f"WITH {_ROWS} SELECT epoch::INTEGER AS epoch, row_id, (row_number() OVER (PARTITION BY epoch ORDER BY md5(epoch || ':' || row_id)) - 1) // 32 AS batch_id FROM r, range(0, 2) e(epoch)")
def _(t):
    return batch.mini_batches(_rows(t).select("row_id"), 32, 2).select("epoch", "row_id", "batch_id")


# --- arrays
def _items(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return rows.select("l_orderkey", F.col("x.l_partkey").alias("a"))


_ITEMS = "a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY l_orderkey)"


def _join(c):
    return F.array_join(c.cast("array<string>"), ",")


for _left in (False, True):
    _fill = "list_transform(range(0, greatest(6 - len(a), 0)), lambda x: 0::BIGINT)"

    @query(f"pad_{'left' if _left else 'right'}", f"WITH {_ITEMS} SELECT l_orderkey, array_to_string({f'list_concat({_fill}, a)' if _left else f'list_concat(a, {_fill})'}, ',') AS padded FROM a")
    def _(t, left=_left):
        return _items(t).select("l_orderkey", _join(arrays.pad(F.col("a"), 6, 0, left)).alias("padded"))


for _side, _sql in (("right", "a[1:3]"), ("left", "CASE WHEN len(a) > 3 THEN a[len(a) - 2 : len(a)] ELSE a END"), ("center", "CASE WHEN len(a) > 3 THEN list_concat(a[1:1], a[len(a) - 1 : len(a)]) ELSE a END")):

    @query(f"truncate_{_side}", f"WITH {_ITEMS} SELECT l_orderkey, array_to_string({_sql}, ',') AS kept FROM a")
    def _(t, side=_side):
        return _items(t).select("l_orderkey", _join(arrays.truncate(F.col("a"), 3, side)).alias("kept"))


@query("position_ids", "WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity > 10) AS k, (sum((l_quantity > 10)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity > 10 ROWS UNBOUNDED PRECEDING))::BIGINT AS s FROM lineitem) SELECT l_orderkey, string_agg(greatest(s - 1, 0)::VARCHAR, ',' ORDER BY k) AS ids FROM m GROUP BY 1")
def _(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") > 10).cast("long").alias("m")))).alias("x"))
    return rows.select("l_orderkey", _join(arrays.position_ids(F.col("x.m"))).alias("ids"))


@query("response_mask", "WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 4) AS k, coalesce(sum((l_suppkey % 4 = 0)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS m FROM lineitem) SELECT l_orderkey, string_agg(m::INTEGER::VARCHAR, ',' ORDER BY k) AS mask FROM m GROUP BY 1")
def _(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 4).cast("int").alias("m")))).alias("x"))
    return rows.select("l_orderkey", _join(arrays.until_first(F.col("x.m"), 0)).alias("mask"))


@query("loss_mask", "SELECT conv_id, string_agg(repeat(CASE role WHEN 'assistant' THEN '1' ELSE '0' END, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INTEGER), '' ORDER BY turn, role, text) AS mask FROM conversations GROUP BY 1".replace("\\\\", "\\"))
def _(t):
    from ..functions.text import words
    from ..sources.records import conversations

    mask = F.transform("messages", lambda m: F.repeat(F.when(m["role"] == "assistant", "1").otherwise("0"), F.size(words(m["text"]))))
    return conversations(t("conversations")).select("conv_id", F.array_join(mask, "").alias("mask"))


@query("softmax_entropy", "WITH z AS (SELECT vec_id, embedding AS e, list_max(embedding)::DOUBLE + ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)))) AS z FROM embeddings) SELECT vec_id, round(z - list_sum(list_transform(e, lambda x: exp(x::DOUBLE - z) * x::DOUBLE)), 6) AS entropy, round(e[1]::DOUBLE - z, 6) AS log_prob FROM z")
def _(t):
    e = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", F.round(arrays.softmax_entropy(e), 6).alias("entropy"), F.round(arrays.log_prob(e, F.lit(0)), 6).alias("log_prob"))


# --- advantages
_SCORES = "l_orderkey, l_linenumber"


def _score(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", (F.col("l_extendedprice") / 997.0).alias("s"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("m"))


_S = "(l_extendedprice / 997.0)"


def _advantage(name, sql, make):
    @query(name, f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS advantage FROM lineitem")
    def _(t):
        return _score(t).select("l_orderkey", "l_linenumber", F.round(make(F.col("s")), 6).alias("advantage"))


_N, _AVG, _STD = (f"{f} OVER (PARTITION BY l_orderkey)" for f in ("count(*)", f"avg({_S})", f"stddev_samp({_S})"))
_advantage("grpo", f"CASE WHEN {_N} = 1 THEN {_S} / (1 + 1e-6) ELSE ({_S} - {_AVG}) / ({_STD} + 1e-6) END", lambda s: advantage.grpo(s, "l_orderkey"))
_advantage("grpo_no_std", f"CASE WHEN {_N} = 1 THEN {_S} ELSE {_S} - {_AVG} END", lambda s: advantage.grpo(s, "l_orderkey", by_std=False))
_advantage("rloo", f"CASE WHEN {_N} = 1 THEN {_S} ELSE ({_S} - {_AVG}) * {_N} / ({_N} - 1) END", lambda s: advantage.rloo(s, "l_orderkey"))
_advantage("group_centred", f"{_S} - {_AVG}", lambda s: advantage.centred(s, "l_orderkey"))
_STEP = "OVER (PARTITION BY l_orderkey, l_linenumber % 2)"
_advantage(
    "mixed_advantage",
    f"0.8 * (CASE WHEN {_N} = 1 THEN {_S} / (1 + 1e-6) ELSE ({_S} - {_AVG}) / ({_STD} + 1e-6) END) + (1 - 0.8) * (CASE WHEN count(*) {_STEP} = 1 THEN l_quantity / (1 + 1e-6) ELSE (l_quantity - avg(l_quantity) {_STEP}) / (stddev_samp(l_quantity) {_STEP} + 1e-6) END)",
    lambda s: 0.8 * advantage.grpo(s, "l_orderkey") + (1 - 0.8) * advantage.grpo(F.col("l_quantity"), "l_orderkey", F.col("l_linenumber") % 2),
)


@query("zero_variance_filter", "WITH s AS (SELECT l_orderkey, l_linenumber, stddev_pop(l_linenumber // 3) OVER (PARTITION BY l_orderkey) AS d, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM s WHERE d > 0 OR n = 1")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_linenumber") / 3).alias("v"))
    return advantage.varied_groups(rows, "v", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("remax", f"SELECT l_orderkey, l_linenumber, round(sum({_S} * (l_linenumber % 3 <> 0)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 5.0 * (l_linenumber % 3 <> 0)::INTEGER, 5) AS advantage FROM lineitem")
def _(t):
    adv = advantage.reward_to_go(F.col("s"), F.col("m"), F.lit(5.0), "l_orderkey", F.struct("l_linenumber", "s"))
    return _score(t).select("l_orderkey", "l_linenumber", F.round(adv, 5).alias("advantage"))


def _series(t):
    rows = _score(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "s", (F.col("l_quantity") / 10).alias("v"), F.col("m").cast("double").alias("m")))).alias("x"))
    return rows.select("l_orderkey", F.col("x.l_linenumber").alias("n"), F.col("x.s").alias("s"), F.col("x.v").alias("v"), F.col("x.m").alias("m"))


_STEPS = "x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 997.0 AS s, l_quantity / 10 AS v, (l_linenumber % 3 <> 0)::INTEGER::DOUBLE AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem)"


@query(
    "discounted_returns",
    f"WITH RECURSIVE {_STEPS}, r AS (SELECT l_orderkey, l_linenumber, k, s AS ret, s * m AS carry FROM x WHERE k = 1 UNION ALL SELECT x.l_orderkey, x.l_linenumber, x.k, x.s + 0.9 * r.carry, (x.s + 0.9 * r.carry) * x.m FROM r JOIN x ON x.l_orderkey = r.l_orderkey AND x.k = r.k + 1) SELECT l_orderkey, l_linenumber, round(ret, 5) AS ret FROM r",
)
def _(t):
    got = _series(t).select("l_orderkey", F.explode(F.arrays_zip(F.col("n").alias("n"), arrays.discounted(F.col("s"), 0.9, F.col("m")).alias("r"))).alias("x"))
    return got.select("l_orderkey", F.col("x.n").alias("l_linenumber"), F.round("x.r", 5).alias("ret"))


@query(
    "gae",
    f"WITH RECURSIVE {_STEPS}, r AS (SELECT l_orderkey, l_linenumber, k, v, s - v AS adv FROM x WHERE k = 1 UNION ALL SELECT x.l_orderkey, x.l_linenumber, x.k, x.v, x.s + 0.99 * r.v - x.v + 0.99 * 0.95 * r.adv FROM r JOIN x ON x.l_orderkey = r.l_orderkey AND x.k = r.k + 1) SELECT l_orderkey, l_linenumber, round(adv, 3) AS advantage, round(adv + v, 3) AS ret FROM r",
)
def _(t):
    got = _series(t).select("l_orderkey", F.explode(F.arrays_zip(F.col("n").alias("n"), F.col("v").alias("v"), arrays.gae(F.col("s"), F.col("v"), 0.99, 0.95).alias("a"))).alias("x"))
    return got.select("l_orderkey", F.col("x.n").alias("l_linenumber"), F.round("x.a", 3).alias("advantage"), F.round(F.col("x.a") + F.col("x.v"), 3).alias("ret"))


_M = "(l_linenumber % 3 <> 0)::INTEGER"


@query("masked_mean", f"SELECT l_returnflag, round(sum({_S} * {_M}) / (sum({_M}) + 1e-8), 5) AS mean FROM lineitem GROUP BY 1")
def _(t):
    s, m = F.col("l_extendedprice") / 997.0, (F.col("l_linenumber") % 3 != 0).cast("int")
    return t("lineitem").groupBy("l_returnflag").agg(F.round(advantage.masked_mean(s, m), 5).alias("mean"))


@query(
    "masked_whiten",
    f"WITH a AS (SELECT sum({_S} * {_M}) / (sum({_M}) + 1e-8) AS mu, sum({_M}) AS n FROM lineitem), b AS (SELECT mu, sum(({_S} - mu) * ({_S} - mu) * {_M}) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM lineitem, a GROUP BY mu) SELECT l_orderkey, l_linenumber, round(({_S} - mu) / sqrt(var + 1e-8), 5) AS whitened FROM lineitem, b",
)
def _(t):
    return advantage.whiten(_score(t), "s", "m").select("l_orderkey", "l_linenumber", F.round("whitened", 5).alias("whitened"))


for _mode, _sql in (
    ("token-mean", f"SELECT round(sum({_S} * {_M}) / (sum({_M}) + 1e-8), 4) AS loss FROM lineitem"),
    ("seq-mean-token-sum", f"SELECT round(avg(l), 4) AS loss FROM (SELECT sum({_S} * {_M}) AS l FROM lineitem GROUP BY l_orderkey)"),
    ("seq-mean-token-mean", f"SELECT round(avg(l), 4) AS loss FROM (SELECT sum({_S} * {_M}) / sum({_M}) AS l FROM lineitem GROUP BY l_orderkey)"),
    ("seq-mean-token-sum-norm", f"SELECT round(sum({_S} * {_M}) / 7.0, 3) AS loss FROM lineitem"),
):

    @query("loss_" + _mode.replace("-", "_"), _sql)
    def _(t, mode=_mode):
        return advantage.aggregate_loss(_score(t), "l_orderkey", F.col("s"), F.col("m"), mode, 7).select(F.round("loss", 3 if mode.endswith("norm") else 4).alias("loss"))


_D = "(l_discount - l_tax)"
for _kind, _sql in (("kl", _D), ("abs", f"abs({_D})"), ("mse", f"0.5 * {_D} * {_D}"), ("low_var_kl", f"least(greatest(exp(-{_D}) + {_D} - 1, -10), 10)")):

    @query(f"penalty_{_kind}", f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS penalty FROM lineitem")
    def _(t, kind=_kind):
        return t("lineitem").select("l_orderkey", "l_linenumber", F.round(values.kl_penalty(F.col("l_discount"), F.col("l_tax"), kind), 6).alias("penalty"))


_RATIO, _ADV = "exp(l_discount - l_tax)", "(l_quantity - 25)"
_CLIPPED = f"greatest(-{_ADV} * {_RATIO}, -{_ADV} * greatest(least({_RATIO}, 1.02), 0.98))"


@query("policy_loss", f"SELECT l_returnflag, round(avg(CASE WHEN {_ADV} < 0 THEN least(-{_ADV} * 3.0, {_CLIPPED}) ELSE {_CLIPPED} END), 6) AS loss FROM lineitem GROUP BY 1")
def _(t):
    loss = advantage.policy_loss(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") - 25, 0.02, 0.02)
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("value_loss", "SELECT l_returnflag, round(avg(0.5 * greatest((l_discount - l_quantity / 50) * (l_discount - l_quantity / 50), (least(greatest(l_discount, l_tax - 0.01), l_tax + 0.01) - l_quantity / 50) * (least(greatest(l_discount, l_tax - 0.01), l_tax + 0.01) - l_quantity / 50))), 6) AS loss FROM lineitem GROUP BY 1")
def _(t):
    loss = advantage.value_loss(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, 0.01)
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("explained_variance", "SELECT l_returnflag, round(1 - var_samp(l_quantity - l_discount * 100) / (var_samp(l_quantity) + 1e-5), 5) AS explained FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(advantage.explained_variance(F.col("l_quantity"), F.col("l_discount") * 100), 5).alias("explained"))


@query("overlong_penalty", "SELECT doc_id, round(least(-(n_chars - 1000) / 500.0 * 1.5, 0), 6) AS penalty FROM documents")
def _(t):
    return t("documents").select("doc_id", F.round(values.overlong_penalty(F.col("n_chars"), 1500, 500, 1.5), 6).alias("penalty"))


# --- partitions
def _lengths(t):
    return t("orders").select((F.col("o_custkey") % 10).alias("batch"), F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 1000).cast("long").alias("length"))


@query("karmarkar_karp")
def _(t):
    return balance.partition(_lengths(t), "batch", "row", "length", 4)


@query("partition_imbalance", "SELECT min(s)::BIGINT AS least, max(s)::BIGINT AS most, round(avg(s), 4) AS mean FROM (SELECT o_custkey % 10 AS b, sum(CAST(trunc(o_totalprice / 1000) AS BIGINT)) AS s FROM orders GROUP BY 1)")
def _(t):
    return balance.imbalance(_lengths(t), "batch", "length").select("least", "most", F.round("mean", 4).alias("mean"))
