"""Every query of the catalog against its SQL in DuckDB, on tables where groups have more than a few rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from weftline import catalog
from weftline.operators import stream

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i]) for i in order) for r in table)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(LARGER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{LARGER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_like_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, LARGER)
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, result.fetchall())


def test_queries_without_sql(spark):
    parts = catalog.QUERIES["karmarkar_karp"](spark, SF).groupBy("batch", "part").sum("length").collect()
    by_batch = {}
    for r in parts:
        by_batch.setdefault(r["batch"], []).append(r["sum(length)"])
    assert all(max(v) - min(v) <= 0.05 * sum(v) + 60 for v in by_batch.values() if len(v) == 4)
    for r in catalog.QUERIES["context_synthesis"](spark, SF).collect():
        assert len(set(r.docs)) == len(r.docs) == 20
        gold = [r.question_id % 7, r.question_id % 11 + 20]
        assert [r.docs[i] for i in r.evidence] == gold
        assert r.is_ordered == (r.evidence == sorted(r.evidence)) and r.min_distance == abs(r.evidence[0] - r.evidence[1])
    for r in catalog.QUERIES["bootstrap"](spark, SF).collect():
        assert r.worst <= r.maj <= r.best


def test_jaccard_searches_all_documents(spark, tmp_path):
    docs = [(d, f"other words {d}") for d in (0, 5, 10)] + [(3, "the quick brown fox"), (7, "a lazy dog sleeps")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "quick brown fox"), (2, "lazy dog"), (3, "other words 5")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, catalog.QUERIES["jaccard_top1"](spark, str(tmp_path)).collect())) == [(1, 3, 0.75), (2, 7, 0.5), (3, 5, 1.0)]


def test_losses_and_resamples_cover_all_lines(spark, tmp_path):
    lines = [(1, n, 7, "A", 1.0 if n <= 4 else 100.0, 997.0 * n) for n in (1, 2, 4, 5, 7)] + [(2, n, 7, "A", 100.0, 997.0 * n) for n in (5, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).first()
    assert run("loss_token_mean").loss == round(31 / 7, 4)
    assert run("loss_seq_mean_token_sum").loss == (19 + 12) / 2
    assert run("loss_seq_mean_token_mean").loss == (19 / 5 + 6) / 2
    assert run("loss_seq_mean_token_sum_norm").loss == round(31 / 7, 3)
    assert run("bootstrap").best > 50


def test_mention_search_takes_any_number_of_words(spark):
    n = 10_100
    texts = [("s", f"r{i}", i, " ".join(f"Word{k}x" for k in range(i * 100, i * 100 + 100))) for i in range(n // 100)] + [("t", "q", 0, "the QUICK é𝄞ö fox"), ("t", "e", 1, ""), ("t", "o", 2, "a")]
    manifest = spark.createDataFrame(texts, "sample_id string, source_ref string, stream_position int, text string")
    phrases = [f"word{k}x" for k in range(n)] + ["uick", "é𝄞ö", "ö", "𝄞ö", "none", "fox"]
    got = {r.phrase: r.source_ref for r in stream.mention_search(manifest, spark.createDataFrame([(p,) for p in phrases], "phrase string"), 1).collect()}
    assert got == {f"word{k}x": f"r{k // 100}" for k in range(n)} | dict.fromkeys(["uick", "é𝄞ö", "ö", "𝄞ö"], "q") | {"fox": "q"}


@pytest.mark.parametrize("name", ["ge", "le"])
def test_an_equal_price_is_not_less_or_more(spark, duck, tmp_path, name):
    prices = [149999.99, 150000.0, 149999.995, 150000.01, 1e7, 0.0, None]
    spark.createDataFrame([(k, 1, datetime.datetime(1996, 1, 15), p) for k, p in enumerate(prices)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = duck.execute(catalog.SQL[f"operator_compare_{name}"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalog.QUERIES[f"operator_compare_{name}"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["le"])
def test_prices_that_no_decimal_holds(spark, duck, tmp_path, name):
    near = [math.nextafter(p, q) for p in (149999.995, 150000.0, 150000.005) for q in (0, p, 1e9)]
    prices = [math.nan, math.inf, -math.inf, 1e20, -1e20, 1e300, -1e300, -0.0, 1e-30, None, *near]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").selectExpr("*", "1L AS o_custkey", "timestamp'1996-01-15' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    want = duck.execute(catalog.SQL[f"operator_compare_{name}"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalog.QUERIES[f"operator_compare_{name}"](spark, str(tmp_path)).collect())) == sorted(want)
