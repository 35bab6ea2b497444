"""Operator 4, mixing sources to target weights: Poisson replication, with DataFrame functions alone.

A source's mean repetition is its target share of the output over its share of the rows.  Each document's number of
copies inverts the Poisson distribution of that mean at a uniform number hashed from the seed and its id; copies are
exploded and dealt by a hash of id and copy, then ordered by that hash within each partition, which shuffles them
globally without a hot key.  Any machine gets the same copies again, so lost tasks repeat exactly.

Defined results: a null source is a source of its own; rows of one id get the same number of copies; a source with
target weight zero, or that `weights` doesn't name, has none; an empty table stays empty.  Extra columns stay, but for
those that clash with copy, copies and shuffle_key, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored

SEED = 17
EXPONENT = 0.5


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) with 52 random bits, hashed from the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as a double can tell from 1; for means of any size."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.log(mean) - F.log(k.cast("double"))
        total = s["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(s["cdf"], F.array(total)).alias("cdf"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])).otherwise(F.array().cast("array<double>"))


def rates(df: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, exponent: float = EXPONENT, source_col: str = "source") -> DataFrame:
    """(source, rows, mean, cdf) of each source.  Without weights a source's target is rows ** exponent.

    total: rows wanted in all, as many as there are if not given.  One number a run goes to the driver.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        aims = sizes.withColumn("aim", F.pow(F.col("rows").cast("double"), F.lit(exponent)))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, aim double")
        aims = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "rows", F.coalesce("aim", F.lit(0.0)).alias("aim"))
    aims = stored(aims, "sources")
    all_rows, all_aims = aims.agg(F.sum("rows"), F.sum("aim")).first()
    factor = (total if total is not None else all_rows or 0) / all_aims if all_aims else 0.0
    mean = F.col("aim") * F.lit(float(factor)) / F.col("rows")
    return stored(aims.select("source", "rows", mean.alias("mean")).withColumn("cdf", poisson_cdf(F.col("mean"))), "rates")


def replicate(df: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, seed: int = SEED, exponent: float = EXPONENT, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df's rows, each `copies` times, with copy (from 0), copies and shuffle_key, globally shuffled."""
    rows = df.drop("copy", "copies", "shuffle_key")
    name, cdf, u = fresh(df.columns, "mix_source", "mix_cdf", "mix_u")
    table = rates(df, weights, total, exponent, source_col).select(F.col("source").alias(name), F.col("cdf").alias(cdf))
    # the side of sources is broadcast where it is small, else skewed sources are split, by the engine at run time
    held = rows.join(table, rows[source_col].eqNullSafe(table[name])).drop(name)
    held = held.withColumn(u, uniform(seed, id_col))
    copies = F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    counted = held.withColumn("copies", F.when(F.size(cdf) == 0, 0).otherwise(copies)).drop(u, cdf).where("copies > 0")
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed + 1)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string"))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH sizes AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS aim FROM documents GROUP BY source
), rates AS (
  SELECT source, aim * ((SELECT sum(n) FROM sizes) / (SELECT sum(aim) FROM sizes)) / n AS mean FROM sizes
), cdf AS (
  SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::BIGINT + 1)) AS k)
), drawn AS (
  SELECT d.*, CAST('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.p <= d.u) AS copies
  FROM drawn d
), copied AS (
  SELECT *, unnest(range(0, copies)) AS copy FROM counted WHERE copies > 0
)
SELECT doc_id, text, lang, source, n_chars, copies::INTEGER AS copies, copy::INTEGER AS copy,
       md5('18:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS shuffle_key
FROM copied
"""
