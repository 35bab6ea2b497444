"""Lexical retrieval: TF-IDF cosine and Jaccard, as joins on terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..tables import stored


#: Terms whose idf is sent to every task (some 60 bytes each); a larger vocabulary is joined by a shuffle.
MOST_TERMS = 1 << 20


def _counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col), F.explode(text.words(F.lower(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_top(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query_id, id, score, place): the k most similar documents by the cosine of tf * idf, idf = ln((1 + n) / (1 + df)) + 1.

    Ties go to the smaller id; terms that no document has don't count.  Texts are counted once, into a stored table.  Lengths of
    documents need every term's idf, which is sent along where it is small enough; scores need the questions' terms alone,
    so everything else is left out before terms meet.
    """
    n = docs.count()
    tf = stored(_counts(docs, id_col, text_col), "terms")
    idf = stored(tf.groupBy("term").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf")), "idf")
    small = idf.count() <= MOST_TERMS
    near = lambda df: F.broadcast(df) if small else df
    lengths = tf.join(near(idf), "term").groupBy(id_col).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("length"))
    asked = _counts(queries, query_id, query_text).join(idf, "term").select(query_id, "term", (F.col("tf") * F.col("idf")).alias("qw"), "idf")
    norms = asked.groupBy(query_id).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("norm"))
    asked = stored(asked.join(norms, query_id).select(query_id, "term", (F.col("qw") / F.col("norm") * F.col("idf")).alias("qw")), "asked")
    met = tf.join(asked, "term").groupBy(query_id, id_col).agg(F.sum(F.col("tf") * F.col("qw")).alias("dot"))
    scores = met.join(lengths, id_col).select(query_id, id_col, (F.col("dot") / F.col("length")).alias("score"))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id_col))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def jaccard_top(memories: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str) -> DataFrame:
    """(query_id, id, score): the memory of the highest Jaccard similarity above 0; of equals the smallest id."""
    a = memories.select(id_col, text.token_set(F.col(text_col)).alias("tokens")).withColumn("n", F.size("tokens"))
    b = queries.select(query_id, text.token_set(F.col(query_text)).alias("q_tokens")).withColumn("m", F.size("q_tokens"))
    shared = a.select(id_col, "n", F.explode("tokens").alias("t")).join(b.select(query_id, "m", F.explode("q_tokens").alias("t")), "t").groupBy(query_id, id_col, "n", "m").agg(F.count(F.lit(1)).alias("same"))
    scored = shared.withColumn("score", F.col("same") / (F.col("n") + F.col("m") - F.col("same")))
    best = F.max_by(F.struct(F.col(id_col).alias("id"), "score"), F.struct("score", -F.col(id_col)))
    return scored.groupBy(query_id).agg(best.alias("best")).select(query_id, F.col("best.id").alias(id_col), F.col("best.score").alias("score"))
