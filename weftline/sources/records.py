"""Question-answering records of several shapes as one table; batch tables; JSON and CSV sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def load(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every record of a .json (one array or object) or .jsonl file, as JSON text; other endings raise."""
    if path.endswith(".jsonl"):
        return spark.read.text(path).where(F.trim("value") != "")
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        many = F.from_json("value", "array<variant>")
        parsed = F.parse_json("value")
        is_list = F.startswith(F.trim("value"), F.lit("["))
        return whole.select(F.explode(F.when(is_list, many).otherwise(F.array(parsed))).alias("v")).select(F.to_json("v").alias("value"))
    raise ValueError(f"unsupported record file: {path}")


_PAIRS = "array<array<variant>>"
_DICTS = "array<struct<title:string,sentences:variant,content:variant>>"
_ARRAYS = "struct<title:array<string>,content:array<variant>,sentences:array<variant>>"


def _strings(c: Column) -> Column:
    """A scalar or an array as an array of strings."""
    text = F.to_json(c)
    many = F.from_json(text, "array<string>")
    one = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    return F.when(c.isNull(), F.expr("cast(array() as array<string>)")).when(F.startswith(text, F.lit("[")), many).otherwise(one)


def canonical(records: DataFrame, value: str = "value") -> DataFrame:
    """(sample_id, question, question_type, answers, documents, supporting_facts) of JSON records.

    The context may be a list of [title, sentences], a list of objects, or an object of lists; supporting facts a list
    of [title, sentence] or an object of lists; answers one value or a list.  Documents are numbered by place.
    """
    at = lambda path: F.get_json_object(value, path)
    first = lambda *paths: F.coalesce(*map(at, paths))
    context = first("$.context", "$.metadata.context")
    rows = records.select(
        first("$.id", "$._id", "$.sample_id").alias("sample_id"), first("$.question").alias("question"), first("$.type", "$.question_type", "$.metadata.type").alias("question_type"),
        F.coalesce(at("$.answers"), at("$.golden_answers"), at("$.answer")).alias("_answers"), context.alias("_context"), first("$.supporting_facts", "$.metadata.supporting_facts").alias("_facts"),
    )
    doc = lambda i, title, sents: F.struct(F.format_string("d%05d", i).alias("document_id"), title.alias("title"), _strings(sents).alias("sentences"))
    pairs = F.transform(F.from_json("_context", _PAIRS), lambda p, i: doc(i, F.try_variant_get(p[0], "$", "string"), p[1]))
    dicts = F.transform(F.from_json("_context", _DICTS), lambda d, i: doc(i, d["title"], F.coalesce(d["sentences"], d["content"])))
    lists = F.from_json("_context", _ARRAYS)
    arrays = F.transform(lists["title"], lambda t, i: doc(i, t, F.get(F.coalesce(lists["content"], lists["sentences"]), i)))
    is_list, is_pairs = F.startswith("_context", F.lit("[")), F.col("_context").rlike(r"^\[\s*\[")
    fact = "array<struct<title:string,sentence_id:int>>"
    fact_pairs = F.transform(F.from_json("_facts", _PAIRS), lambda p: F.struct(F.try_variant_get(p[0], "$", "string").alias("title"), F.try_variant_get(p[1], "$", "int").alias("sentence_id")))
    fact_lists = F.from_json("_facts", "struct<title:array<string>,sent_id:array<int>>")
    fact_zip = F.zip_with(fact_lists["title"], fact_lists["sent_id"], lambda t, s: F.struct(t.alias("title"), s.alias("sentence_id")))
    answers = F.when(F.startswith("_answers", F.lit("[")), F.from_json("_answers", "array<string>")).otherwise(F.array("_answers"))
    return rows.select(
        "sample_id", "question", "question_type", F.filter(answers, lambda a: a.isNotNull()).alias("answers"),
        F.when(is_pairs, pairs).when(is_list, dicts).otherwise(arrays).alias("documents"),
        F.coalesce(F.when(F.startswith("_facts", F.lit("[")), fact_pairs).otherwise(fact_zip), F.expr(f"cast(array() as {fact})")).alias("supporting_facts"),
    )


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, messages): one array of (turn, role, text) a conversation, in order."""
    return turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))).alias("messages"))


def nested_key(df: DataFrame, path: str) -> Column:
    """A value within structs and maps, by a dotted path; names with dots in them may be quoted with backticks.

    A key that a map lacks gives null; a name that a struct lacks raises.
    """
    names = [n.strip("`") for n in re.findall(r"`[^`]+`|[^.]+", path)]
    out, kind = F.col(f"`{names[0]}`"), df.schema[names[0]].dataType
    for name in names[1:]:
        if isinstance(kind, MapType):
            out, kind = F.try_element_at(out, F.lit(name)), kind.valueType
        elif isinstance(kind, StructType):
            out, kind = out.getField(name), kind[name].dataType
        else:
            raise ValueError(f"{path}: nothing is within {kind.simpleString()}")
    return out


def read_all(spark: SparkSession, paths: Sequence[str], limit_columns: Sequence[str] = ()) -> DataFrame:
    """Rows of several files, each Parquet or JSON by its ending, by column name; what one lacks is null there."""
    parts = []
    for path in paths:
        kind = "parquet" if path.endswith(".parquet") else "json" if path.endswith((".json", ".jsonl")) else None
        if kind is None:
            raise ValueError(f"unsupported table file: {path}")
        reader = spark.read.format(kind)
        part = (reader.option("multiLine", True) if path.endswith(".json") else reader).load(path)
        parts.append(part.select(*limit_columns) if limit_columns else part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def preference_pairs(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected", template: str = "{}{}") -> DataFrame:
    """(prompt, answer, preferred) of every pair: two rows, the chosen answer first; template puts the prompt and an answer together."""
    before, middle, after = (template.split("{}") + ["", ""])[:3]
    whole = lambda c: F.concat(F.lit(before), F.col(prompt), F.lit(middle), F.col(c), F.lit(after))
    both = F.array(F.struct(whole(chosen).alias("answer"), F.lit(True).alias("preferred")), F.struct(whole(rejected).alias("answer"), F.lit(False).alias("preferred")))
    return df.select(F.col(prompt).alias("prompt"), F.explode(both).alias("x")).select("prompt", "x.answer", "x.preferred")


def short_prompts(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows whose prompt isn't longer than `most` (tokens, words or whatever length counts)."""
    return df.where(length <= most)


def chosen_samples(df: DataFrame, id_col: str, order: str, ids: Sequence[str] | None = None, start: int = 0, count: int | None = None) -> DataFrame:
    """The samples named, or `count` of them from place `start` on in an order; an id that isn't there raises, and so does a start past the end."""
    if ids is not None:
        wanted = df.sparkSession.createDataFrame([(i,) for i in ids], "_id string")
        rows = df.join(F.broadcast(wanted), F.col(id_col).cast("string") == F.col("_id")).drop("_id")
        lacking = set(ids) - {str(r[0]) for r in rows.select(id_col).distinct().collect()}  # as many as were named at most
        if lacking:
            raise ValueError(f"no such samples: {sorted(lacking)}")
        return rows
    if df.limit(start + 1).count() <= start:
        raise ValueError(f"no sample at place {start}")
    return df.orderBy(order).offset(start).limit(count) if count is not None else df.orderBy(order).offset(start)


def final_turns(turns: DataFrame, sample: str, step: str) -> DataFrame:
    """Each sample's last turn, with `final` and its action: 0 for the final turn, 2 for those before it, in `labelled_turns`."""
    return labelled_turns(turns, sample, step).where("final").drop("final")


def labelled_turns(turns: DataFrame, sample: str, step: str) -> DataFrame:
    """turns with step_id (from 0 in each sample), final, and action_type: 0 for the final turn, 2 for a memory turn."""
    w = Window.partitionBy(sample).orderBy(step)
    rows = turns.withColumns({"step_id": F.row_number().over(w) - 1, "final": F.lead(F.lit(1)).over(w).isNull()})
    return rows.withColumn("action_type", F.when(F.col("final"), 0).otherwise(2))


def corpus(docs: DataFrame, title: str, items: str) -> DataFrame:
    """(doc, position): distinct "title, line break, sentences" texts, numbered in order of the text."""
    from ..operators.batch import numbered

    whole = docs.select(F.concat_ws("\n", F.col(title), F.array_join(items, " ")).alias("doc")).distinct()
    return numbered(whole, "doc").withColumnRenamed("row_id", "position")


def write_json(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A fixed list of fields; nested values as JSON."""
    nested = lambda f: isinstance(df.schema[f].dataType, (ArrayType, MapType, StructType))
    cols = [F.to_json(f).alias(f) if f in df.columns and nested(f) else F.col(f) if f in df.columns else F.lit(None).cast(StringType()).alias(f) for f in fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
