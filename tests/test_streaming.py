"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from weftline.operators import stream
from weftline.streaming import binding, windows


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_binding(spark, tmp_path):
    rows = []
    for run in ("r1", "r2"):
        for k in range(30):
            rows.append((run, f"b{k}", "director", f"film{k}", f"p{k % 12}", 2 * k + (k % 3) * 7, k // 5))
            rows.append((run, f"a{k}", "born", f"p{(k * 5) % 14}", f"y{k}", 2 * k + 1, k // 5))
            rows.append((run, f"a{k}", "born", f"p{(k * 5) % 14}", f"y{k}", 2 * k + 1, k // 5))
    events = spark.createDataFrame(rows, "run_id string, event_id string, relation string, subject string, object string, position long, window_index long")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    live = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    want = sorted(map(tuple, binding.attach_batch(events, "director", "born").collect()), key=str)
    assert drained(spark, binding.attach(live, "director", "born"), "bound") == want
    assert {w[4] for w in want} == {"DIRECT", "PROMOTED"}


def test_binding_odd_rows(spark, tmp_path):
    """Nulls, values with separators and quotes, and facts that wait over two micro-batches."""
    shape = "run_id string, event_id string, relation string, subject string, object string, position long, window_index long"
    early = [("r", "a1", "born", "p", None, 1, 0), ("r", "a2", "born", "p", 'x\x1f"y', 2, 0), ("r", "a3", "born", None, "z", 3, 0), ("r", "a4", "born", "q\x1f1", "v", 4, 1)]
    late = [("r", "b0", "director", "f", None, 5, 2), ("r", "b1", "director", "f", "p", 6, 3), ("r", "b2", "director", "g", "q\x1f1", 7, 3), ("r", "a5", "born", "p", None, 8, 4), ("r", "a1", "born", "p", None, 9, 4)]
    for part in (early, late):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/o")
    events = spark.createDataFrame(early + late, shape)
    live = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/o")
    want = sorted(map(tuple, binding.attach_batch(events, "director", "born").collect()), key=str)
    assert drained(spark, binding.attach(live, "director", "born"), "bound_odd") == want
    assert [w[1] for w in want] == ["a1", "a2", "a4", "a5"] and [w[3] for w in want] == [None, 'x\x1f"y', "v", None]


def test_windows(spark, tmp_path):
    table = spark.range(200).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("position"), (F.col("id") * 7 % 23 + 1).alias("cost"))
    table.coalesce(1).write.parquet(f"{tmp_path}/w")
    live = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/w")
    want = sorted(map(tuple, stream.budget_windows(table, "run_id", "position", F.col("cost"), 40).select("run_id", "position", "window_index").collect()), key=str)
    assert drained(spark, windows.budget_windows(live, 40), "packed") == want
    assert len(set(want)) == 200
