"""JSON arrays that are split within a file; resamples by Poisson weights."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.sources import objects


def some_objects(n):
    rng = random.Random(3)

    def value(depth=0):
        k = rng.randrange(7)
        if k == 0:
            return rng.choice(["}", "{", '"', "\\", "a}{b", '\\"}', "[", "]", 'é漢 } "', "\n}", "", ",", '"}{"'])
        if k == 1:
            return rng.randrange(1000)
        if k == 2 and depth < 3:
            return {rng.choice('ab}{"'): value(depth + 1) for _ in range(rng.randrange(4))}
        if k == 3 and depth < 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return "text " * rng.randrange(6)

    out = [{"id": i, "v": value(), "w": value()} for i in range(n)]
    out[n // 2]["big"] = 'x}"{' * 1500  # over many ranges
    return out


def test_json_arrays_are_split(spark, tmp_path):
    items = some_objects(150)
    forms = {
        "compact": (json.dumps(items, separators=(",", ":")), 1), "pretty": (json.dumps(items, indent=2, ensure_ascii=False), 1), "side": (",\n".join(map(json.dumps, items)), 0),
        "field": (json.dumps({"m": ["x", [[{"z": "}"}]]], "data": items}), 2), "cut": (json.dumps(items + [{"id": "never ended"}])[:-9], 1), "none": (" [ ] \n", 1), "empty": ("", 1),
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for name, (text, depth) in forms.items():
            (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
            for size in ("700", "100m") if name in ("compact", "pretty") else ("900",):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                df = objects.json_objects(spark, f"{tmp_path}/{name}.json", depth)
                got = [json.loads(r.value) for r in df.orderBy("file", "block", "n").collect()]
                assert got == ([] if name in ("none", "empty") else items), (name, size)
                assert size != "700" or df.select("block").distinct().count() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_poisson_bootstrap_is_near_the_closed_form(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(50, 9, 400)
    rows = [(k, "g", float(v)) for k, v in enumerate(values)] + [(1000, "one", 3.0)]
    df = spark.createDataFrame(rows, "id long, grp string, v double")
    reducers = {"mean": lambda v, w: F.sum(v * w) / F.sum(w), "best": lambda v, w: F.max(v), "n": lambda v, w: F.sum(w)}
    got = {r.grp: r for r in metrics.poisson_bootstrap(df, ["grp"], F.col("id"), F.col("v"), reducers, 300).collect()}
    g, error = got["g"], values.std() / np.sqrt(len(values))
    assert abs(g.mean_mean - values.mean()) < 4 * error / np.sqrt(300) + 0.01 and abs(g.mean_std / error - 1) < 0.15
    assert abs(g.n_mean - 400) < 4 * 20 / np.sqrt(300) and abs(g.n_std - 20) < 3
    assert g.best_mean <= values.max() and got["one"].mean_mean == 3.0 and got["one"].mean_std == 0.0
    weights = spark.range(20000).select(metrics.poisson_weight(F.col("id"), F.lit(0), 7).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 20000 for r in weights}
    assert abs(share[0] - 0.3679) < 0.015 and abs(share[1] - 0.3679) < 0.015 and abs(share[2] - 0.1839) < 0.012
