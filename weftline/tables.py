"""Tables written to the folder that all machines share, so that loops cut their lineage and lost executors cost little."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = own.get() if own.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = f"/tmp/checkpoints/weftline-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the program ends."""
    path = f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written and read back."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path  # type: ignore[attr-defined]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing reads any more."""
    for table in tables:
        at = (table.sparkSession, table._stored_at)  # type: ignore[attr-defined]
        _delete(*at)
        _WRITTEN.remove(at)


def _delete_all() -> None:
    for at in _WRITTEN:
        try:
            _delete(*at)
        except Exception:  # the session may have ended; the shared folder's owner clears it then
            return


atexit.register(_delete_all)
