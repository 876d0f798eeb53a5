"""Tables written to the shared folder to cut lineage, and their deletion.

The folder is that of ``spark.checkpoint.dir``.  A lost executor costs nothing
that was stored: the files are in shared storage, and what was computed before
them is not computed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .memory import hand_back_now_and_then

#: Paths of the tables that are there, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file:///tmp/checkpoints"
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; no lineage is left."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshwork/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    hand_back_now_and_then(spark)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` has returned, once nothing will read it again."""
    path = getattr(df, "_stored_at", None)
    mine = _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [])
    if path in mine:
        mine.remove(path)
        _delete(df.sparkSession, [path])


def written(spark: SparkSession) -> set[str]:
    """The stored tables that are there."""
    return set(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete this application's stored tables, but for those to keep, once its results are stored."""
    mine = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _WRITTEN[spark.sparkContext.applicationId] = [p for p in mine if p in keep]
    _delete(spark, [p for p in mine if p not in keep])
