"""Session settings that the operators are written for."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
    session = builder.config(map=SETTINGS).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def job_session() -> SparkSession:
    """The session of whoever submitted the job, on its cluster; without a master, one on this machine."""
    if SparkConf().get("spark.master", None) is None and "MASTER" not in os.environ:
        return local_session(os.cpu_count() or 8)
    return SparkSession.builder.config(map={k: v for k, v in SETTINGS.items() if not SparkConf().contains(k)}).getOrCreate()
