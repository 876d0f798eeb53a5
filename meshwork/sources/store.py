"""Stored stages: split tables, graph bundles, results, documents."""

from __future__ import annotations

import hashlib
import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import Graph

SPLITS = ("train", "val", "test")


def write_processed(df: DataFrame, path: str) -> None:
    """A folder a split, so that a reader of one split opens no other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_processed(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver through Spark's file systems."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, record: dict) -> None:
    write_text(spark, path, json.dumps(record, indent=2, sort_keys=True, default=str))


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def parse_flat_yaml(text: str) -> dict:
    """Top-level ``key: value`` and ``- item`` lists; scalars as in JSON; comments and blank lines skipped."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if body.startswith("- ") and key is not None:
            out[key] = (out[key] if isinstance(out[key], list) else []) + [_scalar(body[2:])]
        else:
            key, _, value = body.partition(":")
            key = key.strip()
            out[key] = _scalar(value)
    return out


def _scalar(text: str):
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def format_flat_yaml(record: dict) -> str:
    lines = []
    for key, value in record.items():
        if isinstance(value, (list, tuple)):
            lines += [f"{key}:", *(f"  - {json.dumps(v)}" for v in value)] if value else [f"{key}: []"]
        else:
            lines.append(f"{key}: {json.dumps(value)}")
    return "\n".join(lines) + "\n"


def markdown_summary(title: str, facts: dict) -> str:
    return "\n".join([f"## {title}", "", *(f"- {k}: {v}" for k, v in facts.items()), ""])


def config_key(config: dict) -> str:
    """A folder name that changes with any setting."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def is_complete(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def cached(spark: SparkSession, root: str, config: dict, make, overwrite: bool = False) -> DataFrame:
    """The stored table of a configuration; made and stored where there is none, or anew."""
    path = f"{root.rstrip('/')}/{config_key(config)}"
    if overwrite or not is_complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_graph(graph: Graph, path: str, stats: DataFrame, config: dict) -> None:
    """nodes, edges and stats as Parquet, and config.json last."""
    spark = graph.nodes.sparkSession
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    write_json(spark, f"{path}/config.json", config)


def read_graph(spark: SparkSession, path: str) -> tuple[Graph, dict]:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")), read_json(spark, f"{path}/config.json")


def write_summary_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for summaries, which are small."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


#: Folders of run results, from the outermost in: a run writes to its own and leaves the others alone.
RUN = ["dataset", "model", "graph_id", "seed"]


def write_results(results: DataFrame, root: str) -> None:
    """Nested run results as JSON below a folder for each dataset, model, graph and seed."""
    writer = results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
    writer.partitionBy(*RUN).json(root)


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All run results below a folder; lines that are no JSON are left out with a warning."""
    kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema)}
    own = ", ".join(f"{c} {kind}" for c, kind in kinds.items() if c not in RUN)
    lines = spark.read.schema(", ".join(["value string", *(f"{c} {kinds[c]}" for c in RUN)])).text(root)
    found = lines.withColumn("r", F.from_json("value", f"{own}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    if broken := found.agg(F.count("r._broken").alias("broken")).first()["broken"]:
        warnings.warn(f"{broken} unreadable results below {root} are left out", stacklevel=2)
    return found.where("r._broken is null and graph_id is not null").select(*(c if c in RUN else F.col(f"r.{c}") for c in kinds))


def fingerprint(df: DataFrame) -> str:
    """Tells a table from another, whatever the order of its rows."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return config_key({"columns": sorted(df.columns), "rows": row["n"], "x": row["x"], "s": str(row["s"])})
