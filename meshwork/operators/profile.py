"""Profiles of raw tables: what each column holds and what role it can play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import as_number
from .ranking import drawn

NULL_VALUE = "<NA>"
TOP = 10
NUMERIC_SHARE = 0.95
SPLIT_NAMES = ("split", "is_train", "train", "set", "dataset")


def profile_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows where there are at most n, else the n of the first draws; ``sampled`` tells which."""
    out = drawn(df, [], seed, key, "_rn", "_n")
    return out.where(F.col("_rn") <= n).withColumn("sampled", F.col("_n") > n).drop("_rn", "_n")


def _long(df: DataFrame, aggregates: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """One pass over ``df``: a row for each column, a field for each aggregate."""
    one = df.agg(*(F.struct(*(a.alias(n) for n, a in zip(names, fields))).alias(c) for c, fields in aggregates.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}`.{n}").alias(n) for n in names)) for c in aggregates))))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, n_missing, pct_missing; one scan for all columns."""
    rows = F.count(F.lit(1))
    return _long(df, {c: [rows, F.count_if(F.col(c).isNull()), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(F.col(c).isNull()), rows), F.lit(0.0)), 6)] for c in columns}, ["n_rows", "n_missing", "pct_missing"])


def numeric_coercion(df: DataFrame, columns: list[str], share: float = NUMERIC_SHARE) -> DataFrame:
    """column_name, ratio of non-null values that are numbers, is_numeric."""
    ratio = lambda c: F.try_divide(F.count(as_number(F.col(c).cast("string"))), F.count(c))
    table = _long(df, {c: [F.round(F.coalesce(ratio(c), F.lit(0.0)), 6)] for c in columns}, ["ratio"])
    return table.withColumn("is_numeric", F.col("ratio") >= share)


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, min_value, max_value, mean_value, std_value (population), pct_zero; nulls where nothing is a number."""
    texts = {c for c, kind in df.dtypes if kind == "string"}
    x = lambda c: as_number(F.col(c)) if c in texts else F.col(c).cast("double")
    fields = lambda c: [F.round(F.min(x(c)), 6), F.round(F.max(x(c)), 6), F.round(F.avg(x(c)), 6), F.round(F.stddev_pop(x(c)), 6), F.round(F.avg(F.when(x(c) == 0, 100.0).when(x(c).isNotNull(), 0.0)), 6)]
    return _long(df, {c: fields(c) for c in columns}, ["min_value", "max_value", "mean_value", "std_value", "pct_zero"])


def categorical_top(df: DataFrame, columns: list[str], top: int = TOP) -> DataFrame:
    """column_name, value, count, rank and n_unique (null is a value) of the most frequent values."""
    values = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(NULL_VALUE)).alias("value")) for c in columns))))
    counts = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    unique = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    order = W.partitionBy("column_name").orderBy(F.desc("count"), "value")
    first = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(F.broadcast(unique), "column_name").select("column_name", "value", "count", F.col("rank").cast("long").alias("rank"), "n_unique")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """class, count, pct; null is the class ``<NA>``."""
    counts = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit(NULL_VALUE)).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("class", "count", F.round(100.0 * F.col("count") / F.sum("count").over(W.partitionBy()), 6).alias("pct"))


def parsed_time(c: Column) -> Column:
    """A timestamp from text or from seconds since 1970, up to the year 5138; null where it is neither."""
    seconds = as_number(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(c.cast("string")), F.when(F.abs(seconds) < 1e11, F.timestamp_seconds(seconds)))


def timestamp_detect(df: DataFrame, candidates: list[str], least: float = 0.0) -> DataFrame:
    """column_name, success_pct, chosen: the first candidate of the highest share, also at 0 %."""
    rate = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.count(parsed_time(F.col(c))), F.count(F.lit(1))), F.lit(0.0)), 6)
    table = _long(df, {c: [F.max(F.lit(k)), rate(c)] for k, c in enumerate(candidates)}, ["turn", "success_pct"])
    best = F.row_number().over(W.partitionBy().orderBy(F.desc("success_pct"), "turn"))
    return table.select("column_name", "success_pct", ((best == 1) & (F.col("success_pct") >= least)).alias("chosen"))


def label_columns(df: DataFrame, candidates: list[str]) -> list[str]:
    return [c for c in candidates if c in df.columns]


def entity_columns(df: DataFrame, candidates: list[str]) -> list[str]:
    """Columns named like a candidate in any case, in case-blind order."""
    wanted = {c.lower() for c in candidates}
    return sorted((c for c in df.columns if c.lower() in wanted), key=str.lower)


def split_columns(df: DataFrame) -> list[str]:
    """Columns that look like a ready-made split; none means that files are the split."""
    return [c for c in df.columns if c.lower() in SPLIT_NAMES]


def type_suggestion(df: DataFrame, skip: tuple[str, ...] = ("_source_file",)) -> dict[str, list[str]]:
    """Columns by suggested kind, from the schema alone."""
    kinds: dict[str, list[str]] = {"numeric": [], "categorical": []}
    for field in df.schema:
        if field.name not in skip:
            kinds["numeric" if isinstance(field.dataType, (T.NumericType, T.BooleanType)) else "categorical"].append(field.name)
    return kinds


def as_rows(df: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """A driver-side role listing as a table: role, column_name."""
    rows = [(role, name) for role, names in kinds.items() for name in names]
    return df.sparkSession.createDataFrame(rows, "role string, column_name string")


def report(df: DataFrame, labels: list[str], times: list[str], entities: list[str]) -> dict:
    """Everything above for one table, as a nested record for a JSON sink."""
    kinds = type_suggestion(df)
    texts = [c for c in kinds["categorical"] if dict(df.dtypes)[c] == "string"]
    counted = [r["column_name"] for r in numeric_coercion(df, texts).where("is_numeric").collect()] if texts else []  # a row for each column
    rows = lambda t: [r.asDict() for r in t.collect()] if t is not None else []  # noqa: E731  a row for each column or class
    present = label_columns(df, labels)
    seen = [c for c in times if c in df.columns]
    return {
        "missing": rows(missing_profile(df, df.columns)),
        "numeric": rows(numeric_summary(df, kinds["numeric"] + counted) if kinds["numeric"] + counted else None),
        "categorical": rows(categorical_top(df, kinds["categorical"]) if kinds["categorical"] else None),
        "labels": {c: rows(class_distribution(df, c)) for c in present},
        "timestamps": rows(timestamp_detect(df, seen) if seen else None),
        "entity_columns": entity_columns(df, entities),
        "split_columns": split_columns(df),
        "suggested": kinds,
    }
