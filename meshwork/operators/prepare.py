"""Cleaning on whole tables: flags, empty columns, roles, distributions, checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import as_number, filled

#: Names of columns that may hold flags.
FLAG_HINTS = ("land", "logged_in", "root_shell", "is_host_login", "is_guest_login", "label", "y_bin")


def flag_columns(df: DataFrame, hints: tuple[str, ...] = FLAG_HINTS) -> list[str]:
    """Hinted columns with at least one number, whose whole parts are all 0 or 1; one scan."""
    seen = [c for c in hints if c in df.columns]
    if not seen:
        return []
    whole = lambda c: as_number(F.col(c).cast("string")).try_cast("long")
    row = df.agg(*(F.coalesce(F.bool_and(whole(c).isin(0, 1)), F.lit(False)).alias(c) for c in seen)).first()
    return [c for c in seen if row[c]]


def with_flags(df: DataFrame, hints: tuple[str, ...] = FLAG_HINTS) -> DataFrame:
    """Flag columns as 0/1 integers, nulls as 0; other columns untouched."""
    return df.withColumns({c: F.coalesce(as_number(F.col(c).cast("string")).try_cast("long").cast("int"), F.lit(0)) for c in flag_columns(df, hints)})


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value."""
    row = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if row[c] == 0]


def drop_empty(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


@dataclass(frozen=True)
class Roles:
    """What each column is for."""

    labels: list[str]
    meta: list[str]
    features: list[str]
    categorical: list[str]
    numeric: list[str]
    warnings: list[str] = field(default_factory=list)


def resolve_roles(df: DataFrame, labels: list[str], timestamp: str | None, entities: list[str], categorical: list[str] | None = None, numeric: list[str] | None = None) -> Roles:
    """Labels and bookkeeping columns are no features; suggested kinds hold, other features go by their type."""
    there = set(df.columns)
    own_labels = [c for c in df.columns if c in {"y_bin", "y_multi", *labels}]
    meta = [c for c in df.columns if c in {"_split_source", "difficulty_level", timestamp, *entities} and c not in own_labels]
    features = [c for c in df.columns if c not in own_labels and c not in meta]
    chosen_cat = [c for c in categorical or [] if c in features]
    chosen_num = [c for c in numeric or [] if c in features and c not in chosen_cat]
    for f in df.schema:
        if f.name in features and f.name not in chosen_cat and f.name not in chosen_num:
            (chosen_num if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else chosen_cat).append(f.name)
    assert set(features) <= there
    return Roles(own_labels, meta, features, chosen_cat, chosen_num, [] if features else ["no feature columns remain"])


def typed(df: DataFrame, roles: Roles) -> DataFrame:
    """Numeric features as doubles, categorical ones as text without nulls."""
    casts = {c: as_number(F.col(c).cast("string")) for c in roles.numeric} | {c: filled(F.col(c)) for c in roles.categorical}
    return with_flags(df.withColumns(casts))


def split_distribution(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """split, class, count, pct within the split."""
    counts = df.groupBy(F.col(split).alias("split"), F.coalesce(F.col(label).cast("string"), F.lit("<NA>")).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("split", "class", "count", F.round(100.0 * F.col("count") / F.sum("count").over(W.partitionBy("split")), 6).alias("pct"))


def quality_checks(df: DataFrame, label: str, entity: str, features: list[str], labels: list[str], split: str = "split") -> DataFrame:
    """check_name, passed, for a split table."""
    spark = df.sparkSession
    overlap = not set(features) & set(labels)
    per_split = df.groupBy(split).agg((F.count_distinct(label) + F.max(F.col(label).isNull().cast("int")) > 1).alias("ok"))
    degenerate = per_split.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed")).select(F.lit("label_varies_in_each_split").alias("check_name"), "passed")
    filled_all = F.least(*(F.count(c) for c in features), F.count(F.lit(1))) > 0
    empty = df.agg(filled_all.alias("passed")).select(F.lit("no_empty_feature").alias("check_name"), "passed")
    places = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*(F.max((F.col(split) == s).cast("int")).alias(s) for s in ("train", "val", "test")))
    apart = places.agg(*(F.coalesce(F.max(F.col(a) + F.col("test")) < 2, F.lit(True)).alias(a) for a in ("train", "val")))
    disjoint = apart.select(F.inline(F.array(*(F.struct(F.lit(f"entities_{a}_test_disjoint").alias("check_name"), F.col(a).alias("passed")) for a in ("train", "val")))))
    return spark.createDataFrame([("features_labels_disjoint", overlap)], "check_name string, passed boolean").unionByName(degenerate).unionByName(empty).unionByName(disjoint)
