"""Feature encoding: train-fitted scaling, one-hot levels, blocks, PCA, length 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import filled

#: Features that PCA takes: their square matrix is summed on executors and solved on the driver.
MAX_PCA_FEATURES = 4096
#: Values of a column that become features of their own; more is an error that names the column.
MAX_LEVELS = 4096


def scope(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    """train_only: train and val; transductive: test as well."""
    wanted = {"train_only": ["train", "val"], "transductive": ["train", "val", "test"]}
    if name not in wanted:
        raise ValueError(f"unknown scope {name!r}")
    return df.where(F.col(split).isin(wanted[name]))


def moments(df: DataFrame, columns: list[str], split: str | None = "split") -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column over the train rows; 0 and 1 where there is none."""
    if not columns:
        return {}
    train = df.where(F.col(split) == "train") if split else df
    row = train.agg(*(f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m{k}"] if row[f"m{k}"] is not None else 0.0, row[f"s{k}"] or 1.0) for k, c in enumerate(columns)}


def standardized(df: DataFrame, columns: list[str], fitted: dict[str, tuple[float, float]], centre: bool = True) -> dict[str, Column]:
    """Imputed with the mean, less the mean, over the deviation."""
    return {c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - (m if centre else 0.0)) / s for c, (m, s) in fitted.items() if c in columns}


def levels(df: DataFrame, columns: list[str], split: str | None = "split") -> dict[str, list[str]]:
    """Sorted values of each column over the train rows, one of them standing for null.

    The driver gets ``MAX_LEVELS`` values of a column at most: a column with
    more is an error, and found before any value is collected.
    """
    train = df.where(F.col(split) == "train") if split else df
    if not columns:
        return {}
    seen = train.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), filled(F.col(c)).alias("level")) for k, c in enumerate(columns))))).distinct().cache()
    many = [columns[r["k"]] for r in seen.groupBy("k").count().where(F.col("count") > MAX_LEVELS).orderBy("k").collect()]
    if many:
        seen.unpersist()
        raise ValueError(f"more than {MAX_LEVELS} values for features in {', '.join(many)}")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in seen.collect():
        out[columns[r["k"]]].append(r["level"])
    seen.unpersist()
    return {c: sorted(found) for c, found in out.items()}


def one_hot(fitted: dict[str, list[str]]) -> dict[str, Column]:
    """``column=level`` to 0 or 1; unseen values give zeros everywhere."""
    return {f"{c}={level}": (filled(F.col(c)) == level).cast("double") for c, seen in fitted.items() for level in seen}


def dummies(df: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, Column]:
    """Numeric columns as they are, with the column's mean for nulls; a column for each value and one for null."""
    means = moments(df, numeric, None)
    seen = levels(df, categorical, None)
    out = {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c][0])) for c in numeric}
    for c in categorical:
        out |= {f"{c}={v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for v in seen[c] if v != "__MISSING__"}
        out[f"{c}=null"] = F.col(c).isNull().cast("double")
    return out


def long_form(df: DataFrame, key: str, features: dict[str, Column]) -> DataFrame:
    """key, feature, value."""
    return df.select(F.col(key), F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.round(c, 6).alias("value")) for n, c in features.items()))))


def assembled(df: DataFrame, keep: list[str], features: dict[str, Column], name: str = "v") -> DataFrame:
    """One array of all features, in their order; no feature gives an empty array."""
    vector = F.array(*features.values()) if features else F.array().cast("array<double>")
    return df.select(*keep, vector.cast("array<double>").alias(name))


def l2_normalized(v: Column) -> Column:
    """Of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.aggregate(F.array(norm), v, lambda kept, n: F.transform(kept, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def gram(df: DataFrame, v: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and matrix of products of a vector column; a partial matrix a task, added up by Spark."""

    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = np.stack([np.append(np.asarray(a.values, float), 1.0) for a in batch.column(0)]) if batch.num_rows else np.zeros((0, size + 1))
            total += x.T @ x
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = df.select(v).mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((size + 1, size + 1))
    for r in rows:
        total[r["i"], r["j"]] = r["x"]
    return int(round(total[size, size])), total[size, :size], total[:size, :size]


def principal_axes(df: DataFrame, v: str, size: int, wanted: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the axes of most variance, each with its loading of largest size positive."""
    if size > MAX_PCA_FEATURES:
        raise ValueError(f"PCA over more than {MAX_PCA_FEATURES} features")
    n, sums, products = gram(df, v, size)
    mean = sums / max(n, 1) if centred else np.zeros(size)
    values, axes = np.linalg.eigh(products - n * np.outer(mean, mean))
    axes = axes[:, np.argsort(-values, kind="stable")[:wanted]]
    signs = np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
    return mean, axes * np.where(signs == 0, 1, signs)


def pca(df: DataFrame, v: str, dim: int, fit_on: DataFrame | None = None, centred: bool = True, strict: bool = False) -> DataFrame:
    """``v`` on its principal axes.

    At most min(dim, features - 1, rows - 1) axes, and at least 2, else ``v``
    stays.  ``strict``: exactly dim axes, or none where features or rows are
    not more than dim.
    """
    first = df.select(F.size(v).alias("f")).first()
    size, n = (first["f"] if first else 0), df.count()
    wanted = (dim if size > dim and n > dim else 0) if strict else (min(dim, size - 1, n - 1) if size > 1 and n > 2 else 0)
    if wanted < (1 if strict else 2):
        return df
    mean, axes = principal_axes(df if fit_on is None else fit_on, v, size, wanted, centred)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(v)
            x = np.stack([np.asarray(a.values, float) for a in batch.column(at)]) if batch.num_rows else np.zeros((0, size))
            yield batch.set_column(at, v, pa.array(list((x - mean) @ axes), pa.list_(pa.float64())))

    return df.withColumn(v, F.col(v).cast("array<double>")).mapInArrow(run, df.withColumn(v, F.col(v).cast("array<double>")).schema)


def feature_matrix(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], split: str = "split", graph_scope: str = "transductive", pca_dim: int | None = None, cosine: bool = True, centred: bool = True) -> DataFrame:
    """key, label, split, v: scoped, scaled and one-hot encoded by the train rows, projected, of length 1 for cosine.

    Without ``centred`` columns are scaled but keep their mean, and the
    projection is on singular vectors of the matrix as it is.
    """
    rows = scope(df, graph_scope, split)
    features = standardized(df, numeric, moments(df, numeric, split), centred) | one_hot(levels(df, categorical, split))
    table = assembled(rows, [key, label, split], features)
    table = pca(table, "v", pca_dim, centred=centred) if pca_dim else table
    return table.withColumn("v", l2_normalized(F.col("v"))) if cosine else table
