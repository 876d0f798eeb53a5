"""Raw text tables: delimiter, headerless and header CSV, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import attack_flag, clean_label, numeric_flag, stripped
from .catalog import RawDataset

DELIMITERS = (",", "\t", " ", ";", "|")
#: Texts that stand for a missing value in a CSV.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def best_delimiter(line: Column) -> Column:
    """The delimiter that is most frequent in a line; the first of them on ties, a comma without any."""
    counts = [F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("turn"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).select(best_delimiter(F.col("value")).alias("d")).first()
    return row["d"] if row else ","


def missing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those that the file system does not have."""
    there = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            there.append(path)
    return there


def require_files(spark: SparkSession, paths: list[str]) -> None:
    if gone := missing_files(spark, paths):
        raise FileNotFoundError(f"missing: {', '.join(gone)}")


def with_provenance(df: DataFrame, part: str) -> DataFrame:
    """``_source_file`` of each row, and the part that its file plays."""
    return df.withColumn("_source_file", F.col("_metadata.file_name")).withColumn("_split_source", F.lit(part))


def resolved(spark: SparkSession, folder: str, bases: tuple[str, ...]) -> str:
    """A folder as it is given, or else below the first of the bases that has it."""
    tried = [folder] if folder.startswith("/") or "://" in folder else [folder, *(f"{b.rstrip('/')}/{folder}" for b in bases)]
    for path in tried:
        if not missing_files(spark, [path]):
            return path
    raise FileNotFoundError(f"no such folder: {', '.join(tried)}")


def without_na(df: DataFrame) -> DataFrame:
    """Text columns with every missing-value token as null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")) for c in texts})


def typed_texts(df: DataFrame) -> DataFrame:
    """Text columns whose values are all whole numbers, or all numbers, as such; one scan; columns without values stay text."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    fits = lambda c, kind: F.coalesce(F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), F.trim(F.col(f"`{c}`")).try_cast(kind).isNotNull())), F.lit(False))
    row = df.agg(*(fits(c, kind).alias(f"{kind}{k}") for k, c in enumerate(texts) for kind in ("bigint", "double"))).first()
    kinds = {c: "bigint" if row[f"bigint{k}"] else "double" for k, c in enumerate(texts) if row[f"double{k}"]}
    return df.withColumns({c: F.trim(F.col(f"`{c}`")).try_cast(kind) for c, kind in kinds.items()})


def read_headerless(spark: SparkSession, path: str, columns: tuple[str, ...], delimiter: str = ",") -> DataFrame:
    """Text columns under fixed names, missing-value tokens as null; a row of another width is an error."""
    row = spark.read.text(path).limit(1).first()
    if row and len(row["value"].split(delimiter)) != len(columns):
        raise ValueError(f"{path} has {len(row['value'].split(delimiter))} columns, not {len(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return without_na(spark.read.schema(schema).csv(path, header=False, sep=delimiter, mode="FAILFAST"))


def read_with_header(spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred where no schema is given."""
    reader = spark.read.option("header", True).option("sep", delimiter)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return without_na(reader.csv(path))


def read_dataset(spark: SparkSession, raw: RawDataset, folder: str) -> DataFrame:
    """All files of a dataset with provenance, y_multi and y_bin; text columns become numbers where all their values are."""
    paths = raw.paths(folder)
    require_files(spark, paths)
    out = None
    for (part, _), path in zip(raw.parts, paths):
        rows = read_headerless(spark, path, raw.header) if raw.header else read_with_header(spark, path, sniff_delimiter(spark, path))
        rows = with_provenance(rows, part)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return labelled(typed_texts(out), raw)


def labelled(df: DataFrame, raw: RawDataset) -> DataFrame:
    """``y_multi`` and ``y_bin`` by the dataset's rule; a missing flag column is an error."""
    rule = raw.labels
    if rule.flag is None:
        multi = clean_label(F.col(rule.classes).cast("string"))
        return df.withColumn("y_multi", multi).withColumn("y_bin", attack_flag(F.col("y_multi")))
    if rule.flag not in df.columns:
        raise ValueError(f"{raw.name} has no column {rule.flag!r}")
    multi = stripped(F.col(rule.classes).cast("string")) if rule.classes in df.columns else F.lit(None).cast("string")
    return df.withColumn("y_multi", multi).withColumn("y_bin", numeric_flag(F.col(rule.flag).cast("string")))
