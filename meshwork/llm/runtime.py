"""Session plumbing shared by the training-data operators.

``prepare``      ships this package to the executors once per application.
``materialize``  cuts lineage with a table written in the shared folder.
``release``      deletes the tables that this session has written.
"""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.memory import hand_back_now_and_then
from ..sources.shared import discard, release, shared_dir, stored, written

__all__ = ["bitmap", "compacted", "discard", "documents", "files_for", "has_bit", "is_empty", "materialize", "prepare", "release", "shared_dir", "unpacked", "written"]

_PACKAGE = Path(__file__).resolve().parents[1]

#: Rows and bytes in one Arrow batch, so that a worker's memory is bounded
#: also where texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": f"{16 << 20}"}
#: Rows of a small table in one file, about; and files at most where there are few rows.
FILE_ROWS, FEW_FILES = 50_000, 24


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and bound the Arrow batches; a setting that the session has stays.

    Every operator begins with this, so what the last one has freed on the driver goes back to the system here.
    """
    hand_back_now_and_then(spark)
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    context = spark.sparkContext
    if getattr(context, "_meshwork_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="meshwork-")
    archive = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    context._meshwork_shipped = True
    return spark


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; no lineage is left."""
    return stored(df, label)


def files_for(rows: int) -> int:
    """In how many files tables derived from so many rows are stored at most: more where there are more rows."""
    return max(FEW_FILES, math.ceil(rows / FILE_ROWS))


def compacted(df: DataFrame, label: str, files: int) -> DataFrame:
    """``materialize`` in no more files than ``files``, which grows with the input.

    A task then works through several partitions one after the other, so it
    needs no more memory, and rounds of small tables are not spent on files.
    """
    return materialize(df.coalesce(files), label)


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits in 64-bit words, one set for each ``slot`` below ``bits``: of the same size whatever the rows."""
    words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def has_bit(found: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (found[slots >> 6] >> (slots & 63)) & 1 == 1


def is_empty(df: DataFrame) -> bool:
    """Whether a table has no row; one row at most comes to the driver."""
    return not df.limit(1).count()


def documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Only the two columns that the operators read, under fixed names.

    With ``carry``, also a struct ``more`` of columns to hand through untouched.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if carry is None:
        return own
    more = F.struct(*(F.col(name).alias(f"c{k}") for k, name in enumerate(carry))) if carry else F.struct(F.lit(0).alias("c"))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), more.alias("more"))


def unpacked(df: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns of ``more`` under their own names."""
    return df.select(*(c for c in df.columns if c != "more"), *(F.col(f"more.c{k}").alias(name) for k, name in enumerate(carry)))
