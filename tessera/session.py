"""What a session needs before it runs this package's Python functions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package to the executors, once for each Spark context; they need no copy on their path."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, os.path.join("tessera", path.relative_to(top)))
    context.addPyFile(str(target))
    context._tessera_shipped = True
    return spark


def by_value(function, kind: pa.DataType, *columns: Column) -> Column:
    """``function``, one of this package's, of the values of ``columns`` in each row, as a column: called within Arrow batches on executors, which get the package first."""
    ship(SparkSession.active())

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array(map(function, *(a.to_pylist() for a in arrays)), kind)

    return F.arrow_udf(run, from_arrow_type(kind))(*columns)


#: Bytes of a batch that Spark hands to Python, and its own default; a batch is held by the JVM and by the worker.
BATCH_BYTES, _BATCH_SETTING, _BATCH_DEFAULT = "16777216b", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, for functions of this package: the executors get it first. Made for ``df.transform``.

    Where the session leaves the bytes of an Arrow batch at Spark's default, ``BATCH_BYTES`` is set.
    """
    spark = ship(df.sparkSession)
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read only through Spark."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
