"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from threatloom.session import checkpoint_folder, ship_package

#: Letters that lower-casing changes; everything beyond ASCII stays as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, U+0020 and U+0009 to U+000D, as a character class body.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; ``bytes`` methods treat exactly the ASCII letters and spaces meant here."""
    return text.lower().split() if text else []


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` on executors that have this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(rows, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for a written table."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{re.sub('[^a-z0-9_]', '_', name)}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors, prunes columns."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(column: str = "text") -> "F.Column":
    return F.col(column).cast("binary").alias(column)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
