"""Idempotent table appends from streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from threatloom.operators.ledger import new_rows


def append_once(batch: DataFrame, batch_no: int, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose key the table does not hold yet.

    Every micro-batch owns one partition and overwrites only that, so a batch
    replayed after a failure rewrites its own rows and nothing twice.
    """
    spark = batch.sparkSession
    stamped = batch.selectExpr("*", f"cast({int(batch_no)} as bigint) as micro_batch")
    held = spark.read.schema(stamped.schema).parquet(path).where(f"micro_batch <> {int(batch_no)}") if _exists(spark, path) else stamped.limit(0)
    new_rows(stamped, held, keys).write.mode("overwrite").partitionBy("micro_batch") \
        .option("partitionOverwriteMode", "dynamic").parquet(path)


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def start_append(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                 **trigger) -> StreamingQuery:
    """Drain a stream into a table, applying a batch operator to every micro-batch first."""

    def write(batch: DataFrame, batch_no: int) -> None:
        append_once(transform(batch) if transform else batch, batch_no, path, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
