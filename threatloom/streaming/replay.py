"""A table replayed as a stream: several micro-batches, out of order inside the lateness, with a restart between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from threatloom.functions.instants import iso_of_epoch
from threatloom.session import checkpoint_folder, ship_package


def replayed(frame: DataFrame, pipeline: Callable[[DataFrame], DataFrame], batches: int = 3, jitter_s: int = 600, files: int = 4, restart: bool = True) -> DataFrame:
    """The rows that ``pipeline`` writes over ``frame`` (with ``epoch_s``), read as a file stream of ``batches`` micro-batches.

    A row lands in the micro-batch of its second plus up to ``jitter_s``, drawn from its content, so rows of neighbouring batches change
    places. Half of the batches are drained by one run, the rest by a second run from its checkpoint. Two rows far behind the end,
    ``~end`` in their texts, move the watermark past all events and are never folded themselves. Everything lies in the shared folder.
    """
    spark = frame.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    home = f"{checkpoint_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    low, high = frame.agg(F.min("epoch_s"), F.max("epoch_s")).first()
    if low is None:
        low = high = 0
    late = F.col("epoch_s") + F.pmod(F.xxhash64(*frame.columns), F.lit(jitter_s + 1))
    span = high + jitter_s - low + 1
    staged = f"{home}/staged"
    frame.withColumn("micro", F.least(
        F.lit(batches - 1), F.floor((late - low) * batches / span)).cast("int")).write.partitionBy("micro").parquet(staged)
    schema = frame.schema
    land = lambda rows, n: rows.repartition(n).write.mode("append").parquet(f"{home}/in")
    far = high + 4 * jitter_s + 400 * 86_400
    iso = iso_of_epoch(F.lit(far))
    marks = {"epoch_s": F.lit(far).cast("long"), "ts_iso": iso, "observed_at": iso}
    fill = {"string": "~end", "bigint": -1, "int": -1}
    end = spark.range(1).select(*[
        marks.get(f.name, F.lit(fill.get(f.dataType.simpleString()))).cast(f.dataType).alias(f.name) for f in schema.fields])

    def drain() -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{home}/in")
        query = pipeline(stream).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint") \
            .outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    # The state keeps the number of partitions of the first run.
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), 2 * spark.sparkContext.defaultParallelism)))
    try:
        pieces = spark.read.schema(frame.withColumn("micro", F.lit(0)).schema).parquet(staged)
        for n in range(batches):
            land(pieces.where(F.col("micro") == n).drop("micro"), files)
            if restart and n + 1 == (batches + 1) // 2:
                drain()
        land(end, 1)
        drain()
        land(end, 1)
        drain()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return spark.read.parquet(f"{home}/out")
