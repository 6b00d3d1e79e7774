"""Client-to-destination contacts from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatloom.sources.transactions import json_type

TEXT_FIELDS = ("src", "dst", "ts_iso")


def contact_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_contacts(lines: DataFrame) -> DataFrame:
    """``line`` to src, dst, ts_iso, epoch_s and ``problem``; blank lines are skipped, other columns pass through.

    Text fields take any JSON value but null as text. ``epoch_s`` is a number, cut to whole seconds, or a string that writes a whole number.
    ``problem`` is null, or names the first field that is missing or unfit; a line that is no object lacks them all.
    """
    def as_text(name):
        return F.try_variant_get("_json", f"$.{name}", "string")

    stated = F.col("_epoch")
    rows = lines.where(F.trim("line") != "").withColumn("_json", F.try_parse_json("line"))
    rows = rows.withColumns({f: as_text(f) for f in TEXT_FIELDS} | {"_epoch": as_text("epoch_s"), "_type": json_type(F.col("_json"), "epoch_s")})
    whole = F.when(stated.rlike(r"\A\s*[+-]?[0-9]{1,18}\s*\z"), F.trim(stated).try_cast("long"))
    cut = F.when(F.col("_type").rlike("DECIMAL|DOUBLE|FLOAT"), stated.try_cast("double").try_cast("long"))
    rows = rows.withColumn("epoch_s", F.when(F.col("_type") != "BOOLEAN", F.coalesce(whole, cut)))
    problem = F.coalesce(*(F.when(F.col(f).isNull(), F.lit(f)) for f in (*TEXT_FIELDS, "epoch_s")), F.lit(None).cast("string"))
    return rows.withColumn("problem", problem).drop("_json", "_epoch", "_type", "line")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    return parse_contacts(contact_lines(spark, path))
