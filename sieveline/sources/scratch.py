"""Folders for intermediate files that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session without the setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file:///tmp/sieveline-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``rows`` with their number in the group (from 1) as ``name``: counted in ranges, with the sizes of the ranges before, so that no task holds a group."""
    ranges = rows.repartitionByRange(group, order).withColumn("__range", F.spark_partition_id())
    ranges = written(ranges, "numbered")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(group, "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(group, "__range").orderBy(order))
    same = ranges[group].eqNullSafe(F.col("__group")) & (ranges["__range"] == F.col("__at"))
    starts = starts.select(F.col(group).alias("__group"), F.col("__range").alias("__at"), "__before")
    return ranges.withColumn("__within", within).join(starts, same).withColumn(name, (F.col("__within") + F.col("__before")).cast("int")).drop("__group", "__at", "__before", "__within", "__range")
