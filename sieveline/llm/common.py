"""Helpers shared by the corpus operators: table access and cluster-visible scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a folder of its own; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file:///tmp/sieveline-scratch-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared one: all that its operators write between their steps."""
    return f"{scratch_root(spark)}/sieveline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written between steps; results that aren't written elsewhere yet are gone then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in DuckDB SQL, which has no function for it (oracles only)."""
    octet = "list_reduce([xor(crc, code), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    codes = f"list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint))"
    return f"xor(list_reduce({codes}, lambda crc, code: {octet}), 4294967295)"
