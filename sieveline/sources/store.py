"""A table of scores by sequence hash that grows from run to run."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

BUCKETS = 64


class ScoreStore:
    """Scores bucketed by the hash of their sequence, so that a run's new sequences meet it without moving it.

    path: a folder that all executors share. Only sequences without a score younger than ``max_age`` are scored; new scores are
    appended with their time. Null sequences have no score.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS, max_age: timedelta | None = None):
        self.spark, self.name, self.path, self.buckets, self.max_age = spark, name, path, buckets, max_age
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` (sha STRING, score DOUBLE, scored_at TIMESTAMP) USING parquet "
            f"CLUSTERED BY (sha) SORTED BY (sha) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def scores(self, now: datetime) -> DataFrame:
        """The newest valid score of every sequence: sha, score, scored_at."""
        rows = self.spark.table(self.name)
        if self.max_age is not None:
            rows = rows.filter(F.col("scored_at") > F.lit(now - self.max_age))
        return rows.groupBy("sha").agg(F.max(F.struct("scored_at", "score")).alias("newest")).select("sha", "newest.score", "newest.scored_at")

    def missing(self, records: DataFrame, now: datetime) -> DataFrame:
        """(sha, sequence) of the distinct sequences without a valid score."""
        hashed = records.filter("sequence IS NOT NULL").select(F.sha2("sequence", 256).alias("sha"), "sequence")
        return hashed.dropDuplicates(["sha"]).join(self.scores(now), "sha", "left_anti")

    def update(self, records: DataFrame, score: Column, now: datetime) -> DataFrame:
        """Scores what is missing, appends it, and returns all records with ``sha``, ``score`` and ``scored_at``."""
        new = written(self.missing(records, now).select("sha", score.cast("double").alias("score"), F.lit(now).cast("timestamp").alias("scored_at")), "scored")
        if not new.isEmpty():
            in_buckets = new.repartition(self.buckets, "sha")  # one file for each bucket
            in_buckets.write.mode("append").format("parquet").bucketBy(self.buckets, "sha").sortBy("sha").option("path", self.path).saveAsTable(self.name)
            self.spark.catalog.refreshTable(self.name)
        return records.withColumn("sha", F.sha2("sequence", 256)).join(self.scores(now), "sha", "left")
