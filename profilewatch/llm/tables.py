"""Reading the corpus tables, and sizes that follow the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions the cluster is set to; buckets follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Whether the shuffle files of a statement go when it ends (Spark 4.1; older versions pass over it).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """Intermediate results kept by checkpoint; dropped, they are cleaned once nothing refers to them.

    A lost executor costs reading a result again. The shuffle files that led to a result are not read
    again and go with its statement, not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.kept = spark, name, []

    def keep(self, df: DataFrame) -> DataFrame:
        was = self.spark.conf.get(DROP_SHUFFLES, None)
        self.spark.conf.set(DROP_SHUFFLES, "true")
        try:
            # a statement of its own: what was planned from df before keeps its files
            self.kept.append(settle(df.select("*")))
        finally:
            if was is None:
                self.spark.conf.unset(DROP_SHUFFLES)
            else:
                self.spark.conf.set(DROP_SHUFFLES, was)
        return self.kept[-1]

    def drop(self, *tables: DataFrame | None) -> None:
        """Let go of results; those that were not kept here are passed over."""
        self.kept = [k for k in self.kept if not any(k is t for t in tables)]

    def clear(self) -> None:
        """Let go of all results kept here."""
        self.kept = []
