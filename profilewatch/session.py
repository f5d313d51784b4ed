"""Session settings the jobs rely on, and where lineage may be cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: ``forceOptimizeSkewedJoin`` lets AQE split a hot key even when an aggregation
#: on the same key follows the join: it then adds one exchange *after* the
#: partial aggregation, which is what a key holding a third of the rows needs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # of a key that a JSON body repeats the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # state of open windows lives outside the JVM heap and is checkpointed as changes
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: What a task reads at most, as far as files and keys can be split: a hash aggregation of
#: compressed cells takes about 35 times these bytes. Larger inputs get more tasks, not larger ones.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
}
_UNITS = {unit: 1 << 10 * power for power, unit in enumerate(("", "k", "m", "g", "t", "p"))}


def _in_bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) * _UNITS[unit]


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built; smaller tasks than ours stay."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, most in TASK_BYTES.items():
        if _in_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, or None where the cluster names none.

    Only a local master may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="profilewatch-")
    return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table below the shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Keep a result that several actions read.

    With a shared folder the result is checkpointed there, so a lost executor
    costs a re-read and not the whole lineage. Without one it is persisted,
    lineage intact.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        if not spark.sparkContext.master.startswith("local"):
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
