"""Hashed manifest of the files of a reference folder: a header row and a table of files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header fields that a refresh keeps where the new header leaves them empty.
CARRIED = ("window", "model_id", "counts", "extra")
#: Bytes a digest reads at once.
CHUNK = 8 << 20

_HEADER = (
    "version string, created_utc string, source string, window array<string>, model_id string, "
    "reference_signal string, metric_layers array<int>, metric_passes array<int>, "
    "counts map<string,bigint>, extra map<string,string>"
)
_FILES = "key string, file string, sha256 string, bytes bigint, tracked boolean"


@dataclass(frozen=True)
class Manifest:
    """``header`` is one row; ``files`` (``key, file, sha256, bytes, tracked``) and ``complete``
    (``request_id``) are tables of any size."""

    header: DataFrame
    files: DataFrame
    complete: DataFrame


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files, a chunk at a time, through the file system of their URI."""
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path
            system, inside = fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with system.open_input_stream(inside) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests)], names=["path", "bytes", "sha256"])


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``file, sha256, bytes`` of every file below a folder.

    Spark lists the files (no content leaves the scan), deals them out by path, and the
    task that has a path reads it in chunks, so neither its size nor the number of
    files is bounded by memory. ``file`` is relative to the folder, so parts of different
    tables do not collide.
    """
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("length").alias("bytes"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = found.repartition(parts, "path").mapInArrow(_hashed, "path string, bytes bigint, sha256 string")
    tail = F.substring_index("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return hashed.select(tail.alias("file"), "sha256", "bytes")


def manifest_files(digests: DataFrame, roles: DataFrame) -> DataFrame:
    """Digests of the files that have a role (``key, file, tracked``); absent files are left out."""
    return roles.join(digests, "file").select("key", "file", "sha256", "bytes", "tracked")


def manifest_record(
    files: DataFrame,
    *,
    version: str,
    summary: dict,
    source: str | None = None,
    reference_signal: str | None = None,
    metric_layers: list[int] | None = None,
    metric_passes: list[int] | None = None,
    extra: dict | None = None,
    complete: DataFrame | None = None,
) -> Manifest:
    """Header and files; counts are the summary's ``n_*`` entries, every key of ``extra`` is kept."""
    spark = files.sparkSession
    counts = {k: int(v) for k, v in summary.items() if k.startswith("n_")}
    kept = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (extra or {}).items()}
    row = (
        version, None, source, list(summary.get("window") or []), summary.get("model_id"), reference_signal,
        list(metric_layers or []), list(metric_passes or []), counts, kept,
    )
    header = spark.createDataFrame([row], _HEADER).withColumn(
        "created_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    )
    ids = spark.createDataFrame([], "request_id string") if complete is None else complete
    return Manifest(header, files, ids.select("request_id"))


def write_manifest(manifest: Manifest, path: str) -> None:
    manifest.header.coalesce(1).write.mode("overwrite").json(f"{path}/header")
    manifest.files.write.mode("overwrite").parquet(f"{path}/files")
    manifest.complete.write.mode("overwrite").parquet(f"{path}/complete")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest(
        spark.read.schema(_HEADER).json(f"{path}/header"),
        spark.read.schema(_FILES).parquet(f"{path}/files"),
        spark.read.schema("request_id string").parquet(f"{path}/complete"),
    )


def verify_manifest(manifest: Manifest, digests: DataFrame) -> DataFrame:
    """Status of every recorded file: ok, changed or missing. All are reported."""
    now = digests.select("file", F.col("sha256").alias("_now"))
    status = (
        F.when(F.col("_now").isNull(), F.lit("missing"))
        .when(F.col("_now") == F.col("sha256"), F.lit("ok"))
        .otherwise(F.lit("changed"))
    )
    return manifest.files.join(now, "file", "left").select("key", "file", status.alias("status"))


def refresh_manifest(previous: Manifest, current: Manifest) -> Manifest:
    """``current`` with what the previous header knew carried forward; its files are the new ones.

    No previous header gives none: there is nothing to refresh.
    """
    old = previous.header.select(F.struct(*CARRIED).alias("old")).scalar()
    joined = current.header.withColumn("_old", old).filter(F.col("_old").isNotNull())

    def carried(c: str):
        empty = F.col(c).isNull() if c == "model_id" else F.size(c) == 0
        return F.when(empty, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c)

    header = joined.select(*[carried(c) if c in CARRIED else F.col(c) for c in current.header.columns])
    complete = current.complete if not current.complete.isEmpty() else previous.complete
    return Manifest(header, current.files, complete)
