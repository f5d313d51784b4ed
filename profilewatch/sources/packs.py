"""Prompt packs: a CSV with multi-line text, or its one-line-per-prompt twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import escape_line, strip, unescape_line
from ..session import settle

def with_position(scan: DataFrame, columns: list, name: str = "position") -> DataFrame:
    """``columns`` of a file scan plus the 0-based row position in file order.

    No row is sorted: every split of a file counts its rows, the running total runs
    over one row per split (ordered by path and offset, because Spark schedules
    splits by size), and a row adds its own place within its split.
    """
    marked = scan.select(
        *columns,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = marked.groupBy("_path", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    starts = splits.select(
        "_path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return (
        marked.join(starts, ["_path", "_block"])
        .withColumn(name, F.col("_start") + F.col("_row") - F.col("_first"))
        .drop("_path", "_block", "_row", "_first", "_start")
    )


def read_pack_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_pack(spark: SparkSession, folder: str) -> DataFrame:
    """``prompt_id, prompt`` of a pack folder.

    The CSV's prompt column is the authority. Without it the text comes from the
    escaped lines, the ids from the CSV by position, else ``pack-00``, ``pack-01``...
    A repeated id keeps its last text.
    """
    csv_path, txt_path = f"{folder}/pack.csv", f"{folder}/pack.txt"
    table = read_pack_csv(spark, csv_path) if path_exists(spark, csv_path) else None
    if table is not None and "prompt" in table.columns:
        listed = with_position(table, [F.col("prompt_id").cast("string"), F.col("prompt")])
    else:
        if not path_exists(spark, txt_path):
            raise FileNotFoundError(f"no pack.csv or pack.txt in {folder}")
        lines = spark.read.text(txt_path).filter(strip(F.col("value")) != "")
        listed = with_position(lines, [unescape_line(F.col("value")).alias("prompt")])
        if table is None:
            number = F.lpad(F.col("position").cast("string"), 2, "0")
            number = F.when(F.col("position") > 99, F.col("position").cast("string")).otherwise(number)
            listed = listed.withColumn("prompt_id", F.concat(F.lit("pack-"), number))
        else:
            ids = with_position(table, [F.col("prompt_id").cast("string")])
            listed = listed.join(ids, "position")
    return listed.groupBy("prompt_id").agg(F.max_by("prompt", "position").alias("prompt"))


def write_pack(prompts: DataFrame, folder: str, with_csv: bool = True, prompt_column: bool = True) -> None:
    """The two views of a pack: verbatim CSV and escaped lines, in the same order.

    Both are written from one settled frame, so a recomputed shuffle cannot order them differently.
    """
    prompts = settle(prompts.select(*[c for c in ("prompt_id", "prompt") if c in prompts.columns]))
    if with_csv:
        columns = ["prompt_id", "prompt"] if prompt_column else ["prompt_id"]
        prompts.select(*columns).write.mode("overwrite").option("escape", '"').csv(
            f"{folder}/pack.csv", header=True
        )
    prompts.select(escape_line(F.col("prompt")).alias("value")).write.mode("overwrite").text(
        f"{folder}/pack.txt"
    )
