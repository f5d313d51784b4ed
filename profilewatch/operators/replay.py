"""Data steps around re-sending a pack: windows, send outcome, text matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import WINDOW_PAD_SECONDS
from ..functions.text import single_spaced
from .joins import join_hot


def request_by_text(
    prompts: DataFrame, pack: DataFrame, order: str = "position"
) -> DataFrame:
    """``request_id, prompt_id`` of requests whose prompt is a pack prompt.

    Prompts are equal up to white space. The pack side is one row per text (a
    repeated text keeps its last id), so copies of one prompt cannot multiply, and
    requests that ask the same are split over tasks.
    """

    def normalised(df, *keep):
        # never NULL, so the join adds no null test that would compute the text twice
        text = F.coalesce(single_spaced(F.col("prompt")), F.lit(""))
        return df.filter(F.col("prompt").isNotNull()).select(text.alias("text"), *keep)

    ours = normalised(pack, "prompt_id", F.col(order).alias("_o")).groupBy("text").agg(
        F.max_by("prompt_id", "_o").alias("prompt_id")
    )
    found = join_hot(normalised(prompts, "request_id"), ours, ["text"])
    # one row per request, whatever the number of its payload rows
    return found.groupBy("request_id").agg(F.max("prompt_id").alias("prompt_id"))


def restamp(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relabel rows with our ids; rows of requests outside the mapping are dropped."""
    kept = [c for c in rows.columns if c != "request_id"]
    mapping = mapping.groupBy("request_id").agg(F.max("prompt_id").alias("prompt_id"))
    return join_hot(rows, mapping, ["request_id"]).select(F.col("prompt_id").alias("request_id"), *kept)


def padded_window(
    started: Column, finished: Column, pad_seconds: int = WINDOW_PAD_SECONDS
) -> tuple[Column, Column]:
    """Window bounds as text in UTC, a little wider than the sending itself."""
    pad = F.make_dt_interval(secs=F.lit(pad_seconds))

    def text(ts: Column) -> Column:
        return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+0000"))

    return text(started - pad), text(finished + pad)


def send_outcome(log: DataFrame, by: list[str] | None = None, dry_run: bool = False) -> DataFrame:
    """Why nothing was captured, from the send log (``ok`` per sent prompt)."""
    counts = log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_sent"), F.count_if("ok").alias("n_ok")
    )
    return counts.withColumn("outcome", outcome_class(F.col("n_sent"), F.col("n_ok"), dry_run))


def outcome_class(n_sent: Column, n_ok: Column, dry_run: bool = False) -> Column:
    if dry_run:
        return F.lit("dry_run")
    return (
        F.when((n_ok == 0) & (n_sent > 0), F.lit("none_answered"))
        .when(n_ok < n_sent, F.lit("partly_answered"))
        .otherwise(F.lit("answered_not_recorded"))
    )


def prompts_of(requests: DataFrame, prompts: DataFrame) -> DataFrame:
    """Requests with their prompt, the last one read; those without a text prompt are left out."""
    asked = prompts.filter(F.col("prompt").isNotNull())
    if "timestamp" in prompts.columns:
        last = F.max_by(F.struct("prompt", *[c for c in prompts.columns if c not in ("request_id", "prompt")]), "timestamp")
    else:
        last = F.max(F.struct("prompt", *[c for c in prompts.columns if c not in ("request_id", "prompt")]))
    one = asked.groupBy("request_id").agg(last.alias("_p")).select("request_id", "_p.*")
    return requests.select("request_id").join(one, "request_id")


def first_requests(requests: DataFrame, n: int) -> DataFrame:
    """The first n requests in id order (a report limit)."""
    return requests.select("request_id").orderBy("request_id").limit(n)
