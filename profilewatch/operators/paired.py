"""Candidates against their own matched controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PACK_SIZE
from ..functions.distributions import t_two_sided
from .joins import join_hot


def match_controls(candidates: DataFrame, controls: DataFrame, measures: list[str]) -> DataFrame:
    """Each candidate beside its control: ``control_<m>`` and ``d<m>`` per measure.

    ``controls`` holds one row per ``control_id``; it is broadcast if its run-time
    size allows, else the candidates of a hot control are split.
    """
    right = controls.select("control_id", *[F.col(m).alias(f"control_{m}") for m in measures])
    return join_hot(candidates, right, ["control_id"]).withColumns(
        {f"d{m}": F.col(m) - F.col(f"control_{m}") for m in measures}
    )


def one_sample_t(values: Column) -> dict[str, Column]:
    """Aggregates of a one-sample t-test against zero."""
    n = F.count(values)
    mean = F.avg(values)
    t = F.try_divide(mean, F.try_divide(F.stddev_samp(values), F.sqrt(n.cast("double"))))
    return {"n": n, "mean": mean, "t": t}


def t_test(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``n, mean, t, p`` of ``value`` against zero, per group."""
    measured = df.groupBy(*(by or [])).agg(
        *[c.alias(name) for name, c in one_sample_t(F.col(value)).items()]
    )
    return measured.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1))


def paired_effect(pairs: DataFrame, delta: str, family: str = "family") -> DataFrame:
    """Mean controlled effect of each family with its t-test."""
    return t_test(pairs, delta, [family])


def dose_response(
    scored: DataFrame,
    columns: list[str],
    value: str,
    level: str = "level",
    high: int = 5,
    low: int = 1,
) -> DataFrame:
    """Highest level minus lowest within each column, tested over the columns.

    Columns that lack one of the two levels have no difference and do not count.
    """
    per_column = scored.groupBy(*columns).agg(
        (
            F.avg(F.when(F.col(level) == high, F.col(value)))
            - F.avg(F.when(F.col(level) == low, F.col(value)))
        ).alias("difference")
    )
    return t_test(per_column.filter(F.col("difference").isNotNull()), "difference")


def selection_census(candidates: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many candidates satisfy each condition, in one pass."""
    counts = candidates.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"), F.lit(name).alias("condition"), F.col(f"c{i}").alias("remaining")
            )
            for i, name in enumerate(conditions)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def strongest_per_question(
    candidates: DataFrame,
    question: str,
    effect: str,
    prompt_id: str,
    size: int | None = PACK_SIZE,
) -> DataFrame:
    """The most negative effect of each question, then the strongest ``size`` overall.

    One candidate per question folds in the aggregation; the report itself is a
    top-k, not a sort of everything.
    """
    best = candidates.groupBy(question).agg(
        F.min_by(F.struct(prompt_id, effect), F.struct(effect, prompt_id)).alias("best")
    ).select(question, "best.*")
    return best if size is None else best.orderBy(effect, prompt_id).limit(size)
