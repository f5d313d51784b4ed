"""Does the answer read normally, and does its vector look normal?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    TEXT_MAX_CHAR_REPEAT,
    TEXT_MAX_CHARS,
    TEXT_MAX_TOP_WORD_SHARE,
    TEXT_MIN_CHARS,
    TEXT_MIN_DISTINCT_WORD_RATIO,
    TEXT_REASONS,
)
from ..functions.text import longest_char_run, strip, with_word_counts

#: Short codes of the reasons, in the order they are reported.
REASON_CODES = ["too_short", "too_long", "char_run", "few_distinct", "top_word", "no_words"]


def text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the numbers the checks are made on, all computed inside the row."""
    stripped = df.withColumn("_t", strip(F.col(text)))
    counted = with_word_counts(stripped, F.col("_t"))
    total = F.col("n_words")
    return counted.withColumns(
        {
            "stripped_chars": F.length("_t").cast("long"),
            "char_run": longest_char_run(F.col("_t")).cast("long"),
            "distinct_ratio": F.try_divide("n_distinct_words", total),
            "top_share": F.try_divide("top_word_count", total),
        }
    ).drop("_t")


def text_checks(
    df: DataFrame,
    text: str = "text",
    *,
    min_chars: int = TEXT_MIN_CHARS,
    max_chars: int = TEXT_MAX_CHARS,
    max_char_repeat: int = TEXT_MAX_CHAR_REPEAT,
    min_distinct_word_ratio: float = TEXT_MIN_DISTINCT_WORD_RATIO,
    max_top_word_share: float = TEXT_MAX_TOP_WORD_SHARE,
) -> DataFrame:
    """Adds ``text_ok``, ``reason_codes`` and ``text_reasons`` to the measures.

    A NULL text stays undecided (NULL), it is not a pass.
    """
    m = text_measures(df, text)
    n, run = F.col("stripped_chars"), F.col("char_run")
    failed = [
        n < min_chars,
        n > max_chars,
        run > max_char_repeat,
        F.col("distinct_ratio") < min_distinct_word_ratio,
        F.col("top_share") > max_top_word_share,
        (F.col("n_words") == 0) & (n > 0),
    ]
    wording = [
        F.format_string(TEXT_REASONS["too_short"].format(limit=min_chars), n),
        F.format_string(TEXT_REASONS["too_long"].format(limit=max_chars), n),
        F.format_string(TEXT_REASONS["char_repeat"], run),
        F.format_string(TEXT_REASONS["few_words"], two_decimals(F.col("distinct_ratio"))),
        F.format_string(TEXT_REASONS["top_word"], two_decimals(F.col("top_share"))),
        F.lit(TEXT_REASONS["no_words"]),
    ]

    def listed(values: list[Column]) -> Column:
        return F.array_compact(F.array(*[F.when(f, v) for f, v in zip(failed, values)]))

    codes = listed([F.lit(c) for c in REASON_CODES])
    present = F.col(text).isNotNull()
    return m.withColumns(
        {
            "text_ok": F.when(present, F.size(codes) == 0),
            "reason_codes": F.when(present, F.concat_ws(";", codes)),
            "text_reasons": F.when(present, F.concat_ws("; ", listed(wording))),
        }
    )


def two_decimals(x: Column) -> Column:
    """Rounded on the stored binary value; ``format_string('%.2f')`` would round ties up."""
    return F.call_function("format_number", x, F.lit("0.00"))


def gate_verdict(text_ok: Column, is_ood: Column) -> Column:
    """Both halves; a vector half that did not run is skipped, not passed."""
    return text_ok & ~F.coalesce(is_ood, F.lit(False))


def run_gate(df: DataFrame, text: str = "text", vector: str | None = None, manifold=None, **limits) -> DataFrame:
    """Text checks and, with a manifold, the vector score; adds ``gate_ok``."""
    checked = text_checks(df, text, **limits)
    if manifold is None or vector is None:
        checked = checked.withColumns(
            {
                "ood_dist": F.lit(None).cast("double"),
                "ood_prob": F.lit(None).cast("double"),
                "is_ood": F.lit(None).cast("boolean"),
            }
        )
    else:
        checked = manifold.score(checked, vector)
    return checked.withColumn("gate_ok", gate_verdict(F.col("text_ok"), F.col("is_ood")))
