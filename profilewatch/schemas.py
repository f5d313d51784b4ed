"""Column contracts of the tables that enter and leave the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import SCALARS

#: Scalar rows. The pass number is stored as text and stays text until
#: ``operators.cells`` casts it once.
SIGNALS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("signal_type", T.StringType()),
        T.StructField("forward_pass_index", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in SCALARS],
        T.StructField("time", T.TimestampType()),
    ]
)

#: What only a locally made capture knows; dropped before any comparison.
CAPTURED_ROWS = T.StructType(
    [
        *SIGNALS.fields[:-1],
        T.StructField("n_positions", T.LongType()),
        T.StructField("dim", T.LongType()),
    ]
)

PROMPT_DOCUMENT = T.StructType(
    [
        T.StructField(
            "raw",
            T.StructType(
                [
                    T.StructField("text", T.StringType()),
                    T.StructField(
                        "messages",
                        T.ArrayType(T.StructType([T.StructField("content", T.StringType())])),
                    ),
                ]
            ),
        )
    ]
)

SCORES = T.StructType(
    [
        T.StructField("prompt_id", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_prompt_tokens", T.LongType()),
        T.StructField("n_generated_tokens", T.LongType()),
        T.StructField("cv", T.DoubleType()),
        T.StructField("slope", T.DoubleType()),
        T.StructField("corr", T.DoubleType()),
        T.StructField("z_cv", T.DoubleType()),
        T.StructField("z_slope", T.DoubleType()),
        T.StructField("max_abs_z_layer", T.DoubleType()),
        T.StructField("cv_pass_slope", T.DoubleType()),
        T.StructField("n_passes_used", T.LongType()),
        T.StructField("ood_dist", T.DoubleType()),
        T.StructField("ood_prob", T.DoubleType()),
        T.StructField("is_ood", T.BooleanType()),
        T.StructField("text_ok", T.BooleanType()),
        T.StructField("text_reasons", T.StringType()),
        T.StructField("flag", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("generated_text", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a contract: its columns, order and types; absent ones are NULL.

    A value that does not fit its type fails the job; it is not turned into NULL.
    """
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in schema.fields
        ]
    )
