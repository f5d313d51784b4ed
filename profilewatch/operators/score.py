"""Score a batch of captured requests: metric, text and vector side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FLAT_Z_CV_MAX, METRIC_LAYERS, METRIC_PASSES, MIN_PASSES, OOD_PROB_MAX
from ..schemas import SCORES, conform
from .band import Band
from .profile import STATISTICS, is_flattened, request_statistics
from .textgate import text_checks


def score_batch(
    requests: DataFrame,
    cells: DataFrame,
    band: Band,
    vectors: DataFrame | None = None,
    manifold=None,
    *,
    z_cv_max: float = FLAT_Z_CV_MAX,
    ood_prob_max: float = OOD_PROB_MAX,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
    min_passes: int = MIN_PASSES,
) -> DataFrame:
    """One row per request in the ordered score contract.

    ``requests``: ``prompt_id, prompt, generated_text, n_prompt_tokens,
    n_generated_tokens``. A request with too few passes keeps its row with an
    ``error``, NULL metrics and no gate. All joins are one to one on the request.
    """
    stats = request_statistics(cells, band, layers=layers, passes=passes, min_passes=min_passes)
    joined = requests.join(
        stats.select(F.col("request_id").alias("prompt_id"), "n_passes_used", *STATISTICS),
        "prompt_id",
        "left",
    )
    used = F.coalesce("n_passes_used", F.lit(0))
    joined = joined.withColumn("_enough", used >= min_passes)
    if manifold is not None and vectors is not None:
        found = vectors.select(F.col("request_id").alias("prompt_id"), "vector")
        joined = joined.join(found, "prompt_id", "left")
        joined = joined.withColumn("vector", F.when(F.col("_enough"), F.col("vector")))
        joined = manifold.score(joined, ood_prob_max=ood_prob_max).drop("vector")
    gated = text_checks(
        joined.withColumn("_text", F.when(F.col("_enough"), F.col("generated_text"))), "_text"
    )
    error = F.when(F.col("_enough"), F.lit("")).otherwise(
        F.format_string(
            f"no profile: Need at least {min_passes} passes with data, got %d", used
        )
    )
    return conform(
        gated.withColumns(
            {
                "n_chars": F.length("prompt"),
                "n_passes_used": F.when(F.col("_enough"), F.col("n_passes_used")),
                "flag": is_flattened(F.col("z_cv"), z_cv_max),
                "error": error,
            }
        ),
        SCORES,
    )
