"""Signal names, layers and pass numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    EMBED_LAYER,
    EMBED_SIGNAL,
    LAYER_SIGNAL_PREFIX,
    N_LAYERS,
    UNKNOWN_LAYER,
)

_LAYER_NAME = "^" + LAYER_SIGNAL_PREFIX.replace(".", r"\.") + r"([0-9]+)\z"


def layer_of(signal: Column) -> Column:
    """Layer number of a signal name, -1 for the embedding, NULL for anything else."""
    number = F.regexp_extract(signal, _LAYER_NAME, 1).try_cast("int")
    return F.when(signal == EMBED_SIGNAL, F.lit(EMBED_LAYER)).otherwise(number)


def layer_of_strict(signal: Column) -> Column:
    """As :func:`layer_of`, but an unknown name fails the job."""
    return F.coalesce(
        layer_of(signal),
        F.raise_error(F.concat(F.lit("not a layer signal: "), F.coalesce(signal, F.lit("NULL")))).cast(
            "int"
        ),
    )


def layer_or_unknown(signal: Column) -> Column:
    return F.coalesce(layer_of(signal), F.lit(UNKNOWN_LAYER))


def layer_signal(layer: Column) -> Column:
    return F.concat(F.lit(LAYER_SIGNAL_PREFIX), layer.cast("string"))


def layer_signal_names(n_layers: int = N_LAYERS) -> list[str]:
    return [f"{LAYER_SIGNAL_PREFIX}{k}" for k in range(n_layers)]


def pass_number(text: Column) -> Column:
    """Pass text as a number ('10' is after '8'); text that is no number is NULL."""
    return text.try_cast("int")


def is_pass_text(text: Column) -> Column:
    """Digits only, the stricter form the vector reader asks for."""
    return text.rlike(r"^[0-9]+\z")


def position_rule(signal: Column) -> Column:
    """How the positions of a signal collapse into one vector."""
    return F.when(signal == EMBED_SIGNAL, F.lit("mean")).otherwise(F.lit("first"))
