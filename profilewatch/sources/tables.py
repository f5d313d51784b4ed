"""Signal rows, payloads, captures and packs derived from the generic test tables.

The tables hold no telemetry; each function maps whole tables onto the column
contracts, so that every job can run on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EMBED_SIGNAL, LAYER_SIGNAL_PREFIX, REFERENCE_SIGNAL
from ..functions.signals import layer_signal

WINDOW = ("1995-03-01 00:00:00+00", "2000-03-01 00:00:00+00")
LAYERS = (0, 1, 2)
PASSES = (2, 3, 4, 5, 6, 7)
DENSE_LAYERS = (0, 1, 2, 3, 4, 5, 6)
STREAM_EVERY = "1 day"
STREAM_DELAY = "1 hour"
#: Leaves out a layer and the prefill pass of the stream.
STREAM_LAYERS = (0, 1, 2, 3)
STREAM_PASSES = (2, 3, 4, 5, 6, 7, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_signals(line: DataFrame, request: Column, layer: Column) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return line.select(
        request.cast("string").alias("request_id"),
        layer_signal(layer).alias("signal_type"),
        F.col("l_linenumber").cast("string").alias("forward_pass_index"),
        F.sqrt("l_extendedprice").alias("std"),
        F.col("l_discount").alias("mean"),
        F.col("l_quantity").alias("norm"),
        F.col("l_tax").alias("sparsity"),
        F.col("l_discount").alias("saturation"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        (F.col("l_partkey") * 100_000_000 + cents).alias("id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("timestamp")).alias("deleted_at"),
    )


def sparse_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few cells per request (an order), double writes, soft deletes."""
    return _line_signals(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_suppkey") % 3)


#: What the first of two polls of the growing table sees: lines up to this day without the late ones.
POLLED_UNTIL = "1996-06-01 00:00:00+00"
LATE_BY_DAYS = 20


def growing_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sparse signals as they stood on a day, and as they stand now.

    Of the last days before it every third row had not arrived yet.
    """
    rows = sparse_signals(spark, sf_dir)
    until = F.lit(POLLED_UNTIL).cast("timestamp")
    late = (F.col("time") > until - F.make_dt_interval(days=F.lit(LATE_BY_DAYS))) & (F.col("id") % 3 == 0)
    return rows.filter((F.col("time") <= until) & ~late), rows


def dense_signals(spark: SparkSession, sf_dir: str, n_layers: int = len(DENSE_LAYERS)) -> DataFrame:
    """Complete grids: a request is a supplier, every cell is written many times."""
    return _line_signals(
        table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_partkey") % n_layers
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        ordered.alias("timestamp"),
        F.col("o_orderstatus").alias("model_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", ordered).alias("deleted_at"),
        F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("text")).alias("raw"))).alias("payload"),
    )


def chat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per turn: chat shape for users, plain text for assistants, none else."""
    turn = table(spark, sf_dir, "conversations")
    system = F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content"))
    asked = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    chat = F.to_json(F.struct(F.struct(F.array(system, asked).alias("messages")).alias("raw")))
    plain = F.to_json(F.struct(F.struct("text", F.array(system).alias("messages")).alias("raw")))
    return turn.select(
        turn_id().alias("request_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") % 100 * 60 + F.col("turn")).alias("timestamp"),
        F.col("role").alias("model_id"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.when(F.col("role") == "user", chat)
        .when(F.col("role") == "assistant", plain)
        .otherwise(F.lit('{"raw":{}}'))
        .alias("payload"),
    )


def turn_id() -> Column:
    return (F.col("conv_id") * 8 + F.col("turn")).cast("string")


def vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference-signal vectors: eight passes per request; the first pass is the prefill."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).cast("string").alias("request_id"),
        F.lit(REFERENCE_SIGNAL).alias("signal_type"),
        (F.col("vec_id") % 8 + 1).cast("string").alias("forward_pass_index"),
        F.col("embedding").alias("embedding_vector"),
        F.col("vec_id").alias("id"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def vector_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per vector request, in one of fifty minutes by its id."""
    number = F.floor(F.col("vec_id") / 8)
    return table(spark, sf_dir, "embeddings").select(
        number.cast("string").alias("request_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + number % 50 * 60).alias("timestamp"),
        F.lit("model").alias("model_id"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit("{}").alias("payload"),
    )


#: Leaves out the first two and the last eight of the fifty minutes, at any size.
VECTOR_WINDOW = ("2023-11-14 22:15:20+00", "2023-11-14 22:55:20+00")
#: Leaves out the first five and the last ten of the hundred minutes of conversations.
CHAT_WINDOW = ("2023-11-14 22:18:20+00", "2023-11-14 23:43:20+00")


def half_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as the two means of its halves: a manifold with a closed form."""
    emb = table(spark, sf_dir, "embeddings")
    n = F.floor(F.size("embedding") / 2).cast("int")

    def mean(part):
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(part)

    first = F.slice("embedding", F.lit(1), n)
    second = F.slice("embedding", n + 1, n)
    return emb.select(
        F.col("vec_id").cast("string").alias("request_id"),
        F.array(mean(first), mean(second)).alias("vector"),
    )


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as positions of a pass: the embedding signal on pass 1, a layer after."""
    vec = F.col("vec_id")
    number = F.floor(vec / 4) % 10 + 1
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 40).cast("string").alias("request_id"),
        F.when(number % 2 == 1, F.lit(EMBED_SIGNAL))
        .otherwise(F.lit(LAYER_SIGNAL_PREFIX + "0"))
        .alias("signal_type"),
        number.cast("string").alias("forward_pass_index"),
        (vec % 4).cast("int").alias("position"),
        F.transform("embedding", lambda x: x * 8).alias("vector"),
    )


def captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two captures of the same orders.

    The second lacks the lines of flag 'A' with status 'F', the first those of
    flag 'N' with status 'O'. Tokens (layer 0 renamed to the embedding) differ
    where the tax is 0.08, other values drift by the discount.
    """
    line = table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    is_token = F.col("l_suppkey") % 3 == 0

    def shaped(rows):
        base = _line_signals(rows, F.col("l_orderkey"), F.col("l_suppkey") % 3)
        name = F.when(F.col("signal_type") == LAYER_SIGNAL_PREFIX + "0", F.lit(EMBED_SIGNAL)).otherwise(
            F.col("signal_type")
        )
        return base.withColumn("signal_type", name).drop("time", "deleted_at")

    price = F.col("l_extendedprice")
    drifted = F.when(
        is_token, F.when(F.col("l_tax") == 0.08, price * 1.21).otherwise(price)
    ).otherwise(price * (1 + F.col("l_discount") / 4))
    local = shaped(line.filter(~((flag == "N") & (status == "O"))))
    platform_lines = line.filter(~((flag == "A") & (status == "F")))
    platform = shaped(platform_lines.withColumn("l_extendedprice", drifted))
    return local, platform


def answer_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies in the shapes services use, the turn's text inside."""
    text = F.col("text")

    def obj(**fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    shapes = [
        F.to_json(obj(generated_text=text)),
        F.to_json(obj(id=F.lit(7), response=obj(output=obj(text=text)))),
        F.to_json(obj(choices=F.array(obj(message=obj(content=text))))),
        F.to_json(F.array(obj(completion=text))),
        F.to_json(obj(text=F.lit(5), result=text)),
        F.concat(F.lit("plain: "), text),
        F.to_json(obj(message=obj(content=text))),
        F.to_json(obj(k=F.lit(1))),
    ]
    pick = F.col("turn") % len(shapes)
    body = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        body = F.when(pick == i, shape).otherwise(body)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of cells."""
    schema = table(spark, sf_dir, "events").schema
    # a glob, because the file source takes folders
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    kinds = ["view", "click", "signup", "purchase", "error"]
    layer = F.lit(None).cast("int")
    for i, kind in enumerate(kinds):
        layer = F.when(F.col("event_type") == kind, F.lit(i)).otherwise(layer)
    return raw.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("user_id").cast("string").alias("request_id"),
        layer.alias("layer"),
        (F.floor(F.hour("ts") / 3) + 1).cast("int").alias("pass"),
        # some cells are missing, some are no number
        F.when(F.col("event_id") % 17 == 0, F.lit(None))
        .when(F.col("event_id") % 13 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
        F.col("event_id").alias("id"),
    )
