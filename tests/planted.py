"""Small planted frames whose statistics are worked out by hand in the tests."""

LAYER = "hidden_states.causal_decoder.layer_"
EMBED = "embeddings.model.embed_tokens"
SCOPE = {"layers": (0, 1, 2), "passes": (2, 3)}
SIGNAL_SCHEMA = (
    "request_id string, signal_type string, forward_pass_index string, std double, mean double, "
    "norm double, sparsity double, saturation double, time timestamp, id long, deleted_at timestamp"
)


def signals(spark, grids):
    """``{request: {pass: [std of layer 0, 1, ...]}}`` as signal rows."""
    rows = []
    for request, passes in grids.items():
        for number, values in passes.items():
            for k, v in enumerate(values):
                rows.append(signal(request, f"{LAYER}{k}", number, v, len(rows)))
    return spark.createDataFrame(rows, SIGNAL_SCHEMA)


def signal(request, name, number, std, order=0):
    return (request, name, str(number), std, 0.0, 1.0, 0.0, 0.0, None, order, None)


RAMP, STEEP = [1.0, 2.0, 3.0], [3.0, 4.0, 5.0]
TRAINING = {"a": {2: RAMP, 3: RAMP}, "b": {2: STEEP, 3: STEEP}}
LIVE = {
    "ramp": {2: RAMP, 3: RAMP},
    "flat": {2: [2.0] * 3, 3: [2.0] * 3},
    "short": {2: RAMP},
}
