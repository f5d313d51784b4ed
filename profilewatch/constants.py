"""Names, scopes and thresholds the results depend on."""

# Fixed values -- signal naming.
EMBED_SIGNAL = "embeddings.model.embed_tokens"
LAYER_SIGNAL_PREFIX = "hidden_states.causal_decoder.layer_"
REFERENCE_SIGNAL = "hidden_states.causal_decoder.layer_14"
EMBED_LAYER = -1
UNKNOWN_LAYER = -99

# Fixed values -- the five stored scalars of one activation vector.
SCALARS = ["std", "mean", "norm", "sparsity", "saturation"]
CELL_KEYS = ["request_id", "signal_type", "forward_pass_index"]

# Fixed values -- model shape and metric scope.
N_LAYERS = 24
KEEP_DIMS = 768
MAX_PASSES = 8
METRIC_LAYERS = tuple(range(0, 23))
METRIC_PASSES = tuple(range(2, 9))
MIN_PASSES = 2
FLAT_Z_CV_MAX = -2.0
SATURATION_ABOVE = 0.95

# Fixed values -- output gate.
OOD_PROB_MAX = 0.99
TEXT_MIN_CHARS = 40
TEXT_MAX_CHARS = 4000
TEXT_MAX_CHAR_REPEAT = 12
TEXT_MIN_DISTINCT_WORD_RATIO = 0.25
TEXT_MAX_TOP_WORD_SHARE = 0.35

# Fixed values -- out-of-distribution manifold.
MANIFOLD_PCA_K = 32
MANIFOLD_SHRINKAGE = 0.1
MANIFOLD_SMALL_SAMPLE_SHRINKAGE = 0.3
MANIFOLD_QUANTILE = 0.99

# Fixed values -- comparison of two captures.
COMPARE_PASSES = tuple(range(1, 7))
COMPARE_ATOL = 5e-3
COMPARE_RTOL = 1e-2
TOKEN_MATCH_TOL = 1e-6
RELATIVE_FLOOR = 1e-12

# Fixed values -- panel histogram, capture window padding, band range, pack size.
SCORE_BANDS = 10
WINDOW_PAD_SECONDS = 120
BAND_RANGE_SDS = 3.0
PACK_SIZE = 5

# Fixed values -- keys under which generation services put their answer, in the
# order they are tried.
ANSWER_KEYS = ["generated_text", "text", "response", "output", "completion", "result"]

# Fixed values -- every character a Unicode-aware strip() treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_PATTERN = "[A-Za-z0-9']+"

#: The wording of failed text checks, as reports and score tables carry it.
TEXT_REASONS = {
    "too_short": "too short: %d < {limit} chars",
    "too_long": "too long: %d > {limit} chars",
    "char_repeat": "character repeated %d times in a row",
    "few_words": "only %s distinct-word ratio",
    "top_word": "top word is %s of all words",
    "no_words": "no words found",
}
