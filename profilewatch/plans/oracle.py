"""The same results as plain SQL over the test tables, for DuckDB."""

from __future__ import annotations

from ..constants import WHITESPACE

_LAYER = "hidden_states.causal_decoder.layer_"
_EMBED = "embeddings.model.embed_tokens"
_REFERENCE = _LAYER + "14"
_WINDOW = "o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '2000-03-01'"
_BLANKS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_BLANK_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]+"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# ------------------------------------------------------------------ building blocks

_SIGNAL = f"""
  sqrt(l_extendedprice) AS std, l_discount AS mean, l_quantity AS norm, l_tax AS sparsity,
  l_discount AS saturation, l_shipdate AS "time", CAST(l_linenumber AS VARCHAR) AS forward_pass_index,
  l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_returnflag = 'R' AS deleted
"""

SPARSE = f"""sparse AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS request_id, '{_LAYER}' || (l_suppkey % 3) AS signal_type,
    CAST(l_suppkey % 3 AS BIGINT) AS layer, CAST(l_linenumber AS BIGINT) AS pass, {_SIGNAL} FROM lineitem)"""


def dense(n: int, name: str = "dense") -> str:
    return f"""{name} AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS request_id, CAST(l_partkey % {n} AS BIGINT) AS layer,
    CAST(l_linenumber AS BIGINT) AS pass, {_SIGNAL} FROM lineitem)"""


PAYLOADS = f"""live AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_orderstatus AS model_id FROM orders
  WHERE {_WINDOW} AND o_orderpriority <> '5-LOW')"""


def cells(name: str, source: str) -> str:
    """One value per cell in passes 2..7; a request outside the scope keeps a marker."""
    return f"""{name} AS (
  SELECT request_id, CASE WHEN pass BETWEEN 2 AND 7 THEN layer END AS layer,
    CASE WHEN pass BETWEEN 2 AND 7 THEN pass END AS pass,
    arg_min(CASE WHEN pass BETWEEN 2 AND 7 THEN std END, id) AS value
  FROM {source} GROUP BY ALL)"""


def cv(x: str) -> str:
    return f"CASE WHEN avg({x}) <> 0 THEN stddev_pop({x}) / abs(avg({x})) ELSE 0 END"


def slope(y: str, x: str) -> str:
    return f"CASE WHEN var_pop({x}) > 0 THEN covar_pop({y}, {x}) / var_pop({x}) ELSE 0 END"


def statistics(name: str, source: str) -> str:
    """<name>_v (request, layer, v), <name>_p (request, pass, cv), <name> (request, ...)."""
    return f"""{name}_v AS (
  SELECT request_id, layer, avg(value) AS v FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
{name}_p AS (
  SELECT request_id, pass, {cv('value')} AS cv FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
{name}_u AS (
  SELECT request_id, count(DISTINCT pass) FILTER (value IS NOT NULL) AS n_passes_used,
    count(*) FILTER (layer IS NOT NULL) AS n_cells FROM {source} GROUP BY ALL),
{name}_l AS (SELECT request_id, {cv('v')} AS cv, {slope('v', 'layer')} AS slope FROM {name}_v GROUP BY ALL),
{name}_t AS (SELECT request_id, {slope('cv', 'pass')} AS cv_pass_slope FROM {name}_p GROUP BY ALL),
{name} AS (
  SELECT u.request_id, n_passes_used, n_cells,
    CASE WHEN n_passes_used >= 2 THEN cv END AS cv, CASE WHEN n_passes_used >= 2 THEN slope END AS slope,
    CASE WHEN n_passes_used >= 2 THEN cv_pass_slope END AS cv_pass_slope
  FROM {name}_u u LEFT JOIN {name}_l USING (request_id) LEFT JOIN {name}_t USING (request_id))"""


def band(name: str, stats: str, n_layers: int, version: str = "v1") -> str:
    """<name> one row, <name>_layer one row per layer; fitted on complete requests."""
    complete = f"n_cells = {n_layers * 6}"
    return f"""{name} AS (
  SELECT avg(cv) AS cv_mean, stddev_samp(cv) AS cv_sd, avg(slope) AS slope_mean,
    stddev_samp(slope) AS slope_sd, count(*) AS n_requests, '{version}' AS version
  FROM {stats} WHERE {complete}),
{name}_layer AS (
  SELECT layer, avg(v) AS profile_mean, stddev_samp(v) AS profile_sd
  FROM {stats}_v JOIN {stats}_u USING (request_id) WHERE {complete} GROUP BY layer)"""


WINDOW_CELLS = ",\n".join(
    [
        SPARSE,
        PAYLOADS,
        """in_window AS (
  SELECT * FROM sparse WHERE NOT deleted AND pass BETWEEN 2 AND 7
    AND request_id IN (SELECT request_id FROM live))""",
        cells("cells", "in_window"),
    ]
)
BAND3 = ",\n".join(
    [dense(3, "dense3"), cells("dense3_cells", "dense3"), statistics("fit", "dense3_cells"), band("band", "fit", 3)]
)
BAND7 = ",\n".join(
    [dense(7), cells("dense_cells", "dense"), statistics("fit", "dense_cells"), band("band", "fit", 7)]
)


def scored(stats: str, name: str = "scored") -> str:
    z_l = "CASE WHEN profile_sd > 0 THEN (v - profile_mean) / profile_sd ELSE 0 END"
    return f"""{name}_shape AS (
  SELECT request_id,
    CASE WHEN stddev_pop(v) > 0 AND stddev_pop(profile_mean) > 0
      THEN covar_pop(v, profile_mean) / (stddev_pop(v) * stddev_pop(profile_mean)) ELSE 0 END AS corr,
    max(abs({z_l})) AS max_abs_z_layer
  FROM {stats}_v JOIN band_layer USING (layer) GROUP BY ALL),
{name} AS (
  SELECT s.*, CASE WHEN n_passes_used >= 2 THEN corr END AS corr,
    CASE WHEN n_passes_used >= 2 THEN max_abs_z_layer END AS max_abs_z_layer,
    CASE WHEN cv_sd > 0 THEN (cv - cv_mean) / cv_sd ELSE 0 * cv END AS z_cv,
    CASE WHEN slope_sd > 0 THEN (slope - slope_mean) / slope_sd ELSE 0 * slope END AS z_slope
  FROM {stats} s CROSS JOIN band LEFT JOIN {name}_shape USING (request_id))"""


PANEL = ",\n".join([WINDOW_CELLS, BAND3, statistics("live_stats", "cells"), scored("live_stats")])

HALVES = """halves AS (
  SELECT vec_id, list_avg(CAST(embedding[1:len(embedding) // 2] AS DOUBLE[])) AS a,
    list_avg(CAST(embedding[len(embedding) // 2 + 1:] AS DOUBLE[])) AS b FROM embeddings),
moments AS (
  SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab FROM halves),
shrunk AS (
  SELECT ma, mb, 0.9 * va + 0.1 * (va + vb) / 2 AS p, 0.9 * vb + 0.1 * (va + vb) / 2 AS q, 0.9 * cab AS r
  FROM moments),
inverse AS (
  SELECT ma, mb, q / (p * q - r * r) AS iaa, p / (p * q - r * r) AS ibb, -r / (p * q - r * r) AS iab FROM shrunk)"""


def manifold(cross: str) -> str:
    return f"""{HALVES},
dist AS (
  SELECT vec_id, sqrt(greatest((a - ma) * (a - ma) * iaa + (b - mb) * (b - mb) * ibb
    + {cross} * (a - ma) * (b - mb) * iab, 0)) AS d FROM halves CROSS JOIN inverse),
limit_at AS (SELECT quantile_cont(d, 0.99) AS threshold FROM dist),
ood AS (
  SELECT CAST(vec_id AS VARCHAR) AS request_id, d AS ood_dist, 1 - exp(-d * d / 2) AS ood_prob,
    d > threshold OR 1 - exp(-d * d / 2) > 0.99 AS is_ood, threshold FROM dist CROSS JOIN limit_at)"""


#: One axis of the 2 x 2 covariance in closed form; probability by the series of the error function.
REDUCED = f"""{HALVES},
axis AS (SELECT *, (va + vb + sqrt((va - vb) * (va - vb) + 4 * cab * cab)) / 2 AS l FROM moments),
dist AS (
  SELECT vec_id, abs((a - ma) * cab + (b - mb) * (l - va)) / sqrt(cab * cab + (l - va) * (l - va)) / sqrt(l) AS d
  FROM halves CROSS JOIN axis),
limit_at AS (SELECT quantile_cont(d, 0.99) AS threshold FROM dist),
probable AS (
  SELECT vec_id, d, threshold, CASE WHEN d * d / 2 > 40 THEN 1.0 ELSE 2 / sqrt(pi()) * d / sqrt(2) * exp(-d * d / 2)
    * list_sum(list_transform(range(0, 221), lambda n: exp(n * ln(greatest(d * d, 1e-300))
      - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1)))) END AS p
  FROM dist CROSS JOIN limit_at)"""

#: Principal axes of 64 dimensions by Jacobi rotations: in each step 32 disjoint pairs, paired as in a
#: tournament of 63 rounds, ten times over. The sixteen strongest axes span the reduced space.
_PARTNERS = """list_transform(range(0, 64), lambda i: 1 + CASE WHEN i = 63 THEN step * 32 % 63
    WHEN ((step - i) % 63 + 63) % 63 = i THEN 63 ELSE ((step - i) % 63 + 63) % 63 END)"""
_TANGENTS = """list_transform(range(1, 65), lambda i: CASE WHEN abs(off[i]) < 1e-300 THEN 0.0 ELSE
    (CASE WHEN dp[i] > d[i] OR (dp[i] = d[i] AND i < p[i]) THEN sign(off[i]) ELSE -sign(off[i]) END)
    / (abs((dp[i] - d[i]) / (2 * off[i])) + sqrt(pow((dp[i] - d[i]) / (2 * off[i]), 2) + 1)) END)"""


def _turned(rows: str) -> str:
    """Columns rotated with their partners."""
    return f"""list_transform({rows}, lambda r: list_transform(list_zip(r, list_select(r, p), co, si),
    lambda y: y[1] * y[3] + y[2] * y[4]))"""


PRINCIPAL = f"""picked AS (
  SELECT vec_id // 8 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id % 8 + 1 >= 2 AND vec_id // 8 % 50 >= 2 AND vec_id // 8 % 50 < 42
  QUALIFY row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id % 8 DESC, vec_id) = 1),
long AS (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM picked),
means AS (SELECT i, avg(x) AS m FROM long GROUP BY i),
centred AS (SELECT r, i, x - m AS x FROM long JOIN means USING (i)),
covariance AS (
  SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM picked) - 1) AS c
  FROM centred a JOIN centred b USING (r) GROUP BY ALL),
matrix AS (SELECT i, list(c ORDER BY j) AS row FROM covariance GROUP BY i),
jacobi(step, a, v) AS (
  SELECT 0, list(row ORDER BY i), list_transform(range(1, 65), lambda i:
    list_transform(range(1, 65), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) FROM matrix
  UNION ALL
  SELECT step + 1, {_turned("list_transform(list_zip(a, list_select(a, p), co, si), lambda z: list_transform(list_zip(z[1], z[2]), lambda y: z[3] * y[1] + z[4] * y[2]))")},
    {_turned("v")}
  FROM (SELECT *, list_transform(tn, lambda t: 1 / sqrt(t * t + 1)) AS co,
      list_transform(tn, lambda t: -t / sqrt(t * t + 1)) AS si
    FROM (SELECT *, {_TANGENTS} AS tn
      FROM (SELECT *, list_select(d, p) AS dp
        FROM (SELECT *, list_transform(range(1, 65), lambda i: a[i][i]) AS d, list_transform(range(1, 65), lambda i: a[i][p[i]]) AS off
          FROM (SELECT *, {_PARTNERS} AS p FROM jacobi WHERE step < 630)))))),
axes AS (
  SELECT k, a[k][k] AS strength, list_transform(v, lambda r: r[k]) AS axis
  FROM jacobi CROSS JOIN (SELECT unnest(range(1, 65)) AS k) WHERE step = 630
  QUALIFY row_number() OVER (ORDER BY a[k][k] DESC) <= 16),
scaled AS (SELECT k, axis, 0.9 * strength + 0.1 * avg(strength) OVER () AS spread FROM axes),
middle AS (SELECT list(m ORDER BY i) AS m FROM means),
dist AS (
  SELECT vec_id, sqrt(sum(pow(list_dot_product(axis, list_transform(list_zip(CAST(embedding AS DOUBLE[]), m), lambda y: y[1] - y[2])), 2) / spread)) AS d
  FROM embeddings CROSS JOIN middle CROSS JOIN scaled GROUP BY vec_id),
trained AS (
  SELECT quantile_cont(d, 0.99) AS threshold FROM dist WHERE vec_id IN (
    SELECT vec_id FROM embeddings WHERE vec_id % 8 + 1 >= 2 AND vec_id // 8 % 50 >= 2 AND vec_id // 8 % 50 < 42
    QUALIFY row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id % 8 DESC, vec_id) = 1)),
probable AS (
  SELECT vec_id, d, threshold, 1 - exp(-d * d / 2) * list_sum(list_transform(range(0, 8), lambda j: pow(d * d / 2, j) / gamma(j + 1))) AS p
  FROM dist CROSS JOIN trained)"""

#: Four training vectors: 0.3 of the mean eigenvalue instead of 0.1.
SMALL = f"""{HALVES},
few AS (
  SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab
  FROM halves WHERE vec_id < 4),
mixed AS (
  SELECT ma, mb, 0.7 * va + 0.15 * (va + vb) AS p, 0.7 * vb + 0.15 * (va + vb) AS q, 0.7 * cab AS r FROM few),
dist AS (
  SELECT vec_id, sqrt(((a - ma) * (a - ma) * q + (b - mb) * (b - mb) * p - 2 * (a - ma) * (b - mb) * r)
    / (p * q - r * r)) AS d FROM halves CROSS JOIN mixed),
limit_at AS (SELECT quantile_cont(d, 0.99) AS threshold FROM dist WHERE vec_id < 4)"""


def _files(text: str = "text") -> str:
    """One file per language: a line per document, in id order."""
    return f"""contents AS (
  SELECT lang, string_agg(doc_id || ' ' || md5(coalesce({text}, '')), chr(10) ORDER BY doc_id) || chr(10) AS body
  FROM documents WHERE lang IS NOT NULL GROUP BY lang),
files AS (SELECT lang, sha256(body) AS sha256, strlen(body)::BIGINT AS bytes FROM contents)"""


def text_measures(source: str, key: str) -> str:
    """Whole texts, character by character and word by word."""
    return f"""stripped AS (SELECT {key} AS k, trim(text, {_BLANKS}) AS t FROM {source}),
chars AS (
  SELECT k, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) AS i
  FROM stripped),
marked AS (
  SELECT k, i, CASE WHEN c = lag(c) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END AS starts FROM chars),
runs AS (
  SELECT k, run, count(*) AS n FROM (
    SELECT k, sum(starts) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked)
  GROUP BY ALL),
longest AS (SELECT k, max(n) AS char_run FROM runs GROUP BY k),
tokens AS (SELECT k, lower(unnest(regexp_extract_all(t, '[A-Za-z0-9'']+'))) AS w FROM stripped),
word_n AS (SELECT k, w, count(*) AS n FROM tokens GROUP BY ALL),
word_stats AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_distinct_words, max(n) AS top_word_count
  FROM word_n GROUP BY k),
measures AS (
  SELECT s.k, length(t) AS stripped_chars, coalesce(char_run, 0) AS char_run, coalesce(n_words, 0) AS n_words,
    coalesce(n_distinct_words, 0) AS n_distinct_words, coalesce(top_word_count, 0) AS top_word_count,
    n_distinct_words / n_words AS distinct_ratio, top_word_count / n_words AS top_share
  FROM stripped s LEFT JOIN longest USING (k) LEFT JOIN word_stats USING (k)),
checked AS (
  SELECT *, concat_ws(';',
    CASE WHEN stripped_chars < 40 THEN 'too_short' END, CASE WHEN stripped_chars > 4000 THEN 'too_long' END,
    CASE WHEN char_run > 12 THEN 'char_run' END, CASE WHEN distinct_ratio < 0.25 THEN 'few_distinct' END,
    CASE WHEN top_share > 0.35 THEN 'top_word' END,
    CASE WHEN n_words = 0 AND stripped_chars > 0 THEN 'no_words' END) AS reason_codes
  FROM measures)"""


_CAPTURE_ORDER = "l_partkey * 100000000 + CAST(round(price * 100) AS BIGINT)"
_CAPTURE_VALUES = {"std": "sqrt(price)", "mean": "l_discount", "norm": "l_quantity", "sparsity": "l_tax", "saturation": "l_discount"}


def _capture(name: str, rows: str, price: str, pick: str = "arg_min") -> str:
    return f"""{name}_raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS request_id,
    CASE WHEN l_suppkey % 3 = 0 THEN '{_EMBED}' ELSE '{_LAYER}' || (l_suppkey % 3) END AS signal_type,
    CAST(l_linenumber AS VARCHAR) AS forward_pass_index, {price} AS price, l_discount, l_quantity, l_tax,
    l_partkey FROM lineitem WHERE NOT ({rows})),
{name} AS (
  SELECT request_id, signal_type, forward_pass_index,
    {', '.join(f'{pick}({v}, {_CAPTURE_ORDER}) AS {c}' for c, v in _CAPTURE_VALUES.items())}
  FROM {name}_raw GROUP BY ALL)"""


_DRIFT = """CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN l_tax = 0.08 THEN l_extendedprice * 1.21
  ELSE l_extendedprice END ELSE l_extendedprice * (1 + l_discount / 4) END"""


def captures(pick: str = "arg_min") -> str:
    return ",\n".join(
        [
            _capture("mine", "l_returnflag = 'N' AND l_linestatus = 'O'", "l_extendedprice", pick),
            _capture("theirs", "l_returnflag = 'A' AND l_linestatus = 'F'", _DRIFT, pick),
        ]
    )


CAPTURES = captures()
_SCALARS = ["std", "mean", "norm", "sparsity", "saturation"]


def diff(passes: str, pick: str = "arg_min") -> str:
    values = ", ".join(f"m.{c} AS {c}_local, t.{c} AS {c}_platform, m.{c} - t.{c} AS d_{c}" for c in _SCALARS)
    return f"""{captures(pick)},
pairs AS (
  SELECT request_id, signal_type, forward_pass_index, CAST(forward_pass_index AS BIGINT) AS pass, {values},
    m.std IS NOT NULL AND t.std IS NOT NULL AS captured,
    CASE WHEN t.std IS NULL THEN 'local_only' WHEN m.std IS NULL THEN 'platform_only' ELSE 'both' END AS side
  FROM mine m FULL JOIN theirs t USING (request_id, signal_type, forward_pass_index)
  WHERE CAST(forward_pass_index AS BIGINT) IN ({passes})),
prints AS (
  SELECT request_id, pass, coalesce(abs(d_std) < 1e-6, false) AS same FROM pairs WHERE signal_type = '{_EMBED}'),
printed AS (SELECT DISTINCT request_id FROM prints),
passes AS (SELECT DISTINCT request_id, pass FROM pairs),
flags AS (
  SELECT p.request_id, p.pass, coalesce(f.same, true) AS token_match,
    bool_and(coalesce(f.same, true)) OVER (PARTITION BY p.request_id ORDER BY p.pass
      ROWS UNBOUNDED PRECEDING) AS so_far,
    h.request_id IS NOT NULL AS has_fingerprint
  FROM passes p LEFT JOIN prints f USING (request_id, pass) LEFT JOIN printed h USING (request_id)),
diff AS (
  SELECT pairs.*, token_match, so_far AND captured AS comparable, has_fingerprint,
    abs(d_std) <= 0.005 + 0.01 * abs(std_platform) AS within
  FROM pairs JOIN flags USING (request_id, pass))"""


COMPARED = f"""SELECT request_id, signal_type, forward_pass_index,
  {', '.join(f'{r6(c)} AS {c}' for s in _SCALARS for c in (f'{s}_local', f'{s}_platform', f'd_{s}'))},
  captured, side, pass, token_match, comparable, has_fingerprint FROM diff"""

SUMMARY = f"""at_pass AS (
  SELECT pass, max(abs(d_std)) FILTER (comparable) AS x, count(*) FILTER (comparable) AS compared,
    count(DISTINCT request_id) FILTER (captured AND NOT comparable) AS diverged FROM diff GROUP BY pass)
SELECT count(*) FILTER (side <> 'platform_only') AS n_local_rows,
  count(*) FILTER (side <> 'local_only') AS n_platform_rows, count(*) FILTER (captured) AS n_matched,
  count(*) FILTER (side = 'local_only') AS n_local_only, count(*) FILTER (side = 'platform_only') AS n_platform_only,
  count(DISTINCT request_id) FILTER (captured) AS n_requests_captured,
  count(DISTINCT request_id) FILTER (side <> 'platform_only') AS n_requests_local,
  {r6('max(abs(d_std)) FILTER (comparable)')} AS max_abs_d_std,
  {r6('avg(abs(d_std)) FILTER (comparable)')} AS mean_abs_d_std,
  {r6('max(abs(d_std) / greatest(abs(std_platform), 1e-12)) FILTER (comparable)')} AS max_rel_d_std,
  count(*) FILTER (comparable AND NOT within) AS n_over_tol,
  count(*) FILTER (comparable) > 0 AND count(*) FILTER (comparable AND within) = count(*) FILTER (comparable)
    AS within_tol,
  min(pass) FILTER (comparable AND NOT within) AS first_divergent_pass,
  0.005::DOUBLE AS tol, 0.01::DOUBLE AS rtol, count(*) FILTER (comparable) AS n_comparable,
  count(*) FILTER (captured AND NOT comparable) AS n_decode_diverged,
  count(DISTINCT request_id) FILTER (captured AND NOT comparable) AS n_requests_decode_diverged,
  count(DISTINCT request_id) FILTER (NOT has_fingerprint) AS n_requests_without_fingerprint,
  count(*) FILTER (comparable) > 0 AND count(*) FILTER (comparable AND within) = count(*) FILTER (comparable)
    AND count(*) FILTER (side = 'platform_only') = 0 AS passed,
  string_agg(DISTINCT CAST(pass AS VARCHAR), ',' ORDER BY CAST(pass AS VARCHAR)) FILTER (comparable) AS passes,
  (SELECT string_agg(printf('%d:%.6f', pass, x), ',' ORDER BY pass) FROM at_pass WHERE compared > 0) AS max_abs_d_by_pass,
  coalesce((SELECT string_agg(pass || ':' || diverged, ',' ORDER BY pass) FROM at_pass WHERE diverged > 0), '')
    AS decode_divergence_by_pass
FROM diff"""


PAIRED = f"""{text_measures('documents', 'doc_id')},
measured AS (
  SELECT doc_id, lang AS family, source AS question, n_words % 5 + 1 AS level, lang || '/' || source AS control_id,
    distinct_ratio AS z_cv, n_words FROM documents JOIN measures ON doc_id = k WHERE distinct_ratio IS NOT NULL),
controls AS (
  SELECT control_id, min(doc_id) AS control_doc, arg_min(z_cv, doc_id) AS control_z_cv FROM measured GROUP BY ALL),
pairs AS (
  SELECT m.*, control_z_cv, z_cv - control_z_cv AS dz_cv FROM measured m JOIN controls USING (control_id)
  WHERE doc_id <> control_doc)"""


def t_test(source: str, value: str, key: str | None = None) -> str:
    """Two-sided p by the finite sums for even and odd degrees of freedom."""
    keys = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""tested AS (
  SELECT {keys}count({value}) AS n, avg({value}) AS mean,
    avg({value}) / (stddev_samp({value}) / sqrt(count({value}))) AS t FROM {source} {group}),
angles AS (SELECT *, n - 1 AS df, atan(abs(t) / sqrt(n - 1)) AS th FROM tested),
probed AS (
  SELECT {keys}n, mean, t, CASE WHEN df % 2 = 1
    THEN 1 - 2 / pi() * (th + sin(th) * coalesce(list_sum([
      exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos(th), 2 * j + 1)
      for j in range(0, (df - 1) // 2)]), 0))
    ELSE 1 - sin(th) * list_sum([
      exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(cos(th), 2 * j)
      for j in range(0, df // 2)]) END AS p
  FROM angles)"""


_EVENT_LAYER = """CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
  WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END"""
EVENTS = f"""events_in AS (
  SELECT date_trunc('day', ts) AS day, CAST(user_id AS VARCHAR) AS request_id, {_EVENT_LAYER} AS l, hour(ts) // 3 + 1 AS p,
    CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS x, event_id FROM events),
cells AS (
  SELECT day, request_id, CASE WHEN l <= 3 AND p >= 2 THEN l END AS layer, CASE WHEN l <= 3 AND p >= 2 THEN p END AS pass,
    arg_min_null(CASE WHEN l <= 3 AND p >= 2 THEN x END, event_id) AS value FROM events_in GROUP BY ALL),
closed AS (
  SELECT * FROM cells WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
prof AS (SELECT day, request_id, layer, avg(value) AS v FROM closed WHERE value IS NOT NULL GROUP BY ALL),
by_pass AS (SELECT day, request_id, pass, {cv('value')} AS c FROM closed WHERE value IS NOT NULL GROUP BY ALL),
used AS (SELECT day, request_id, count(DISTINCT pass) FILTER (value IS NOT NULL) AS n_passes_used FROM closed GROUP BY ALL),
{dense(4, "dense4")}, {cells("dense4_cells", "dense4")}, {statistics("fit", "dense4_cells")}, {band("band", "fit", 4)},
shape AS (
  SELECT day, request_id, {cv('v')} AS cv, {slope('v', 'layer')} AS slope,
    CASE WHEN stddev_pop(v) > 0 AND stddev_pop(profile_mean) > 0
      THEN covar_pop(v, profile_mean) / (stddev_pop(v) * stddev_pop(profile_mean)) ELSE 0 END AS corr,
    max(abs(CASE WHEN profile_sd > 0 THEN (v - profile_mean) / profile_sd ELSE 0 END)) AS max_abs_z_layer
  FROM prof JOIN band_layer USING (layer) GROUP BY ALL),
trend AS (SELECT day, request_id, {slope('c', 'pass')} AS cv_pass_slope FROM by_pass GROUP BY ALL),
scored AS (
  SELECT strftime(day, '%Y-%m-%d') AS window_start, request_id, n_passes_used,
    CASE WHEN n_passes_used >= 2 THEN shape.cv END AS cv,
    CASE WHEN n_passes_used >= 2 THEN (shape.cv - cv_mean) / cv_sd END AS z_cv,
    CASE WHEN n_passes_used >= 2 THEN corr END AS corr, CASE WHEN n_passes_used >= 2 THEN shape.slope END AS slope,
    CASE WHEN n_passes_used >= 2 THEN max_abs_z_layer END AS max_abs_z_layer,
    CASE WHEN n_passes_used >= 2 THEN cv_pass_slope END AS cv_pass_slope
  FROM used LEFT JOIN shape USING (day, request_id) LEFT JOIN trend USING (day, request_id) CROSS JOIN band)"""

_TURN = "CAST(conv_id * 8 + turn AS VARCHAR)"


def _vector_stats(v: str) -> str:
    return f"""{r6(f"list_aggregate({v}, 'stddev_pop')")} AS std, {r6(f'list_avg({v})')} AS mean,
    {r6(f'sqrt(list_sum([x * x for x in {v}]))')} AS norm,
    {r6(f'len([x for x in {v} if x = 0]) / len({v})')} AS sparsity,
    {r6(f'len([x for x in {v} if abs(x) > 0.95]) / len({v})')} AS saturation"""


HIDDEN = f"""hidden AS (
  SELECT CAST(vec_id // 40 AS VARCHAR) AS request_id, vec_id // 4 % 10 + 1 AS pass,
    vec_id % 4 AS position, [x * 8 for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings),
long AS (SELECT request_id, pass, position, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM hidden),
folded AS (
  SELECT request_id, pass, i, count(*) AS n_positions, avg(x) AS mean_x, arg_min(x, position) AS first_x
  FROM long GROUP BY ALL),
reduced AS (
  SELECT request_id, CASE WHEN pass % 2 = 1 THEN '{_EMBED}' ELSE '{_LAYER}0' END AS signal_type,
    CAST(pass AS VARCHAR) AS forward_pass_index, pass, n_positions, i - 1 AS dim,
    CASE WHEN pass % 2 = 1 THEN mean_x ELSE first_x END AS x FROM folded)"""

# ------------------------------------------------------------------------- queries

ORACLE: dict[str, str] = {
    "signal_reader": f"""WITH {SPARSE}, {PAYLOADS}
SELECT request_id, signal_type, forward_pass_index,
  {', '.join(f'{r6(c)} AS {c}' for c in _SCALARS)}, strftime("time", '%Y-%m-%d %H:%M:%S') AS "time"
FROM sparse WHERE NOT deleted AND pass BETWEEN 2 AND 7 AND request_id IN (SELECT request_id FROM live)
QUALIFY row_number() OVER (PARTITION BY request_id, signal_type, forward_pass_index ORDER BY id) = 1""",
    "signal_reader_one_model": f"""WITH {SPARSE}, {PAYLOADS}, firsts AS (
  SELECT * FROM sparse WHERE NOT deleted AND request_id IN (SELECT request_id FROM live WHERE model_id = 'O')
  QUALIFY row_number() OVER (PARTITION BY request_id, signal_type, forward_pass_index ORDER BY id) = 1)
SELECT signal_type, forward_pass_index, count(*) AS n_rows, {r6('avg(std)')} AS mean_std FROM firsts GROUP BY ALL""",
    "prompt_reader": f"""SELECT {_TURN} AS request_id, 1700000000 + conv_id % 100 * 60 + turn AS at,
  CASE WHEN role IN ('user', 'assistant') THEN text END AS prompt,
  CASE WHEN role IN ('user', 'assistant') THEN length(text) END AS n_chars FROM conversations
WHERE conv_id % 100 * 60 + turn >= 300 AND conv_id % 100 * 60 + turn < 5400""",
    "signals_polled_again": f"""WITH {SPARSE}
SELECT request_id, signal_type, forward_pass_index,
  {', '.join(f"{r6(f'arg_min({c}, id)')} AS {c}" for c in _SCALARS)},
  strftime(arg_min("time", id), '%Y-%m-%d %H:%M:%S') AS "time" FROM sparse GROUP BY ALL""",
    "layer_parse_strict": f"""WITH {CAPTURES}
SELECT CASE signal_type WHEN '{_EMBED}' THEN -1 ELSE CAST(regexp_extract(signal_type, '[0-9]+$') AS BIGINT) END AS layer,
  count(*) AS n_rows FROM mine_raw GROUP BY ALL""",
    "layer_parse": f"""WITH {_capture('theirs', "l_returnflag = 'A' AND l_linestatus = 'F'", _DRIFT)},
both_kinds AS (SELECT signal_type, forward_pass_index FROM theirs_raw
  UNION ALL SELECT event_type, props FROM events),
parsed AS (
  SELECT signal_type, CASE WHEN signal_type = '{_EMBED}' THEN -1
      WHEN regexp_full_match(signal_type, 'hidden_states\\.causal_decoder\\.layer_[0-9]+')
      THEN CAST(regexp_extract(signal_type, '([0-9]+)$', 1) AS BIGINT) END AS layer,
    CASE WHEN regexp_full_match(forward_pass_index, '[0-9]+') THEN CAST(forward_pass_index AS BIGINT) END AS pass
  FROM both_kinds)
SELECT signal_type, CAST(layer AS BIGINT) AS layer, CAST(coalesce(layer, -99) AS BIGINT) AS layer_or_unknown, pass,
  CASE WHEN layer = -1 THEN 'mean' ELSE 'first' END AS position_rule, count(*) AS n_rows FROM parsed GROUP BY ALL""",
    "unreadable_passes": "SELECT count(*) AS n_unreadable FROM events WHERE NOT regexp_full_match(props, '[0-9]+')",
    "pass_budget": """SELECT CAST(l_linenumber AS VARCHAR) AS forward_pass_index, count(*) AS n_rows FROM lineitem
WHERE l_linenumber BETWEEN 1 AND 5 GROUP BY ALL""",
    "last_generation_pass": """SELECT CAST(l_orderkey AS VARCHAR) AS request_id,
  CAST(max(l_linenumber) AS BIGINT) AS last_pass FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL""",
    "scalars_csv_roundtrip": f"""WITH {SPARSE}, {PAYLOADS}, firsts AS (
  SELECT * FROM sparse WHERE NOT deleted AND request_id IN (SELECT request_id FROM live)
  QUALIFY row_number() OVER (PARTITION BY request_id, signal_type, forward_pass_index ORDER BY id) = 1)
SELECT forward_pass_index, signal_type, count(*) AS n_rows, {r6('sum(std)')} AS sum_std,
  strftime(max("time"), '%Y-%m-%d') AS last_day FROM firsts GROUP BY ALL""",
    "captured_rows_roundtrip": f"""WITH {HIDDEN}, kept AS (
  SELECT request_id, signal_type, forward_pass_index, n_positions, count(*) AS n_dims,
    list(x ORDER BY dim) FILTER (dim < 48) AS v FROM reduced WHERE pass BETWEEN 1 AND 8 GROUP BY ALL)
SELECT request_id, signal_type, forward_pass_index, {_vector_stats('v')}, n_positions, n_dims AS dim FROM kept""",
    "profile_by_layer": f"""WITH {SPARSE}, {cells('cells', 'sparse')}, {statistics('s', 'cells')}
SELECT request_id, layer, {r6('v')} AS v FROM s_v JOIN s_u USING (request_id) WHERE n_passes_used >= 2""",
    "variation_by_pass": f"""WITH {SPARSE}, {cells('cells', 'sparse')}, {statistics('s', 'cells')}
SELECT request_id, pass, {r6('cv')} AS cv FROM s_p""",
    "profile_statistics": f"""WITH {SPARSE}, {cells('cells', 'sparse')}, {statistics('s', 'cells')}
SELECT request_id, n_passes_used, n_cells, {r6('cv')} AS cv, {r6('slope')} AS slope,
  {r6('cv_pass_slope')} AS cv_pass_slope FROM s""",
    "layer_z_scores": f"""WITH {SPARSE}, {cells('cells', 'sparse')}, {statistics('s', 'cells')}, {BAND3}
SELECT request_id, layer, {r6('v')} AS v,
  {r6('CASE WHEN profile_sd > 0 THEN (v - profile_mean) / profile_sd ELSE 0 END')} AS z
FROM s_v JOIN s_u USING (request_id) JOIN band_layer USING (layer) WHERE n_passes_used >= 2""",
    "request_arrays": f"""WITH {BAND7}
SELECT u.request_id, b.layer, {r6('v')} AS v,
  {r6('CASE WHEN profile_sd > 0 THEN (v - profile_mean) / profile_sd ELSE 0 END')} AS z
FROM fit_u u CROSS JOIN band_layer b LEFT JOIN fit_v f ON f.request_id = u.request_id AND f.layer = b.layer""",
    "complete_requests": f"""WITH {dense(7)}, {cells('dense_cells', 'dense')}, {statistics('fit', 'dense_cells')}
SELECT request_id FROM fit_u WHERE n_cells = 42""",
    "fit_band": f"""WITH {BAND7}
SELECT {r6('cv_mean')} AS cv_mean, {r6('cv_sd')} AS cv_sd, {r6('slope_mean')} AS slope_mean,
  {r6('slope_sd')} AS slope_sd, n_requests, version, {r6('cv_mean - 3 * cv_sd')} AS cv_low,
  {r6('cv_mean + 3 * cv_sd')} AS cv_high FROM band""",
    "band_layers": f"""WITH {BAND7}
SELECT layer, {r6('profile_mean')} AS profile_mean, {r6('profile_sd')} AS profile_sd FROM band_layer""",
    "band_saved_and_loaded": f"""WITH {dense(7)}, {cells('dense_cells', 'dense')},
named AS (SELECT * FROM dense_cells WHERE request_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)),
{statistics('fit', 'named')}
SELECT {r6('avg(cv)')} AS cv_mean, {r6('stddev_samp(cv)')} AS cv_sd, {r6('avg(slope)')} AS slope_mean,
  {r6('stddev_samp(slope)')} AS slope_sd, count(*) AS n_requests, 'v1' AS version FROM fit""",
    "request_scores": f"""WITH {PANEL}
SELECT request_id, {r6('cv')} AS cv, {r6('z_cv')} AS z_cv, {r6('corr')} AS corr, {r6('slope')} AS slope,
  {r6('max_abs_z_layer')} AS max_abs_z_layer, {r6('cv_pass_slope')} AS cv_pass_slope, n_passes_used,
  z_cv <= -2.0 AS is_flattened FROM scored WHERE n_passes_used >= 2""",
    "window_summary": f"""WITH {PANEL}, totals AS (
  SELECT coalesce(avg(CASE WHEN z_cv <= -2.0 THEN 1.0 ELSE 0.0 END) FILTER (n_passes_used >= 2), 0) AS rate,
    count(*) FILTER (n_passes_used >= 2) AS sample_count, coalesce(avg(cv), 0) AS mean_cv,
    coalesce(avg(z_cv), 0) AS mean_z_cv, coalesce(avg(corr), 0) AS mean_corr,
    count(*) FILTER (n_passes_used < 2) AS n_incomplete FROM scored)
SELECT {r6('rate')} AS flattened_rate, {r6('1 - rate')} AS healthy_rate, sample_count, {r6('mean_cv')} AS mean_cv,
  {r6('mean_z_cv')} AS mean_z_cv, {r6('mean_corr')} AS mean_corr, {r6('cv_mean')} AS reference_cv_mean,
  {r6('cv_sd')} AS reference_cv_sd, n_requests AS reference_n_requests, n_incomplete
FROM totals CROSS JOIN band""",
    "empty_window_summary": f"""WITH {BAND3}
SELECT 0.0::DOUBLE AS flattened_rate, 1.0::DOUBLE AS healthy_rate, 0 AS sample_count, 0.0::DOUBLE AS mean_cv,
  0.0::DOUBLE AS mean_z_cv, 0.0::DOUBLE AS mean_corr, {r6('cv_mean')} AS reference_cv_mean,
  {r6('cv_sd')} AS reference_cv_sd, n_requests AS reference_n_requests, 0 AS n_incomplete FROM band""",
    "score_distribution": f"""WITH {PANEL}, ranged AS (
  SELECT min(z_cv) AS lo, max(z_cv) AS hi, count(z_cv) AS n FROM scored),
bands AS (
  SELECT i AS band, n, lo + (i - 1) * ((hi - lo) / 10) AS lower,
    CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS upper
  FROM ranged CROSS JOIN range(1, 11) r(i)),
counted AS (
  SELECT band, n, lower, upper, count(z_cv) AS c FROM bands LEFT JOIN scored
    ON z_cv >= lower AND (z_cv < upper OR (band = 10 AND z_cv <= upper)) GROUP BY ALL)
SELECT band, {r6('lower')} AS lower, {r6('upper')} AS upper, c AS count, {r6('c / n')} AS fraction FROM counted""",
    "snapshot_census": f"""WITH {SPARSE}, {PAYLOADS}, firsts AS (
  SELECT * FROM sparse WHERE NOT deleted AND request_id IN (SELECT request_id FROM live)
  QUALIFY row_number() OVER (PARTITION BY request_id, signal_type, forward_pass_index ORDER BY id) = 1),
full_grid AS (
  SELECT request_id FROM firsts WHERE pass BETWEEN 2 AND 7 GROUP BY ALL HAVING count(DISTINCT (layer, pass)) = 18)
SELECT (SELECT count(*) FROM live) AS n_requests, count(DISTINCT request_id) AS n_requests_with_signals,
  (SELECT count(*) FROM full_grid) AS n_requests_complete, count(DISTINCT signal_type) AS n_signal_types,
  count(*) AS n_scalar_rows FROM firsts""",
    "snapshot_complete_ids": f"""WITH {dense(3)}, {PAYLOADS}
SELECT request_id FROM dense
WHERE NOT deleted AND request_id IN (SELECT request_id FROM live) AND pass BETWEEN 2 AND 7
GROUP BY request_id HAVING count(DISTINCT (layer, pass)) = 18""",
    "capture_description": f"""SELECT '{{"n_rows":' || count(*) || ',"signal_types":["' ||
  string_agg(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN '{_EMBED}' ELSE '{_LAYER}' || (l_suppkey % 3) END, '","'
    ORDER BY CASE WHEN l_suppkey % 3 = 0 THEN '{_EMBED}' ELSE '{_LAYER}' || (l_suppkey % 3) END) ||
  '"],"n_prompt_tokens":' || (SELECT sum(length(text)) FROM conversations) || ',"n_generated_tokens":' ||
  (SELECT sum(turn) FROM conversations) || '}}' AS json
FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')""",
    "vector_scalars": f"""WITH v AS (SELECT vec_id, [x * 8 for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings)
SELECT vec_id, {_vector_stats('v')} FROM v""",
    "position_reduction": f"""WITH {HIDDEN}
SELECT request_id, signal_type, forward_pass_index, n_positions, dim, {r6('x')} AS x FROM reduced""",
    "last_pass_vector": f"""WITH picked AS (
  SELECT vec_id // 8 AS r, vec_id % 8 + 1 AS p, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id % 8 + 1 >= 2 AND vec_id // 8 % 50 >= 2 AND vec_id // 8 % 50 < 42
  QUALIFY row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id % 8 DESC, vec_id) = 1),
long AS (SELECT r, p, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM picked)
SELECT CAST(r AS VARCHAR) AS request_id, CAST(p AS VARCHAR) AS forward_pass_index, dim, {r6('x')} AS x FROM long""",
    "reference_vector": f"""WITH picked AS (
  SELECT vec_id // 8 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  QUALIFY row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id % 8 DESC, vec_id) = 1)
SELECT CAST(r AS VARCHAR) AS request_id, {r6('list_sum(v)')} AS total FROM picked""",
    "manifold_full": f"""WITH {manifold('2')}
SELECT request_id, {r6('ood_dist')} AS ood_dist, {r6('ood_prob')} AS ood_prob, is_ood,
  {r6('threshold')} AS threshold FROM ood""",
    "manifold_diagonal": f"""WITH {manifold('0')}
SELECT request_id, {r6('ood_dist')} AS ood_dist, {r6('ood_prob')} AS ood_prob, is_ood,
  {r6('threshold')} AS threshold FROM ood""",
    "ood_reduced": f"""WITH {REDUCED}
SELECT CAST(vec_id AS VARCHAR) AS request_id, {r6('d')} AS ood_dist, {r6('p')} AS ood_prob,
  d > threshold OR p > 0.99 AS is_ood, {r6('threshold')} AS threshold FROM probable""",
    "ood_small_sample": f"""WITH {SMALL}
SELECT CAST(vec_id AS VARCHAR) AS request_id, {r6('d')} AS ood_dist, {r6('1 - exp(-d * d / 2)')} AS ood_prob,
  d > threshold OR 1 - exp(-d * d / 2) > 0.99 AS is_ood, 0.3::DOUBLE AS shrinkage FROM dist CROSS JOIN limit_at""",
    "ood_scores": f"""WITH RECURSIVE {PRINCIPAL}
SELECT vec_id, {r6('d')} AS ood_dist, {r6('greatest(p, 0)')} AS ood_prob, d > threshold OR p > 0.99 AS is_ood FROM probable""",
    "distance_quantiles": f"""SELECT probability, {r6('quantile')} AS quantile FROM (
  SELECT unnest([0.1, 0.5, 0.95, 0.99])::DOUBLE AS probability,
    unnest(quantile_cont(sqrt(l_extendedprice), [0.1, 0.5, 0.95, 0.99])) AS quantile FROM lineitem)""",
    "chi_square_probability": f"""WITH p AS (
  SELECT l_quantity, 1 - list_sum([exp(i * ln(l_quantity / 2) - l_quantity / 2 - lgamma(i + 1))
      for i in range(0, 16)]) AS p32,
    1 - exp(-l_quantity / 2) * (1 + l_quantity / 2) AS p4 FROM lineitem)
SELECT l_quantity, {r6('avg(p32)')} AS p32, {r6('avg(p4)')} AS p4, count(*) AS n_rows FROM p GROUP BY ALL""",
    "text_checks": f"""WITH {text_measures('documents', 'doc_id')}
SELECT k AS doc_id, stripped_chars, char_run, reason_codes = '' AS text_ok, reason_codes FROM checked""",
    "text_reasons": f"""WITH {text_measures('documents', 'doc_id')}
SELECT k AS doc_id, concat_ws('; ',
  CASE WHEN stripped_chars < 40 THEN 'too short: ' || stripped_chars || ' < 40 chars' END,
  CASE WHEN stripped_chars > 4000 THEN 'too long: ' || stripped_chars || ' > 4000 chars' END,
  CASE WHEN char_run > 12 THEN 'character repeated ' || char_run || ' times in a row' END,
  CASE WHEN distinct_ratio < 0.25 THEN 'only ' || printf('%.2f', distinct_ratio) || ' distinct-word ratio' END,
  CASE WHEN top_share > 0.35 THEN 'top word is ' || printf('%.2f', top_share) || ' of all words' END,
  CASE WHEN n_words = 0 AND stripped_chars > 0 THEN 'no words found' END) AS text_reasons FROM checked""",
    "word_statistics": f"""WITH {text_measures('documents', 'doc_id')}
SELECT k AS doc_id, n_words, n_distinct_words, top_word_count, {r6('distinct_ratio')} AS distinct_ratio,
  {r6('top_share')} AS top_share FROM checked""",
    "gate_combined": f"""WITH {text_measures('documents', 'doc_id')}, {manifold('2')}
SELECT CAST(k AS VARCHAR) AS request_id, reason_codes = '' AS text_ok, {r6('ood_dist')} AS ood_dist, is_ood,
  reason_codes = '' AND NOT coalesce(is_ood, false) AS gate_ok
FROM checked LEFT JOIN ood ON request_id = CAST(k AS VARCHAR)""",
    "gate_foreign_detector": f"""WITH {text_measures('documents', 'doc_id')}, {HALVES.split("moments AS")[0]}
spread AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM halves),
far AS (SELECT vec_id, greatest(abs(a - ma) / sa, abs(b - mb) / sb) AS d FROM halves CROSS JOIN spread),
judged AS (SELECT vec_id, d, 1 - exp(-d * d / 2) AS p, d > 2.5 OR 1 - exp(-d * d / 2) > 0.99 AS is_ood FROM far)
SELECT CAST(k AS VARCHAR) AS request_id, reason_codes = '' AS text_ok, {r6('d')} AS ood_dist, {r6('p')} AS ood_prob,
  is_ood, reason_codes = '' AND NOT coalesce(is_ood, false) AS gate_ok FROM checked LEFT JOIN judged ON vec_id = k""",
    "prompt_extract": f"""SELECT {_TURN} AS request_id,
  CASE WHEN role IN ('user', 'assistant') THEN text END AS prompt FROM conversations
UNION ALL SELECT 'e' || event_id, NULL FROM events""",
    "response_text": """SELECT conv_id, turn, CASE turn % 8 WHEN 5 THEN 'plain: ' || text WHEN 7 THEN ''
  ELSE text END AS answer FROM conversations""",
    "escape_roundtrip": r"""WITH odd AS (
  SELECT doc_id, text || '\n C:\new' || chr(13) || chr(10) || 'end \' AS t FROM documents),
lined AS (
  SELECT doc_id, replace(replace(replace(t, '\', '\\'), chr(13) || chr(10), chr(10)), chr(10), '\n') AS line FROM odd)
SELECT doc_id, line, contains(line, chr(10)) AS has_newline, true AS restored FROM lined""",
    "prompt_pack": """SELECT 't-' || conv_id || '-' || turn AS prompt_id, text AS prompt FROM conversations""",
    "prompt_pack_lines": """SELECT 'pack-' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS prompt_id, prompt FROM (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, text AS prompt FROM conversations)""",
    "prompt_pack_id_column": """SELECT 't-' || conv_id || '-' || turn AS prompt_id, text AS prompt FROM conversations""",
    "restamp_by_text": rf"""WITH normed AS (
  SELECT doc_id, n_chars, trim(regexp_replace(text, '{_BLANK_RUN}', ' ', 'g'), ' ') AS t FROM documents),
last_of AS (SELECT t, max(doc_id) AS doc FROM normed GROUP BY t)
SELECT 'p-' || doc AS request_id, n_chars FROM normed JOIN last_of USING (t)""",
    "capture_normalised": f"""WITH {CAPTURES}
SELECT request_id, signal_type, forward_pass_index, {', '.join(f'{r6(c)} AS {c}' for c in _SCALARS)} FROM mine""",
    "capture_diff": f"""WITH {diff('1, 2, 3, 4, 5, 6')} {COMPARED}""",
    "capture_diff_files": f"""WITH {diff('1, 2, 3, 4, 5, 6', 'arg_max')} {COMPARED}""",
    "capture_files_summary": f"""WITH {diff('1, 2, 3, 4, 5, 6', 'arg_max')}, {SUMMARY}""",
    "capture_report": f"""WITH {diff('1, 2, 3, 4, 5, 6')}
SELECT request_id, signal_type, forward_pass_index, side,
  row_number() OVER (ORDER BY request_id, signal_type, forward_pass_index) - 1 AS position FROM diff""",
    "capture_relabelled": f"""WITH {CAPTURES}
SELECT 'one' AS request_id, signal_type, forward_pass_index,
  {', '.join(f"{r6(f'arg_min({v}, {_CAPTURE_ORDER})')} AS {c}" for c, v in _CAPTURE_VALUES.items())}
FROM mine_raw GROUP BY ALL""",
    "capture_comparability": f"""WITH {diff('1, 2, 3, 4, 5, 6, 7')}
SELECT request_id, pass, token_match, so_far AS comparable, has_fingerprint FROM flags""",
    "capture_summary": f"""WITH {diff('1, 2, 3, 4, 5, 6')}, {SUMMARY}""",
    "capture_by_pass": f"""WITH {diff('1, 2, 3, 4, 5, 6')}, firsts AS (
  SELECT request_id, min(pass) AS pass FROM diff WHERE captured AND NOT comparable GROUP BY ALL),
first_n AS (SELECT pass, count(*) AS n_first_diverged FROM firsts GROUP BY ALL)
SELECT pass, {r6('max(abs(d_std)) FILTER (comparable)')} AS max_abs_d,
  count(*) FILTER (comparable) AS n_comparable,
  count(DISTINCT request_id) FILTER (captured AND NOT comparable) AS n_requests_diverged,
  coalesce(any_value(n_first_diverged), 0) AS n_first_diverged FROM diff LEFT JOIN first_n USING (pass) GROUP BY pass""",
    "score_batch": f"""WITH {SPARSE}, {cells('cells', 'sparse')}, {statistics('s', 'cells')}, {BAND3}, {scored('s')},
{manifold('2')},
answers AS (
  SELECT conv_id * 8 + turn AS doc, a.text, q.text AS prompt FROM conversations a
  LEFT JOIN (SELECT conv_id AS qc, turn AS qt, text FROM conversations) q ON qc = conv_id AND qt = turn - 1
  WHERE role = 'assistant'),
{text_measures('answers', 'doc')}
SELECT CAST(doc AS VARCHAR) AS prompt_id, length(prompt) AS n_chars,
  CASE WHEN prompt IS NULL THEN NULL ELSE len(regexp_extract_all(prompt, '[A-Za-z0-9'']+')) END AS n_prompt_tokens,
  len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS n_generated_tokens,
  {r6('cv')} AS cv, {r6('slope')} AS slope, {r6('corr')} AS corr, {r6('z_cv')} AS z_cv, {r6('z_slope')} AS z_slope,
  {r6('max_abs_z_layer')} AS max_abs_z_layer, {r6('cv_pass_slope')} AS cv_pass_slope,
  CASE WHEN n_passes_used >= 2 THEN n_passes_used END AS n_passes_used,
  CASE WHEN n_passes_used >= 2 THEN {r6('ood_dist')} END AS ood_dist,
  CASE WHEN n_passes_used >= 2 THEN {r6('ood_prob')} END AS ood_prob,
  CASE WHEN n_passes_used >= 2 THEN is_ood END AS is_ood,
  CASE WHEN n_passes_used >= 2 THEN reason_codes = '' END AS text_ok, z_cv <= -2.0 AS flag,
  CASE WHEN n_passes_used >= 2 THEN ''
    ELSE 'no profile: Need at least 2 passes with data, got ' || coalesce(n_passes_used, 0) END AS error,
  prompt, text AS generated_text
FROM answers JOIN checked ON k = doc LEFT JOIN scored ON scored.request_id = CAST(doc AS VARCHAR)
LEFT JOIN ood ON ood.request_id = CAST(doc AS VARCHAR)""",
    "first_complete_prompts": f"""WITH {dense(7)}, {cells('dense_cells', 'dense')}, {statistics('fit', 'dense_cells')},
first_ids AS (SELECT request_id FROM fit_u WHERE n_cells = 42 ORDER BY request_id LIMIT 25)
SELECT request_id, o_orderpriority AS prompt FROM first_ids JOIN orders ON request_id = CAST(o_orderkey AS VARCHAR)
WHERE o_orderpriority <> '5-LOW' AND {_WINDOW}""",
    "paired_effect": f"""WITH {PAIRED}, {t_test('pairs', 'dz_cv', 'family')}
SELECT family, n, {r6('mean')} AS mean, {r6('t')} AS t, {r6('greatest(p, 0)')} AS p FROM probed""",
    "dose_response": f"""WITH {PAIRED}, differences AS (
  SELECT family, question, avg(z_cv) FILTER (level = 5) - avg(z_cv) FILTER (level = 1) AS difference
  FROM pairs GROUP BY ALL), {t_test('differences', 'difference')}
SELECT n, {r6('mean')} AS mean, {r6('t')} AS t, {r6('greatest(p, 0)')} AS p FROM probed""",
    "selection_census": f"""WITH {PAIRED}
SELECT unnest([0, 1, 2, 3])::BIGINT AS step,
  unnest(['candidates', 'dz_cv <= -0.1', 'z_cv <= 0.5', 'selected']) AS condition,
  unnest([count(*), count(*) FILTER (dz_cv <= -0.1), count(*) FILTER (z_cv <= 0.5),
    count(*) FILTER (dz_cv <= -0.1 AND z_cv <= 0.5)]) AS remaining FROM pairs""",
    "strongest_per_question": f"""WITH {PAIRED}, best AS (
  SELECT question, doc_id, dz_cv FROM pairs
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY dz_cv, doc_id) = 1)
SELECT question, doc_id, {r6('dz_cv')} AS dz_cv FROM best ORDER BY best.dz_cv, doc_id LIMIT 5""",
    "send_outcome": """WITH sent AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_sent,
    count(*) FILTER (event_type <> 'error') AS n_ok FROM events GROUP BY ALL)
SELECT *, CASE WHEN n_ok = 0 THEN 'none_answered' WHEN n_ok < n_sent THEN 'partly_answered'
  ELSE 'answered_not_recorded' END AS outcome FROM sent""",
    "send_outcome_dry_run": """SELECT user_id, count(*) AS n_sent, count(*) FILTER (event_type <> 'error') AS n_ok,
  'dry_run' AS outcome FROM events GROUP BY user_id""",
    "padded_windows": """SELECT user_id, strftime(min(ts) - INTERVAL 120 SECONDS, '%Y-%m-%d %H:%M:%S') || '+0000' AS window_start,
  strftime(max(ts) + INTERVAL 120 SECONDS, '%Y-%m-%d %H:%M:%S') || '+0000' AS window_end FROM events GROUP BY user_id""",
    "manifest_files": f"""WITH {_files()}
SELECT 'docs-' || lang AS key, lang AS file, sha256, bytes, lang <> 'en' AS tracked FROM files""",
    "manifest_verify": f"""WITH {_files()}
SELECT 'docs-' || lang AS key, lang AS file,
  CASE lang WHEN 'fr' THEN 'changed' WHEN 'es' THEN 'missing' ELSE 'ok' END AS status FROM files""",
    "manifest_refresh": f"""WITH {_files("CASE WHEN lang = 'fr' THEN 'edited' ELSE text END")}
SELECT 'docs-' || lang AS key, sha256, bytes, lang <> 'en' AS tracked, 'O' AS model_id, 3 AS n_requests,
  'first' AS note, '2' AS runs FROM files""",
    "stream_panel": f"""WITH {EVENTS}, rated AS (
  SELECT *, CASE WHEN z_cv <= -2 THEN 1.0 WHEN z_cv > -2 THEN 0.0 END AS flat FROM scored)
SELECT window_start, {r6('coalesce(avg(flat), 0)')} AS flattened_rate, {r6('1 - coalesce(avg(flat), 0)')} AS healthy_rate,
  count(cv) AS sample_count, {r6('coalesce(avg(cv), 0)')} AS mean_cv, {r6('coalesce(avg(z_cv), 0)')} AS mean_z_cv,
  {r6('coalesce(avg(corr), 0)')} AS mean_corr, count(*) FILTER (cv IS NULL) AS n_incomplete FROM rated GROUP BY ALL""",
    "stream_scores": f"""WITH {EVENTS}
SELECT window_start, request_id, n_passes_used, z_cv <= -2 AS is_flattened,
  {', '.join(f'{r6(c)} AS {c}' for c in ('cv', 'z_cv', 'corr', 'slope', 'max_abs_z_layer', 'cv_pass_slope'))} FROM scored""",
    "stream_distribution": f"""WITH {EVENTS},
ranges AS (
  SELECT window_start, min(z_cv) AS lo, max(z_cv) AS hi, count(z_cv) AS n FROM scored WHERE z_cv IS NOT NULL GROUP BY ALL),
bands AS (
  SELECT *, CASE WHEN lo = hi THEN 1 ELSE 10 END AS k,
    unnest(range(1, CASE WHEN lo = hi THEN 2 ELSE 11 END)) AS band FROM ranges),
edged AS (
  SELECT *, CASE WHEN k = 1 THEN lo ELSE lo + (band - 1) * ((hi - lo) / 10) END AS lower,
    CASE WHEN band = k THEN hi ELSE lo + band * ((hi - lo) / 10) END AS upper FROM bands)
SELECT window_start, band, {r6('lower')} AS lower, {r6('upper')} AS upper, count(z_cv) AS count,
  {r6('count(z_cv) / any_value(n)')} AS fraction
FROM edged LEFT JOIN (SELECT window_start AS ws, z_cv FROM scored)
  ON ws = window_start AND z_cv >= lower AND (z_cv < upper OR band = k)
GROUP BY window_start, band, lower, upper""",
    "stream_dedup": f"""WITH e AS (
  SELECT ts, CAST(user_id AS VARCHAR) AS request_id, '{_LAYER}' || {_EVENT_LAYER} AS signal_type,
    CAST(hour(ts) // 3 + 1 AS VARCHAR) AS forward_pass_index, event_id AS id,
    CASE WHEN event_id % 17 <> 0 AND event_id % 13 <> 0 THEN value END AS x FROM events),
marked AS (
  SELECT *, coalesce(ts > lag(ts) OVER cell + INTERVAL 30 MINUTES, true) AS opens FROM e
  WINDOW cell AS (PARTITION BY request_id, signal_type, forward_pass_index ORDER BY ts, id)),
numbered AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY request_id, signal_type, forward_pass_index ORDER BY ts, id) AS session
  FROM marked)
SELECT request_id, signal_type, forward_pass_index, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time, min(id) AS id, {r6('arg_min_null(x, id)')} AS value,
  2 * count(*) AS n_copies
FROM numbered GROUP BY request_id, signal_type, forward_pass_index, session
HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_dedup_first_arrival": f"""SELECT CAST(event_id AS VARCHAR) AS request_id, '{_LAYER}' || {_EVENT_LAYER} AS signal_type,
  CAST(hour(ts) // 3 + 1 AS VARCHAR) AS forward_pass_index,
  CASE WHEN event_id % 17 <> 0 AND event_id % 13 <> 0 THEN {r6('value')} END AS value FROM events""",
    "stream_progress": """WITH expected AS (SELECT count(DISTINCT user_id) AS expected FROM events),
days AS (
  SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id) AS seen, count(*) AS n_rows FROM events GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS window_start, seen, expected, seen >= expected AS complete, n_rows
FROM days CROSS JOIN expected WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}
