"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPACE}'), lambda x: x <> '')"


_SUBSTRING = f"""WITH w AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
firsts AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM win JOIN firsts USING (g) WHERE m < doc_id)),
marked AS (SELECT doc_id, p, p - lag(p, 1, -9) OVER (PARTITION BY doc_id ORDER BY p) > 1 AS opens FROM gone),
cut AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (opens) AS spans, list(p) AS ps FROM marked GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) AS e
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = e.doc_id AND gone.p = e.i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_EXACT = f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t"""

_MIXING = f"""WITH sized AS (
  SELECT doc_id, source, len({_words('text')})::BIGINT AS size, md5(doc_id::VARCHAR || ':0') AS draw FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM sized GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][k % 3 + 1]::DOUBLE AS weight, 2.0 * source_size AS most FROM sources),
filling AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighted),
levels AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * held::DOUBLE) / open AS level FROM filling),
found AS (SELECT coalesce(arg_min(level, most / weight) FILTER (level * weight <= most), max(level)) AS level FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN found.level * weight > most THEN most::DOUBLE ELSE found.level * weight END AS target
  FROM weighted CROSS JOIN found),
wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
running AS (
  SELECT sized.*, source_size, target, whole, target - whole * source_size AS need,
    sum(size) OVER (PARTITION BY sized.source ORDER BY draw) AS upto
  FROM sized JOIN wholes ON sized.source IS NOT DISTINCT FROM wholes.source),
stops AS (
  SELECT source, any_value(need) AS need, max(draw) FILTER (upto <= need) AS stop,
    any_value(need) - coalesce(max(upto) FILTER (upto <= need), 0) AS gap FROM running GROUP BY source),
fillers AS (
  SELECT running.source, arg_min(draw, {{'miss': abs(gap - size), 'draw': draw}}) AS filler
  FROM running JOIN stops ON running.source IS NOT DISTINCT FROM stops.source
  WHERE draw > coalesce(stop, '') AND size > 0 AND size < 2 * gap GROUP BY running.source)
SELECT doc_id, running.source, size, source_size, target,
  size * (whole + (running.need > 0 AND (draw <= coalesce(stop, '') OR draw = coalesce(filler, '')))::BIGINT) AS taken
FROM running JOIN stops ON running.source IS NOT DISTINCT FROM stops.source
LEFT JOIN fillers ON running.source IS NOT DISTINCT FROM fillers.source"""

_MINHASH = f"""WITH RECURSIVE w AS (
  SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.v = b.v AND a.doc_id <> b.doc_id
    AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.id, links.y FROM reach JOIN links ON reach.other = links.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) ON id = doc_id"""

_COLLOCATIONS = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, ws[i:i + k - 1] AS p
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k))),
f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cand AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 30),
inner_of AS (
  SELECT lang, p[i:i + k - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM cand, (VALUES (2), (3)) AS sizes(k) WHERE k < len(p))
  GROUP BY ALL),
kept AS (
  SELECT cand.* FROM cand LEFT JOIN inner_of USING (lang, p)
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.p = cuts.p[1:k]
  JOIN f AS y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
    array_to_string(p, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, bit: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"""

_PAIRS = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"

_MERKLE = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS l, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS slot FROM documents),
tree(l, level, nodes) AS (
  SELECT l, 0, list(leaf ORDER BY slot) FROM leaves GROUP BY l
  UNION ALL SELECT l, level + 1, {_PAIRS} FROM tree WHERE len(nodes) > 1),
subroots AS (
  SELECT l, level, nodes[1] AS subroot, row_number() OVER (ORDER BY l) - 1 AS place FROM tree WHERE len(nodes) = 1),
crown(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL SELECT level + 1, {_PAIRS} FROM crown WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, tree.level, (slot >> tree.level) & 1 AS own, nodes[xor(slot >> tree.level, 1) + 1] AS sibling
  FROM leaves JOIN tree USING (l) WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, subroots.level + crown.level, (place >> crown.level) & 1, nodes[xor(place >> crown.level, 1) + 1]
  FROM leaves JOIN subroots USING (l) CROSS JOIN crown WHERE len(nodes) > 1),
folded(doc_id, level, node) AS (
  SELECT doc_id, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT doc_id, level + 1, sha256(CASE WHEN own = 1 THEN coalesce(sibling, '') || node ELSE node || coalesce(sibling, '') END)
  FROM folded JOIN steps USING (doc_id, level)),
ends AS (SELECT doc_id, arg_max(node, level) AS folded_root FROM folded GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT doc_id, leaf, subroot, nodes[1] AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = nodes[1] AS verified
FROM leaves JOIN subroots USING (l) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
CROSS JOIN (SELECT nodes FROM crown WHERE len(nodes) = 1)"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": _SUBSTRING,
    "op4_exact_dedup": _EXACT,
    "op6_mixing": _MIXING,
    "op8_minhash_dedup": _MINHASH,
    "op11_collocations": _COLLOCATIONS,
    "op13_merkle_manifest": _MERKLE,
}
