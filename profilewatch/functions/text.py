"""Text columns: strip, escape, tokens, character runs, JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANSWER_KEYS, WHITESPACE, WORD_PATTERN
from ..schemas import PROMPT_DOCUMENT


def _char_class(chars: str) -> str:
    """Regex class of some characters, neighbours as ranges (few nodes match fast)."""
    points, ranges = sorted(map(ord, chars)), []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


_SPACE_RUN = _char_class(WHITESPACE) + "+"
_HELD_BACKSLASH = "\u0001"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def single_spaced(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(text, F.lit(_SPACE_RUN), F.lit(" ")), F.lit(" "))


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lower)


def with_word_counts(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``n_words, n_distinct_words, top_word_count``.

    All inside the row, no explode and no shuffle: the sorted tokens change value
    at the first place of each distinct word, and the gaps between those places
    are the counts. Each step is a column of its own, so it is computed once.
    """
    i, here = F.sequence(F.lit(0), F.size("_words") - 1), F.col("_words")
    starts = F.filter(i, lambda k: ~F.get(here, k).eqNullSafe(F.get(here, k - 1)))
    n, first = F.size("_words"), F.col("_starts")
    gaps = F.transform(first, lambda at, k: F.coalesce(F.get(first, k + 1), n) - at)
    return (
        df.withColumn("_words", F.sort_array(words(text)))
        .withColumn("_starts", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")))
        .withColumns(
            {
                "n_words": n.cast("long"),
                "n_distinct_words": F.size("_starts").cast("long"),
                "top_word_count": F.coalesce(F.array_max(gaps), F.lit(0)).cast("long"),
            }
        )
        .drop("_words", "_starts")
    )


def longest_char_run(text: Column) -> Column:
    """Length of the longest run of one character; only real repeats are extracted."""
    repeats = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1+"), F.lit(0))
    floor = F.when(F.length(text) > 0, F.lit(1)).otherwise(F.lit(0))
    return F.greatest(floor, F.array_max(F.transform(repeats, F.length)))


def escape_line(text: Column) -> Column:
    r"""One line, reversible: backslash doubled, CRLF and LF to a literal ``\n``."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    unix = F.replace(doubled, F.lit("\r\n"), F.lit("\n"))
    return F.replace(unix, F.lit("\n"), F.lit("\\n"))


def unescape_line(line: Column) -> Column:
    """Inverse of :func:`escape_line`. Doubled backslashes are parked on U+0001.

    A U+0001 of the text itself is parked as the pair U+0001 '0' first, a
    backslash pair becomes U+0001 '1', so the two never mix.
    """
    parked = F.replace(line, F.lit(_HELD_BACKSLASH), F.lit(_HELD_BACKSLASH + "0"))
    parked = F.replace(parked, F.lit("\\\\"), F.lit(_HELD_BACKSLASH + "1"))
    lines = F.replace(parked, F.lit("\\n"), F.lit("\n"))
    lines = F.replace(lines, F.lit(_HELD_BACKSLASH + "1"), F.lit("\\"))
    return F.replace(lines, F.lit(_HELD_BACKSLASH + "0"), F.lit(_HELD_BACKSLASH))


def prompt_text(payload: Column) -> Column:
    """Prompt of a request payload: ``raw.text``, else the last message's content."""
    raw = F.from_json(payload, PROMPT_DOCUMENT)["raw"]
    return F.coalesce(raw["text"], F.try_element_at(raw["messages"], F.lit(-1))["content"])


#: Strings whole, JSON's missing numbers, and everything else, as tokens.
_JSON_TOKENS = r'''"(?:[^"\\]|\\.)*"|NaN|-?Infinity|[^"NI-]+|.'''


def _strict(body: Column) -> Column:
    """One JSON value and nothing behind it.

    The parser stops at the end of the first value. What follows it cannot end both a list and
    an object, so a body that parses inside either of them is a single value.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    return F.when(listed.isNotNull(), F.try_variant_get(named, "$.v", "variant"))


def _document(body: Column) -> Column:
    """The body as a variant, NULL where it is no JSON. NaN and infinities outside of strings count as null."""
    tokens = F.regexp_extract_all(body, F.lit(_JSON_TOKENS), F.lit(0))
    plain = F.transform(tokens, lambda t: F.when(t.isin("NaN", "Infinity", "-Infinity"), F.lit("null")).otherwise(t))
    strict = _strict(body)
    return F.when(strict.isNotNull(), strict).when(body.rlike("NaN|Infinity"), _strict(F.array_join(plain, "")))


def _item(value: Column, depth: Column) -> Column:
    return F.struct(value.alias("v"), depth.alias("d"))


def _opened(node: Column, depth: Column) -> Column:
    """What a container offers, in the order it counts: entries of the list of open values."""
    def at(path):
        return F.try_variant_get(node, path, "variant")

    offered = [at(f"$.{key}") for key in ANSWER_KEYS]
    first_choice, content = at("$.choices[0]"), at("$.message.content")
    # once there are choices the container ends behind them: an empty text closes it
    offered += [first_choice, F.when(first_choice.isNotNull(), F.parse_json(F.lit('""')))]
    offered += [F.when(F.schema_of_variant(content) == "STRING", content), at("$[0]")]
    return F.filter(F.array(*[_item(v, depth) for v in offered]), lambda e: e["v"].isNotNull())


def _searched(document: Column, steps: Column) -> Column:
    """The answer inside a document: values are opened one by one, each in front of what is still open.

    A text that is not empty ends the search. An empty one closes its container: what the
    container still had open is dropped, and its neighbours are looked at next.
    """
    def step(state, _):
        head, rest = F.get(state["open"], F.lit(0)), F.slice(state["open"], 2, F.greatest(F.size(state["open"]), F.lit(1)))
        kind = F.schema_of_variant(head["v"])
        text = F.when(kind == "STRING", F.try_variant_get(head["v"], "$", "string"))
        container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        left = (
            F.when(text == "", F.filter(rest, lambda e: e["d"] < head["d"]))
            .when(container, F.concat(_opened(head["v"], head["d"] + 1), rest))
            .otherwise(rest)
        )
        going = state["found"].isNull() & (F.size(state["open"]) > 0)
        return F.when(going, F.struct(left.alias("open"), F.nullif(text, F.lit("")).alias("found"))).otherwise(state)

    start = F.struct(F.array(_item(document, F.lit(0))).alias("open"), F.lit(None).cast("string").alias("found"))
    return F.reduce(F.sequence(F.lit(1), steps), start, step, lambda state: F.coalesce(state["found"], F.lit("")))


def response_text(body: Column) -> Column:
    """Answer text of a response body whose shape is not known in advance, all in the JVM.

    A body that is no JSON is the answer itself. A known key holding text at the top level is
    read directly; nested answers, lists, ``choices`` and messages are searched in variant
    paths, in as many steps as the body can have values. A repeated key counts with its last value
    when ``spark.sql.variant.allowDuplicateKeys`` is on (``session.configure`` sets it). Bodies
    beyond the variant's size limit count as no JSON.
    """
    document = _document(body)
    top = F.lit(None).cast("string")
    for key in reversed(ANSWER_KEYS):
        field = F.try_variant_get(document, f"$.{key}", "variant")
        kind = F.schema_of_variant(field)
        # a nested value in an earlier key may win, so it blocks the keys after it
        top = (
            F.when(kind == "STRING", F.try_variant_get(document, f"$.{key}", "string"))
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(None).cast("string"))
            .otherwise(top)
        )
    opening = F.length(body) - F.length(F.translate(body, "{[", ""))
    values = opening + F.length(body) - F.length(F.translate(body, ",", "")) + 1
    # a value is opened at most once, and a list of choices closes its container once
    return F.when(document.isNull(), body).when(top.isNotNull(), top).otherwise(_searched(document, values + opening))
