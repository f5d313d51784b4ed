"""URL filter: host and path rules first, gradient-boosted trees for the rest.

Everything is columns and MLlib: parsing, features, the suffix statistics, training and
prediction stay in the JVM. The trees learn from URLs with a known verdict. Fitting
reads a bounded sample of them (``max_train``, drawn by a hash of the URL, half for each kind);
the suffix statistics count all of them, out of fold, and every URL is judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: (host, path, verdict): fits the host and its subdomains where the path begins so.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MAX_TRAIN = 20_000
#: Parts of the labelled URLs; a URL's suffix statistics come from the other parts.
FOLDS = 5
TREES = 10
DEPTH = 4
#: Verdict where no labelled URL exists to learn from.
DEFAULT = "allow"

FEATURES = (
    "n_chars", "host_chars", "path_chars", "depth", "host_labels", "digit_share", "host_digit_share",
    "dash_share", "entropy", "host_entropy", "n_params", "query_chars", "has_fragment", "is_secure",
    "suffix_rate", "suffix_weight",
)


def _ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def url_parts(urls: DataFrame) -> DataFrame:
    """``host, path, query`` of a ``url`` column; both parts are empty where there is no ``://``."""
    rest = F.coalesce(_after_scheme(F.col("url")), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return urls.withColumn("__rest", rest).select(
        *urls.columns,
        _ascii_lower(host).alias("host"),
        F.regexp_extract(F.col("__rest"), r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(F.col("__rest"), r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict (null: none)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r))
    for host, path, what in ordered:
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(
            F.col("path"), F.lit(path)
        )
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.length(text)
    counted = F.aggregate(
        chars,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, c: F.when(a["last"] == c, F.struct(c.alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum")))
        .otherwise(F.struct(c.alias("last"), F.lit(1).alias("run"), (a["sum"] + _xlogx(a["run"])).alias("sum"))),
        lambda a: a["sum"] + _xlogx(a["run"]),
    )
    return F.when(n > 0, F.log2(n.cast("double")) - counted / n).otherwise(F.lit(0.0))


def _xlogx(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def lexical(parts: DataFrame) -> DataFrame:
    """Lexical features of ``url, host, path, query``; a null url counts as empty."""
    url, host, path, query = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path"), F.col("query")
    labels = F.size(F.split(host, r"\."))
    values = {
        "n_chars": F.length(url),
        "host_chars": F.length(host),
        "path_chars": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda c: c != "")),
        "host_labels": F.when(host == "", F.lit(0)).otherwise(labels),
        "digit_share": _share(url, "[0-9]"),
        "host_digit_share": _share(host, "[0-9]"),
        "dash_share": _share(host, "-"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda c: c != "")),
        "query_chars": F.length(query),
        "has_fragment": F.contains(url, F.lit("#")),
        "is_secure": F.startswith(url, F.lit("https:")),
    }
    return parts.select(
        *parts.columns,
        F.element_at(F.split(host, r"\."), -1).alias("suffix"),
        *[v.cast("double").alias(k) for k, v in values.items()],
    )


def _fold() -> Column:
    """Fold of a labelled URL, by its host, so that copies of a URL share one."""
    return F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """``suffix, fold, n, blocks``: labels of every host suffix by fold; with a null fold, of all of them."""
    by_fold = labelled.groupBy("suffix", _fold().alias("fold")).agg(
        F.count("*").alias("n"), F.sum("label").alias("blocks")
    )
    total = by_fold.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"))
    return by_fold.unionByName(total.withColumn("fold", F.lit(None).cast("int")))


def _with_suffix(rows: DataFrame, stats: DataFrame, labelled: bool, seen_at_most: int = 10_000) -> DataFrame:
    """Rows with their suffix's block rate, drawn towards one half.

    A labelled row sees the labels of the other folds only, never its own. A suffix that has no label there,
    or labels of one kind, is at one half: it would be the label under another name.
    """
    total = stats.filter("fold IS NULL").select("suffix", F.col("n").alias("n_all"), F.col("blocks").alias("blocks_all"))
    small = stats.limit(FOLDS * seen_at_most + 1).count() <= FOLDS * seen_at_most
    out = rows.join(F.broadcast(total) if small else total, "suffix", "left")
    n, blocks = F.coalesce("n_all", F.lit(0)), F.coalesce("blocks_all", F.lit(0.0))
    if labelled:
        own = stats.filter("fold IS NOT NULL").withColumnRenamed("fold", "own_fold")
        out = out.withColumn("own_fold", _fold()).join(F.broadcast(own) if small else own, ["suffix", "own_fold"], "left")
        n, blocks = n - F.coalesce("n", F.lit(0)), blocks - F.coalesce("blocks", F.lit(0.0))
    mixed = (blocks > 0) & (blocks < n)
    return out.withColumns(
        {
            "suffix_rate": F.when(mixed, (blocks + 1) / (n + 2)).otherwise(F.lit(0.5)),
            "suffix_weight": F.when(mixed, F.log1p(n.cast("double"))).otherwise(F.lit(0.0)),
        }
    )


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    labels: DataFrame | None = None,
    max_train: int = MAX_TRAIN,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = 7,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    A rule decides where one fits, the longest first. The others get the verdict of
    trees trained on ``labels`` (``url, label``: 1 block, 0 allow), or without them
    on the URLs that rules decide. ``score`` is the trees' probability of ``block``, null
    where a rule decides. A null url, or one without ``://``, has an empty host and path
    and goes to the trees. With no labelled URL, or labels of one kind only, the verdict of the
    rest is that kind, or ``allow``. Repeated rows are judged alike. An empty table
    gives an empty result.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    name, verdict = rule_of(rules)
    parts = url_parts(urls).withColumn("rule", name).withColumn("by_rule", verdict)
    if labels is None:
        known = parts.filter("by_rule IS NOT NULL").withColumn("label", (F.col("by_rule") == "block").cast("double"))
    else:
        given = labels.select(F.lit(None).cast("long").alias("page_id"), "url", F.col("label").cast("double"))
        known = url_parts(given).filter("label IS NOT NULL")
    known = lexical(known)
    counts = known.agg(F.count("*").alias("n"), F.sum("label").alias("blocks")).first()
    n, blocks = counts["n"], counts["blocks"] or 0
    features = lexical(parts)
    columns = ["page_id", "host", "path", "rule"]
    if n == 0 or blocks in (0, n):
        return _one_kind(parts, columns, DEFAULT if n == 0 or blocks == 0 else "block")
    stats = settle(suffix_statistics(known))
    draw = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    # the rarer label is drawn by a rate of its own, so a large table gives both kinds within the bound
    rate = F.when(F.col("label") == 1.0, F.lit(min(1.0, max_train / 2 / blocks))).otherwise(F.lit(min(1.0, max_train / 2 / (n - blocks))))
    sample = known.filter(draw < rate)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = settle(assembler.transform(_with_suffix(sample, stats, labelled=True)).select("label", "features"))
    kinds = [r["label"] for r in train.select("label").distinct().collect()]
    if len(kinds) < 2:  # every copy of one kind was passed over
        return _one_kind(parts, columns, "block" if kinds == [1.0] else DEFAULT)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(train)
    open_urls = assembler.transform(_with_suffix(features, stats, labelled=False))
    scored = model.transform(open_urls)
    block = F.element_at(vector_to_array("probability"), 2)
    return scored.select(
        *columns,
        F.coalesce("by_rule", F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("by_rule").isNull(), block).alias("score"),
    )


def _one_kind(parts: DataFrame, columns: list[str], rest: str) -> DataFrame:
    """The rules' verdicts, and one verdict for all other URLs."""
    return parts.select(
        *columns,
        F.coalesce("by_rule", F.lit(rest)).alias("verdict"),
        F.when(F.col("by_rule").isNull(), F.lit(float(rest == "block"))).alias("score"),
    )
