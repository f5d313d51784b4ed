"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are n-grams of one to three characters of the lower-cased text in which every
run of non-letters is one space, hashed to ``SLOTS`` slots. A feature's value is its
share of the text's n-grams times its inverse document frequency. Document frequencies
count every training document. The classifier is fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample (about ``PER_LANG`` documents of each language,
drawn by a hash of the id); a fifth of the sample is kept apart to calibrate the
temperature of the softmax.

Since a value is a sum over the positions of a text, prediction is one table lookup per
position and a sum per document, on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

SLOTS = 1 << 16
MAX_N = 3
#: Documents of each language in the sample, about; the bound of what fitting sees.
PER_LANG = 1_500
FOLDS = 5
UNKNOWN = "und"
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Feature values are shares of one text, far below 1; this brings them to the order of 1.
SCALE = 50.0
#: Rows of the table of document frequencies that a task sends.
PIECES = 64

_SMALL = 1 << 16
_lower = np.array([ord(c) if len(c) == 1 else i for i, c in ((i, chr(i).lower()) for i in range(_SMALL))], np.uint32)
_letter = np.array([chr(i).isalpha() for i in range(_SMALL)])


def _characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the simplified texts, their row, and whether each row has a letter."""
    rows = len(offs) - 1
    head = (buf & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(head)))[offs]
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    small = chars < _SMALL
    low = np.where(small, chars, 0)
    letter = _letter[low]
    out = np.where(small, _lower[low], chars)
    rare = np.flatnonzero(~small)
    if len(rare):
        kinds, back = np.unique(chars[rare], return_inverse=True)
        letter[rare] = np.array([chr(c).isalpha() for c in kinds])[back]
        out[rare] = np.array([ord(chr(c).lower()[0]) for c in kinds], np.uint32)[back]
    out = np.where(letter, out, np.uint32(32))
    row = np.repeat(np.arange(rows), np.diff(at))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~letter[1:]  # the first non-letter of a run ends a word
    has = np.zeros(rows, dtype=bool)
    has[row[letter]] = True
    return out[keep], row[keep], has


def _grams(chars: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams of each length, and their rows."""
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(chars) < n:
            return
        h = (h[: len(chars) - n + 1] + chars[n - 1 :]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        slot = (h * np.uint32(0xC2B2AE35) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(16)
        inside = row[: len(slot)] == row[n - 1 :]
        yield slot[inside], row[: len(slot)][inside]


def _steps(column: pa.Array):
    _, offs = K.text_bytes(column)
    for lo, hi in K.steps(offs, K.SMALL_STEP):
        chars, row, has = _characters(*K.text_bytes(column.slice(lo, hi - lo)))
        yield lo, hi, list(_grams(chars, row)), has


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SLOTS, np.int64)
    docs = 0
    for batch in batches:
        for lo, hi, grams, _ in _steps(batch.column(0)):
            docs += hi - lo
            edges = [np.searchsorted(row, np.arange(hi - lo + 1)) for _, row in grams]
            for i in range(hi - lo):
                one = np.zeros(SLOTS, dtype=bool)
                for (slot, _), edge in zip(grams, edges, strict=True):
                    one[slot[edge[i] : edge[i + 1]]] = True
                seen += one
    parts = [p.astype("<i8").tobytes() for p in np.split(seen, PIECES)] + [np.array([docs], "<i8").tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(range(PIECES + 1), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "seen"])


def _add(key: tuple, parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_py(), "<i8") for p in parts.column("seen"))
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "seen": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, shares = [], []
        for lo, hi, grams, _ in _steps(batch.column(2)):
            for i in range(hi - lo):
                own = [slot[row == i] if hi - lo == 1 else slot[slice(*np.searchsorted(row, [i, i + 1]))] for slot, row in grams]
                own = np.concatenate(own) if own else np.zeros(0, np.uint32)
                used, n = np.unique(own, return_counts=True)
                slots.append(used.astype("<u4").tobytes())
                shares.append((n / max(1, len(own))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(slots, pa.binary()), pa.array(shares, pa.binary())],
            names=["draw", "lang", "slots", "shares"],
        )


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # SLOTS x languages: idf times weight
    bias: np.ndarray
    temperature: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (SLOTS + 1) x classes by proximal follow-the-regularised-leader; the last row is the bias."""
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, x, y in examples:
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def calibrated(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t):
        p = softmax(scores / np.exp(t))[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-300)).mean()

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi, b = b, a
            a = hi - ratio * (hi - lo)
        else:
            lo, a = a, b
            b = lo + ratio * (hi - lo)
    return float(np.exp((lo + hi) / 2))


def fit(labelled: DataFrame, per_lang: int = PER_LANG, seed: int = 11) -> Model:
    """A model from rows ``draw_by, text, lang`` without nulls.

    The driver sees the table of document frequencies, of fixed size, and the sample:
    about ``per_lang`` rows of each language, at most ``SLOTS`` features each.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0), 1.0)
    pieces = labelled.select("text").mapInArrow(_frequencies, "piece int, seen binary")
    summed = {r["piece"]: np.frombuffer(r["seen"], "<i8") for r in pieces.groupBy("piece").applyInArrow(_add, "piece int, seen binary").collect()}
    total = int(summed[PIECES][0])
    seen = np.concatenate([summed[i] for i in range(PIECES)])
    idf = np.log((1 + total) / (1 + seen)) + 1
    draw = F.xxhash64(F.col("draw_by"), F.lit(seed))
    part = F.pmod(draw, F.lit(1_000_000_007)) / 1_000_000_007
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (part < min(1.0, per_lang / n)))
    sample = labelled.filter(wanted).select(draw.alias("draw"), "lang", "text")
    rows = sample.mapInArrow(_features, "draw long, lang string, slots binary, shares binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], r["slots"], r["shares"]))
    languages = sorted(counts)
    place = {lang: i for i, lang in enumerate(languages)}
    examples = []
    for r in rows:
        at = np.frombuffer(r["slots"], "<u4").astype(np.int64)
        x = np.frombuffer(r["shares"], "<f4").astype(np.float64) * idf[at] * SCALE
        examples.append((np.append(at, SLOTS), np.append(x, 1.0), place[r["lang"]]))
    kept_apart = examples[::5] if len(examples) >= 50 else []
    learned = [e for i, e in enumerate(examples) if not kept_apart or i % 5]
    w = fit_ftrl(learned, len(languages))
    scores = np.array([x @ w[at] for at, x, _ in kept_apart]).reshape(-1, len(languages))
    temperature = calibrated(scores, np.array([y for *_, y in kept_apart], dtype=np.int64))
    return Model(languages, (w[:SLOTS] * idf[:, None] * SCALE).astype(np.float32), w[SLOTS], temperature)


def _predict(sent, text: int, kept: int):
    """The first ``kept`` columns with language and score of the column ``text``, a batch for every step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for lo, hi, grams, has in _steps(batch.column(text)):
                z = np.zeros((hi - lo, len(model.languages)))
                n = np.zeros(hi - lo)
                for slot, row in grams:
                    at, rows = K.cuts(row)
                    if len(slot):
                        z[rows] += np.add.reduceat(model.table[slot], at[:-1], axis=0)
                        n[rows] += np.diff(at)
                best, sure = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                if model.languages:
                    p = softmax((z / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
                    best, sure = np.where(has, p.argmax(axis=1), len(model.languages)), np.where(has, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(kept)] + [pa.array(names[best], pa.string()), pa.array(sure)],
                    names=[*batch.schema.names[:kept], "lang_pred", "score"],
                )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """What may be learned from: id, text and language present, id outside the held-out fold."""
    return docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("draw_by"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter("text IS NOT NULL AND lang IS NOT NULL")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    A null text, one without a letter, or an untrained model gives ``und`` with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _predict(sent, 1, 1), "doc_id long, lang_pred string, score double"
    )


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of the documents with ``__lang_pred, __score`` beside them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held, kept = docs, len(docs.columns)
    if text_col in docs.columns and docs.schema[text_col].dataType == T.StringType():
        text = docs.columns.index(text_col)  # a text goes to Python and back once
    else:
        held, text = docs.select("*", F.col(text_col).cast("string").alias("__text")), kept
    found = [T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())]
    held = held.toDF(*[f"c{i}" for i in range(len(held.columns))])  # names with dots don't pass
    return held.mapInArrow(_predict(sent, text, kept), T.StructType([*docs.schema.fields, *found]))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from the table outside the fold, judge all of it.

    A null id is neither held out nor learned from. Repeated rows are judged alike. An
    empty table gives an empty result.
    """
    scored = predict(docs, fit(training_rows(docs), per_lang))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
