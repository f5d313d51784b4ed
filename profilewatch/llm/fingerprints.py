"""Document fingerprints by MinHash, and search by bands of them.

A text's shingles are the runs of ``SHINGLE`` words that end at each of its words, padded with
nothing before the first, so a text of n words has n of them and short texts have some
too. A fingerprint holds, for each of ``HASHES`` universal hash functions
(multiply-add-shift on 32-bit shingle values), 16 bits of the smallest hash; the share
of equal places estimates the Jaccard similarity of two sets.

``edited_fingerprints`` needs each document's neighbour in id order. Ids are cut into ranges by
their quantiles, texts move once, to their range, and are read there as a sorted stream. The first
document of a range also goes to the end of the range before: one text per range.

``search`` joins bands of the fingerprints of a stated query set with those of all documents in
Spark, drops pairs by the estimate and verifies the rest by exact Jaccard similarity. Equal
texts are one class; the bands hold one row per class.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..session import settle
from . import kernels as K
from .tables import shuffle_width

SHINGLE = 5
HASHES = 128
BANDS, ROWS = 21, 6
SIMILARITY = 0.8
#: How far below the threshold an estimate may lie: over four standard deviations of the estimate.
SLACK = 0.15
#: Bytes of text whose shingles are hashed together; they fit a core's cache.
STEP = 256_000
_rng = np.random.default_rng(12)
MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_values(words: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit value for the run of up to ``width`` words that ends at each word."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out = words * np.uint64(K.TOKEN_BASE)
    for back in range(1, width):
        out[back:] += np.where(place[back:] >= back, words[:-back], np.uint64(0)) if len(words) > back else 0
        out *= np.uint64(K.TOKEN_BASE)
    return K.mix(out)


def _shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    _, offs = K.text_bytes(texts)
    for lo, hi in K.steps(offs, STEP):
        *_, first, words = K.words_of(texts, lo, hi, lower=True)
        yield lo, hi, shingle_values(words, first), first


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hashes of every text, 16 bits each, and which texts have any."""
    out = np.zeros((len(texts), HASHES), dtype="<u2")
    some = np.zeros(len(texts), dtype=bool)
    for lo, hi, values, first in _shingles(texts):
        full = np.flatnonzero(np.diff(first) > 0)
        if not len(full):
            continue
        some[lo + full] = True
        x, starts = values >> np.uint64(32), first[:-1][full]
        hashed = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, MULTIPLY[i], out=hashed)
            hashed += ADD[i]
            out[lo + full, i] = (np.minimum.reduceat(hashed, starts) >> np.uint64(32)) & np.uint64(0xFFFF)
    return out, some


def _spelled(rows: np.ndarray, some: np.ndarray) -> list[str]:
    return [base64.b64encode(r.tobytes()).decode() if s else "" for r, s in zip(rows, some, strict=True)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Share of equal places; two texts without words are alike, one without is unlike any other."""
    return np.where(some_a & some_b, (a == b).mean(axis=1), (some_a == some_b).astype(float))


# Neighbours


def _order_key() -> list[Column]:
    return [F.col("place").desc(), F.col("tie").asc()]


def _with_ranges(docs: DataFrame) -> DataFrame:
    """The documents with the number of their range of ids, in descending order of id.

    An id that fills several ranges is cut further by a hash of the text.
    """
    parts = 4 * shuffle_width(docs.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    cut = docs.agg(F.percentile_approx("place", shares, max(10_000, 20 * parts)).alias("cut")).first()["cut"] or []
    bounds, cut = [], sorted(cut, reverse=True)
    for at in sorted(set(cut), reverse=True):
        n = cut.count(at)
        bounds += [(at, -(1 << 63) + (1 << 64) * i // n) for i in range(n)]
    docs = docs.withColumn("tie", F.xxhash64("text"))
    if not bounds:
        return docs.withColumn("part", F.lit(0))
    table = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(t).alias("tie")) for p, t in bounds))
    behind = F.filter(table, lambda b: (F.col("place") < b["place"]) | ((F.col("place") == b["place"]) & (F.col("tie") >= b["tie"])))
    return docs.withColumn("part", F.size(behind))


def _in_order(docs: DataFrame) -> DataFrame:
    """Ranges as sorted streams; behind each range's rows stands the first row of the next one (``guest``)."""
    ranged = _with_ranges(docs)
    heads = ranged.groupBy("part").agg(F.max(F.struct("place", F.bitwise_not("tie").alias("tie"))).alias("head"))
    found = sorted((r["part"], r["head"]["place"], ~r["head"]["tie"]) for r in heads.collect())  # a row per range
    if not found:
        return ranged.withColumn("guest", F.lit(False)).select("guest", "doc_id", "text")
    # by number of the range: its first row, and the range before, to whose end that row goes too
    table = [(None, None, None)] * (found[-1][0] + 1)
    for i, (part, place, tie) in enumerate(found):
        table[part] = (place, tie, found[i - 1][0])
    kinds = ("long", "long", "int")
    rows = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(row, kinds, ("place", "tie", "before"), strict=True))) for row in table))
    known = ranged.withColumn("head", F.element_at(rows, F.col("part") + 1))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("head.before").alias("part"), F.lit(True).alias("guest"))
    is_head = (F.col("place") == F.col("head.place")) & (F.col("tie") == F.col("head.tie"))
    sent = known.select("doc_id", "text", "place", "tie", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    sent = sent.select("to.part", "to.guest", "place", "tie", "doc_id", "text")
    return sent.repartition("part").sortWithinPartitions("part", "guest", *_order_key()).select("guest", "doc_id", "text")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first code points of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for block in K.blocks(iter([batch]), "text"):
            rows = pa.Table.from_batches([block] if held is None else [held, block]).combine_chunks()
            texts = rows.column("text").combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            said = [t or "" for t in texts.to_pylist()]
            new = [edited(a, b) for a, b in zip(said[:-1], said[1:], strict=True)]
            guest = np.array(rows.column("guest").to_pylist(), dtype=bool)[:-1]
            held = rows.slice(len(said) - 1).to_batches()[0]
            if not len(new):
                continue
            sig, some = signatures(texts)
            changed, some_changed = signatures(pa.array(new, pa.large_string()))
            spelled = _spelled(sig, some)
            out = pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").combine_chunks().slice(0, len(new)),
                    pa.array([len(t) for t in said[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                    pa.array(spelled[:-1], pa.string()),
                    pa.array(_spelled(changed, some_changed), pa.string()),
                    pa.array(likeness(sig[:-1], some[:-1], changed, some_changed), pa.float64()),
                    pa.array(likeness(sig[:-1], some[:-1], sig[1:], some[1:]), pa.float64()),
                ],
                names=[f.split(" ")[0] for f in RESULT.split(", ")],
            )
            yield out.filter(pa.array(~guest))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last half of its code points replaced by the first as many of the next
    document in descending order of id; after the last comes the first. Nulls count as empty
    texts. Texts without words have the empty fingerprint, alike among themselves only. Null ids
    come last; rows with the same id are ordered by a hash of their text, and each is a document.
    A single document follows itself. An empty table gives an empty result.
    """
    ids = F.col(id_col).cast("long")
    docs = docs.select(
        ids.alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(ids, F.lit(-(1 << 63))).alias("place"),
    )
    return _in_order(docs).mapInArrow(_fingerprints, RESULT)


# Search


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in K.blocks(iter([batch]), "text"):
            sig, some = signatures(block.column(1))
            keys = np.zeros((len(sig), BANDS), dtype=np.uint64)
            for i in range(BANDS * ROWS):
                keys[:, i // ROWS] = K.mix(keys[:, i // ROWS] * np.uint64(K.BASE) + sig[:, i] + np.uint64(1))
            bands = [k.tolist() if s else [] for k, s in zip(keys.view(np.int64), some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(_spelled(sig, some)), pa.array(bands, pa.list_(pa.int64()))],
                names=["class_id", "fingerprint", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in K.blocks(iter([batch]), "text"):
            sets: list = []
            for _, _, values, first in _shingles(block.column(1)):
                sets += [np.unique(values[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["class_id", "shingles"])


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (
            np.stack([np.frombuffer(base64.b64decode(x), "<u2") for x in batch.column(i).to_pylist()]) if batch.num_rows else np.zeros((0, HASHES))
            for i in (2, 3)
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1), pa.float64())], names=["query_class", "class_id", "estimate"]
        )


def search(
    docs: DataFrame, is_query: Column, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """Documents like those of a stated query set: ``(pairs, members)``.

    ``pairs``: ``query_class, class_id, estimate, jaccard`` of different texts with at least
    ``similarity``; ``members``: ``doc_id, class_id, is_query`` of every row, where a class is all rows of one text
    and its id the smallest of theirs. Rows without an id and texts without words are in no
    pair; null counts as empty. A null in ``is_query`` means no. Bands find a pair of similarity 0.8 with
    probability 0.998. Empty tables give empty results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, F.coalesce(is_query, F.lit(False)).alias("is_query"))
    hashed = docs.select("doc_id", "is_query", F.sha2("text", 256).alias("sha"))
    classes = hashed.groupBy("sha").agg(F.min("doc_id").alias("class_id"), F.max("is_query").alias("asked"))
    members = settle(join_hot(hashed, classes, ["sha"]).select("doc_id", "class_id", "is_query", "asked"))
    chosen = members.filter("doc_id = class_id").groupBy("class_id").agg(F.max("asked").alias("asked"))
    texts = join_hot(docs.select(F.col("doc_id").alias("class_id"), "text"), chosen, ["class_id"])
    # rows that repeat an id with other texts stay apart from the class of that id only by their text: the first one speaks
    one = Window.partitionBy("class_id").orderBy("text")
    texts = texts.withColumn("turn", F.row_number().over(one)).filter("turn = 1")
    known = settle(texts.select("class_id", "text").mapInArrow(_described, "class_id long, fingerprint string, bands array<long>"))
    bands = join_hot(known, chosen, ["class_id"]).select("class_id", "asked", F.posexplode("bands").alias("band", "key"))
    asking = bands.filter("asked").select(F.col("class_id").alias("query_class"), "band", "key")
    pairs = join_hot(bands.select("class_id", "band", "key"), asking, ["band", "key"]).filter("class_id != query_class")
    pairs = pairs.select("query_class", "class_id").distinct()
    prints = known.select("class_id", "fingerprint")
    pairs = join_hot(pairs, prints, ["class_id"]).withColumnRenamed("fingerprint", "own")
    pairs = join_hot(pairs, prints.select(F.col("class_id").alias("query_class"), "fingerprint"), ["query_class"])
    likely = pairs.select("query_class", "class_id", "own", "fingerprint").mapInArrow(
        _estimates, "query_class long, class_id long, estimate double"
    )
    likely = settle(likely.filter(F.col("estimate") >= similarity - SLACK))
    wanted = likely.select(F.explode(F.array("query_class", "class_id")).alias("class_id")).distinct()
    sets = join_hot(texts.select("class_id", "text"), wanted, ["class_id"]).select("class_id", "text").mapInArrow(_sets, "class_id long, shingles array<long>")
    both = join_hot(likely, sets, ["class_id"]).withColumnRenamed("shingles", "own")
    both = join_hot(both, sets.select(F.col("class_id").alias("query_class"), "shingles"), ["query_class"])
    shared = F.size(F.array_intersect("own", "shingles"))
    verified = both.withColumn("jaccard", shared / (F.size("own") + F.size("shingles") - shared))
    found = verified.filter(F.col("jaccard") >= similarity).select("query_class", "class_id", "estimate", "jaccard")
    return found, members.select("doc_id", "class_id", "is_query")
