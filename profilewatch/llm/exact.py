"""Exact dedup by chunk recipes.

A text, with every run of white space replaced by one space, is cut where a rolling
hash of its last bytes says so: equal passages are cut alike wherever they stand. A
document becomes its recipe, the ordered list of its chunks' identifiers, and equal
texts are equal recipes. Contents move once: chunks are folded by digest with map-side
combine, and a digest counts as an identifier only when the smallest and the largest
content below it are the same bytes. Documents with a digest that fails this are
compared by their whole text instead. Only recipes, a few bytes per kilobyte, are
grouped and joined.

A recipe that a third of all rows share is one row per task after the partial
aggregation; the join back leaves Spark free to split it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..session import settle
from . import kernels as K

#: Bytes the rolling hash looks back on, bits that must be zero at a cut, longest chunk.
LOOK_BACK = 48
CUT_BITS = 11
MAX_CHUNK = 1 << 15
DIGEST_BYTES = 16


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of white space inside a row as one space."""
    space = K.SPACE[buf]
    again = np.zeros(len(buf), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    starts = offs[:-1][offs[:-1] < len(buf)]
    again[starts] = False
    keep = ~again
    out = np.where(space, np.uint8(0x20), buf)[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[offs]


def chunk_ends(buf: np.ndarray, offs: np.ndarray, bits: int = CUT_BITS) -> list[np.ndarray]:
    """Per row the ends of its chunks, as positions in the buffer."""
    n = len(buf)
    cut = np.zeros(0, np.int64)
    if n > LOOK_BACK:
        up, down = K.powers(K.BASE, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        rolled = (sums[LOOK_BACK:] - sums[:-LOOK_BACK]) * down[: n + 1 - LOOK_BACK]
        # the high bits of the product mix all the bytes
        rolled *= np.uint64(0xD1B54A32D192ED03)
        cut = np.flatnonzero((rolled >> np.uint64(64 - bits)) == 0) + LOOK_BACK
    out = []
    at = np.searchsorted(cut, offs)
    for i in range(len(offs) - 1):
        lo, hi = int(offs[i]), int(offs[i + 1])
        own = cut[at[i] : at[i + 1]]
        own = own[(own - LOOK_BACK >= lo) & (own < hi)]
        ends, last = [], lo
        for e in [*own.tolist(), hi]:
            while e - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if e > last or (e == hi and not ends):
                ends.append(e)
                last = e
        out.append(np.array(ends, dtype=np.int64))
    return out


def _pieces(column: pa.Array, digest_bytes: int):
    """Per row: digest of the whole normalised text, and its (digest, content) chunks."""
    _, offs = K.text_bytes(column)
    for lo, hi in K.steps(offs):
        buf, at = normalised(*K.text_bytes(column.slice(lo, hi - lo)))
        whole = buf.tobytes()
        for i, ends in enumerate(chunk_ends(buf, at)):
            begin = int(at[i])
            chunks = []
            for e in ends.tolist():
                body = whole[begin:e]
                chunks.append((hashlib.blake2b(body, digest_size=digest_bytes).digest(), body))
                begin = e
            yield hashlib.sha256(whole[at[i] : at[i + 1]]).hexdigest(), chunks


def _recipes(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, recipes = [], []
            for sha, chunks in _pieces(batch.column(1), digest_bytes):
                hashes.append(sha)
                recipes.append(b"".join([c[0] for c in chunks]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.string()), pa.array(recipes, pa.binary())],
                names=["doc_id", "text_sha256", "recipe"],
            )

    return run


def _contents(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(iter([batch]), "text"):
                seen = {c for _, chunks in _pieces(block.column(1), digest_bytes) for c in chunks}
                digests, bodies = zip(*seen, strict=True) if seen else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], names=["digest", "body"]
                )

    return run


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, at = normalised(*K.text_bytes(batch.column(1)))
        whole = buf.tobytes()
        texts = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every input row.

    Of equal texts the row with the smallest id stays. A null text counts as empty;
    all empty texts are equal. White space alone is one space and not equal to empty.
    Repeated rows with the same id and text are all counted in ``group_size`` and share
    ``kept``. A null id loses against any other. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    recipes = settle(docs.mapInArrow(_recipes(digest_bytes), "doc_id long, text_sha256 string, recipe binary"))
    chunks = docs.mapInArrow(_contents(digest_bytes), "digest binary, body binary")
    verified = chunks.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    clashes = settle(verified.filter("low != high").select("digest"))
    key = F.concat(F.lit("r").cast("binary"), F.col("recipe"))
    if clashes.isEmpty():
        keyed = recipes.withColumn("key", key)
    else:
        size = digest_bytes
        parts = recipes.select(
            "doc_id",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), (F.length("recipe") / size).cast("int") - 1),
                    lambda i: F.substring("recipe", i * size + 1, F.lit(size)),
                )
            ).alias("digest"),
        )
        doubtful = parts.join(clashes, "digest", "left_semi").select("doc_id").distinct()
        same = F.expr("doc_id <=> id")
        texts = docs.mapInArrow(_whole_texts, "doc_id long, text binary")
        doubtful = doubtful.withColumnRenamed("doc_id", "id")
        whole = texts.join(doubtful, same, "left_semi").select(
            "doc_id", F.sha2("text", 256).alias("text_sha256"), F.concat(F.lit("t").cast("binary"), "text").alias("key")
        )
        keyed = recipes.join(doubtful, same, "left_anti").select("doc_id", "text_sha256", key.alias("key")).unionByName(whole)
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_hot(keyed, groups, ["key"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        "text_sha256",
    )
