"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted by Spark.

A word goes when a window that covers it also starts in a document with a smaller
id. The work runs in three steps:

1. ``_scatter`` hashes every window of a block of documents. Of equal windows in one
   block only the one of the smallest id goes on (the others are known to repeat), so
   a window that a third of all documents share leaves one entry per block. Entries
   travel as packed arrays, one row per block and range of the hash space.
2. ``_repeats`` sorts the entries of one range and reports those whose window also has
   an entry with a smaller id.
3. ``_removal`` brings the reported windows back to their documents, merges
   overlapping ones into maximal intervals and drops the words below them.

Ranges and groups follow ``spark.sql.shuffle.partitions``; a task holds one range or
one group. Windows are compared by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import shuffle_width

WIDTH = 13
#: With at least 256 ranges, what is left of a hash fits seven bytes.
LEAST_RANGES = 256

PACKED = "kind int, part int, body binary"
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string, kept string"
DIGEST = ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"]


def _pack(h: np.ndarray, ids: np.ndarray) -> bytes:
    """Seven bytes of each hash, and the ids as runs."""
    keys, counts = K.run_lengths(ids)
    head = np.array([len(h), len(keys)], dtype=np.int64)
    low = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return b"".join((head.tobytes(), keys.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), low.tobytes()))


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, runs = np.frombuffer(body, "<i8", 2)
    keys = np.frombuffer(body, "<i8", runs, 16)
    counts = np.frombuffer(body, "<u4", runs, 16 + 8 * runs)
    full = np.zeros((n, 8), dtype=np.uint8)
    full[:, :7] = np.frombuffer(body, np.uint8, 7 * n, 16 + 12 * runs).reshape(n, 7)
    return full.view("<u8").ravel(), np.repeat(keys, counts)


def _parts(kind: int, part: np.ndarray, h: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed row per part; entries keep the order of their ids."""
    order = np.lexsort((ids, part))
    part, h, ids = part[order], h[order], ids[order]
    at, keys = K.cuts(part)
    for i, key in enumerate(keys):
        yield kind, int(key), _pack(h[at[i] : at[i + 1]], ids[at[i] : at[i + 1]])


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, bodies = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())],
        names=["kind", "part", "body"],
    )


def _tail(h: np.ndarray) -> np.ndarray:
    """A hash less the top byte; the number of its range gives that back."""
    return h & np.uint64((1 << 56) - 1)


def _whole(bucket: np.ndarray, tail: np.ndarray, ranges: int) -> np.ndarray:
    low = (((bucket << np.uint64(32)) + np.uint64(ranges - 1)) // np.uint64(ranges)) << np.uint64(32)
    return low + ((tail - low) & np.uint64((1 << 56) - 1))


def _least(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new hash starts in sorted (hash, id) pairs, and the smallest id of each entry's hash."""
    new = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
    return new, ids[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]


def _windows(column: pa.Array, width: int, lo: int, hi: int):
    buf, starts, ends, first, words = K.words_of(column, lo, hi)
    h, at = K.window_hashes(words, first, width)
    row = np.searchsorted(first, at, side="right") - 1
    return buf, starts, ends, first, h, at, row


def _scatter(width: int, ranges: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, "text"):
            ids, text = K.id_values(block.column(0)), block.column(1)
            _, offs = K.text_bytes(text)
            hashes, owners = [], []
            for lo, hi in K.steps(offs):
                *_, h, _, row = _windows(text, width, lo, hi)
                hashes.append(h)
                owners.append(ids[lo:hi][row])
            h, own = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owners or [ids[:0]])
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            new, least = _least(h, own)
            again = (own > least) & np.concatenate(([False], (own[1:] != own[:-1])))[: len(h)]
            found = list(_parts(0, K.bucket_of(h[new], ranges), _tail(h[new]), own[new]))
            # windows known to repeat inside the block go straight to their documents
            found += _home(h[again], own[again], ranges, groups)
            if found:
                yield _rows(found)

    return run


def _home(h: np.ndarray, ids: np.ndarray, ranges: int, groups: int) -> list[tuple[int, int, bytes]]:
    """Rows for the documents' groups: whole hashes as (range, rest) by group."""
    out = []
    group = K.group_of(ids, groups)
    bucket = K.bucket_of(h, ranges).astype(np.int64)
    order = np.lexsort((bucket, group))
    group, bucket, h, ids = group[order], bucket[order], h[order], ids[order]
    at, keys = K.cuts(group)
    for i, key in enumerate(keys):
        s = slice(at[i], at[i + 1])
        runs, counts = K.run_lengths(bucket[s])
        head = np.array([len(runs)], "<i8").tobytes() + runs.astype("<i4").tobytes() + counts.astype("<u4").tobytes()
        out.append((1, int(key), head + _pack(_tail(h[s]), ids[s])))
    return out


def _read_home(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = np.frombuffer(body, "<i8", 1)
    runs = np.frombuffer(body, "<i4", n, 8)
    counts = np.frombuffer(body, "<u4", n, 8 + 4 * n)
    tail, ids = _unpack(body[8 + 8 * n :])
    return np.repeat(runs, counts).astype(np.uint64), tail, ids


def _repeats(ranges: int, groups: int):
    def run(key: tuple, packed: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            return packed
        pairs = [_unpack(b.as_py()) for b in packed.column("body")]
        tail, ids = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        order = np.lexsort((ids, tail))
        tail, ids = tail[order], ids[order]
        _, least = _least(tail, ids)
        again = ids > least
        tail, ids = tail[again], ids[again]
        group = K.group_of(ids, groups)
        order = np.lexsort((ids, group))
        group, tail, ids = group[order], tail[order], ids[order]
        at, keys = K.cuts(group)
        out = []
        for i, g in enumerate(keys):
            s = slice(at[i], at[i + 1])
            head = np.array([1], "<i8").tobytes() + np.array([key[1].as_py()], "<i4").tobytes()
            head += np.array([at[i + 1] - at[i]], "<u4").tobytes()
            out.append((1, int(g), head + _pack(tail[s], ids[s])))
        return pa.Table.from_batches([_rows(out)])

    return run


def _signature(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One value for a window of a document, to look it up among those reported."""
    return K.mix(h) ^ K.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(K.BASE))


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``at``."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, np.minimum(at + width, n), -1)
    return np.cumsum(depth[:-1]) > 0


def _removal(width: int, ranges: int, with_text: bool):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        found = [_read_home(b.as_py()) for b in flags.column("body")]
        known = [_signature(_whole(bucket, tail, ranges), own) for bucket, tail, own in found]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        docs = docs.combine_chunks()
        ids, text = K.id_values(docs.column("doc_id")), docs.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        out: list[list] = [[] for _ in range(6)]
        _, offs = K.text_bytes(text)
        for lo, hi in K.steps(offs):
            buf, starts, ends, first, h, at, row = _windows(text, width, lo, hi)
            if len(known):
                sig = _signature(h, ids[lo:hi][row])
                spot = np.minimum(np.searchsorted(known, sig), len(known) - 1)
                at = at[known[spot] == sig]
            else:
                at = at[:0]
            gone = covered(at, width, len(starts))
            bytes_kept, kept_at = K.joined_words(buf, starts, ends, first, ~gone)
            for i in range(hi - lo):
                out_of = gone[first[i] : first[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], out_of.astype(np.int8), [0]))))
                kept = bytes_kept[kept_at[i] : kept_at[i + 1]].tobytes()
                out[0].append(int(first[i + 1] - first[i]))
                out[1].append(int(out_of.sum()))
                out[2].append(len(edges) // 2)
                out[3].append(edges.reshape(-1, 2).tolist() if with_text else None)
                out[4].append(hashlib.sha256(kept).hexdigest())
                out[5].append(kept.decode("utf-8", "replace") if with_text else None)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.string()]
        columns = [docs.column("doc_id").cast(pa.int64())] + [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True
) -> DataFrame:
    """Drop every word under a window of ``width`` words that an earlier document has.

    Returns one row per input row: ``doc_id, n_words, n_removed, n_spans, spans``
    (word intervals, end exclusive), ``kept_sha256, kept`` (spans and text are null
    without ``with_text``). A null or empty text has no words and the hash of the empty
    string. Rows with the same id count as one document: they do not remove each
    other's words, and each gets its row. A null id counts as larger than any other.
    Texts below ``width`` words keep everything. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranges = max(LEAST_RANGES, shuffle_width(spark))
    groups = max(8, 2 * shuffle_width(spark))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scattered = docs.mapInArrow(_scatter(width, ranges, groups), PACKED)
    found = scattered.groupBy("kind", "part").applyInArrow(_repeats(ranges, groups), PACKED)
    flags = found.select(F.col("part").alias("g"), "body")
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(int(K.NO_ID)))), F.lit(groups)).cast("int")
    return (
        docs.withColumn("g", group)
        .groupBy("g")
        .cogroup(flags.groupBy("g"))
        .applyInArrow(_removal(width, ranges, with_text), RESULT)
    )
