"""Vectorised helpers that run inside tasks: bytes, words and hashes of Arrow columns.

A text column reaches Python as one buffer of UTF-8 bytes with offsets. Words,
rolling hashes and set members of all its rows are computed on that buffer at once,
a few MB at a time. A row with a null text counts as a row without bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 2_000_000
#: The same where a step holds many arrays of some times its bytes, and nothing is folded or judged by step.
SMALL_STEP = 500_000
#: Bytes of text whose entries are sorted into buckets together.
BLOCK_BYTES = 12_000_000
#: A missing doc_id orders after every other one.
NO_ID = np.iinfo(np.int64).max

BASE = 0x9E3779B97F4A7C15 | 1
TOKEN_BASE = 0xD6E8FEB86659FD93 | 1
WORD = 1 << 64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1024)
        tables = []
        for step in (base, pow(base, -1, WORD)):
            t = np.full(size, step, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        have = (tables[0], tables[1])
        if size <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """``xxhash64`` of a bigint column, as Spark computes it."""
    p1, p2, p3, p4, p5 = (
        np.uint64(v)
        for v in (
            0x9E3779B185EBCA87,
            0xC2B2AE3D27D4EB4F,
            0x165667B19E3779F9,
            0x85EBCA77C2B2AE63,
            0x27D4EB2F165667C5,
        )
    )
    k = _rotl(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = np.full(len(x), 42 + 8, dtype=np.uint64) + p5
    h = _rotl(h ^ k, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    return h ^ (h >> np.uint64(32))


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """``pmod(xxhash64(id), groups)``."""
    return np.mod(spark_hash(ids).view(np.int64), groups)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts; one more offset than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def id_values(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def steps(offs: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into blocks of about ``BLOCK_BYTES`` of text."""
    for batch in batches:
        _, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in steps(offs, BLOCK_BYTES):
            yield batch.slice(lo, hi - lo)


def word_spans(
    buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every row (one more than rows)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    space = breaks[buf]
    edge = np.empty(len(buf) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    inner = offs[(offs > 0) & (offs < len(buf))]
    edge[inner] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[inner] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs, side="left")


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: polynomial prefix sums, then mixed."""
    up, down = powers(BASE, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every ``width`` consecutive values of a row, and its position.

    ``first`` holds the first value of every row; windows do not cross rows.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(TOKEN_BASE, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    inside = np.ones(n, dtype=bool)
    for back in range(1, width):  # the windows that would reach into the next row
        at = first[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    # rows shorter than the width may leave windows over two boundaries: all are marked above
    at = np.flatnonzero(inside)
    return mix((sums[at + width] - sums[at]) * down[at]), at


def words_of(column: pa.Array, lo: int, hi: int, lower: bool = False):
    """Word hashes of rows lo..hi with their spans: (bytes, starts, ends, first word per row, hashes)."""
    buf, offs = text_bytes(column.slice(lo, hi - lo))
    if lower:
        buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    return buf, starts, ends, first, span_hashes(buf, starts, ends)


def joined_words(
    buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every row joined by one space: bytes, and where each row starts in them."""
    order = np.flatnonzero(keep)
    count = np.concatenate(([0], np.cumsum(keep)))[first]
    last = np.zeros(len(order), dtype=bool)
    last[count[1:][np.diff(count) > 0] - 1] = True
    begin, end = starts[order], ends[order]
    edge = np.zeros(len(buf) + 2, dtype=np.int8)
    edge[begin] += 1
    stop = np.where(last, end, end + 1)  # the byte after a word that another one follows is white space
    np.add.at(edge, stop, -1)
    mask = np.cumsum(edge[: len(buf)], dtype=np.int8) > 0
    out = buf.copy()
    out[end[~last]] = 0x20
    size = np.where(last, end - begin, end - begin + 1)
    return out[mask], np.concatenate(([0], np.cumsum(size)))[count]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash space, in order."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, with the end appended; and the key of each run."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64), sorted_keys
    at = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return np.append(at, len(sorted_keys)), sorted_keys[at]


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal neighbours."""
    at, keys = cuts(values)
    return keys, np.diff(at)
