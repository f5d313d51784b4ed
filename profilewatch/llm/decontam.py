"""Benchmark decontamination by spaced seeds.

A mask selects some positions of a window of words; words at the others do not enter
the hash. So a window still meets its source when a word at an ignored position was
replaced, and several masks together tolerate replacements anywhere. Every window of
every document is hashed under every mask and looked up among the hashes of the test
items. A hit fixes an item and an offset; the overlap around it is then compared word by
word on the whole length of the item, and counts when a stretch of it has enough equal
words at a high enough share. The masks leave none out: every stretch of ``MIN_EQUAL`` equal
words at ``MIN_SHARE`` holds all counting positions of one of them. For a stretch of 26 words or
more has a half that qualifies by itself, so only the patterns of at most 25 words that hold no
shorter one need a mask; ``tests/llm/test_decontam.py`` goes through all of them.

Words are runs of letters and digits with A-Z in lower case, so punctuation, line
breaks and case do not hide a passage. In scripts that put no spaces between words (Chinese,
Japanese, Thai, Lao, Burmese, Khmer) every character is a word.

An item of fewer than ``MIN_EQUAL`` words has no such stretch: it is looked up as a whole.

The test side is hashed first. While it has at most ``MAX_SENT`` hashes it is sent to
every task as sorted arrays, and the documents are read once without a shuffle.
Above, it is handled in slices of that size, a pass over the documents each; results
of the passes are united per document and item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Positions that count. Weight 6 of spans 7 to 14: a cover of all stretches that MIN_EQUAL and MIN_SHARE allow.
MASKS = (
    "1110111",
    "100101111",
    "111010011",
    "1010001111",
    "11010000010011",
    "11110100001",
    "11000100111",
    "111100101",
    "110110101",
    "11100100000011",
    "1101010000011",
    "11001010011",
)
#: Equal words, and their share of the stretch, that make an overlap.
MIN_EQUAL = 10
MIN_SHARE = 0.7
#: Test hashes that are sent to the tasks at once (16 bytes each).
MAX_SENT = 4_000_000

RESULT = "doc_id long, item_id long, n_equal long, n_span long, doc_start long, item_start long"

#: What separates words here: all ASCII that is neither letter nor digit.
_BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

#: Second bytes of U+0080 to U+00BF that are no part of a word.
_LATIN_MARK = np.array([0x80 <= c <= 0xBF and not chr(c).isalnum() for c in range(256)])


def _characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with a space on both sides of every character of a script without spaces.

    The punctuation of these scripts is space, and so are quotes, dashes, ellipses and other general
    punctuation (U+2000 to U+206F), and the no-break space, quotes and marks of Latin 1 that are
    neither letters nor numbers.
    """
    pair = np.flatnonzero(buf[:-1] == 0xC2)
    pair = pair[_LATIN_MARK[buf[pair + 1]]]
    lead = np.flatnonzero(buf >= 0xE0)
    if len(pair):
        buf = buf.copy()
        buf[pair] = buf[pair + 1] = 0x20
    lead = lead[lead + 2 < len(buf)]
    if not len(lead):
        return buf, offs
    x, y, z = buf[lead], buf[lead + 1], buf[lead + 2]
    mark = (x == 0xE2) & ((y == 0x80) | (y == 0x81) & (z <= 0xAF))
    mark |= (x == 0xE3) & (y == 0x80) & (z < 0xA0) & ~((z >= 0x85) & (z <= 0x87))
    mark |= (x == 0xEF) & (y == 0xBC) & ((z <= 0x8F) | (z >= 0x9A) & (z <= 0xA0))
    mark |= (x == 0xEF) & ((y == 0xBC) & (z >= 0xBB) | (y == 0xBD) & ((z == 0x80) | (z >= 0x9B) & (z <= 0xA5)))
    if mark.any():
        buf = buf.copy()
        for i in range(3):
            buf[lead[mark] + i] = 0x20
    own = (x == 0xE0) & (y >= 0xB8) & (y <= 0xBB)  # Thai, Lao
    own |= (x == 0xE1) & ((y >= 0x80) & (y <= 0x82) | (y == 0x9E) | (y == 0x9F))  # Burmese, Khmer
    own |= (x == 0xE2) & (y >= 0xBA) | (x >= 0xE3) & (x <= 0xE9)  # kana, ideographs
    own |= (x == 0xEF) & ((y >= 0xA4) & (y <= 0xAB) | (y == 0xBD) & (z >= 0xA6) | (y == 0xBE))
    own |= (x == 0xF0) & (y >= 0xA0)
    own &= ~mark
    begin = lead[own]
    if not len(begin):
        return buf, offs
    at = np.unique(np.concatenate((begin, begin + np.where(x[own] == 0xF0, 4, 3))))
    return np.insert(buf, at, 0x20), offs + np.searchsorted(at, offs)


def _tokens(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of rows lo..hi, and the first word of every row."""
    buf, offs = K.text_bytes(column.slice(lo, hi - lo))
    buf, offs = _characters(K.LOWER[buf], offs)
    starts, ends, first = K.word_spans(buf, offs, _BREAK)
    return K.span_hashes(buf, starts, ends), first


def seed_hashes(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the selected words of every window inside a row, and where it starts."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, len(mask) * 0x9E37 + int(mask, 2), dtype=np.uint64)
    for place, used in enumerate(mask):
        if used == "1":
            h = (h ^ words[place : place + n]) * np.uint64(K.TOKEN_BASE)
            h ^= h >> np.uint64(29)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return h[at], at


def best_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """The stretch of most equal words whose share of equal words is high enough: count, from, to.

    Longest first by sums of (equal - share): a stretch from i to j qualifies when its
    sum is not negative.
    """
    sums = np.concatenate(([0.0], np.cumsum(equal - min_share)))
    count = np.concatenate(([0], np.cumsum(equal)))
    best = (0, 0, 0)
    for i in np.flatnonzero(equal & ~np.concatenate(([False], equal[:-1]))):
        ok = np.flatnonzero(sums[i + 1 :] >= sums[i] - 1e-9)
        if len(ok):
            j = i + 1 + ok[-1]
            while j > i and not equal[j - 1]:
                j -= 1
            got = int(count[j] - count[i])
            if got > best[0]:
                best = (got, int(i), int(j))
    return best


class TestItems:
    """Words of the test items and the sorted hashes of their windows."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], masks: tuple[str, ...]):
        self.ids, self.words, self.masks = ids, words, masks
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        hashes, items, starts = [], [], []
        for mask in masks:
            h, at = seed_hashes(flat, first, mask)
            item = np.searchsorted(first, at, side="right") - 1
            hashes.append(h)
            items.append(item)
            starts.append(at - first[item])
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.item = np.concatenate(items)[order]
        self.start = np.concatenate(starts)[order]
        #: One bit per hash value's low 20 bits, to pass over most windows cheaply.
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.h & np.uint64((1 << 20) - 1)] = True

        #: By number of words the hashes of whole items, sorted, and their items.
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def look_up_whole(self, shorter_than: int) -> None:
        """Prepares the items of fewer words to be found as a whole."""
        size = np.array([len(w) for w in self.words], np.int64)
        for n in np.unique(size[(size > 0) & (size < shorter_than)]).tolist():
            own = np.flatnonzero(size == n)
            h, _ = seed_hashes(np.concatenate([self.words[i] for i in own]), np.arange(len(own) + 1) * n, "1" * n)
            order = np.argsort(h, kind="stable")
            self.whole[n] = h[order], own[order]

    def whole_items(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, number of words and first place of every short item that a row holds."""
        for n, (hashes, own) in self.whole.items():
            h, at = seed_hashes(words, first, "1" * n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = np.flatnonzero(hi > lo)
            row = np.searchsorted(first, at[some], side="right") - 1
            _, once = np.unique(np.stack((row, lo[some])), axis=1, return_index=True)
            for k in once.tolist():
                spot = int(at[some[k]])
                for item in own[lo[some[k]] : hi[some[k]]].tolist():
                    if np.array_equal(words[spot : spot + n], self.words[item]):
                        yield int(row[k]), item, n, spot

    def candidates(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (row, item, offset of the item's first word) of all hits."""
        found = []
        for mask in self.masks:
            h, at = seed_hashes(words, first, mask)
            some = self.maybe[h & np.uint64((1 << 20) - 1)]
            h, at = h[some], at[some]
            lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
            n = hi - lo
            at = np.repeat(at, n)
            spot = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            row = np.searchsorted(first, at, side="right") - 1
            found.append(np.stack((row, self.item[spot], at - self.start[spot])))
        pairs = np.concatenate(found, axis=1)
        return np.unique(pairs, axis=1).T if pairs.size else pairs.T


def _search(sent, min_equal: int, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            _, offs = K.text_bytes(text)
            for lo, hi in K.steps(offs):
                words, first = _tokens(text, lo, hi)
                best: dict[tuple[int, int], tuple] = {}
                for row, item, offset in items.candidates(words, first).tolist():
                    own = items.words[item]
                    a, b = max(offset, int(first[row])), min(offset + len(own), int(first[row + 1]))
                    equal = words[a:b] == own[a - offset : b - offset]
                    n, i, j = best_stretch(equal, min_share)
                    if n >= min_equal and n > best.get((row, item), (0,))[0]:
                        best[row, item] = (n, j - i, a + i - int(first[row]), a + i - offset)
                for row, item, n, spot in items.whole_items(words, first):
                    best[row, item] = (n, n, spot - int(first[row]), 0)
                if best:
                    rows = [r for r, _ in best]
                    columns = list(zip(*best.values(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(lo, hi - lo).take(pa.array(rows)).cast(pa.int64()), pa.array([int(items.ids[i]) for _, i in best], pa.int64())]
                        + [pa.array(c, pa.int64()) for c in columns],
                        names=["doc_id", "item_id", "n_equal", "n_span", "doc_start", "item_start"],
                    )

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, first = _tokens(batch.column(1), 0, batch.num_rows)
        rows = [words[a:b].astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["item_id", "words"])


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_equal: int = MIN_EQUAL,
    min_share: float = MIN_SHARE,
    max_sent: int = MAX_SENT,
) -> DataFrame:
    """Contaminated documents with the items they hold.

    One row per (document row, item) that overlap in a stretch of at least ``min_equal``
    equal words making up ``min_share`` of it: ``doc_id, item_id, n_equal, n_span,
    doc_start, item_start`` (the longest such stretch; positions are word numbers).
    Every such pair is found with the given masks; another ``min_equal`` or ``min_share`` needs its own.
    An item below ``min_equal`` words overlaps where all its words stand in a row. Null texts and
    texts without words overlap with nothing, nor do items with a null id. Equal items are all reported. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter("text IS NOT NULL")
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    words = tests.filter("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_item_words, "item_id long, words binary")
    words = words.filter(F.length("words") > 0)
    total = words.agg(F.sum(F.length("words") / 8 * len(masks))).first()[0] or 0
    slices = max(1, -(-int(total) // max_sent))
    found = None
    for k in range(slices):
        # a slice holds its share of the hashes; an item longer than that is one slice's own
        part = words if slices == 1 else words.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        rows = part.orderBy("item_id", "words").collect()
        held = TestItems(
            np.array([r["item_id"] for r in rows], np.int64), [np.frombuffer(r["words"], "<u8") for r in rows], masks
        )
        held.look_up_whole(min_equal)
        hits = texts.mapInArrow(_search(spark.sparkContext.broadcast(held), min_equal, min_share), RESULT)
        found = hits if found is None else found.unionByName(hits)
    return found


def clean(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows whose text overlaps with no item, all columns unchanged.

    Every row is judged by its own text, also rows without an id and rows that share one: they are
    told apart by a 64-bit hash of id and text.
    """
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    keyed = docs.select(row.alias("doc_id"), F.col(text_col).alias("text"))
    found = overlaps(keyed, items, **options).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(found, row == F.col("__doc"), "left_anti")
