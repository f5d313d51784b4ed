"""Phrase collocations by a weighted de Bruijn graph of words.

Nodes are sequences of words, an edge is a phrase of ``longest`` words that joins its first
words to its last ones. Only edges are counted in the text; what a piece has behind
its last edge is kept as end corrections, one for each shorter length. Counts of all
shorter phrases follow: the flow out of a node plus the pieces that end there.

1. ``_word_counts`` counts words, folded per block and then by Spark. A phrase counts as
   often as its rarest word at most, so words below ``min_count`` end a piece like
   punctuation does and no candidate or part of one is lost. The frequent words reach
   the scan as a bit table of fixed size; a word that it takes for frequent by
   mistake costs work, not correctness.
2. ``_edges`` folds the edges of a block. One exchange by the first two words and a sort
   bring equal edges and all edges of a node together.
3. ``_Flow`` reads them as a stream and adds up four levels at once with a state of
   one row per level. Where the whole flow of a node leaves by one edge the path is
   unary: it is compacted into one row that stands for all its lengths. Only the
   longest phrase of such a path can survive, as it holds the others with equal counts.
4. Cuts, containment and ranks are joins and aggregations over the phrases left,
   at most one per ``min_count`` words.

Words are compared by a 64-bit hash that includes the language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..session import settle
from . import kernels as K

LONGEST = 4
MIN_COUNT = 30
SHARE = 80
TOP = 2_000
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Bits of the table of frequent words; its size in bytes is an eighth of 2**BITS, whatever the input.
BITS = 26
#: Edges that go to Spark at once.
SENT_ROWS = 1 << 16
#: Parts that each language's ranking is first cut into.
PARTS = 64

_CUTS = np.zeros(256, dtype=bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAKS = _CUTS.copy()
_BREAKS[[0x20, 0x09]] = True


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _words(block: pa.RecordBatch):
    """Words of a block step by step: (bytes, starts, ends, hashes, language numbers, joined to the next word)."""
    langs, text = block.column(0).dictionary_encode(), block.column(1)
    seeds = np.array([_seed(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
    number = langs.indices.to_numpy(zero_copy_only=False)
    _, offs = K.text_bytes(text)
    for lo, hi in K.steps(offs):
        buf, at = K.text_bytes(text.slice(lo, hi - lo))
        buf = K.LOWER[buf]
        starts, ends, first = K.word_spans(buf, at, _BREAKS)
        row = np.repeat(np.arange(lo, hi), np.diff(first))
        h = K.mix(K.span_hashes(buf, starts, ends) ^ seeds[number[row]]) if len(starts) else np.zeros(0, np.uint64)
        h[h == 0] = 1
        cut = np.concatenate(([0], np.cumsum(_CUTS[buf])))
        joined = np.zeros(len(h), dtype=bool)
        if len(h) > 1:
            joined[:-1] = (row[1:] == row[:-1]) & (cut[starts[1:]] == cut[ends[:-1]])
        yield buf, starts, ends, h, number[row], joined


def _strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offs = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])
    return pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(buf[at])]
    ).cast(pa.string())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, h, n`` of each step of a block, and a row without word for all words of a language."""
    for block in K.blocks(batches, "text"):
        names = block.column(0).dictionary_encode().dictionary
        for buf, starts, ends, h, lang, _ in _words(block):
            kinds, where, n = np.unique(h, return_index=True, return_counts=True)
            every = np.bincount(lang, minlength=len(names))
            present = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(np.concatenate((lang[where], present)))),
                    pa.concat_arrays([_strings(buf, starts[where], ends[where]), pa.nulls(len(present), pa.string())]),
                    pa.array(np.concatenate((kinds.view(np.int64), np.zeros(len(present), np.int64)))),
                    pa.array(np.concatenate((n, every[present])).astype(np.int64)),
                ],
                names=["lang", "word", "h", "n"],
            )


def _bit_table(words: DataFrame) -> np.ndarray:
    """The frequent words as bits, by the low bits of their hash."""
    low = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    parts = words.groupBy(F.shiftright(low, 15).alias("part")).agg(
        F.bitmap_construct_agg(low.bitwiseAND(F.lit(0x7FFF))).alias("bits")
    )
    table = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for part, bits in parts.collect():  # at most 2**(BITS - 15) rows of 4 KB
        table[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return table


def _columns(longest: int) -> list[str]:
    return [f"w{i + 1}" for i in range(longest)]


def grams(h: np.ndarray, joined: np.ndarray, longest: int) -> np.ndarray:
    """Edges of pieces and the end corrections of every shorter length, zeros behind them."""
    out = []
    for size in range(longest, 0, -1):
        whole = np.ones(max(0, len(h) - size + 1), dtype=bool)
        for i in range(size - 1):
            whole &= joined[i : i + len(whole)]
        if size < longest:  # only what the piece ends with
            whole &= ~joined[size - 1 : size - 1 + len(whole)]
        at = np.flatnonzero(whole)
        rows = np.zeros((len(at), longest), dtype=np.uint64)
        for i in range(size):
            rows[:, i] = h[at + i]
        out.append(rows)
    return np.concatenate(out)


def _fold(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.zeros(len(rows), dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = K.mix(key * np.uint64(K.BASE) + rows[:, i] + np.uint64(1))
    order = np.argsort(key, kind="stable")
    at, _ = K.cuts(key[order])
    return rows[order[at[:-1]]], np.add.reduceat(n[order], at[:-1]) if len(n) else n


def _edges(table, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for block in K.blocks(batches, "text"):
            found = []
            for *_, h, _, joined in _words(block):
                low = h & np.uint64((1 << BITS) - 1)
                known = (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                joined[:-1] &= known[1:]
                rows = grams(h[known], joined[known], longest)
                found.append(_fold(rows, np.ones(len(rows), np.int64)))
            if not found:
                continue
            rows, n = _fold(np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found]))
            del found
            order = np.lexsort((rows[:, 1], rows[:, 0]))  # like neighbours take less room in the shuffle
            rows, n = rows[order].view(np.int64), n[order]
            for lo in range(0, len(n), SENT_ROWS):
                part = rows[lo : lo + SENT_ROWS]
                columns = [pa.array(np.ascontiguousarray(part[:, i])) for i in range(longest)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[lo : lo + SENT_ROWS])], names=[*_columns(longest), "n"])

    return run


class _Flow:
    """Sums over sorted edges, level by level; holds one row of each level back.

    A row is (words, flow, length of its path, open): a row that is not open stands
    for a group whose own rows have been given out already.
    """

    def __init__(self, longest: int, least: int):
        self.longest, self.least = longest, least
        self.held: dict[int, tuple] = {}
        self.out: list[tuple] = []

    def add(self, words: np.ndarray, flow: np.ndarray, last: bool = False) -> tuple:
        """The paths that are settled now: words, shortest and longest length, flow."""
        rows = (words, flow, (words != 0).sum(axis=1), np.ones(len(words), dtype=bool))
        for level in range(self.longest, 0, -1):
            rows = self._level(level, rows, last)
        words, flow, length, _ = rows
        self.out.append((words, np.ones(len(words), np.int64), length, flow))
        done = tuple(np.concatenate(c) for c in zip(*self.out, strict=True))
        self.out = []
        return done

    def _level(self, level: int, rows: tuple, last: bool) -> tuple:
        if level in self.held:
            rows = tuple(np.concatenate(c) for c in zip(self.held.pop(level), rows, strict=True))
        words, flow, length, fresh = rows
        if not len(words):
            return rows
        new = np.concatenate(([True], (words[1:, :level] != words[:-1, :level]).any(axis=1)))
        at = np.flatnonzero(new)
        total = np.add.reduceat(flow, at)
        if level == self.longest:
            words, length, fresh = words[at], length[at], fresh[at]
        else:
            count = np.add.reduceat(np.where(fresh, 1, 2), at)
            many = count > 1
            if level == 1:  # the first word's count is summed over tasks, so its path stays apart
                many[:] = True
            give = many[np.cumsum(new) - 1] & fresh & (words[:, level] != 0) & (flow >= self.least)
            self.out.append((words[give], np.full(give.sum(), level + 1), length[give], flow[give]))
            words, length = words[at], length[at]
            words[many, level:] = 0
            length = np.where(many, np.minimum(length, level), length)
            fresh = ~many
        if not last:
            self.held[level] = (words[-1:], total[-1:], length[-1:], fresh[-1:])
            words, total, length = words[:-1], total[:-1], length[:-1]
        return words, total, length, np.ones(len(words), dtype=bool)


def _paths(longest: int, least: int):
    names = [*_columns(longest), "lo", "hi", "f"]

    def batch(done: tuple) -> pa.RecordBatch:
        words, lo, hi, f = done
        columns = [pa.array(np.ascontiguousarray(words[:, i])) for i in range(longest)]
        columns += [pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(f.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = _Flow(longest, least)
        for b in batches:
            words = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(longest)], axis=1)
            done = flow.add(words, b.column(longest).to_numpy(zero_copy_only=False))
            if len(done[0]):
                yield batch(done)
        yield batch(flow.add(np.zeros((0, longest), np.int64), np.zeros(0, np.int64), last=True))

    return run


def _pieces(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))


def frequent_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, word, h, n`` of words with ``min_count`` occurrences; with a null word, all of the language."""
    counted = _pieces(docs, text_col, lang_col).mapInArrow(_word_counts, "lang string, word string, h long, n long")
    total = counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    return total.filter((F.col("n") >= min_count) | F.col("word").isNull())


def strong_paths(
    docs: DataFrame, words: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST
) -> DataFrame:
    """Compacted paths ``w1.., lo, hi, f``: the first lo to hi words each occur f times.

    Rows of one word are sums of one task. ``words`` is what ``frequent_words`` returns.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(_bit_table(words.filter("word is not null")))
    names = _columns(longest)
    kinds = ", ".join(f"{c} long" for c in names)
    edges = _pieces(docs, text_col, lang_col).mapInArrow(_edges(table, longest), f"{kinds}, n long")
    near = edges.repartition("w1", "w2").sortWithinPartitions(*names)
    return near.mapInArrow(_paths(longest, min_count), f"{kinds}, lo int, hi int, f long")


def _exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    share: int = SHARE,
    top: int = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best ``top`` phrases of 2 to ``longest`` words.

    A to Z are lower-cased; punctuation and line ends cut pieces, blanks cut words. a, l and r
    count the phrase and the two parts of its worst cut, n all words of the language.
    Phrases inside a longer one with at least ``share`` percent of their count are left
    out. A null language is ``und``, together with rows that say so. Null, empty and
    blank texts add nothing; a language without a phrase has no row. Repeated rows count
    each time. An empty table gives an empty result.
    """
    words = settle(frequent_words(docs, text_col, lang_col, min_count))
    paths = settle(strong_paths(docs, words, text_col, lang_col, min_count, longest))
    ws = F.array(*_columns(longest))
    single = paths.filter("hi = 1").groupBy("w1").agg(F.sum("f").alias("f")).select(F.array("w1").alias("ws"), "f")
    several = paths.filter("hi > 1").select(ws.alias("ws"), "f", F.explode(F.sequence("lo", "hi")).alias("size"))
    counts = single.unionByName(several.select(F.slice("ws", 1, F.col("size")).alias("ws"), "f"))
    found = paths.filter("hi > 1").select(F.slice(ws, 1, F.col("hi")).alias("ws"), F.col("f").alias("a"))

    # parts of longer phrases, each with the largest count among those that hold it
    size = F.size("ws")
    parts = found.filter(size > 2).select("a", "ws", F.explode(F.sequence(F.lit(2), size - 1)).alias("len"))
    parts = parts.select("a", "ws", "len", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1)).alias("at"))
    held = parts.groupBy(F.expr("slice(ws, at, len)").alias("ws")).agg(F.max("a").alias("longer"))
    kept = join_hot(found, held, ["ws"], "left").filter(
        F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * share)
    )

    cuts = kept.select("ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.select("ws", "a", "k", F.expr("slice(ws, 1, k)").alias("left"), F.expr("slice(ws, k + 1, size(ws) - k)").alias("right"))
    cuts = join_hot(cuts, counts.select(F.col("ws").alias("left"), F.col("f").alias("l")), ["left"])
    cuts = join_hot(cuts, counts.select(F.col("ws").alias("right"), F.col("f").alias("r")), ["right"])
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = cuts.groupBy("ws", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spelled = worst.select("ws", "a", "cut", F.posexplode("ws").alias("at", "h"))
    spelled = join_hot(spelled, words.filter("word is not null").select("h", "lang", "word"), ["h"])
    spelled = spelled.groupBy("ws", "a", "cut").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("said")
    )
    phrases = spelled.select("lang", F.array_join("said.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score", F.pmod(F.hash("ws"), F.lit(PARTS)).alias("part"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ahead = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    totals = words.filter("word is null").select("lang", "n")
    return join_hot(ranked, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
