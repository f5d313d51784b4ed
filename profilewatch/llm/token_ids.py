"""Token ids in a compact binary form, written in document order and read back.

Ids are replaced by their frequency rank in the corpus, so that the common ones are
small. A rank takes one to four whole bytes; its length is a two-bit code in a
separate run of control bytes, four codes to a byte. A reader turns a control byte
into four lengths with one table lookup and gathers all values of a block at once.

One pass encodes the texts. It computes every distinct piece of a text once: the vocabulary's
pattern never crosses white space, nor the border between an ASCII letter and most ASCII
punctuation (each sign is tried when an encoder starts), so a text's ids are those of its pieces in turn. Encoded documents are kept as a table, ranges of ids are dealt to tasks, and
each task writes its range as blocks. Counts per range (one per task) give the
position of every document in the whole.
"""

from __future__ import annotations

import functools
import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import kernels as K

END_ID = 1
#: Ids of a block at most, but for a longer document.
BLOCK_IDS = 1 << 20
#: Words given to the tokenizer in one call, and in one text; its result takes some hundred bytes a word.
AT_ONCE = 4096
IN_TEXT = 128
#: Places for remembered words (16 bytes each), and ids they may have in all before a worker starts anew.
SLOTS = 1 << 20
REMEMBER = 1 << 22

ENCODED = "doc_id long, ids binary"
BLOCKS = "part int, block long, first_id long, at long, n_ids long, doc_ids binary, sizes binary, control binary, data binary"
DIGEST = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"

#: Control byte -> length in bytes of each of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


class WordEncoder:
    """Ids of words by hash; texts become ids by lookup. A word here is a piece of text.

    A word is given to the tokenizer when it is met and not remembered. Every hash has one place,
    which a word that is met twice at once takes over from another. A worker keeps its encoder between tasks; what it remembers
    has no effect on the ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        #: Added tokens are found in the text as it is, before anything else.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = self._kinds()
        alike = all(self._ids(f"a{chr(c)}b{chr(c)}") == self._ids(f"a{chr(c + 32)}b{chr(c + 32)}") for c in range(ord("A"), ord("Z") + 1))
        self.fold = K.LOWER if alike else np.arange(256, dtype=np.uint8)
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _kinds(self) -> np.ndarray:
        """Byte -> 0 white space, 1 ASCII letter, 2 punctuation that always parts from letters, 3 anything else."""
        kind = np.full(256, 3, np.uint8)
        kind[K.SPACE] = 0
        kind[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1

        ids = self._ids
        letters = [chr(c) for c in range(256) if kind[c] == 1]
        for sign in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
            parts = all(
                ids(f"ab{sign}{x}") == ids("ab") + ids(sign) + ids(x) and ids(f"{x}{sign}{sign}ab") == ids(x) + ids(sign * 2) + ids("ab")
                for x in letters
            )
            if parts and not any(sign in t for t in self.special):
                kind[ord(sign)] = 2
        return kind

    def pieces(self, column: pa.Array, lo: int, hi: int):
        """Pieces of rows lo..hi: (bytes, starts, ends, first piece per row, hashes)."""
        buf, offs = K.text_bytes(column.slice(lo, hi - lo))
        if not len(buf):
            none = np.zeros(0, np.int64)
            return buf, none, none, np.zeros(len(offs), np.int64), np.zeros(0, np.uint64)
        low = self.fold[buf]  # where case has no effect on the ids
        raw = low.tobytes()
        if not any(t.lower().encode() in raw for t in self.special):
            buf = low  # else an added token might appear that the text does not have
        kind = self.kind[buf]
        edge = np.ones(len(buf) + 1, dtype=bool)
        both = kind[1:] * kind[:-1]
        edge[1:-1] = (both == 0) | (both == 2)  # white space on a side, or a letter beside a sign
        edge[offs] = True
        at = np.flatnonzero(edge)
        some = kind[at[:-1]] != 0
        starts, ends = at[:-1][some], at[1:][some]
        return buf, starts, ends, np.searchsorted(starts, offs, side="left"), K.span_hashes(buf, starts, ends)

    def forget(self) -> None:
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.slot_key = np.zeros(SLOTS, np.uint64)
        self.slot_key[0] = 1  # no hash of place 0, so an empty table knows no word
        self.slot_at = np.zeros(SLOTS, np.int32)
        self.slot_size = np.zeros(SLOTS, np.int32)

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has.

        Many words make one text, as they do in a document; where a token starts says whose it is.
        """
        texts = [" ".join(words[lo : lo + IN_TEXT]) for lo in range(0, len(words), IN_TEXT)]
        coded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ids = np.array(list(itertools.chain.from_iterable([c.ids for c in coded])), np.uint32)
        size = np.array([len(w) + 1 for w in words], np.int64)
        base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
        at = [np.array([a for a, _ in c.offsets], np.int64) + b for c, b in zip(coded, base.tolist(), strict=True)]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        owner = np.searchsorted(np.cumsum(size), at, side="right")
        return ids, np.bincount(owner, minlength=len(words))

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of the words are put, and how many each has."""
        sizes = np.zeros(len(words), np.int64)
        first = self.used
        for lo in range(0, len(words), AT_ONCE):
            ids, n = self._coded(words[lo : lo + AT_ONCE])
            sizes[lo : lo + len(n)] = n
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return first + np.cumsum(sizes) - sizes, sizes

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        """Ids of all words in turn, and how many each word has."""
        if self.used > REMEMBER:
            self.forget()
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        at, sizes = self.slot_at[slot].astype(np.int64), self.slot_size[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_key[slot] != hashes)
        if len(miss):
            keys, one, back, n = np.unique(hashes[miss], return_index=True, return_inverse=True, return_counts=True)
            whole = buf.tobytes()
            begin, end = starts[miss[one]].tolist(), ends[miss[one]].tolist()
            new_at, new_sizes = self.learn([whole[a:b].decode("utf-8", "replace") for a, b in zip(begin, end, strict=True)])
            place = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
            stay = (n > 1) | (self.slot_key[place] <= 1)  # a word met once takes no place from another
            place = place[stay]
            self.slot_key[place], self.slot_at[place], self.slot_size[place] = keys[stay], new_at[stay], new_sizes[stay]
            at[miss], sizes[miss] = new_at[back], new_sizes[back]
        return self.pool[spread(at, sizes)], sizes


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def spread(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices at..at+size of every entry in turn."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(at - (ends - sizes), sizes)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        width = np.dtype("<u2") if encoder.size <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            _, offs = K.text_bytes(text)
            for lo, hi in K.steps(offs, K.SMALL_STEP):
                buf, starts, ends, first, hashes = encoder.pieces(text, lo, hi)
                flat, sizes = encoder.encode(buf, starts, ends, hashes)
                at = np.concatenate(([0], np.cumsum(sizes)))[first]
                # one end id behind every document
                rows = np.arange(hi - lo)
                out = np.empty(len(flat) + hi - lo, width)
                ends_at = at[1:] + rows
                out[np.arange(len(flat)) + np.repeat(rows, np.diff(at))] = flat
                out[ends_at] = end_id
                body = out.tobytes()
                edges = np.concatenate(([0], ends_at + 1)) * width.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).cast(pa.int64()),
                        pa.array([body[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "ids"],
                )

    return run


def _count(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            buf, _ = K.text_bytes(batch.column(0))
            seen += np.bincount(np.frombuffer(buf.tobytes(), f"<u{width}"), minlength=size)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used])], names=["id", "n"])

    return run


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of values below 2**32."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    keep = np.arange(4) < sizes[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block: lengths by table lookup, then one gather per byte."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
    out = raw[at].astype(np.uint32)
    for byte in range(1, 4):
        more = np.flatnonzero(sizes > byte)
        out[more] |= raw[at[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def _write_blocks(rank_of, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_of.value
        part, block, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids = K.id_values(batch.column(0))
            _, offs = K.text_bytes(batch.column(1))
            for lo, hi in K.steps(offs, BLOCK_IDS * width):
                body, edge = K.text_bytes(batch.column(1).slice(lo, hi - lo))
                values = np.frombuffer(body.tobytes(), f"<u{width}")
                control, data = pack(ranks[values])
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "part": part, "block": block, "first_id": int(ids[lo]), "at": at, "n_ids": len(values),
                            "doc_ids": ids[lo:hi].astype("<i8").tobytes(),
                            "sizes": (np.diff(edge) // width).astype("<i8").tobytes(),
                            "control": control, "data": data,
                        }
                    ],
                    schema=_BLOCK_SCHEMA,
                )
                block, at = block + 1, at + len(values)

    return run


_BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64())]
    + [(c, pa.binary()) for c in ("doc_ids", "sizes", "control", "data")]
)


def _read_blocks(id_of, starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by_rank = id_of.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_by_rank[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<i8")
                ends = np.cumsum(sizes)
                begins = ends - sizes
                raw = memoryview(ids.tobytes())
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                base = starts.value[row["part"]] + row["at"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, mask=doc_ids == K.NO_ID),
                        pa.array(np.full(len(sizes), row["part"], np.int32)),
                        pa.array(begins + base),
                        pa.array(sizes),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_files(
    docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Encode every text and write the ids below ``path`` in ascending id order.

    ``path/blocks`` holds the blocks, ``path/ranks`` the ids by frequency rank (most
    frequent first, ties by id). A null or empty text is its end id alone. A null id
    is written last. Rows that share an id follow one another. An empty table
    gives an empty set of blocks.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(K.NO_ID))).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    staged = f"{path}/encoded"
    texts.mapInArrow(_encode(tokenizer_path, end_id), ENCODED).write.parquet(staged)
    encoded = spark.read.schema(ENCODED).parquet(staged)
    # at most one row per entry of the vocabulary
    counts = encoded.select("ids").mapInArrow(_count(width, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()], dtype=np.int64)
    rank_of = np.zeros(size, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranked = [(rank, int(i)) for rank, i in enumerate(by_rank)]
    spark.createDataFrame(ranked, "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_write_blocks(spark.sparkContext.broadcast(rank_of), width), BLOCKS).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ranks = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").collect()
    by_rank = np.array([r["id"] for r in ranks], dtype=np.uint32)
    # one row per written range
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_id").alias("first")).collect()
    starts, total = {}, 0
    for r in sorted(sums, key=lambda r: (r["first"], r["part"])):
        starts[r["part"]] = total
        total += r["n"]
    context = spark.sparkContext
    return blocks.mapInArrow(_read_blocks(context.broadcast(by_rank), context.broadcast(starts)), DIGEST)


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, **columns: str) -> DataFrame:
    """Write the token files of a table and return what reading them gives per document."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    write_token_files(docs, tokenizer_path, path, **columns)
    return read_token_files(spark, path)
