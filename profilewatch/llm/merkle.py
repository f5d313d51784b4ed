"""Merkle manifest of a table, with leaf coordinates from bitmap ranks.

Every row is a leaf. Where it stands among the leaves of its group (its language) is the
rank of its doc_id: the number of smaller ids in the group. No list of leaves is sorted:

1. ``_containers`` turns the ids of a task into compressed bitmaps: per group and block of 65,536
   ids a sorted array of positions, or 8 KB of bits where that is smaller. ``_merged`` unites
   those of all tasks; an id that occurs again is counted beside the bits.
2. A directory holds, per container, how many ids lie in front: sums over at most 65,536 children
   at each of three levels of the id's bits, so no window grows with a group.
3. ``_ranks`` asks each container for the rank of its ids: the directory's sum, the popcounts of
   the 64-bit words in front (the container's own directory) and the bits below in the word.
4. Leaves go to slot arrays keyed by (group, slot / 1024). A task puts hashes in their slots and
   reduces ten levels at once; the nodes that are left are the slots of the next round.
5. On the way down every key gets the path of its node to the root, and each leaf its proof.

Rows with the same id in a group are told apart by leaf hash, in steps that never hold more
than one input partition's equal rows in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..session import settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
WORDS = BLOCK // 64
#: Levels that one slot array reduces.
LEVELS = 10
#: Ids that a task holds before it packs them.
HOLD = 2_000_000

CONTAINER = "l string, bucket long, bits binary, extra binary, n long"
PLACED = "l string, doc_id long, first long, m long"
PATH = "l string, slot long, path array<string>, subroot string, root string"
RESULT = (
    "doc_id long, slot long, leaf string, subroot string, root string, proof array<string>, "
    "proof_sha256 string, folded_root string, verified boolean"
)


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hex sha256 of the fields, each with its length in bytes, ``-`` for null."""
    return F.sha2(F.concat(*(_field(x) for x in (doc_id, source, lang, n_chars, text))), 256)


# Bitmaps


def pack(at: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """A container of sorted positions: positions or bits, and the counts of repeated ones."""
    extra = n > 1
    more = at[extra].astype("<u2").tobytes() + (n[extra] - 1).astype("<i8").tobytes()
    if 2 * len(at) < BLOCK // 8:
        return at.astype("<u2").tobytes(), more
    bits = np.zeros(BLOCK, dtype=np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes(), more


def unpack(bits: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(bits) == BLOCK // 8:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    else:
        at = np.frombuffer(bits, "<u2").astype(np.int64)
    n = np.ones(len(at), dtype=np.int64)
    k = len(more) // 10
    if k:
        n[np.searchsorted(at, np.frombuffer(more, "<u2", k))] += np.frombuffer(more, "<i8", k, 2 * k)
    return at, n


class Ranks:
    """A container with its popcount directory; answers how many ids lie below a position."""

    def __init__(self, bits: bytes, more: bytes):
        self.at, self.n = unpack(bits, more)
        if len(bits) == BLOCK // 8:
            self.words = np.frombuffer(bits, "<u8")
        else:
            self.words = np.zeros(WORDS, dtype="<u8")
            np.bitwise_or.at(self.words, self.at >> 6, np.uint64(1) << (self.at & 63).astype(np.uint64))
        self.directory = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.again = self.at[self.n > 1]
        self.more = np.concatenate(([0], np.cumsum(self.n[self.n > 1] - 1)))

    def below(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        found = self.directory[word] + np.bitwise_count(self.words[word] & mask)
        return found + self.more[np.searchsorted(self.again, at)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[name for name, _ in fields]
    )


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the ids of a task, per group and block of ids."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def packed() -> Iterator[pa.RecordBatch]:
        rows = []
        for group, parts in held.items():
            ids, n = np.unique(np.concatenate(parts), return_counts=True)
            buckets, start = np.unique(ids >> BLOCK_BITS, return_index=True)
            for bucket, lo, hi in zip(buckets.tolist(), start, [*start[1:], len(ids)], strict=True):
                rows.append((group, bucket, *pack(ids[lo:hi] & (BLOCK - 1), n[lo:hi]), int(n[lo:hi].sum())))
                if len(rows) >= 2_000:
                    yield _batch(rows, CONTAINER)
                    rows = []
        held.clear()
        yield _batch(rows, CONTAINER)

    for b in batches:
        groups = b.column(0).dictionary_encode()
        number, ids = groups.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for i, group in enumerate(groups.dictionary.to_pylist()):
            held.setdefault(group, []).append(ids[number == i])
        size += len(ids)
        if size >= HOLD:
            yield from packed()
            size = 0
    yield from packed()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of one key, which arrive side by side, as one."""
    key, parts = None, []

    def united() -> tuple:
        at = np.concatenate([p[0] for p in parts])
        kinds, back = np.unique(at, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        return (*key, *pack(kinds, n), int(n.sum()))

    for b in batches:
        rows = []
        for group, bucket, bits, more, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (group, bucket) != key:
                if parts:
                    rows.append(united())
                key, parts = (group, bucket), []
            parts.append(unpack(bits, more))
            if len(parts) > 64:
                _, _, bits, more, _ = united()
                parts = [unpack(bits, more)]
        if rows:
            yield _batch(rows, CONTAINER)
    if parts:
        yield _batch([united()], CONTAINER)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``l, doc_id, first, m``: the first slot of every id and its number of rows."""
    for b in batches:
        for group, bucket, bits, more, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = Ranks(bits, more)
            ids = found.at + (bucket << BLOCK_BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group]).take(pa.array(np.zeros(len(ids), np.int64))),
                    pa.array(ids),
                    pa.array(found.below(found.at) + base),
                    pa.array(found.n),
                ],
                names=["l", "doc_id", "first", "m"],
            )


def _with_base(containers: DataFrame) -> DataFrame:
    """The containers with the number of rows of their group in front of them."""
    levels, keys = containers.select("l", F.col("bucket").alias("k0"), "n"), []
    for i in (1, 2):
        keys.append(levels.select("l", *(c for c in levels.columns if c[0] == "k"), "n"))
        up = levels.withColumn(f"k{i}", F.shiftright(f"k{i - 1}", BLOCK_BITS))
        levels = up.groupBy("l", f"k{i}").agg(F.sum("n").alias("n"))
    keys.append(levels)
    out = containers.withColumns(
        {"k0": F.col("bucket"), "k1": F.shiftright("bucket", BLOCK_BITS), "k2": F.shiftright("bucket", 2 * BLOCK_BITS)}
    )
    total = F.lit(0).cast("long")
    for i, table in enumerate(keys):
        inside = ["l"] if i == 2 else ["l", f"k{i + 1}"]
        if i < 2:
            table = table.withColumn(f"k{i + 1}", F.shiftright(f"k{i}", BLOCK_BITS))
        order = Window.partitionBy(*inside).orderBy(f"k{i}").rowsBetween(Window.unboundedPreceding, -1)
        before = table.select("l", f"k{i}", F.coalesce(F.sum("n").over(order), F.lit(0)).alias(f"before{i}"))
        out = join_hot(out, before, ["l", f"k{i}"])
        total = total + F.col(f"before{i}")
    return out.select("l", "bucket", "bits", "extra", total.alias("base"))


# Slots


def _tied(rows: DataFrame) -> DataFrame:
    """Rows that share ``(l, first)`` with slots by leaf hash; equal leaves by where they were read."""
    rows = rows.withColumns({"part": F.shiftright("mid", 33), "head": F.substring("leaf", 1, 2)})
    n = rows.groupBy("l", "first", "head", "leaf", "part").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("l", "first", "head").orderBy("leaf", "part").rowsBetween(Window.unboundedPreceding, -1)
    low = n.select("l", "first", "leaf", "part", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("low"))
    heads = n.groupBy("l", "first", "head").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("l", "first").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    high = heads.select("l", "first", "head", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("high"))
    same = Window.partitionBy("l", "first", "leaf", "part").orderBy("mid")
    rows = rows.withColumn("turn", F.row_number().over(same) - 1)
    rows = join_hot(join_hot(rows, low, ["l", "first", "leaf", "part"]), high, ["l", "first", "head"])
    return rows.withColumn("slot", F.expr("first + high + low + turn"))


def _slots(leaves: DataFrame) -> DataFrame:
    """``l, slot, doc_id, leaf, changed``: every leaf at its place in its group."""
    known = leaves.filter("doc_id is not null")
    packed = known.select("l", "doc_id").mapInArrow(_containers, CONTAINER)
    packed = packed.repartition("l", "bucket").sortWithinPartitions("l", "bucket")
    containers = settle(packed.mapInArrow(_merged, CONTAINER))
    ranks = _with_base(containers).mapInArrow(_ranks, PLACED)
    placed = join_hot(known, ranks, ["l", "doc_id"])
    behind = containers.groupBy("l").agg(F.sum("n").alias("behind"))
    missing = join_hot(leaves.filter("doc_id is null"), behind, ["l"], "left")
    missing = missing.select(*leaves.columns, F.coalesce("behind", F.lit(0)).alias("first"))
    tied = placed.filter("m > 1").select(*leaves.columns, "first").unionByName(missing)
    columns = ["l", "slot", "doc_id", "leaf", "changed"]
    alone = placed.filter("m = 1").withColumnRenamed("first", "slot").select(*columns)
    return alone.unionByName(_tied(tied).select(*columns))


def _numbered(groups: DataFrame) -> DataFrame:
    """``l`` with its place in byte order, numbered range by range."""
    spread = groups.repartitionByRange("l").sortWithinPartitions("l").withColumn("mid", F.monotonically_increasing_id())
    spread = settle(spread).withColumn("part", F.shiftright("mid", 33))
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return spread.join(sizes, "part").withColumn(
        "place", F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("part", "mid", "before")


# Levels


def tree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, the given ones first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def levels_of(n: int, most: int = LEVELS) -> int:
    """Levels above n nodes that one slot array of at most ``2**most`` slots reduces."""
    return min(most, (n - 1).bit_length())


def siblings(rows: list[list[str]], i: int) -> list[str]:
    """Per level the sibling of node i: ``<hash`` to its left, ``>hash`` to its right, empty for none."""
    out = []
    for below in rows[:-1]:
        at = i ^ 1
        out.append("" if at >= len(below) else ("<" if at < i else ">") + below[at])
        i >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    for s in path:
        node = h(s[1:], node) if s[:1] == "<" else h(node, s[1:])
    return node


def _in_slots(t: pa.Table, most: int) -> tuple[list[str], int]:
    slots = t.column("slot").to_pylist()
    nodes: list = [None] * len(slots)
    for slot, node in zip(slots, t.column("node").to_pylist(), strict=True):
        nodes[slot % (1 << most)] = node
    return nodes, t.column("left").to_pylist()[0]


def _reduce(most: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        nodes, left = _in_slots(t, most)
        levels = levels_of(left, most)
        top = tree(nodes, levels)[-1][0]
        up = -(-left >> levels)
        return pa.table({"l": [key[0]], "slot": pa.array([key[1].as_py()], pa.int64()), "left": pa.array([up], pa.int64()), "node": [top]})

    return run


def _rounds(nodes: DataFrame, largest: int, most: int) -> list[DataFrame]:
    """Nodes of every round, ``l, slot, left, node`` with ``left`` nodes in all, down to one per ``l``."""
    out = [nodes]
    while largest > 1:
        up = out[-1].groupBy("l", F.shiftright("slot", most).alias("key")).applyInArrow(
            _reduce(most), "l string, slot long, left long, node string"
        )
        out.append(settle(up))
        largest = -(-largest >> levels_of(largest, most))
    return out


def _down(most: int):
    def run(key: tuple, below: pa.Table, above: pa.Table) -> pa.Table:
        if not below.num_rows:
            return _PATH.empty_table()
        nodes, left = _in_slots(below, most)
        rows = tree(nodes, levels_of(left, most))
        up = above.to_pylist()[0]
        n = len(nodes)
        first = key[1].as_py() << most
        return pa.table(
            {
                "l": [up["l"]] * n,
                "slot": list(range(first, first + n)),
                "path": [siblings(rows, i) + up["path"] for i in range(n)],
                "subroot": [up["subroot"]] * n,
                "root": [up["root"]] * n,
            },
            schema=_PATH,
        )

    return run


_PATH = pa.schema(
    [("l", pa.string()), ("slot", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]
)
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("slot", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
        ("proof", pa.list_(pa.string())), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
    ]
)


def _proofs(with_proof: bool, most: int):
    def run(key: tuple, below: pa.Table, above: pa.Table) -> pa.Table:
        if not below.num_rows:
            return _RESULT.empty_table()
        nodes, left = _in_slots(below, most)
        rows = tree(nodes, levels_of(left, most))
        up = above.to_pylist()[0]
        out = []
        for doc_id, slot, leaf, changed in zip(*(below.column(c).to_pylist() for c in ("doc_id", "slot", "node", "changed")), strict=True):
            path = siblings(rows, slot % (1 << most)) + up["path"]
            folded = fold(changed or leaf, path)
            proof = h(*(s[1:] for s in path))
            out.append((doc_id, slot, leaf, up["subroot"], up["root"], path if with_proof else None, proof, folded, folded == up["root"]))
        columns = zip(*out, strict=True)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return run


def _paths(rounds: list[DataFrame], top: DataFrame, most: int) -> DataFrame:
    """Paths of the nodes of the first of the rounds, from those of the last (``PATH``)."""
    for nodes in reversed(rounds):
        key = F.shiftright("slot", most).alias("key")
        top = (
            nodes.groupBy("l", key)
            .cogroup(top.withColumnRenamed("slot", "key").groupBy("l", "key"))
            .applyInArrow(_down(most), PATH)
        )
    return top


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    altered: Column | None = None,
    with_proof: bool = True,
    levels: int = LEVELS,
) -> DataFrame:
    """A row per input row: ``doc_id, slot, leaf, subroot, root, proof, proof_sha256, folded_root, verified``.

    ``fields`` names the id, source, group, length and text columns. Rows where ``altered`` holds are
    read again with a length that is one larger, and folded from there; the proof is that of the
    original leaf. ``levels`` of the tree are reduced at a time. A proof lists the siblings up to the root, ``<`` left, ``>`` right, empty where a
    node has none.

    Within a group null ids come last. Rows with the same id, and those without one, are ordered by
    leaf; rows that are equal in all fields are leaves of their own. Null fields are ``-``, empty
    ones ``0:``. A null group is a group of its own and the first. An empty table gives an empty result.
    """
    ids, source, lang, size, text = (F.col(c) for c in fields)
    ids = ids.cast("long")
    altered = F.lit(False) if altered is None else F.coalesce(altered, F.lit(False))
    more = size.cast("decimal(20,0)") + 1
    leaf = F.unhex(leaf_hash(ids, source, lang, size, text))
    leaves = settle(
        docs.select(
            F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-")).alias("l"),
            ids.alias("doc_id"),
            leaf.alias("leaf"),
            F.when(altered, F.unhex(leaf_hash(ids, source, lang, more, text))).alias("changed"),
            F.monotonically_increasing_id().alias("mid"),
        )
    )
    sizes = leaves.groupBy("l").agg(F.count("*").alias("left"))
    largest = sizes.agg(F.max("left")).first()[0] or 0
    hexed = {"node": F.lower(F.hex("leaf")), "changed": F.lower(F.hex("changed"))}
    nodes = settle(join_hot(_slots(leaves), sizes, ["l"]).withColumns(hexed).select("l", "slot", "left", "doc_id", "node", "changed"))
    rounds = _rounds(nodes, largest, levels)

    subroots = _numbered(rounds[-1].select("l", F.col("node").alias("subroot")))
    n_groups = subroots.count()
    one = subroots.select(F.lit("").alias("l"), F.col("place").alias("slot"), F.lit(n_groups).cast("long").alias("left"), F.col("subroot").alias("node"))
    above = _rounds(settle(one), n_groups, levels)
    none = F.array().cast("array<string>")
    top = above[-1].select("l", "slot", none.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    places = _paths(above[:-1], top, levels).select(F.col("slot").alias("place"), "path", "root")
    path = subroots.join(places, "place").select("l", F.lit(0).cast("long").alias("slot"), "path", "subroot", "root")
    path = settle(_paths(rounds[1:-1], path, levels))
    key = F.shiftright("slot", levels).alias("key")
    return (
        rounds[0]
        .groupBy("l", key)
        .cogroup(path.withColumnRenamed("slot", "key").groupBy("l", "key"))
        .applyInArrow(_proofs(with_proof, levels), RESULT)
    )
