"""Near-dedup with bottom-k sketches from one hash function.

A document is the set of its distinct word shingles; documents are linked when their sets
have a Jaccard similarity of ``percent`` or more. Links are exact; components follow.

* The sketch of a set keeps the first k of its values in one order for all documents,
  with k = n - ceil(J n) + 1: two linked sets always share a value that both keep. The order is
  the hash, within classes of document frequency, so that rare values are kept first.
* The inverted lists of the kept values give the overlaps. A list is compared in stars:
  each member with one pivot, then only members that are in different components yet
  with another pivot, and so on. A group of thousands of near copies takes some rows per
  member and never all pairs.
* Candidates are thinned out before any set moves: each set has a parity sketch, its values
  folded to ``PARITY_BITS`` bits by exclusive or. Two of these differ in at most as many bits as the
  sets differ in values, so a pair that differs in more than similar sets may is dismissed
  for certain. Sets of more values have a second one with a bit for each value or more, as similar
  large sets may differ in more values than ``PARITY_BITS`` bits can show.
* For what is left the sketch of the union (the smallest hashes of both sets) estimates
  the similarity; pairs far below the threshold are dismissed, the others are
  verified on the full sets.

How it runs. Document frequencies are counted exactly, apart from 35 or more bits of a hash
standing for a value: packed entries go to ranges of the hash space and classes come back to
groups of documents (``_scatter``, ``_classes``, ``_retain``). A value with one document cannot
link; a set with more of those than its sketch has room for is done. Values that stand out in
a bounded sample (``COMMON_SAMPLE`` documents) are not counted: they come last in the order, and
so no range receives a value that a third of the documents hold. Equal sets are folded to one
representative before any list is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from . import kernels as K
from .components import smallest_reachable
from .suffix import PACKED, _dealt, _joined, _rows, _unpack
from .tables import Stored, shuffle_width

SHINGLE = 5
PERCENT = 80
#: Documents of the sample that finds common values, about.
COMMON_SAMPLE = 20_000
#: Share of the sample's documents from which a value is common.
COMMON_SHARE = 0.002
#: Values of the union sketch, and the share of them below which a pair is dismissed:
#: at a similarity of 0.8 fewer than 0.55 of 256 agree with a probability below 1e-18.
UNION_K = 256
UNION_LEAST = 0.55
#: Bits of the parity sketch.
PARITY_BITS = 1024
#: Rounds of pivots at most, and new links of a round from which on no other follows, or one for so many
#: members that are still apart: these are then compared with each other.
MAX_ROUNDS = 12
FEW = 20
FEW_PER = 2_000
#: Nodes from here up stand for rows without an id, by a hash of their text.
NO_ID_FROM = (1 << 63) - (1 << 60)
#: Ids that are sent to every task at once, 8 bytes each.
SENT_IDS = 500_000

VALUES, SETS, CLASSES, COPIES = 0, 1, 2, 3
RETAINED = "key long, doc_id long, n long, copy_of long, kept array<long>, members array<long>, parity array<long>, wide array<long>"


def shingle_sets(column: pa.Array, lo: int, hi: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of rows lo..hi, and where each row starts in them."""
    _, _, _, first, words = K.words_of(column, lo, hi, lower=True)
    h, at = K.window_hashes(words, first, shingle)
    row = np.searchsorted(first, at, side="right") - 1
    # a shorter text is one shingle of all its words
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < shingle))
    extra = np.array([_whole(words[first[r] : first[r + 1]]) for r in short], dtype=np.uint64)
    h, row = np.concatenate((h, extra)), np.concatenate((row, short))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(hi - lo + 1))


def _whole(words: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little"))


def parity_sketch(h: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The values folded to bits (a power of two) by exclusive or, as 64-bit words."""
    bits = bits or PARITY_BITS
    odd = np.bincount((h >> np.uint64(7)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(h: np.ndarray) -> np.ndarray | None:
    """The parity sketch of a set of more than ``PARITY_BITS`` values, a bit for each value or more."""
    return parity_sketch(h, 1 << (len(h) - 1).bit_length()) if len(h) > PARITY_BITS else None


def sketch_size(n: np.ndarray | int, percent: int):
    """k of a set of n values: one more than may be missing from a linked set."""
    return n - (n * percent + 99) // 100 + 1


def _common(shingle: int, sample: DataFrame, stored: Stored) -> np.ndarray:
    """Values of many documents of the sample; at most mean set size over ``COMMON_SHARE``."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = K.text_bytes(batch.column(0))
            for lo, hi in K.steps(offs):
                h, _ = shingle_sets(batch.column(0), lo, hi, shingle)
                keys, n = np.unique(h, return_counts=True)
                # a value that is common has some copies in any block of a few hundred documents
                some = n > max(1, (hi - lo) * COMMON_SHARE / 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[some].view(np.int64)), pa.array(n[some], pa.int64()), pa.array(np.full(int(some.sum()), 0), pa.int64())],
                    names=["value", "n", "docs"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([hi - lo], pa.int64())], names=["value", "n", "docs"]
                )

    counted = stored.keep(sample.mapInArrow(values, "value long, n long, docs long").groupBy("value").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    docs = counted.agg(F.sum("docs")).first()[0] or 0
    rows = counted.filter((F.col("n") > max(3, docs * COMMON_SHARE)) & F.col("value").isNotNull()).select("value").collect()
    stored.drop(counted)
    return np.sort(np.array([r["value"] for r in rows], dtype=np.int64).view(np.uint64))


def _is_common(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(h), dtype=bool)
    return common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h


def _scatter(shingle: int, common, ranges: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, "text"):
            keys, ids, text = (block.column(i) for i in range(3))
            keys, ids = K.id_values(keys), K.id_values(ids)
            _, offs = K.text_bytes(text)
            # rows alike in id and text have one key: only the first sends values, so an entry is one set
            fresh = np.zeros(len(keys), dtype=bool)
            fresh[np.unique(keys, return_index=True)[1]] = True
            parts, low, owner, prints = [], [], [], []
            for lo, hi in K.steps(offs, K.SMALL_STEP):
                h, edge = shingle_sets(text, lo, hi, shingle)
                body = h.tobytes()
                for i in range(hi - lo):
                    if edge[i + 1] > edge[i]:
                        digest = hashlib.blake2b(body[8 * edge[i] : 8 * edge[i + 1]], digest_size=16).digest()
                        prints.append((digest, int(ids[lo + i]), int(keys[lo + i])))
                row = np.repeat(np.arange(hi - lo), np.diff(edge))
                use = fresh[lo:hi][row] & ~_is_common(h, common.value)
                h, row = h[use], row[use]
                parts.append(K.bucket_of(h, ranges).astype(np.int64))
                low.append(_low(h, ranges))
                owner.append(keys[lo:hi][row])
            out = []
            if parts:
                part, value, own = np.concatenate(parts), np.concatenate(low), np.concatenate(owner)
                order = np.argsort(part, kind="stable")
                part, value, own = part[order], value[order], own[order]
                at, found = K.cuts(part)
                for p, a, b in zip(found, at[:-1], at[1:], strict=True):
                    runs, n = K.run_lengths(own[a:b])
                    out.append((VALUES, int(p), _pair(_two(runs, n), value[a:b].tobytes())))
            # equal sets of the block: the smallest id speaks for them
            prints.sort()
            least: dict[bytes, tuple[int, int]] = {}
            copies = []
            for digest, doc, key in prints:
                if digest in least:
                    copies.append((key, least[digest][0]))
                else:
                    least[digest] = (doc, key)
            if copies:
                key, of = (np.array(c, "<i8") for c in zip(*copies, strict=True))
                out += _dealt(COPIES, np.mod(key, groups), key, of)
            if least:
                first = np.array([int.from_bytes(d[:8], "little") for d in least], "<u8")
                second = np.array([int.from_bytes(d[8:], "little") for d in least], "<u8")
                doc, key = (np.array(c, "<i8") for c in zip(*least.values(), strict=True))
                out += _dealt(SETS, K.bucket_of(first, ranges).astype(np.int64), first, second, doc, key)
            if out:
                yield _rows(out)

    return run


def _two(keys: np.ndarray, n: np.ndarray) -> bytes:
    return np.array([len(keys)], "<i8").tobytes() + keys.astype("<i8").tobytes() + n.astype("<u4").tobytes()


def _pair(head: bytes, rest: bytes) -> bytes:
    return np.array([len(head)], "<i8").tobytes() + head + rest


def _unpair(body: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    (size,) = np.frombuffer(body, "<i8", 1)
    (n,) = np.frombuffer(body, "<i8", 1, 8)
    keys = np.frombuffer(body, "<i8", n, 16)
    counts = np.frombuffer(body, "<u4", n, 16 + 8 * int(n))
    return keys, counts, body[8 + int(size) :]


def _low(h: np.ndarray, ranges: int) -> np.ndarray:
    """The 32 bits of a hash that follow those which tell its range."""
    used = max(1, (ranges - 1).bit_length())
    return ((h << np.uint64(used)) >> np.uint64(32)).astype("<u4")


def _classes(groups: int):
    """Frequency classes of the entries of one range, and the smallest id of equal sets."""

    def run(key: tuple, packed: pa.Table) -> pa.Table:
        kind, bodies = key[0].as_py(), packed.column("body").to_pylist()
        if kind == COPIES:
            return packed
        if kind == SETS:
            first, second, doc, own = _joined(bodies, 4)
            order = np.lexsort((own, doc, second, first))
            first, second, doc, own = first[order], second[order], doc[order], own[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            of = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
            return pa.Table.from_batches([_rows(_dealt(COPIES, np.mod(own[~new], groups), own[~new], of[~new]))])
        read = [_unpair(b) for b in bodies]
        values = np.concatenate([np.frombuffer(r[2], "<u4") for r in read])
        keys = np.concatenate([r[0] for r in read])
        counts = np.concatenate([r[1] for r in read]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        at, _ = K.cuts(values[order])
        n = np.diff(at)
        # 0: one document; from there by doublings
        rank = np.zeros(len(values), np.uint8)
        rank[order] = np.repeat(np.frexp(n)[1] - (n == 1), n).astype(np.uint8)
        group = np.mod(keys, groups)
        begin = np.cumsum(counts) - counts
        order = np.argsort(group, kind="stable")
        at, found = K.cuts(group[order])
        out = []
        for g, a, b in zip(found, at[:-1], at[1:], strict=True):
            mine = order[a:b]
            size = counts[mine].astype(np.int64)
            take = np.arange(int(size.sum())) + np.repeat(begin[mine] - (np.cumsum(size) - size), size)
            out.append((CLASSES, int(g), np.array([key[1].as_py()], "<i8").tobytes() + _pair(_two(keys[mine], counts[mine]), rank[take].tobytes())))
        return pa.Table.from_batches([_rows(out)])

    return run


def _retain(shingle: int, percent: int, common, ranges: int):
    """Of every document the kept values that other documents hold too, and its whole set if there are any."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        n_docs = docs.num_rows
        keys = K.id_values(docs.column("key").combine_chunks())
        ids = K.id_values(docs.column("doc_id").combine_chunks())
        text = docs.column("text").combine_chunks()
        by_key: dict[int, int] = {}
        for i, k in enumerate(keys.tolist()):
            by_key.setdefault(k, i)  # rows that are alike in id and text share their values
        copy_of: dict[int, int] = {}
        rows, parts, ranks, counts = [], [], [], []
        for kind, body in zip(replies.column("kind").to_pylist(), replies.column("body").to_pylist(), strict=True):
            if kind == COPIES:
                own, of = _unpack(body)
                for k, d in zip(own.tolist(), of.tolist(), strict=True):
                    if d != ids[by_key[k]]:
                        copy_of[k] = min(d, copy_of.get(k, d))
            else:
                (part,) = np.frombuffer(body, "<i8", 1)
                own, n, rest = _unpair(body[8:])
                rows.append(np.array([by_key[k] for k in own.tolist()], np.int64))
                parts.append(np.full(len(own), int(part)))
                counts.append(n.astype(np.int64))
                ranks.append(np.frombuffer(rest, np.uint8))
        rank, at_row, at_part, size = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (ranks, rows, parts, counts))
        start = np.cumsum(size) - size
        # replies in the order of document and range: that of the sorted values
        order = np.lexsort((start, at_part, at_row))
        size, start, at_row, at_part = size[order], start[order], at_row[order], at_part[order]
        # a document seen twice (equal id and text) sent its values twice: keep one reply per range
        once = np.ones(len(size), dtype=bool)
        once[1:] = (at_row[1:] != at_row[:-1]) | (at_part[1:] != at_part[:-1])
        size, start, at_row = size[once], start[once], at_row[once]
        take = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        rank, owner = rank[take] if len(take) else rank[:0].astype(np.uint8), np.repeat(at_row, size)
        edge_of = np.searchsorted(owner, np.arange(n_docs + 1))
        out: list[list] = [[] for _ in range(8)]
        _, offs = K.text_bytes(text)
        for lo, hi in K.steps(offs, K.SMALL_STEP):
            h, edge = shingle_sets(text, lo, hi, shingle)
            usual = _is_common(h, common.value)
            for i in range(lo, hi):
                own = h[edge[i - lo] : edge[i - lo + 1]]
                n = len(own)
                key, rep = int(keys[i]), copy_of.get(int(keys[i]))
                first = by_key[key]
                kept, members, parity, wide = None, None, None, None
                if n and rep is None and first == i:
                    seen = np.full(n, 255, np.uint8)
                    seen[~usual[edge[i - lo] : edge[i - lo + 1]]] = rank[edge_of[i] : edge_of[i + 1]]
                    k = sketch_size(n, percent)
                    alone = int((seen == 0).sum())
                    if alone < k:
                        best = np.lexsort((own, seen))[alone:k]
                        kept, members, parity = own[best].view(np.int64), np.sort(own.view(np.int64)), parity_sketch(own)
                        wide = wide_sketch(own)
                elif n and rep is None:
                    rep = int(ids[i])
                out[0].append(key)
                out[1].append(int(ids[i]))
                out[2].append(n)
                out[3].append(rep)
                out[4].append(kept)
                out[5].append(members)
                out[6].append(parity)
                out[7].append(wide)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 4
        names = ["key", "doc_id", "n", "copy_of", "kept", "members", "parity", "wide"]
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return run


def _linked(percent: int) -> Column:
    """Whether the sets ``left`` and ``right`` are similar enough: the union sketch dismisses, the full sets decide."""
    n_left, n_right = F.size("left"), F.size("right")
    a, b = F.slice("left", 1, UNION_K), F.slice("right", 1, UNION_K)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, UNION_K)
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
    least = (UNION_LEAST + percent / 100 - 0.8) * UNION_K
    far = (F.least(n_left, n_right) > 4 * UNION_K) & (shared < least)
    inter = F.size(F.array_intersect("left", "right"))
    return F.when(far, F.lit(False)).otherwise(100 * inter >= percent * (n_left + n_right - inter))


def _of_ids(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of some documents; only these move. The ids are sent to the scan while they are few."""
    if ids.limit(SENT_IDS + 1).count() <= SENT_IDS:
        return sets.join(F.broadcast(ids), "doc_id", "left_semi")
    return join_hot(sets, ids, ["doc_id"], "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough.

    The set of ``b`` goes to ``a`` once for each pair and the set of ``a`` once for all its pairs, so of a
    star the pivot should be ``a``. While the pairs are few they are sent to the scan.
    """
    named = pairs.select(F.col("b").alias("doc_id"), "a")
    if named.limit(SENT_IDS // 2 + 1).count() <= SENT_IDS // 2:
        ends = sets.select("doc_id", "members").join(F.broadcast(named), "doc_id")
    else:
        ends = join_hot(named, sets.select("doc_id", "members"), ["doc_id"])
    ends = ends.select("a", F.col("doc_id").alias("b"), F.col("members").alias("right"))
    hubs = _of_ids(pairs.select(F.col("a").alias("doc_id")).distinct(), sets.select("doc_id", "members"))
    both = join_hot(ends, hubs.select(F.col("doc_id").alias("a"), F.col("members").alias("left")), ["a"])
    return both.filter(_linked(percent)).select("a", "b").distinct()


def _differ(one: str, other: str) -> Column:
    """Bits in which two parity sketches differ."""
    words = PARITY_BITS // 64
    return sum((F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i])) for i in range(1, words)), F.bit_count(F.col(one)[0].bitwiseXOR(F.col(other)[0])))


def _near(percent: int, n_one: str, n_other: str, one: str, other: str) -> Column:
    """What similar sets fulfil: |A xor B| <= (|A| + |B|) (1 - J) / (1 + J)."""
    return _differ(one, other) * (100 + percent) <= (F.col(n_one) + F.col(n_other)) * (100 - percent)


def _candidates(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their parity sketches do not dismiss."""
    def side(c: str):
        return sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _of_ids(ids, sets.select("doc_id", "n", "parity"))
    both = join_hot(join_hot(pairs, side("a"), ["a"]), side("b"), ["b"])
    return both.filter(_near(percent, "n_a", "n_b", "p_a", "p_b")).select("a", "b")


def _halved(words: Column) -> Column:
    """A parity sketch folded to half its bits."""
    half = (F.size(words) / 2).cast("int")
    return F.zip_with(F.slice(words, 1, half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _still_near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their wide sketches do not dismiss; a pair with a set that has none stays."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _of_ids(ids, sets.filter("wide IS NOT NULL").select("doc_id", "n", "wide"))

    def side(c: str):
        return sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"w_{c}"))

    # sets of a candidate pair have about the same size, so one sketch is at most twice as long
    a, b = F.col("w_a"), F.col("w_b")
    one = F.when(F.size(a) > F.size(b), _halved(a)).otherwise(a)
    other = F.when(F.size(b) > F.size(a), _halved(b)).otherwise(b)
    differ = F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    both = join_hot(join_hot(pairs, side("a"), ["a"], "left"), side("b"), ["b"], "left")
    return both.filter(a.isNull() | b.isNull() | (F.size(one) != F.size(other)) | near).select("a", "b")


def _fits(percent: int):
    return (F.col("n") * 100 >= F.col("pivot_n") * percent) & (F.col("pivot_n") * 100 >= F.col("n") * percent)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, row_key`` of every input row.

    Words are maximal runs without ASCII white space, A-Z in lower case. A text of fewer
    words than a shingle is one shingle of all of them. A null, empty or blank text has an
    empty set, is linked with nothing and stays. Documents are linked at ``percent``
    per cent similarity; ``component_id`` is the smallest id reachable over links. Rows that
    share an id are one node: they have a component together, and each gets its row. A
    row without an id is a node of its own, larger than any id (rows without one and with the same
    text are one, ids must be below ``NO_ID_FROM``); its id comes back null, as does the component if
    no row in it has an id. ``row_key`` is a 64-bit hash of id and text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    ranges, groups = max(8, width // 2), max(8, 2 * width)
    keyed = docs.select(*_node(F.col(id_col), F.col(text_col)))
    total = keyed.count()
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / 1_000_003
    sample = keyed.filter(draw < min(1.0, COMMON_SAMPLE / max(1, total))).select("text")
    stored = Stored(spark, "near-duplicates")
    common = spark.sparkContext.broadcast(_common(shingle, sample, stored))

    entries = keyed.mapInArrow(_scatter(shingle, common, ranges, groups), PACKED)
    replies = entries.groupBy("kind", "part").applyInArrow(_classes(groups), PACKED)
    replies = replies.select("kind", F.col("part").alias("g"), "body").groupBy("g")
    dealt = keyed.withColumn("g", F.pmod("key", F.lit(groups)).cast("int")).groupBy("g")
    kept = stored.keep(dealt.cogroup(replies).applyInArrow(_retain(shingle, percent, common, ranges), RETAINED))

    copies = kept.filter("copy_of IS NOT NULL").select(F.col("copy_of").alias("a"), F.col("doc_id").alias("b"))
    sets = kept.filter("kept IS NOT NULL").select("doc_id", "n", "members", "parity", "wide")
    posting = kept.filter("kept IS NOT NULL").select("doc_id", "n", F.explode("kept").alias("value"))
    lists = _distinct_lists(posting, stored)
    links = stored.keep(copies.unionByName(_all_links(lists, sets, percent, max_rounds, stored)))
    stored.drop(lists)
    found = smallest_reachable(links, stored)
    joined = join_hot(kept.select("key", "doc_id", "n"), found.withColumnRenamed("id", "doc_id"), ["doc_id"], "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        _id_of(F.col("doc_id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        _id_of(component).alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
        F.col("key").alias("row_key"),
    )


def _node(doc_id: Column, text: Column) -> list[Column]:
    """Key, node and text of a row."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    alone = F.lit(NO_ID_FROM) + F.xxhash64(text).bitwiseAND(F.lit((1 << 60) - 1))
    node = F.coalesce(doc_id.cast("long"), alone)
    return [F.xxhash64(node, text).alias("key"), node.alias("doc_id"), text.alias("text")]


def row_key(doc_id: Column, text: Column) -> Column:
    """The ``row_key`` of a row of the input."""
    return _node(doc_id, text)[0]


def _id_of(node: Column) -> Column:
    return F.when(node < NO_ID_FROM, node)


def _distinct_lists(posting: DataFrame, stored: Stored) -> DataFrame:
    """``value, doc_id, n`` of the lists of two members or more; of lists with the same members, one."""
    mark = F.xxhash64("doc_id")
    by_value = posting.groupBy("value").agg(
        F.count("*").alias("many"), F.min("doc_id").alias("low"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("s")
    )
    one = by_value.filter("many > 1").groupBy("many", "low", "x", "s").agg(F.min("value").alias("value"))
    return stored.keep(join_hot(posting, one.select("value"), ["value"]))


def _all_links(lists: DataFrame, sets: DataFrame, percent: int, max_rounds: int, stored: Stored) -> DataFrame:
    """Links that connect all similar members of every list.

    A round names its links by the components that it began with, so it works on its own links and not
    on all before; they connect what the links between the documents do.
    """
    members = lists.withColumn("component", F.col("doc_id"))
    found = None
    for turn in range(max_rounds):
        first = F.struct(F.when(F.lit(turn) > 0, F.xxhash64("doc_id", F.lit(turn))), F.col("doc_id"))
        pivot = F.struct(F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("component").alias("pivot_component"))
        pivots = members.groupBy("value").agg(
            F.min_by(pivot, first).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")
        ).filter("low != high").select("value", "p.*")
        stars = join_hot(members, pivots, ["value"]).filter("component != pivot_component").filter(_fits(percent))
        ends = [F.least("pivot", "doc_id").alias("low"), F.greatest("pivot", "doc_id").alias("high")]
        roots = F.min(F.struct(F.col("pivot").alias("a"), F.col("pivot_component").alias("root_a"), F.col("component").alias("root_b"))).alias("p")
        pairs = stars.groupBy(*ends).agg(roots).select("p.*", F.when(F.col("p.a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
        named = stored.keep(pairs)
        near = stored.keep(_candidates(named.select("a", "b"), sets, percent))
        pairs = stored.keep(_still_near(near, sets, percent))
        links = stored.keep(_verified(pairs, sets, percent).join(named, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        inner = Stored(lists.sparkSession, "components")
        components = stored.keep(smallest_reachable(links, inner))
        inner.clear()
        joined = components.select(F.col("component").alias("a"), F.col("id").alias("b"))
        found = joined if found is None else found.unionByName(joined)
        # a list that lies in one component stays so: only what was apart is looked at again
        moved = components.select(F.col("id").alias("component"), F.col("component").alias("root"))
        before, members = members, join_hot(members, moved, ["component"], "left")
        members = stored.keep(_apart(members.select("value", "doc_id", "n", F.coalesce("root", "component").alias("component"))))
        stored.drop(named, near, pairs, components, before)
        apart = members.count()
        if not apart:
            return found
        if turn > 0 and links.count() <= max(FEW, apart // FEW_PER):
            break
    # what is still apart, each member with those of other components of about its size
    level = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))
    left = join_hot(members, sets.select("doc_id", "parity"), ["doc_id"]).withColumn("level", level)
    near = left.select(
        F.col("value"), F.explode(F.array("level", F.col("level") + 1)).alias("level"), F.col("level").alias("pivot_level"), F.col("doc_id").alias("pivot"),
        F.col("n").alias("pivot_n"), F.col("component").alias("pivot_component"), F.col("parity").alias("pivot_parity"),
    )
    same = [left["value"] == near["value"], left["level"] == near["level"]]
    once = (F.col("pivot_level") < left["level"]) | (F.col("doc_id") > F.col("pivot"))
    open_ = [once, F.col("component") != F.col("pivot_component"), _fits(percent), _near(percent, "n", "pivot_n", "parity", "pivot_parity")]
    rest = left.join(near, [*same, *open_])
    pairs = rest.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
    pairs = stored.keep(_still_near(stored.keep(pairs), sets, percent))
    return found.unionByName(stored.keep(_verified(pairs, sets, percent)))


def _apart(members: DataFrame) -> DataFrame:
    """Members of lists that still span components."""
    spans = members.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return join_hot(members, spans.filter("low != high").select("value"), ["value"])
