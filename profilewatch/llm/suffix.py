"""Suffix-array dedup: remove every byte under a ``length``-byte string that occurs elsewhere.

Threshold-bounded interval expansion on a Burrows-Wheeler transform (``bwt.py``) needs
all texts that may share a string in one place. So the corpus is cut first such that
equal strings always meet:

1. ``_anchor``: the smallest hash of all ``GRAM``-byte grams inside a ``length``-byte
   string is its anchor. Equal strings have equal anchors. Neighbouring starts with the
   same anchor form a piece: their starts and the bytes these reach. Only
   the anchor, a fingerprint and the place of a piece leave the task.
2. ``_meet`` (by range of anchors): pieces that are equal to another one repeat as a
   whole. Where an anchor has different pieces, or stands twice in its only one, one of
   each kind is asked for. The rest cannot repeat.
3. ``_cut`` (by documents), only for anchors with more than ``HOT`` different pieces or more
   bytes than one transform takes: their pieces are cut by the alignment of their starts
   (``aligned``) and meet once more by the bytes that these have in common.
4. ``_fetch`` (by documents) sends the bytes of the pieces asked for, and only those. Where
   aligned pieces are still of too many kinds, every start goes by itself, as a fingerprint.
5. ``_expand`` (by anchor) builds the transform over the different pieces and reports
   which of their starts repeat.
6. ``_remove`` (by documents) merges the reported starts into maximal runs of bytes.

Every step carries packed arrays; equal pieces of one block are folded before they
move. A passage that a third of all documents share has equal pieces inside and different
ones only at its edges; cut by alignment, these are equal but for the few that reach over
the edge. So no transform takes more than ``CHUNK`` bytes, however many documents share a
passage. Buckets hold about ``GROUP_BYTES`` of text, whatever the cluster is set to.
Documents are dealt once; Spark reads the same exchange in all steps that need the texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bwt import repeated_starts
from .tables import Stored, shuffle_width

LENGTH = 200
GRAM = 32
#: Different pieces of one anchor from which on they are cut further.
HOT = 4_000
#: Starts of one alignment block of a hot anchor.
ALIGNED = 16
#: Starts of a piece at most; a longer run of one anchor is several pieces.
MAX_STARTS = 2_048
#: Bytes that one transform takes.
CHUNK = 1_500_000
#: Bytes of text whose documents, or the entries of twice as many, are one bucket.
GROUP_BYTES = 8_000_000

#: Kinds of packed rows. SPLIT pieces are to be cut by alignment, SINGLE ones by start; STRINGS are those starts.
ENTRIES, FLAGS, WANTED, PIECES, SPLIT, SINGLE, STRINGS = range(7)
#: Bits of an entry: others of its block equal it, its anchor recurs in it, it was reported as a whole before.
MANY, AGAIN, DONE = 1, 2, 4
PACKED = "kind int, part int, body binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string, kept binary"
DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, one after the other; the first byte runs tell their types."""
    head = np.array([len(columns[0]), len(columns)], "<i8").tobytes() + "".join(c.dtype.str.ljust(4) for c in columns).encode()
    return head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(body: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(body, "<i8", 2).tolist()
    kinds = body[16 : 16 + 4 * k].decode()
    at, out = 16 + 4 * k, []
    for i in range(k):
        kind = np.dtype(kinds[4 * i : 4 * i + 4].strip())
        out.append(np.frombuffer(body, kind, n, at))
        at += n * kind.itemsize
    return out


def _joined(bodies: list[bytes], n: int) -> list[np.ndarray]:
    parts = [_unpack(b) for b in bodies]
    if not parts:
        return [np.zeros(0, np.int64) for _ in range(n)]
    return [np.concatenate([p[i] for p in parts]) for i in range(n)]


def _dealt(kind: int, part: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    at, keys = K.cuts(part)
    return [(kind, int(k), _pack(*[c[a:b] for c in columns])) for k, a, b in zip(keys, at[:-1], at[1:], strict=True)]


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, bodies = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], names=["kind", "part", "body"]
    )


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span, out = 1, h
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums of bytes, and the powers that make their differences independent of the place."""
    up, down = K.powers(K.BASE, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return sums, down


def _recurs(grams: np.ndarray, anchor: np.ndarray, at: np.ndarray, reach: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the anchor of a piece stands at two places of it, so that it may repeat in itself."""
    width = len(grams) - len(anchor) + 1
    edge = np.zeros(width - 1, np.uint64)
    # a gram is an anchor's place when some string over it has its hash as the smallest
    most = ~_smallest(~np.concatenate((edge, anchor, edge)), width)
    spots = np.flatnonzero(most == grams)
    lo, hi = np.searchsorted(spots, at), np.searchsorted(spots, reach)
    many = hi - lo
    owner = np.repeat(np.arange(len(at)), many)
    spot = spots[np.arange(int(many.sum())) + np.repeat(lo - (np.cumsum(many) - many), many)]
    return np.bincount(owner[grams[spot] == value[owner]], minlength=len(at)) > 1


def pieces(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Row, first start in the row, number of starts, anchor, fingerprint, and whether the anchor recurs, of every piece."""
    n = len(buf) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    sums, down = _sums(buf)
    grams = K.mix((sums[gram:] - sums[:-gram]) * down[: len(buf) - gram + 1])
    anchor = _smallest(grams, length - gram + 1)
    row_of = np.searchsorted(offs, np.arange(0, n, 1), side="right") - 1 if len(offs) > 2 else np.zeros(n, np.int64)
    inside = np.arange(n) + length <= offs[row_of + 1]
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row_of[1:] != row_of[:-1])
    at = np.flatnonzero(new & inside)
    # inside is true for a prefix of every row, so a run ends at the next start or where it turns false
    stop = np.append(at[1:], n)
    stop = np.minimum(stop, offs[row_of[at] + 1] - length + 1)
    if len(at) and (stop - at).max() > MAX_STARTS:
        parts = -(-(stop - at) // MAX_STARTS)
        base, which = np.repeat(at, parts), np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(stop, parts)
        at = base + which * MAX_STARTS
        stop = np.minimum(at + MAX_STARTS, end)
    size = stop - at
    reach = stop + length - 1
    print_ = K.mix((sums[reach] - sums[at]) * down[at] + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    row = row_of[at]
    again = _recurs(grams, anchor, at, reach - gram + 1, anchor[at])
    return row, at - offs[row], size, anchor[at], print_, again


def _flag_rows(group_count: int, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int, bytes]]:
    return _dealt(FLAGS, np.mod(key, group_count), key, start.astype("<i8"), size.astype("<u4"))


def _folded(ranges: int, groups: int, anchor, mark, doc, start, size, bits) -> list[tuple[int, int, bytes]]:
    """Entries in an order of anchors and marks: equal ones repeat, and the first of them speaks for all."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1])
    many = new & ~np.append(new[1:], True)
    # an anchor is the smallest of many hashes, so most of them are small: mixed again, they fill all ranges
    out = _dealt(
        ENTRIES, K.bucket_of(K.mix(anchor[new]), ranges).astype(np.int64), anchor[new], mark[new], doc[new],
        start[new].astype("<i8"), size[new].astype("<u4"), (bits | many * np.uint8(MANY))[new],
    )
    return out + _flag_rows(groups, doc[~new], start[~new], size[~new])


def _anchor(length: int, gram: int, ranges: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, "text"):
            keys, text = K.id_values(block.column(0)), block.column(1)
            _, offs = K.text_bytes(text)
            found = []
            for lo, hi in K.steps(offs, K.SMALL_STEP):
                row, start, size, anchor, mark, again = pieces(*K.text_bytes(text.slice(lo, hi - lo)), length, gram)
                found.append((keys[lo:hi][row], start, size, anchor, mark, again))
            if not found:
                continue
            key, start, size, anchor, mark, again = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((mark, anchor))
            key, start, size, anchor, mark, again = (c[order] for c in (key, start, size, anchor, mark, again))
            out = _folded(ranges, groups, anchor, mark, key, start, size, again * np.uint8(AGAIN))
            if out:
                yield _rows(out)

    return run


def _meet(length: int, groups: int, hot: int, finer: int):
    """Flags of equal entries, and of those left one of each kind as ``WANTED``, or as ``finer`` where there are too many."""

    def run(key: tuple, packed: pa.Table) -> pa.Table:
        if key[0].as_py() == FLAGS:
            return packed
        anchor, mark, doc, start, size, bits = _joined([b.as_py() for b in packed.column("body")], 6)
        order = np.lexsort((start, doc, mark, anchor))
        anchor, mark, doc, start, size, bits = (c[order] for c in (anchor, mark, doc, start, size, bits))
        kind = np.ones(len(anchor), dtype=bool)
        kind[1:] = (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1])
        edges = np.append(np.flatnonzero(kind), len(anchor))
        of = np.cumsum(kind) - 1
        whole = ((np.diff(edges) > 1) | (np.maximum.reduceat(bits & MANY, edges[:-1]) > 0))[of]
        out = _flag_rows(groups, doc[whole], start[whole], size[whole])
        one = np.flatnonzero(kind)  # one of each kind
        first = np.concatenate(([True], anchor[one][1:] != anchor[one][:-1]))
        at = np.flatnonzero(first)
        kinds = np.diff(np.append(at, len(one)))
        reach = np.add.reduceat(size[one].astype(np.int64) + length - 1, at)
        large = ((kinds > hot) | (reach > CHUNK)) & (kinds > 1)
        which = np.cumsum(first) - 1
        asked = (kinds > 1)[which] | ((bits[one] & AGAIN > 0) & ~whole[one])
        done = (whole[one] | (bits[one] & DONE > 0)).astype(np.uint8)
        for asks, some in ((WANTED, asked & ~large[which]), (finer, asked & large[which])):
            ask = one[some]
            out += _dealt(asks, np.mod(doc[ask], groups), anchor[ask], doc[ask], start[ask], size[ask], done[some])
        return pa.Table.from_batches([_rows(out)])

    return run


def _placed(docs: pa.Table, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the documents, and where in them each start lies."""
    keys = K.id_values(docs.column("key").combine_chunks())
    buf, offs = K.text_bytes(docs.column("text").combine_chunks())
    by = np.argsort(keys, kind="stable")
    return buf, offs[by[np.searchsorted(keys[by], doc)]] + start


def _copied(buf: np.ndarray, begin: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of pieces, their bytes one after the other, and where each begins in these (one more than pieces)."""
    ends = np.concatenate(([0], np.cumsum(reach)))
    for lo, hi in K.steps(ends, K.SMALL_STEP):
        at = ends[lo : hi + 1] - ends[lo]
        yield lo, hi, buf[np.arange(int(at[-1])) + np.repeat(begin[lo:hi] - at[:-1], reach[lo:hi])], at


def aligned(text: np.ndarray, at: np.ndarray, anchor: np.ndarray, size: np.ndarray, length: int, gram: int):
    """Parts of pieces of hot anchors: piece, first start in it, number of starts, key, fingerprint.

    Equal strings hold their anchor at the same distance, so they fall into the same block
    of distances; and they agree on the bytes that all strings of that block share. No string
    stands twice in one part. ``at`` tells where pieces begin in ``text``, with the end appended.
    """
    sums, down = _sums(text)
    grams = K.mix((sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1])
    # a gram over the end of a piece lies behind the anchors of all its strings
    spots = np.flatnonzero(grams == np.repeat(anchor, np.diff(at))[: len(grams)])
    owner = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    here = at[owner] + start
    spot = spots[np.searchsorted(spots, here)]  # the first place of the anchor inside each string
    block = (spot - here) // ALIGNED
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (spot[1:] != spot[:-1]) | (block[1:] != block[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(owner)))
    owner, start, here, spot, block = (c[new] for c in (owner, start, here, spot, block))
    latest = spot - block * ALIGNED  # the last start of the whole block
    core = np.maximum(latest - ALIGNED + 1 + length, latest)
    key = K.mix((sums[core] - sums[latest]) * down[latest] + (block + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    mark = K.mix((sums[here + count + length - 1] - sums[here]) * down[here] + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return owner, start, count, key, mark


def _cut(length: int, gram: int, ranges: int, groups: int):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and docs.num_rows:
            anchor, doc, start, size, done = _joined(asked.column("body").to_pylist(), 5)
            size = size.astype(np.int64)
            buf, begin = _placed(docs, doc, start)
            found = []
            for lo, hi, text, at in _copied(buf, begin, size + length - 1):
                owner, first, count, key, mark = aligned(text, at, anchor[lo:hi], size[lo:hi], length, gram)
                owner += lo
                found.append((key, mark, doc[owner], start[owner] + first, count, done[owner] * np.uint8(DONE)))
            key, mark, doc, start, count, bits = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((start, doc, mark, key))
            out = _folded(ranges, groups, *(c[order] for c in (key, mark, doc, start, count, bits)))
        return pa.Table.from_batches([_rows(out)])

    return run


def _sent(raw: memoryview, begin: np.ndarray, length: int, parts: int, anchor, doc, start, size, done) -> list[tuple[int, int, bytes]]:
    """Pieces with their bytes, dealt by anchor."""
    part = ((anchor >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges, keys = K.cuts(part[order])
    out = []
    for k, a, b in zip(keys.tolist(), edges[:-1], edges[1:], strict=True):
        mine = order[a:b]
        head = _pack(*(c[mine] for c in (anchor, doc, start, size, done)))
        spans = zip(begin[mine].tolist(), (begin[mine] + size[mine] + length - 1).tolist(), strict=True)
        out.append((PIECES, k, b"".join([np.array([len(head)], "<i8").tobytes(), head, *(raw[x:y] for x, y in spans)])))
    return out


def _strings(buf: np.ndarray, begin: np.ndarray, length: int, parts: int, groups: int, doc, start, size, done) -> list[tuple[int, int, bytes]]:
    """Every start of the pieces by the fingerprint of its string; equal ones are folded."""
    found = []
    for lo, hi, text, at in _copied(buf, begin, size + length - 1):
        sums, down = _sums(text)
        many = size[lo:hi]
        owner = np.repeat(np.arange(hi - lo), many)
        step = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
        here = at[owner] + step
        owner += lo
        found.append((K.mix((sums[here + length] - sums[here]) * down[here]), doc[owner], start[owner] + step, done[owner]))
    mark, doc, start, done = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((start, doc, mark))
    mark, doc, start, done = (c[order] for c in (mark, doc, start, done))
    new = np.ones(len(mark), dtype=bool)
    new[1:] = mark[1:] != mark[:-1]
    many = new & ~np.append(new[1:], True)
    bits = many * np.uint8(MANY) | done * np.uint8(DONE)
    out = _dealt(STRINGS, K.bucket_of(mark[new], parts).astype(np.int64), mark[new], doc[new], start[new], bits[new])
    rest = ~new & (done == 0)
    return out + _flag_rows(groups, doc[rest], start[rest], np.ones(int(rest.sum())))


def _fetch(length: int, parts: int, groups: int):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        bodies: dict[int, list[bytes]] = {FLAGS: [], WANTED: [], SINGLE: []}
        for kind, body in zip(asked.column("kind").to_pylist(), asked.column("body").to_pylist(), strict=True):
            bodies[kind].append(body)
        out = [(FLAGS, asked.column("g")[0].as_py(), body) for body in bodies[FLAGS]]
        for kind in (WANTED, SINGLE):
            if bodies[kind] and docs.num_rows:
                anchor, doc, start, size, done = _joined(bodies[kind], 5)
                buf, begin = _placed(docs, doc, start)
                if kind == WANTED:
                    out += _sent(memoryview(buf), begin, length, parts, anchor, doc, start, size, done)
                else:
                    out += _strings(buf, begin, length, parts, groups, doc, start, size.astype(np.int64), done)
        return pa.Table.from_batches([_rows(out)])

    return run


def _repeated_strings(groups: int, packed: pa.Table) -> list[tuple[int, int, bytes]]:
    """Flags of the starts whose fingerprints meet."""
    mark, doc, start, bits = _joined(packed.column("body").to_pylist(), 4)
    order = np.argsort(mark, kind="stable")
    edges, _ = K.cuts(mark[order])
    size = np.diff(edges)
    twice = np.repeat((size > 1) | (np.maximum.reduceat(bits[order] & MANY, edges[:-1]) > 0), size)
    told = order[twice & (bits[order] & DONE == 0)]
    return _flag_rows(groups, doc[told], start[told], np.ones(len(told)))


def _expand(length: int, groups: int):
    def run(key: tuple, packed: pa.Table) -> pa.Table:
        if key[0].as_py() == FLAGS:
            return packed
        if key[0].as_py() == STRINGS:
            return pa.Table.from_batches([_rows(_repeated_strings(groups, packed))])
        columns, texts = [], []
        for body in packed.column("body"):
            raw = body.as_buffer()
            (n,) = np.frombuffer(raw, "<i8", 1)
            columns.append(_unpack(raw[8 : 8 + int(n)].to_pybytes()))
            texts.append(np.frombuffer(raw, np.uint8, offset=8 + int(n)))
        anchor, doc, start, size, whole = (np.concatenate([c[i] for c in columns]) for i in range(5))
        text = np.concatenate(texts)
        reach = size.astype(np.int64) + length - 1
        at = np.cumsum(reach) - reach
        order = np.argsort(anchor, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges, _ = K.cuts(anchor[order])
        upto = np.concatenate(([0], np.cumsum(reach[order])))[edges]
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + CHUNK, side="right")) - 1)
            j = min(j, len(edges) - 1)
            mine = order[edges[i] : edges[j]]
            i = j
            sizes = reach[mine]
            ends = np.cumsum(sizes)
            take = np.arange(int(ends[-1])) + np.repeat(at[mine] - (ends - sizes), sizes)
            twice = repeated_starts(text[take], ends, length)
            spot = np.flatnonzero(twice)
            owner = np.searchsorted(ends, spot, side="right")
            where = spot - (ends - sizes)[owner]
            some = (where < size[mine][owner]) & (whole[mine][owner] == 0)
            owner, where = owner[some], where[some]
            run_at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (where[1:] != where[:-1] + 1)))[: len(owner)])
            found.append((doc[mine][owner[run_at]], start[mine][owner[run_at]] + where[run_at], np.diff(np.append(run_at, len(owner)))))
        doc, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_batches([_rows(_flag_rows(groups, doc, start, size))])

    return run


def _flagged(keys: np.ndarray, offs: np.ndarray, length: int, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where flagged runs begin and end in the bytes of the documents, in the order of their begins."""
    doc, start, size = _joined(bodies, 3)
    # rows of one id and text are told once for each of them, and each time about all of them
    order = np.lexsort((size, start, doc))
    doc, start, size = (c[order] for c in (doc, start, size))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    doc, start, size = doc[new], start[new], size[new]
    by = np.argsort(keys, kind="stable")
    ordered = keys[by]
    lo, hi = np.searchsorted(ordered, doc, "left"), np.searchsorted(ordered, doc, "right")
    many = hi - lo
    rows = by[np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    begin = offs[rows] + np.repeat(start, many)
    end = begin + np.repeat(size.astype(np.int64), many) + length - 1
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


def _remove(length: int, with_text: bool):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        keys = K.id_values(docs.column("key").combine_chunks())
        buf, every = K.text_bytes(docs.column("text").combine_chunks())
        begin, end = _flagged(keys, every, length, flags.column("body").to_pylist())
        sizes, removed, spans, hashes, cuts, texts = [], [], [], [], [], []
        for lo, hi in K.steps(every, K.SMALL_STEP):
            base, offs = every[lo], every[lo : hi + 1] - every[lo]
            raw = buf[base : every[hi]]
            mine = slice(*np.searchsorted(begin, (base, every[hi])))  # a run stays inside its text
            depth = np.bincount(begin[mine] - base, minlength=len(raw) + 1) - np.bincount(end[mine] - base, minlength=len(raw) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            kept = ~gone
            left = raw[kept].tobytes()
            at = np.concatenate(([0], np.cumsum(kept)))[offs]
            turn = np.zeros(len(raw) + 1, dtype=bool)
            turn[:-1] = gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]
            turn[offs[:-1]] |= np.append(gone, False)[offs[:-1]]
            size = np.diff(offs)
            sizes.append(size)
            removed.append(size - np.diff(at))
            spans.append(np.diff(np.concatenate(([0], np.cumsum(turn[:-1])))[offs]))
            for i in range(hi - lo):
                text = left[at[i] : at[i + 1]]
                hashes.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[offs[i] : offs[i + 1]].astype(np.int8), [0]))))
                    cuts.append(edge.reshape(-1, 2).tolist())
                    texts.append(text)
        n = docs.num_rows
        none = np.zeros(0, np.int64)
        return pa.table(
            [
                docs.column("doc_id"), *(pa.array(np.concatenate([none, *c]), pa.int64()) for c in (sizes, removed, spans)),
                pa.array(cuts if with_text else [None] * n, pa.list_(pa.list_(pa.int64()))),
                pa.array(hashes, pa.string()),
                pa.array(texts if with_text else [None] * n, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"],
        )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int | None = None,
    hot: int = HOT,
    with_text: bool = True,
) -> DataFrame:
    """Remove every byte under a ``length``-byte string that also starts anywhere else.

    One row per input row: ``doc_id, n_bytes, n_removed, n_spans, spans`` (byte intervals,
    end exclusive), ``kept_sha256, kept`` (spans and bytes are null without ``with_text``).
    Matches stay inside texts and are judged on the input. A null text is empty. Texts
    shorter than ``length`` keep everything. Repeated rows, with or without an equal id,
    are copies like any other and remove each other. Null ids are passed through. An
    empty table gives an empty result.
    """
    gram = gram or max(4, min(GRAM, length // 2))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    width = shuffle_width(docs.sparkSession)
    size = keyed.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    groups = max(16, 2 * width, math.ceil(size / GROUP_BYTES))
    ranges, parts = max(64, groups // 2), groups
    dealt = keyed.withColumn("g", F.pmod("key", F.lit(groups)).cast("int")).groupBy("g")

    def asked(rows: DataFrame):
        return rows.select("kind", F.col("part").alias("g"), "body").groupBy("g")

    entries = keyed.select("key", "text").mapInArrow(_anchor(length, gram, ranges, groups), PACKED)
    met = Stored(docs.sparkSession, "suffix-dedup").keep(entries.groupBy("kind", "part").applyInArrow(_meet(length, groups, hot, SPLIT), PACKED))
    wanted, hottest = met.filter(F.col("kind") == WANTED), met.filter(F.col("kind") == SPLIT)
    if not hottest.isEmpty():
        cut = dealt.cogroup(asked(hottest)).applyInArrow(_cut(length, gram, ranges, groups), PACKED)
        wanted = wanted.unionByName(cut.groupBy("kind", "part").applyInArrow(_meet(length, groups, hot, SINGLE), PACKED))
    fetched = dealt.cogroup(asked(wanted)).applyInArrow(_fetch(length, parts, groups), PACKED)
    found = fetched.groupBy("kind", "part").applyInArrow(_expand(length, groups), PACKED)
    flags = asked(found.unionByName(met.filter(F.col("kind") == FLAGS)))
    return dealt.cogroup(flags).applyInArrow(_remove(length, with_text), RESULT)
