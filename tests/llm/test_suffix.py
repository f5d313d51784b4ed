import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewatch.llm import bwt, suffix
from profilewatch.llm.bwt import repeated_starts
from tests.llm.corpus import documents, frame, planted, tuples


def brute(docs, length):
    count = collections.Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, hot", [(20, 4000), (20, 2), (47, 1), (200, 3)])
def test_planted_documents(spark, length, hot):
    rows = planted(n=60)
    docs = [(r[0], (r[1] or "").encode()) for r in rows]
    got = suffix.remove_repeats(frame(spark, rows), length=length, hot=hot)
    assert tuples(got, *suffix.DIGEST) == brute(docs, length)


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in documents(sf_dir)]
    got = suffix.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    assert tuples(got, *suffix.DIGEST) == brute(docs, 200)


def test_repeats_inside_one_text_and_odd_inputs(spark):
    df = spark.createDataFrame(
        [(1, "xy" * 40), (2, "a" * 21), (3, "b" * 20), (None, None), (5, "")], "doc_id long, text string"
    ).withColumns({"key": F.lit(0), "g": F.lit(0), "kind": F.lit("k")})
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in suffix.remove_repeats(df, length=20).collect()}
    assert got == {1: (80, b""), 2: (21, b""), 3: (0, b"b" * 20), None: (0, b""), 5: (0, b"")}
    assert suffix.remove_repeats(df.limit(0), length=20).collect() == []


def test_transform_against_counting():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab\x00c") for _ in range(80))
    for _ in range(150):
        length = rng.choice([7, 8, 9, 12, 20, 33])
        texts = []
        for _ in range(rng.randint(1, 8)):
            at, size = rng.randrange(60), rng.randint(1, 70)
            text = rng.choice([base[at : at + size], b"a" * size, bytes(rng.choice(b"ab") for _ in range(size))])
            if rng.random() < 0.4:
                text = text[: size // 2] + b"z" + text[size // 2 + 1 :]
            texts.append(text or b"q")
        count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [len(t) - i >= length and count[t[i : i + length]] > 1 for t in texts for i in range(len(t))]
        got = repeated_starts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), length)
        assert got.tolist() == want


@pytest.mark.parametrize("n", [1, 40, (1 << 21) - 1, 1 << 21, 1 << 30])
def test_tied_suffixes_by_both_ranks(n):
    rng = np.random.default_rng(n)
    # as the doubling hands them over: by the first rank, ties by position
    at = np.unique(rng.integers(0, n, 500))
    own = np.sort(rng.integers(0, n + 1, len(at)) // 3 * 3)
    at = np.concatenate([np.sort(g) for g in np.split(rng.permutation(at), np.flatnonzero(np.diff(own)) + 1)])
    second = rng.choice([0, n // 2, n], len(at))
    by = np.lexsort((at, second, own))
    got = bwt._by_ranks(own, second, at, n)
    assert [c.tolist() for c in got] == [own[by].tolist(), second[by].tolist(), at[by].tolist()]


def test_a_transform_sorts_no_three_arrays(monkeypatch):
    text = np.frombuffer(random.Random(5).randbytes(300) * 20, np.uint8)
    monkeypatch.setattr(np, "lexsort", None)
    ends = np.arange(300, len(text) + 1, 300)
    assert repeated_starts(text, ends, 200).reshape(-1, 300)[:, :101].all()


def staged(texts, length, gram, hot, ranges, groups, parts):
    """The steps up to the flags, without Spark: starts that repeat by text, and the rows that left the first step."""
    import pyarrow as pa

    docs = pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["key", "text"])

    def grouped(rows, run):
        dealt = collections.defaultdict(list)
        for kind, part, body in rows:
            dealt[kind, part].append((kind, part, body))
        return [row for k, own in dealt.items() for row in listed(run((pa.scalar(k[0]), pa.scalar(k[1])), suffix._rows(own)))]

    def cogrouped(rows, run):
        out = []
        for g in sorted({part for _, part, _ in rows}):
            own = pa.Table.from_batches([suffix._rows([row for row in rows if row[1] == g])]).rename_columns(["kind", "g", "body"])
            out += listed(run(docs.filter(pa.array([i % groups == g for i in range(len(texts))])), own))
        return out

    def listed(found):
        return list(zip(*(found.column(c).to_pylist() for c in ("kind", "part", "body")), strict=True))

    first = [row for batch in suffix._anchor(length, gram, ranges, groups)(iter(docs.to_batches())) for row in listed(batch)]
    met = grouped(first, suffix._meet(length, groups, hot, suffix.SPLIT))
    cut = cogrouped([row for row in met if row[0] == suffix.SPLIT], suffix._cut(length, gram, ranges, groups))
    asked = [row for row in met if row[0] == suffix.WANTED] + grouped(cut, suffix._meet(length, groups, hot, suffix.SINGLE))
    found = grouped(cogrouped(asked, suffix._fetch(length, parts, groups)), suffix._expand(length, groups))
    starts = collections.defaultdict(set)
    for kind, _, body in found + [row for row in met if row[0] == suffix.FLAGS]:
        assert kind == suffix.FLAGS
        for doc, start, size in zip(*(c.tolist() for c in suffix._unpack(body)), strict=True):
            starts[doc].update(range(start, start + size))
    return starts, first


def test_a_passage_of_many_texts_fills_no_transform(monkeypatch):
    rng = random.Random(3)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, taken = words(600), []
    repeated = suffix.repeated_starts
    monkeypatch.setattr(suffix, "repeated_starts", lambda text, *a: taken.append(len(text)) or repeated(text, *a))
    monkeypatch.setattr(suffix, "CHUNK", 20_000)
    for n in (200, 800):
        # edges that 16 starts reach over alike for some, and for none
        texts = [words(rng.randint(0, 150)) + rng.choice(["", "xyz"]) + passage + words(rng.randint(0, 150)) for _ in range(n)]
        taken.clear()
        starts, _ = staged(texts, 200, 32, 50, 8, 4, 4)
        count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        for doc, t in enumerate(texts):
            assert starts[doc] == {i for i in range(len(t) - 199) if count[t[i : i + 200]] > 1}
        assert max(taken, default=0) <= suffix.CHUNK


def test_anchors_fill_all_ranges():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(100)]
    _, first = staged(texts, 200, 32, 50, 64, 4, 4)
    sizes = [len(suffix._unpack(body)[0]) for kind, _, body in first if kind == suffix.ENTRIES]
    assert len(sizes) == 64 and max(sizes) < 3 * sum(sizes) / 64


def test_buckets_follow_the_bytes_of_the_input(spark, monkeypatch):
    rows = planted(n=60)
    anchor, asked = suffix._anchor, []
    monkeypatch.setattr(suffix, "GROUP_BYTES", 250)
    monkeypatch.setattr(suffix, "_anchor", lambda *a: asked.append(a) or anchor(*a))
    got = suffix.remove_repeats(frame(spark, rows), length=20, hot=5)
    assert tuples(got, *suffix.DIGEST) == brute([(r[0], (r[1] or "").encode()) for r in rows], 20)
    size = sum(len((r[1] or "").encode()) for r in rows)
    assert asked[0][3] >= size / 250 and asked[0][2] >= size // 500


def test_flags_of_equal_rows_do_not_multiply():
    n = 3_000
    body = suffix._pack(np.full(n, 7), np.full(n, 2), np.full(n, 5, "<u4"))
    begin, end = suffix._flagged(np.full(n, 7), np.arange(n + 1) * 40, 20, [body, body])
    assert begin.tolist() == [40 * i + 2 for i in range(n)] and (end - begin == 24).all()


def test_equal_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "xyzuvw" * 9)] * 400 + [(1, "abc" + "d" * 15)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(df, length=20).collect())
    assert got == {(None, 54, 54): 400, (1, 18, 0): 1}
