import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from profilewatch.llm import fingerprints as P
from tests.llm.corpus import SCHEMA, documents, frame, lower, planted, words


def order(rows):
    """Descending ids, nulls last; the tests compare rows of one id as a set."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def shingles(text):
    ws = words(lower(text))
    return {tuple(ws[max(0, i - P.SHINGLE + 1) : i + 1]) for i in range(len(ws))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def check(rows, got):
    rows = order(rows)
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    errors = []
    for i, (d, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = by_id[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        errors += [abs(r["near_edited"] - jaccard(text, new)), abs(r["near_next"] - jaccard(text, following))]
    assert max(errors) < 0.25 and np.mean(errors) < 0.03


def test_planted_documents(spark):
    rows = planted(n=120)[:121]
    check([r[:2] for r in rows], P.edited_fingerprints(frame(spark, rows, 6)).collect())


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(sf_dir)]
    check(rows, P.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(["a b c d e f g", "x", "", None, "  ", "a b c d e f g", "x"])]
    got = {r["doc_id"]: r for r in P.edited_fingerprints(frame(spark, rows)).collect()}
    assert got[0]["fingerprint"] == got[5]["fingerprint"] != got[1]["fingerprint"] == got[6]["fingerprint"]
    assert {got[i]["fingerprint"] for i in (2, 3, 4)} == {""}
    assert got[4]["near_next"] == got[3]["near_next"] == 1.0 and got[2]["near_next"] == 0.0


def test_one_row_no_row_repeated_and_missing_ids(spark):
    one = P.edited_fingerprints(spark.createDataFrame([(4, "abcd efgh", None, None, None)], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest() and one["near_next"] == 1.0
    assert P.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(1)
    rows = [(rng.choice([None, 7, 7, 8]), f"text {i % 40} " * 5, None, None, None) for i in range(400)]
    df = frame(spark, rows, 9).withColumns({c: F.lit(0) for c in ("place", "tie", "part", "guest", "head")})
    got = P.edited_fingerprints(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    again = P.edited_fingerprints(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_search_finds_what_brute_force_finds(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocab) for _ in range(200)] for _ in range(12)]
    rows = []
    for i in range(400):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 9])):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        rows.append((i, " ".join(ws) if i % 13 else rng.choice(["", None, " "]), None, None, None))
    pairs, members = P.search(frame(spark, rows), F.col("doc_id") % 20 == 0)
    at = {r["doc_id"]: r["class_id"] for r in members.collect()}
    first = {}
    for d, t, *_ in rows:
        first.setdefault(t or "", d)
    assert at == {d: first[t or ""] for d, t, *_ in rows}
    got = {(r["query_class"], r["class_id"]): r["jaccard"] for r in pairs.collect()}
    text = {d: t for d, t, *_ in rows}
    asked = {at[d] for d in text if d % 20 == 0}
    want = {
        (q, c): jaccard(text[q], text[c])
        for q in asked
        for c in set(at.values())
        if q != c and shingles(text[q]) and jaccard(text[q], text[c]) >= 0.8
    }
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    none, nobody = P.search(frame(spark, rows).limit(0), F.lit(True))
    assert none.count() == nobody.count() == 0


def test_long_text_and_estimates():
    rng = np.random.default_rng(2)
    long = " ".join(map(str, rng.integers(0, 9999, 300_000)))
    half = long[: len(long) // 2]
    sig, some = P.signatures(pa.array([long, half, long, ""]))
    assert some.tolist() == [True, True, True, False]
    assert P.likeness(sig[:1], some[:1], sig[2:3], some[2:3])[0] == 1
    assert abs(P.likeness(sig[:1], some[:1], sig[1:2], some[1:2])[0] - 0.5) < 0.2
