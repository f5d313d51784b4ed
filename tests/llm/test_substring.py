import hashlib

from pyspark.sql import functions as F

from profilewatch.llm import substring
from tests.llm.corpus import documents, frame, planted, tuples, words


def brute(docs, width):
    first = {}
    listed = [(d, words(t)) for d, t in docs]
    for d, ws in sorted(listed, key=lambda x: x[0]):
        for i in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[i : i + width]), d)
    out = []
    for d, ws in listed:
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_planted_documents(spark):
    rows = planted()
    got = substring.remove_repeats(frame(spark, rows), width=5)
    assert tuples(got, *COLUMNS) == brute([r[:2] for r in rows], 5)
    # spans are maximal, end exclusive, and the kept text is what they leave
    for r in got.filter("n_removed > 0").collect():
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
        assert all(x[1] < y[0] for x, y in zip(r["spans"], r["spans"][1:]))
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_blocks_and_steps_do_not_matter(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in documents(sf_dir)]
    got = substring.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7), with_text=False)
    assert tuples(got, *COLUMNS) == brute(docs, 13)


def test_null_ids_empty_table_and_clashing_columns(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (4, text), (9, None)], "doc_id long, text string")
    df = df.withColumns({"g": F.lit(1), "kind": F.lit("x"), "part": F.lit(2), "body": F.lit(b"")})
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(df, width=3).collect()}
    assert got == {None: 7, 4: 0, 9: 0}                      # a missing id comes last
    assert substring.remove_repeats(df.limit(0), width=3).collect() == []
