import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from profilewatch.llm import exact
from tests.llm.corpus import SPACE, documents, frame, planted, tuples


def brute(docs):
    groups = collections.defaultdict(list)
    for d, t in docs:
        groups[re.sub(SPACE, " ", t or "")].append(d)
    return sorted(
        (
            (d, min(ids), len(ids), d == min(ids), hashlib.sha256(text.encode()).hexdigest())
            for text, ids in groups.items()
            for d in ids
        ),
        key=repr,
    )


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("digest_bytes", [16, 1])           # with one byte most digests stand for several contents
def test_planted_documents(spark, digest_bytes):
    rows = planted()
    got = exact.exact_groups(frame(spark, rows), digest_bytes=digest_bytes)
    assert tuples(got, *COLUMNS) == brute([r[:2] for r in rows])


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in documents(sf_dir)]
    assert tuples(exact.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")), *COLUMNS) == brute(docs)


def test_blank_is_not_empty_null_is(spark):
    df = spark.createDataFrame([(3, ""), (1, None), (2, " "), (7, "\n\t"), (None, "x"), (9, "x")], "doc_id long, text string")
    df = df.withColumns({"key": F.lit(1), "recipe": F.lit(2), "digest": F.lit(3)})
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(df).collect()}
    assert got == {3: (1, 2, False), 1: (1, 2, True), 2: (2, 2, True), 7: (2, 2, False), None: (9, 2, False), 9: (9, 2, True)}
    assert exact.exact_groups(df.limit(0)).collect() == []


def test_equal_passages_are_cut_alike():
    import numpy as np

    passage = bytes(np.random.default_rng(5).integers(97, 123, 60_000, dtype=np.uint8))
    ends = []
    for head in (b"", b"something before it "):
        buf = np.frombuffer(head + passage, np.uint8)
        ends.append({int(e) - len(head) for e in exact.chunk_ends(buf, np.array([0, len(buf)]))[0]})
    assert len(ends[0] & ends[1]) > 0.9 * len(ends[0])
