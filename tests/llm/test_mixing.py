import collections

import pytest
from pyspark.sql import functions as F

from profilewatch.llm import mixing
from tests.llm.corpus import SCHEMA, documents, frame, planted, words


def brute_targets(sizes, weights, share, cap):
    """Clamp and deal out again, source by source."""
    total, clamped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in clamped)
        weight = sum(weights[s] for s in sizes if s not in clamped)
        target = {s: cap * sizes[s] if s in clamped else rest * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in clamped and target[s] > cap * sizes[s]}
        if not over:
            return target
        clamped |= over


def check(rows, docs):
    sizes = collections.Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for source, own in by.items():
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[source]) <= largest / 2 + 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_planted_documents(spark):
    docs = planted(n=150)[:150]
    taken, _ = mixing.mix(frame(spark, docs))
    check(taken.collect(), docs)


def test_whole_table_twice(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], None) for r in documents(sf_dir)]
    runs = []
    for parts in (3, 8):
        taken, _ = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(parts))
        rows = taken.collect()
        check(rows, docs)
        runs.append({r["doc_id"]: r["taken"] for r in rows})
    assert runs[0] == runs[1]


def test_weights_and_caps_of_the_caller(spark):
    docs = [(i, "w " * 10, None, s, None) for i, s in enumerate(["a"] * 10 + ["b"] * 10 + ["c"] * 10)]
    weights = spark.createDataFrame([("a", 1), ("b", 4), (None, 7)], "source string, weight long")
    taken, plan = mixing.mix(frame(spark, docs), weights=weights, share=1.0, cap=2.5)
    target = {r["source"]: r["target"] for r in plan.collect()}
    assert target == pytest.approx({"a": 60.0, "b": 240.0, "c": 0.0})
    assert {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("taken").alias("n")).collect()} == {"a": 60, "b": 240, "c": 0}


def test_the_mix_itself_repeats_whole_rows(spark):
    docs = frame(spark, planted(n=60)[:60]).withColumn("repeats", F.lit("mine")).withColumn("draw", F.lit(1))
    taken, plan = mixing.mix(docs)
    want = {r["doc_id"]: r["repeats"] for r in taken.collect() if r["repeats"]}
    out = mixing.repeated(docs, plan)
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == want


def test_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none)[0].collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "s", None)], SCHEMA)
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(blank)[0].collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
