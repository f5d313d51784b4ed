import datetime as dt

from pyspark.sql import functions as F

from profilewatch.operators.cells import first_per_key
from profilewatch.sources import poll as P

SCHEMA = "k string, v double, time timestamp, id long"
KEYS = {"keys": ["k"], "values": ["v", "time"]}
def day():
    return F.make_dt_interval(days=F.lit(1))


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def seen(df):
    return sorted((r["k"], r["v"], r["time"]) for r in df.collect())


ROWS = [
    ("a", 1.0, at(1), 5), ("b", 2.0, at(2), 6), ("b", 2.5, at(2, 1), 4),           # of b the id 4 counts
    ("c", 3.0, at(3), 7), ("a", 0.5, at(3), 1),                                    # late lower id of a key kept before
    ("d", 4.0, at(2, 20), 9),                                                      # arrives late, inside the overlap
    ("e", 5.0, None, 10),
]


def test_polls_of_a_growing_table_equal_one_full_read(spark, tmp_path):
    full = spark.createDataFrame(ROWS, SCHEMA)
    store = str(tmp_path / "store")
    for upto in (2, 3, 5, 5, 7):
        got = P.poll(spark.createDataFrame(ROWS[:upto], SCHEMA), store, overlap=day(), **KEYS)
        want = first_per_key(spark.createDataFrame(ROWS[:upto], SCHEMA), ["k"], ["v", "time"])
        assert sorted(map(repr, got.select("k", "v", "time").collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, P.polled(spark, store, **KEYS).collect())) == sorted(
        map(repr, first_per_key(full, ["k"], ["v", "time"]).collect())
    )


def test_a_poll_reads_and_keeps_only_what_is_new(spark, tmp_path):
    path, store = str(tmp_path / "table"), str(tmp_path / "store")
    spark.createDataFrame(ROWS[:4], SCHEMA).write.parquet(path)
    P.poll(spark.read.parquet(path), store, overlap=day(), **KEYS)
    spark.createDataFrame([("f", 6.0, at(4), 11), ("g", 7.0, at(1), 12)], SCHEMA).write.mode("append").parquet(path)
    got = P.poll(spark.read.parquet(path), store, overlap=day(), **KEYS)
    assert [r["k"] for r in spark.read.parquet(f"{store}/rows/poll=2").collect()] == ["f"]
    assert {r["k"] for r in got.collect()} == {"a", "b", "c", "f"}                 # g came later than the overlap allows


def test_a_poll_that_died_is_done_again(spark, tmp_path):
    store = str(tmp_path / "store")
    P.poll(spark.createDataFrame(ROWS[:2], SCHEMA), store, overlap=day(), **KEYS)
    # rows without a mark: the poll after them uses the number again
    spark.createDataFrame([("x", 9.0, at(9), 99)], SCHEMA).withColumn("_order", F.col("id")).drop("id").write.parquet(f"{store}/rows/poll=2")
    assert {k for k, *_ in seen(P.polled(spark, store, **KEYS))} == {"a", "b"}
    got = P.poll(spark.createDataFrame(ROWS[:4], SCHEMA), store, overlap=day(), **KEYS)
    assert {k for k, *_ in seen(got)} == {"a", "b", "c"}


def test_numbers_as_marks_and_nothing_new(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame(ROWS[:4], SCHEMA)
    keys = {"keys": ["k"], "values": ["v"], "mark": "id"}
    first = P.poll(rows, store, **keys)
    again = P.poll(rows, store, **keys)
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))
    assert P.poll(rows.limit(0), store, **keys).count() == 3
    assert P.poll(rows.limit(0), str(tmp_path / "none"), **keys).count() == 0
