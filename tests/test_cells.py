import pytest
from pyspark.sql import functions as F

from profilewatch.constants import WHITESPACE
from profilewatch.functions import signals as S
from profilewatch.functions import text as X
from profilewatch.operators import cells as C
from profilewatch.schemas import SCORES, conform
from profilewatch.sources import readers
from tests.planted import EMBED, LAYER, SCOPE, SIGNAL_SCHEMA, signal


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    "name,layer",
    [(LAYER + "0", 0), (LAYER + "23", 23), (EMBED, -1), ("logits", None), (LAYER, None),
     (LAYER + "x", None), ("", None), (LAYER + "3\n", None), ("x" + LAYER + "3", None)],
)
def test_layer_of(spark, name, layer):
    assert one(spark, S.layer_of(F.col("s")), s=name) == layer
    assert one(spark, S.layer_or_unknown(F.col("s")), s=name) == (-99 if layer is None else layer)


def test_strict_layer_fails_on_unknown_names(spark):
    assert one(spark, S.layer_of_strict(F.col("s")), s=LAYER + "4") == 4
    with pytest.raises(Exception, match="not a layer signal"):
        one(spark, S.layer_of_strict(F.col("s")), s="logits")


def test_layer_names():
    names = S.layer_signal_names()
    assert len(names) == 24 and names[0] == LAYER + "0" and names[-1] == LAYER + "23"


def test_last_generation_pass_is_numeric_and_skips_prefill(spark):
    rows = [("r1", "8"), ("r1", "10"), ("r2", "1"), ("r3", "x"), ("r3", "4"), ("r4", None)]
    df = spark.createDataFrame(rows, "request_id string, forward_pass_index string")
    found = {r["request_id"]: r["last_pass"] for r in C.last_generation_pass(df).collect()}
    assert found == {"r1": 10, "r3": 4}
    assert C.last_generation_pass(df, min_pass=9).count() == 1
    assert C.unreadable_passes(df).first()[0] == 1


def test_cells_keep_the_lowest_id_and_one_marker_outside_the_scope(spark):
    rows = [
        signal("r", LAYER + "0", 2, 5.0, 7), signal("r", LAYER + "0", 2, 1.0, 3),
        signal("r", LAYER + "1", 3, float("nan"), 1), signal("r", LAYER + "1", 9, 4.0, 1),
        signal("out", LAYER + "9", 2, 4.0, 1), signal("out", "logits", 2, 4.0, 1),
        signal("out", EMBED, 2, 4.0, 1),
    ]
    df = spark.createDataFrame(rows, SIGNAL_SCHEMA)
    found = {(r[0], r[1], r[2]): r[3] for r in C.typed_cells(df, **SCOPE).collect()}
    assert found == {
        ("r", 0, 2): 1.0, ("r", 1, 3): None, ("r", None, None): None, ("out", None, None): None
    }


def test_a_row_without_an_id_loses_but_still_counts(spark):
    df = spark.createDataFrame(
        [("k", 1.0, None), ("k", 2.0, 5), ("only", 3.0, None)], "key string, v double, id long"
    )
    assert {tuple(r) for r in C.first_per_key(df, ["key"], ["v"]).collect()} == {("k", 2.0), ("only", 3.0)}


def test_deduplication_is_idempotent(spark):
    rows = [signal("r", LAYER + str(i % 3), 2 + i % 2, float(i), i) for i in range(50)]
    df = spark.createDataFrame(rows, SIGNAL_SCHEMA)
    keys, values = ["request_id", "signal_type", "forward_pass_index"], ["std", "id"]
    once = C.first_per_key(df, keys, values)
    assert sorted(once.collect()) == sorted(C.first_per_key(once, keys, values).collect())


WINDOW = ("2024-01-01 10:00:00+00", "2024-01-01 11:00:00+00")


def test_reader_window_model_and_soft_deletes(spark):
    payloads = spark.createDataFrame(
        [("start", "2024-01-01 10:00:00", "m", None), ("end", "2024-01-01 11:00:00", "m", None),
         ("start", "2024-01-01 10:30:00", "m", None), ("gone", "2024-01-01 10:30:00", "m", "2024-01-02 00:00:00"),
         ("other", "2024-01-01 10:30:00", "n", None)],
        "request_id string, timestamp string, model_id string, deleted_at string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp", "deleted_at")})
    rows = [signal(r, LAYER + "0", p, 1.0, i) for i, r in enumerate(["start", "end", "gone", "other"]) for p in (1, 2)]
    deleted = list(signal("start", LAYER + "1", 2, 1.0, 9))
    deleted[-1] = __import__("datetime").datetime(2024, 1, 1)
    df = spark.createDataFrame([*rows, tuple(deleted)], SIGNAL_SCHEMA)

    def ids(**kw):
        return sorted((r["request_id"], r["forward_pass_index"]) for r in
                      readers.read_signals(df, payloads, WINDOW, **kw).collect())

    assert ids() == [("other", "1"), ("other", "2"), ("start", "1"), ("start", "2")]
    assert ids(model_id="m", passes=(2,)) == [("start", "2")]
    assert ids(signal_types=[LAYER + "7"]) == []


def test_last_vectors_skip_prefill_junk_and_empty(spark):
    payloads = spark.createDataFrame([("r",), ("p",)], "request_id string").withColumns(
        {"timestamp": F.lit("2024-01-01 10:30:00").cast("timestamp"), "model_id": F.lit("m"),
         "deleted_at": F.lit(None).cast("timestamp")}
    )
    rows = [("r", "1", [9.0], 1), ("r", "8", [8.0], 2), ("r", "10", [1.0, 2.0, 3.0], 5), ("r", "10", [7.0], 6),
            ("r", "11", [], 3), ("r", "x", [5.0], 4), ("r", " 12", [6.0], 4), ("p", "1", [9.0], 7)]
    df = spark.createDataFrame(rows, "request_id string, forward_pass_index string, embedding_vector array<float>, id long"
                               ).withColumns({"signal_type": F.lit(LAYER + "14"), "deleted_at": F.lit(None).cast("timestamp")})
    found = readers.read_last_vectors(df, payloads, WINDOW, keep_dims=2).collect()
    assert [tuple(r) for r in found] == [("r", "10", [1.0, 2.0])]
    assert len(readers.read_last_vectors(df, payloads, WINDOW, min_pass=0).collect()) == 2


def test_contracts_hold_for_empty_and_foreign_frames(spark):
    odd = spark.createDataFrame([("p", "7", 1)], "prompt_id string, cv string, extra int")
    row = conform(odd, SCORES)
    assert row.columns == SCORES.names and row.first()["cv"] == 7.0 and row.first()["flag"] is None


def test_a_value_that_does_not_fit_fails(spark):
    odd = spark.createDataFrame([("p", "12x")], "prompt_id string, cv string")
    with pytest.raises(Exception, match="12x"):
        conform(odd, SCORES).collect()


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "signals.csv"
    path.write_text("id,std,extra,request_id,forward_pass_index,signal_type\n7,2.5,x,r9,08,sig\n")
    row = readers.read_table(spark, str(path)).first()
    assert (row["request_id"], row["std"], row["forward_pass_index"], row["id"], row["mean"]) == ("r9", 2.5, "08", 7, None)
    path.write_text("request_id,std\nr9,many\n")
    with pytest.raises(Exception, match="many"):
        readers.read_table(spark, str(path)).collect()


def test_a_stored_capture_gets_its_file_order(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("request_id,signal_type,forward_pass_index,std\n" + "".join(f"r,s,1,{i}\n" for i in range(50)))
    rows = readers.read_capture(spark, str(path))
    assert [r["std"] for r in rows.orderBy("id").collect()] == [float(i) for i in range(50)]


@pytest.mark.parametrize("kind, low", [("string", "'a'"), ("timestamp", "timestamp'2024-01-01 00:00:00.1'"), ("double", "0.25D"), ("long", "3L")])
def test_copies_are_ordered_by_ids_of_any_type(spark, kind, low):
    high = {"string": "'b'", "timestamp": "timestamp'2024-01-01 00:00:00.2'", "double": "0.5D", "long": "4L"}[kind]
    rows = spark.sql(f"select 'k' k, 2.0D v, {high} id union all select 'k', 1.0D, {low} union all select 'k', 9.0D, null")
    assert C.first_per_key(rows, ["k"], ["v"]).first()["v"] == 1.0


def test_csv_keeps_the_pass_as_text(spark, tmp_path):
    df = spark.createDataFrame([signal("r", LAYER + "0", "08", 1.5)], SIGNAL_SCHEMA).drop("id", "deleted_at")
    path = str(tmp_path / "rows.csv")
    readers.write_csv(df, path)
    back = readers.read_table(spark, path).first()
    assert back["forward_pass_index"] == "08" and back["std"] == 1.5


def test_prompt_from_payload(spark):
    payloads = ['{"raw":{"text":"t","messages":[{"content":"m"}]}}', '{"raw":{"messages":[{"content":"a"},{"content":"b"}]}}',
                '{"raw":{"messages":[]}}', '{"k":1}', "no json", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = [r[1] for r in df.select("i", X.prompt_text(F.col("p"))).orderBy("i").collect()]
    assert got == ["t", "b", None, None, None, None]


def test_whitespace_covers_what_python_strips(spark):
    import sys

    assert set(WHITESPACE) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    raw = WHITESPACE + "a" + WHITESPACE + "b" + WHITESPACE
    assert one(spark, X.strip(F.col("t")), t=raw) == raw.strip()
    assert one(spark, X.single_spaced(F.col("t")), t=raw) == " ".join(raw.split())
