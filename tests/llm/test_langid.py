import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from profilewatch.llm import langid
from tests.llm.corpus import documents

ALPHABETS = {"aa": "abcde rst", "bb": "éèçabo xyz", "cc": "дежзик лмн"}


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(ALPHABETS))
        text = "".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(40, 300)))
        out.append((i, text.upper() if i % 7 == 0 else text, lang))
    return out


def test_held_out_accuracy(spark):
    rows = texts(400)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {d: lang for d, _, lang in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_whole_table(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in documents(sf_dir)}
    got = langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_labels_of_the_held_out_fold_have_no_effect(spark):
    rows = texts(120)
    other = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in rows]
    frames = [spark.createDataFrame(x, "doc_id long, text string, lang string") for x in (rows, other)]
    first, second = (sorted(tuple(r) for r in langid.identify(f).collect()) for f in frames)
    assert first == second


def test_no_letter_no_text_and_columns_in_the_way(spark):
    rows = texts(80) + [(900, None, "aa"), (901, "12 !? ***", "bb"), (902, "", None), (None, "абв дед", "cc"), (1, "abc", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "row": F.lit(2)})
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert not got[None]["held_out"] and got[None]["lang_pred"] == "cc"
    model = langid.fit(langid.training_rows(df))
    assert langid.with_language(df, model).columns == [*df.columns, "__lang_pred", "__score"]


def test_whole_rows_pass_in_small_batches_with_one_text():
    class Sent:
        value = langid.Model(["aa", "bb"], np.zeros((langid.SLOTS, 2), np.float32), np.array([0.0, 1.0]), 1.0)

    text = pa.array(["abcde rst " * 100] * 5_000 + ["12", None])
    batch = pa.record_batch([pa.array(range(len(text))), text, pa.array(["x"] * len(text))], names=["id", "text", "source"])
    got = list(langid._predict(Sent, 1, 3)(iter([batch])))
    assert max(b.num_rows for b in got) <= 1_000  # 1,000 bytes a row
    whole = pa.Table.from_batches(got)
    assert whole.select(["id", "text", "source"]).equals(pa.Table.from_batches([batch]))
    assert whole.column("lang_pred").to_pylist() == ["bb"] * 5_000 + ["und"] * 2


def test_whole_rows_keep_columns_of_any_name_and_type(spark):
    rows = [(d, t, lang, 7, [1, 2], None) for d, t, lang in texts(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, `a.b` array<int>, lang_pred string")
    model = langid.fit(langid.training_rows(df))
    got = langid.with_language(df, model)
    assert got.schema.fields[:6] == df.schema.fields and sorted(tuple(r)[:6] for r in got.collect()) == rows
    want = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert {r["doc_id"]: (r["__lang_pred"], r["__score"]) for r in got.collect()} == want


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(df).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0)).collect() == []


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(4000, 3)) * 2
    truth = np.array([rng.choice(3, p=p) for p in langid.softmax(scores)])
    assert langid.calibrated(scores * 4, truth) == pytest.approx(4, rel=0.15)


def test_penalty_keeps_weights_sparse():
    examples = [(np.array([1, 2 + i % 50, langid.SLOTS]), np.array([1.0, 1e-5, 1.0]), i % 2) for i in range(100)]
    w = langid.fit_ftrl(examples, 2)
    assert np.count_nonzero(w[2:52]) == 0 and np.count_nonzero(w[langid.SLOTS]) > 0
