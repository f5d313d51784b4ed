import json
import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilewatch.functions import text as X
from profilewatch.operators import manifold as M
from profilewatch.operators import textgate as G

GOOD = (
    "To repot a fern, water it the day before, loosen the root ball gently and choose a pot "
    "only slightly wider than the old one. Fresh soil goes underneath and around the sides."
)


def checked(spark, texts, **limits):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return G.text_checks(df, **limits).orderBy("i").collect()


def test_each_reason_on_its_own_text(spark):
    rows = checked(spark, [
        GOOD, "Sure.", "word " * 2000, "It reads mmmmmmmmmmmmmmmmmmmm and then goes on to the end.",
        "yes no " * 40, "the " * 30 + "harbour lights dim slowly over quiet water tonight again friends",
        "-?!... " * 10, "", "   ", "z" * 24,
    ])
    assert rows[0]["text_ok"] and rows[0]["reason_codes"] == "" and rows[0]["text_reasons"] == ""
    assert [r["reason_codes"] for r in rows[1:]] == [
        "too_short;top_word", "too_long;few_distinct;top_word", "char_run", "few_distinct;top_word", "top_word", "no_words",
        "too_short", "too_short", "too_short;char_run;top_word",
    ]
    assert rows[1]["text_reasons"] == "too short: 5 < 40 chars; top word is 1.00 of all words"
    assert "character repeated 20 times in a row" in rows[3]["text_reasons"]
    assert "only 0.03 distinct-word ratio" in rows[4]["text_reasons"]
    assert "top word is 0.50 of all words" in rows[4]["text_reasons"]


def test_limits_are_arguments_and_null_is_undecided(spark):
    assert checked(spark, [GOOD], max_chars=50)[0]["reason_codes"] == "too_long"
    row = checked(spark, [None])[0]
    assert row["text_ok"] is None and row["reason_codes"] is None


def test_two_decimals_follow_the_stored_value(spark):
    values = [0.125, 0.345, 0.355, 0.005, 0.015, 0.25, 1.0, 0.999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(G.two_decimals(F.col("x"))).collect()] == [f"{v:.2f}" for v in values]


def naive(text):
    t = text.strip()
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9']+", t)]
    run = best = 0
    for a, b in zip([None, *t], t):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return len(t), best, len(words), len(set(words)), max(Counter(words).values(), default=0)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from("aAbB' 1é😀\n\t\x1c -"), max_size=60), min_size=1, max_size=20))
def test_measures_equal_a_plain_loop(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [
        (r["stripped_chars"], r["char_run"], r["n_words"], r["n_distinct_words"], r["top_word_count"])
        for r in G.text_measures(df).orderBy("i").collect()
    ]
    assert got == [naive(t) for t in texts]


def test_very_long_runs(spark):
    df = spark.createDataFrame([("a" * 300_000 + "b",)], "text string")
    assert G.text_measures(df).first()["char_run"] == 300_000


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from("n\\\n a\u0001r01"), max_size=25), min_size=1, max_size=30))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    line = df.withColumn("line", X.escape_line(F.col("t")))
    for r in line.withColumn("back", X.unescape_line(F.col("line"))).collect():
        assert "\n" not in r["line"] and r["back"] == r["t"]


def test_carriage_returns_become_newlines(spark):
    df = spark.createDataFrame([("a\r\nb",)], "t string")
    assert df.select(X.escape_line(F.col("t"))).first()[0] == "a\\nb"


BODIES = [
    ('{"generated_text":"g","text":"t"}', "g"),
    ('{"text":"","output":"o"}', ""),                          # an empty text is an answer
    ('{"response":{"output":{"text":"deep"}}}', "deep"),
    ('{"response":{"other":1},"result":"r"}', "r"),            # nothing nested, the next key counts
    ('{"response":{"text":""},"result":"r"}', "r"),            # nested and empty does not
    ('{"text":5,"result":"r"}', "r"),
    ('{"output":["first","second"]}', "first"),
    ('{"choices":[{"message":{"content":"c"}}]}', "c"),
    ('{"choices":[{"text":"ct"},{"text":"no"}]}', "ct"),
    ('{"choices":[{"k":1}],"message":{"content":"m"}}', ""),   # a choice decides, even without text
    ('{"choices":[],"message":{"content":"m"}}', "m"),
    ('{"message":{"content":7}}', ""),
    ('[{"completion":"l"},{"completion":"m"}]', "l"),
    ("[]", ""),
    ('"just text"', "just text"),
    ("no json at all", "no json at all"),
    ("17", ""),
    ("null", ""),
    (json.dumps({"output": {"output": {"output": {"output": {"output": {"text": "six"}}}}}}), "six"),
    (None, None),
]


def test_answers_of_unknown_shape(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "i int, body string")
    got = [r[1] for r in df.select("i", X.response_text(F.col("body"))).orderBy("i").collect()]
    assert got == [want for _, want in BODIES]


MORE_BODIES = [
    ('{"text":"a","text":"b"}', "b"),                          # the last of a repeated key
    ('{"result":"say NaN, \\" Infinity","x":NaN,"y":[-Infinity]}', 'say NaN, " Infinity'),
    ('{"response":[{"text":""},{"text":"b"}],"output":"o"}', "o"),
    ('{"response":{"choices":[{"k":1}],"message":{"content":"in"}},"result":"r"}', "r"),
    ('{"response":{"choices":[],"message":{"content":"in"}},"result":"r"}', "in"),
    ('{"choices":[""],"message":{"content":"m"}}', ""),
    ('{"choices":[null],"message":{"content":"m"}}', ""),
    ('{"choices":[[[["x"]]]]}', "x"),
    ('{"choices":{"text":"no list"},"message":{"content":"m"}}', "m"),
    ('{"text":null,"output":{"message":{"content":"c"}}}', "c"),
    ('""', ""), ("{}", ""), ("", ""), ("  ", "  "), ("{broken", "{broken"), ("NaN is no answer", "NaN is no answer"),
    ("17 apples", "17 apples"), ('{"text":"a"} {"text":"b"}', '{"text":"a"} {"text":"b"}'), ('"a","b"', '"a","b"'),
    ('"a"],["b"', '"a"],["b"'), (' {"text":"a"}\n', "a"),
]


def test_answers_in_odd_bodies_without_python(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(MORE_BODIES)], "i int, body string")
    found = df.select("i", X.response_text(F.col("body")).alias("t"))
    assert [r["t"] for r in found.orderBy("i").collect()] == [want for _, want in MORE_BODIES]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_answers_at_any_depth(spark):
    def nested(depth):
        body = {"text": f"d{depth}"}
        for i in range(depth):
            body = [{"output": body}, {"response": {"text": ""}, "result": body}, [body]][i % 3]
        return json.dumps(body)

    df = spark.createDataFrame([(i, nested(i)) for i in range(0, 60, 3)], "i int, body string")
    assert {r[0]: r[1] for r in df.select("i", X.response_text(F.col("body"))).collect()} == {i: f"d{i}" for i in range(0, 60, 3)}


@pytest.fixture(scope="module")
def model(spark):
    ring = [(i, [math.cos(i), math.sin(i)]) for i in range(200)]
    return M.fit_manifold(spark.createDataFrame(ring, "i int, vector array<double>"), mode="full")


def test_both_halves_decide_and_a_missing_half_is_skipped(spark, model):
    rows = [(0, GOOD, [0.0, 0.0]), (1, GOOD, [12.0, -12.0]), (2, "yes no " * 40, [0.0, 0.0]), (3, GOOD, None)]
    df = spark.createDataFrame(rows, "i int, text string, vector array<double>")
    got = G.run_gate(df, "text", "vector", model).orderBy("i").collect()
    assert [r["gate_ok"] for r in got] == [True, False, False, True]
    assert [r["is_ood"] for r in got] == [False, True, False, None]
    bare = G.run_gate(df.drop("vector")).orderBy("i").collect()
    assert [r["gate_ok"] for r in bare] == [True, True, False, True] and bare[1]["is_ood"] is None
