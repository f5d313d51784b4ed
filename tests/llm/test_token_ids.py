import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilewatch.llm import token_ids
from profilewatch.llm.queries import vocabulary_path
from tests.llm.corpus import documents, frame, planted, tuples

COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


def brute(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    out, start = [], 0
    for d, text in sorted(docs, key=lambda x: x[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_planted_documents(spark):
    odd = ["It's we'll 12 34 <|endoftext|> x<|startoftext|>y", "é ́   z", "ΑΣ ΑΣΑ İ ﬁ", "\x00 \x1f\x85"]
    rows = planted(n=40) + [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    rows = list({r[0]: r for r in rows}.values())
    assert tuples(token_ids.token_files(frame(spark, rows), vocabulary_path()), *COLUMNS) == brute([r[:2] for r in rows])


def test_pieces_give_the_ids_of_whole_texts():
    """Letters, signs, marks and added tokens in any order."""
    import random

    import pyarrow as pa

    rng = random.Random(6)
    alphabet = list("abAZz019 '\u2019.,;:!?-_()[]{}<>=+*/\\|\"#$%&@^`~\t\n \u0085\xa0éüßñ«»“”…—\u0338\u0327\u0301İẞ中日あ\u017f\u212a")
    alphabet += ["'s", "'t", "'LL", "N'T", " the ", "<|endoftext|>", "<|EndOfText|>", "\U0001f600"]
    encoder = token_ids.WordEncoder(vocabulary_path())
    run = token_ids._encode(vocabulary_path(), 1)
    for _ in range(8):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["doc_id", "text"])
        got = {i: np.frombuffer(b, "<u2").tolist() for r in run(iter([batch])) for i, b in zip(*(c.to_pylist() for c in r.columns), strict=True)}
        assert got == {i: [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in documents(sf_dir)]
    got = token_ids.token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
    assert tuples(got, *COLUMNS) == brute(docs)


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([(2, "b c"), (2, "b c"), (None, "z"), (1, None)], "doc_id long, text string")
    df = df.withColumns({"part": F.lit(1), "ids": F.lit(2)})
    got = [tuple(r) for r in token_ids.token_files(df, vocabulary_path()).orderBy("start").select("doc_id", "start", "n_tokens").collect()]
    assert got == [(1, 0, 1), (2, 1, 3), (2, 4, 3), (None, 7, 2)]
    assert token_ids.token_files(df.limit(0), vocabulary_path()).collect() == []


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
def test_coding_is_exact(values):
    control, data = token_ids.pack(np.array(values, np.uint32))
    assert token_ids.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


@pytest.mark.parametrize("value, size", [(255, 1), (256, 2), (65535, 2), (65536, 3), (1 << 24, 4)])
def test_bytes_of_a_value(value, size):
    assert len(token_ids.pack(np.array([value]))[1]) == size


def test_forgetting_words_changes_nothing(monkeypatch):
    from profilewatch.llm import kernels as K
    import pyarrow as pa

    monkeypatch.setattr(token_ids, "REMEMBER", 5)
    encoder = token_ids.WordEncoder(vocabulary_path())
    for text in ("alpha beta gamma", "delta beta alpha", "a b c d e f g h"):
        buf, starts, ends, _, hashes = K.words_of(pa.array([text]), 0, 1)
        ids, _ = encoder.encode(buf, starts, ends, hashes)
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
