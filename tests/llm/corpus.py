"""Planted documents for the training-data operators, and helpers to compare with."""

from __future__ import annotations

import random
import re

import pyarrow.dataset as ds

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def planted(seed=3, n=90, vocabulary=40):
    """Random texts with copies, near copies, shared passages, nulls, blanks and a very long one."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéßz") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0:
            text = rng.choice([None, "", " ", "\t\n", "one", "one  two"])
        elif kind == 1:
            text = " ".join(base)
        elif kind == 2:
            near = list(base)
            for _ in range(rng.randint(1, 12)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            text = " ".join(near)
        elif kind == 3:
            at = rng.randrange(40)
            text = " ".join([*(rng.choice(vocab) for _ in range(rng.randrange(9))), *passage[at:], rng.choice(vocab)])
        elif kind == 4:
            text = "la " * rng.randrange(60)
        else:
            text = rng.choice([" ", "  ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randrange(150)))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), None))
    rows.append((n, " ".join(rng.choice(vocab) for _ in range(30_000)), "en", "s1", None))
    rows += [rows[1], rows[1], rows[5]]                      # repeated rows
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def documents(sf_dir, table="documents"):
    return ds.dataset(f"{sf_dir}/{table}.parquet").to_table().to_pylist()


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
