import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewatch.llm import collocations as C
from tests.llm.corpus import documents, lower

SCHEMA = "doc_id long, text string, lang string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=30, share=80, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = collections.Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    best = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= share * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        best[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return [
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
        for lang in sorted(best)
        for i, (score, a, p, left, right) in enumerate(sorted(best[lang])[:top])
    ]


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def planted(seed, n=300):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "élan", "x", "the", "of", "zz-9", "the"]
    line = "copy of this Notice shall be kept in all parts of it"
    rows = []
    for i in range(n):
        said = [rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " "]) for _ in range(rng.randrange(30))]
        if rng.random() < 0.4:
            said.insert(rng.randrange(len(said) + 1), line + rng.choice([" ", ".", " more "]))
        if rng.random() < 0.2:
            said.append("la " * rng.randrange(9))
        rows.append((i, rng.choice(["".join(said), None, "", " \t", "".join(said)]), rng.choice(["en", "fr", None, "und", "en"])))
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 30, 2000), (2, 5, 2000), (3, 5, 7), (4, 1, 2000)])
def test_planted_documents(spark, seed, least, top):
    rows = planted(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(C.collocations(df, min_count=least, top=top)) == brute([r[1:] for r in rows], least, top=top)


def test_whole_table(spark, sf_dir):
    rows = [(r["text"], r["lang"]) for r in documents(sf_dir)]
    assert got(C.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_count=4)) == brute(rows, 4)


def test_a_stream_cut_anywhere_gives_the_same_paths():
    rng = np.random.default_rng(7)
    words = rng.integers(1, 4, (400, 4))
    for row, size in zip(words, rng.integers(1, 5, 400), strict=True):
        row[size:] = 0
    words = words[np.lexsort(words.T[::-1])].astype(np.int64)
    flow = rng.integers(1, 9, 400)

    def run(step):
        f, out = C._Flow(4, 3), []
        for i in range(0, 400, step):
            out += [tuple(map(int, (*w, lo, hi, n))) for w, lo, hi, n in zip(*f.add(words[i : i + step], flow[i : i + step]), strict=True)]
        out += [tuple(map(int, (*w, lo, hi, n))) for w, lo, hi, n in zip(*f.add(words[:0], flow[:0], last=True), strict=True)]
        return sorted(out)

    whole = run(400)
    assert all(run(step) == whole for step in (1, 2, 3, 7, 50))
    counts = collections.Counter()
    for row, n in zip(words, flow, strict=True):
        for k in range(1, int((row != 0).sum()) + 1):
            counts[tuple(row[:k])] += int(n)
    said = collections.Counter()
    for *w, lo, hi, n in whole:
        for k in range(lo, hi + 1):
            said[tuple(w[:k])] += n
    assert {k: v for k, v in said.items() if len(k) > 1} == {k: v for k, v in counts.items() if len(k) > 1 and v >= 3}
    assert {k: v for k, v in said.items() if len(k) == 1} == {k: v for k, v in counts.items() if len(k) == 1}


def test_empty_table_blank_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, " .\n", None)], SCHEMA)
    assert got(C.collocations(df)) == [] == got(C.collocations(df.limit(0)))
    df = spark.createDataFrame([(None, "New York, new york " * 40, None)], SCHEMA)
    df = df.withColumns({c: F.lit(1) for c in ("h", "n", "word", "ws", "f", "rank", "w1", "part")})
    assert got(C.collocations(df)) == brute([("New York, new york " * 40, None)])


def test_a_very_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "la " * 200_000, "en")], SCHEMA)
    assert got(C.collocations(df)) == brute([("la " * 200_000, "en")])
