import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewatch.llm import decontam
from tests.llm.corpus import documents, lower


def tokens(text):
    return [t for t in re.split("[\x00-/:-@\\[-`{-\x7f]+", lower(text)) if t]


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(10, 40))]) for i in range(12)]
    docs, want = [], set()
    for d in range(80):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if d % 4 == 0:
            i, item = items[d % 12]
            copy = list(item)
            for at in range(d % 5, len(copy), 7):            # every seventh word is another one
                copy[at] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = copy
            if len(copy) - len(range(d % 5, len(copy), 7)) >= decontam.MIN_EQUAL:
                want.add((d, i))
        docs.append((d, rng.choice([" ", ", ", ".\n"]).join(body).upper() if d % 8 == 0 else " ".join(body)))
    return docs, [(i, " ".join(t)) for i, t in items], want


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("max_sent", [decontam.MAX_SENT, 100])   # at once, and in slices
def test_changed_passages_are_found_clean_documents_are_not(spark, max_sent):
    docs, items, want = corpus()
    got = decontam.overlaps(*frames(spark, docs, items), max_sent=max_sent).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    texts, tests = ({k: tokens(t) for k, t in x} for x in (docs, items))
    for r in got:
        a, b = texts[r["doc_id"]][r["doc_start"] :], tests[r["item_id"]][r["item_start"] :]
        assert sum(x == y for x, y in zip(a[: r["n_span"]], b[: r["n_span"]])) == r["n_equal"]


def test_clean_keeps_the_rest_unchanged(spark):
    docs, items, want = corpus()
    d, i = frames(spark, docs, items)
    d = d.withColumns({"item_id": F.lit(1), "__doc": F.lit("x")}).unionByName(
        spark.createDataFrame([(None, "t")], "doc_id long, text string").withColumns({"item_id": F.lit(1), "__doc": F.lit("x")})
    )
    kept = decontam.clean(d.drop("__doc"), i)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert {r["doc_id"] for r in kept.collect()} == ({x for x, _ in docs} | {None}) - {x for x, _ in want}


def test_every_row_is_judged_by_its_own_text(spark):
    """A copy without an id goes, a clean row that shares an id with a contaminated one stays."""
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(None, f"so {item} it goes"), (None, "nothing of it"), (None, None), (4, item), (4, "clean"), (5, ""), (6, item)]
    d, i = frames(spark, docs, [(7, item)])
    kept = decontam.clean(d.withColumnRenamed("text", "body"), i, text_col="body").collect()
    assert sorted(map(repr, ((r["doc_id"], r["body"]) for r in kept))) == sorted(
        map(repr, [(None, "nothing of it"), (None, None), (4, "clean"), (5, "")])
    )


def test_quotes_dashes_and_blanks_beyond_ascii_part_words(spark):
    said = [f"w{i}" for i in range(20)]
    odd = ["\u201c{}\u201d", "\u00ab{}\u00bb", "{}\u2014", "{}\u2026", "\u00a0{}\u2003", "\u2018{}\u2019", "\u00bf{}"]
    docs = [(k, " ".join(form.format(w) for w in said)) for k, form in enumerate(odd)] + [(99, " ".join(w + "\u00ba" for w in said))]
    got = decontam.overlaps(*frames(spark, docs, [(1, " ".join(said))])).collect()
    assert {(r["doc_id"], r["n_equal"]) for r in got} == {(k, 20) for k in range(len(odd))}     # U+00BA is a letter


def test_whole_tables_against_word_windows(spark, sf_dir):
    docs, items = documents(sf_dir), documents(sf_dir, "benchmark")
    grams = {tuple(t[i : i + 10]) for t in (tokens(r["text"]) for r in items) for i in range(len(t) - 9)}
    want = set()
    for r in docs:
        t = tokens(r["text"])
        if any(tuple(t[i : i + 10]) in grams for i in range(len(t) - 9)):
            want.add(r["doc_id"])
    got = decontam.overlaps(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    assert {r["doc_id"] for r in got.collect()} == want


def test_nulls_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (None, item), (3, item), (3, item)]
    d, i = frames(spark, docs, [(7, item), (8, None), (None, item), (9, "short one")])
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.overlaps(d, i).collect()) == [(0, 7), (3, 7), (3, 7)]
    assert decontam.overlaps(d.limit(0), i).collect() == [] and decontam.overlaps(d, i.limit(0)).collect() == []


def allowed(equal):
    return sum(equal) >= decontam.MIN_EQUAL and sum(equal) >= decontam.MIN_SHARE * len(equal) - 1e-9


def minimal_stretches(n):
    """Patterns of n words with equal ends that are an overlap and hold no shorter one."""
    for k in range(n - decontam.MIN_EQUAL + 1):
        for other in itertools.combinations(range(1, n - 1), k):
            equal = [i not in other for i in range(n)]
            if not allowed(equal):
                break
            inner = ((i, j) for i in range(n) for j in range(i + decontam.MIN_EQUAL, n + 1) if j - i < n)
            if not any(allowed(equal[i:j]) for i, j in inner):
                yield equal


def test_every_minimal_stretch_holds_a_seed():
    # of 26 words or more, one of two halves is an overlap by itself
    counts = {}
    for n in range(decontam.MIN_EQUAL, 26):
        patterns = np.array(list(minimal_stretches(n)), bool).reshape(-1, n)
        counts[n] = len(patterns)
        item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        words = np.where(patterns, item, np.uint64(5)).ravel()
        held = decontam.TestItems(np.array([1]), [item], decontam.MASKS)
        hits = held.candidates(words, np.arange(len(patterns) + 1) * n)
        assert {r for r, _, offset in hits.tolist() if offset == r * n} == set(range(len(patterns))), n
    assert counts[14] == 495 and counts[24] == 720 and counts[25] == 0


@pytest.mark.parametrize("n, period", [(15, 4), (23, 4), (59, 4), (59, 5)])
def test_periodic_replacements_are_found(spark, n, period):
    item = [f"w{i}" for i in range(n)]
    copies = [["other" if i % period == shift else w for i, w in enumerate(item)] for shift in range(period)]
    docs = [(shift, " ".join(["x", *copy, "y"])) for shift, copy in enumerate(copies)]
    got = decontam.overlaps(*frames(spark, docs, [(7, " ".join(item))])).collect()
    assert {(r["doc_id"], r["item_id"], r["n_equal"]) for r in got} == {(k, 7, n - c.count("other")) for k, c in enumerate(copies)}


def test_short_items_and_text_without_spaces(spark):
    long, thai = "今天天气很好我们一起去公园散步然后回家吃饭", "สวัสดีครับยินดีต้อนรับ"
    items = [(1, "Red, green!"), (2, "blue"), (3, long), (4, "东京塔"), (5, "..."), (6, thai), (7, "red green")]
    docs = [
        (10, "a red. Green b red green"), (11, "red and green"), (12, "bluer"), (13, "so blue"), (14, f"他说，{long.replace('公园', '海边')}。完"),
        (15, "我在东京塔下面"), (16, "东京的塔"), (17, f"x{thai}y"), (18, "red"), (19, "green"), (20, "京"), (21, "𠀀东京塔"),
    ]
    got = decontam.overlaps(*frames(spark, docs, items)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found == {(10, 1), (10, 7), (13, 2), (14, 3), (15, 4), (17, 6), (21, 4)} and len(got) == len(found)
    assert {(r["n_equal"], r["n_span"], r["doc_start"], r["item_start"]) for r in got if r["doc_id"] == 10} == {(2, 2, 1, 0)}
    sliced = decontam.overlaps(*frames(spark, docs, items), max_sent=50).collect()
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, got))
