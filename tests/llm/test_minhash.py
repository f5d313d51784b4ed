import collections
import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewatch.llm import minhash
from profilewatch.llm.components import smallest_reachable
from profilewatch.llm.tables import DROP_SHUFFLES, Stored
from tests.llm.corpus import documents, frame, lower, planted, tuples, words


def shingles(text, k):
    ws = words(lower(text))
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def brute(docs, k, percent=80):
    """Every pair that shares a shingle, then the smallest id reachable."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = collections.defaultdict(list)
    for i, (d, own) in enumerate(sets):
        shared = collections.Counter(j for s in own for j in seen[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for s in own:
            seen[s].append(i)
    return sorted(((d, len(own), find(d), find(d) == d) for d, own in sets), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("shingle, percent", [(2, 80), (5, 80), (1, 60), (3, 95)])
def test_planted_documents(spark, shingle, percent):
    rows = planted(n=120)
    got = minhash.near_duplicates(frame(spark, rows), shingle=shingle, percent=percent)
    assert tuples(got, *COLUMNS) == brute([r[:2] for r in rows], shingle, percent)


@pytest.mark.parametrize("rounds", [1, 6])
def test_a_chain_of_near_copies_is_one_component(spark, rounds):
    # each text differs from the next by one word: the ends are far apart
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        docs.append((i * 7 % 40, " ".join(base)))
        base[i] = f"x{i}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash.near_duplicates(df, shingle=2, max_rounds=rounds)
    assert tuples(got, *COLUMNS) == brute(docs, 2)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in documents(sf_dir)]
    got = minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
    assert tuples(got, *COLUMNS) == brute(docs, 2)


def test_common_values_come_last_and_lose_nothing(spark, monkeypatch):
    rows = planted(n=80, vocabulary=6)                       # almost every shingle is common
    monkeypatch.setattr(minhash, "COMMON_SHARE", 0.02)
    got = minhash.near_duplicates(frame(spark, rows), shingle=2)
    assert tuples(got, *COLUMNS) == brute([r[:2] for r in rows], 2)


def test_repeated_rows_side_by_side_in_one_partition(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:30], "other", *base[31:]]
    docs = [(4, " ".join(base))] * 3 + [(2, " ".join(near))] * 2 + [(9, "p q r s")] * 2 + [(1, "t u v")] + [(None, "a b c")] * 2 + [(9, "p q r s")]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), shingle=2)
    size = {4: 59, 2: 59, 9: 3, 1: 2, None: 2}
    want = [(d, size[d], 2 if d == 4 else d, d != 4) for d, _ in docs]
    assert tuples(got, *COLUMNS) == sorted(want, key=repr)


def test_odd_inputs(spark):
    df = spark.createDataFrame(
        [(5, None), (6, ""), (7, "a"), (3, "A"), (None, "a"), (8, " \n"), (9, "q r s"), (9, "t u v")], "doc_id long, text string"
    ).withColumns({"key": F.lit(1), "n": F.lit(2), "value": F.lit(3), "component": F.lit(4)})
    got = tuples(minhash.near_duplicates(df, shingle=2), *COLUMNS)
    assert got == sorted(
        [(5, 0, 5, True), (6, 0, 6, True), (7, 1, 3, False), (3, 1, 3, True), (None, 1, 3, False), (8, 0, 8, True), (9, 2, 9, True), (9, 2, 9, True)],
        key=repr,
    )
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_rows_without_an_id_are_nodes_of_their_own(spark):
    """A near copy without an id joins its original, unlike rows without one stay apart."""
    base = [f"w{i}" for i in range(60)]
    near, other = [*base[:30], "x", *base[31:]], [f"v{i}" for i in range(60)]
    docs = [(5, base), (None, near), (None, other), (None, [*other[:30], "x", *other[31:]]), (None, ["p", "q", "r"]), (None, other)]
    rows = [(d, " ".join(t), i) for i, (d, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, i int")
    found = minhash.near_duplicates(df, shingle=2)
    keyed = df.select("i", minhash.row_key(df["doc_id"], df["text"]).alias("row_key"))
    got = {r["i"]: (r["doc_id"], r["component_id"], r["kept"]) for r in keyed.join(found, "row_key").collect()}
    assert got[0] == (5, 5, True) and got[1] == (None, 5, False) and got[4] == (None, None, True)
    assert got[2] == got[5] and got[2][:2] == got[3][:2] == (None, None) and {got[2][2], got[3][2]} == {True, False}


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(10, 30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {7: 7} | {i: 10 for i in range(10, 31)} | {i: 100 for i in range(100, 120)}


def test_pairs_too_many_to_send_find_the_same_links(spark, monkeypatch):
    """After one round of pivots members of about one size are compared, those of neighbouring sizes too."""
    monkeypatch.setattr(minhash, "SENT_IDS", 2)
    base = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join([*base[: 50 - i % 9], *(f"x{i}y{j}" for j in range(i % 4))])) for i in range(30)]
    docs += [(40 + i, " ".join(f"v{j}" for j in range(i, 30 + i))) for i in range(0, 12, 4)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2, max_rounds=1)
    assert tuples(got, *COLUMNS) == brute(docs, 2)


@pytest.mark.parametrize("sent", [500_000, 2])
def test_verified_pairs_come_back_whichever_end_is_the_hub(spark, monkeypatch, sent):
    monkeypatch.setattr(minhash, "SENT_IDS", sent)
    sets = spark.range(20).select(F.col("id").alias("doc_id"), F.sequence(F.lit(0), F.when(F.col("id") % 5 == 0, 9).otherwise(3)).cast("array<long>").alias("members"))
    pairs = spark.range(20).filter("id != 9").select(F.lit(9).cast("long").alias("a"), F.col("id").alias("b"))
    found = minhash._verified(pairs.unionByName(pairs.filter("b < 3").select(F.col("b").alias("a"), F.col("a").alias("b"))), sets, 80)
    assert sorted(tuple(r) for r in found.collect()) == sorted([(9, i) for i in range(20) if i % 5 and i != 9] + [(1, 9), (2, 9)])


def test_wide_sketches_dismiss_large_unlike_sets_and_no_link(spark):
    """Of 4,000 and 3,300 values 1,024 bits tell nothing; a sketch as long as the set does."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    sets, pairs = [], []
    for at, (n, shared) in enumerate([(4000, 3600), (4000, 3560), (4200, 3700), (4000, 2800), (4000, 1200), (3300, 3250), (4000, 0)]):
        own = [pool[:4000], np.concatenate((pool[:shared], pool[10_000 : 10_000 + n - shared]))]
        for side, h in enumerate(own):
            sets.append((2 * at + side, len(h), *(x.tolist() for x in (np.sort(h.view(np.int64)), minhash.parity_sketch(h), minhash.wide_sketch(h)))))
        pairs.append((2 * at, 2 * at + 1, 100 * shared >= 80 * (8000 - 4000 + n - shared)))
    sets.append((99, 900, *(x.tolist() for x in (np.sort(pool[:900].view(np.int64)), minhash.parity_sketch(pool[:900]))), minhash.wide_sketch(pool[:900])))
    frame_of = spark.createDataFrame(sets, "doc_id long, n long, members array<long>, parity array<long>, wide array<long>")
    asked = spark.createDataFrame([p[:2] for p in pairs] + [(0, 99)], "a long, b long")
    links = {p[:2] for p in pairs if p[2]}
    assert tuples(minhash._verified(asked, frame_of, 80), "a", "b") == sorted(links, key=repr) and len(links) == 4
    narrow = {tuple(r) for r in minhash._candidates(asked, frame_of, 80).collect()}
    wide = {tuple(r) for r in minhash._still_near(asked, frame_of, 80).collect()}
    assert {(8, 9), (12, 13)} <= narrow and not {(6, 7), (8, 9), (12, 13)} & wide, (narrow, wide)
    assert links | {(0, 99)} <= wide


def test_rounds_end_when_few_links_are_new(spark, monkeypatch):
    """Members that are left over are compared with each other, so fewer rounds lose no link."""
    docs = [r[:2] for r in planted(n=120)]
    rounds = []
    candidates = minhash._candidates
    monkeypatch.setattr(minhash, "_candidates", lambda *a: rounds.append(1) or candidates(*a))
    monkeypatch.setattr(minhash, "FEW", -1)
    monkeypatch.setattr(minhash, "FEW_PER", 1)
    got = minhash.near_duplicates(frame(spark, planted(n=120)), shingle=2)
    assert tuples(got, *COLUMNS) == brute(docs, 2) and len(rounds) <= 2


def test_kept_results_leave_no_shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    before = set(glob.glob(f"{folder}/**/shuffle_*", recursive=True))
    was = spark.conf.get(DROP_SHUFFLES, None)
    source = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = Stored(spark, "test").keep(source)
    for _ in range(50):
        left = set(glob.glob(f"{folder}/**/shuffle_*", recursive=True)) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.count() == source.count() == 100 and spark.conf.get(DROP_SHUFFLES, None) == was
