import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewatch.llm import merkle as M
from tests.llm.corpus import SCHEMA, documents, frame, planted

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """Rounds of pairs; per leaf its path of (is left, sibling or None)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, own, strict=True):
            path.append((i % 2 == 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        own = [i // 2 for i in own]
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    """Rows of (doc_id, text, lang, source, n_chars)."""
    groups = collections.defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = h(*map(field, (d, source, lang, n, text)))
        tampered = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        changed = h(*map(field, (d, source, lang, n + 1, text))) if tampered and n is not None else leaf
        groups[lang].append((d is None, d or 0, leaf, changed, d))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = [up([x[2] for x in sorted(groups[k])]) for k in order]
    if not trees:
        return []
    root, tops = up([t[0] for t in trees])
    out = []
    for k, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for (*_, leaf, changed, d), path in zip(sorted(groups[k]), paths, strict=True):
            node = changed
            for left, s in path + top:
                node = h(node) if s is None else h(s, node) if left else h(node, s)
            proof = h(*(s for _, s in path + top if s))
            out.append((d, leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def got(df, **options):
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return sorted((tuple(r) for r in M.manifest(df, altered=altered, **options).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 90])
def test_planted_documents(spark, n):
    rows = [(d, t, lang, s, None if i % 5 == 0 else i) for i, (d, t, lang, s, _) in enumerate(planted(n=90)[:n])]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in documents(sf_dir)]
    assert got(spark.read.parquet(f"{sf_dir}/documents.parquet")) == brute(rows)


def test_several_rounds_of_slots_and_sparse_negative_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    ids = [*range(-70, 70), *rng.integers(-(1 << 62), 1 << 62, 120).tolist(), *[5] * 9, *[None] * 11, -(1 << 63), (1 << 63) - 1]
    rows = [(d, f"t{i % 17}", ["en", "en", "fr", None][i % 4], "s", i) for i, d in enumerate(ids)]
    rows += [rows[3]] * 6 + [(None, None, None, None, None)] * 5
    assert got(frame(spark, rows, 7), levels=3) == brute(rows)


def test_other_columns_and_an_empty_table(spark):
    rows = [(1, "a", "en", "s", 1), (2, "b", None, None, (1 << 63) - 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("l", "leaf", "slot", "node", "left", "key", "mid")})
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_a_proof_folds_to_the_root_and_a_changed_leaf_does_not(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(11)]
    for r in M.manifest(frame(spark, rows)).collect():
        assert M.fold(r["leaf"], r["proof"]) == r["root"] != M.fold(h(r["leaf"]), r["proof"]) and r["verified"]


def test_ranks_of_containers():
    rng = np.random.default_rng(5)
    for size in (0, 1, 70, 5_000, 60_000):
        at = np.unique(rng.integers(0, M.BLOCK, size))
        n = np.where(rng.random(len(at)) < 0.1, rng.integers(2, 9, len(at)), 1)
        bits, more = M.pack(at, n)
        back = M.unpack(bits, more)
        assert (back[0] == at).all() and (back[1] == n).all()
        ask = np.arange(M.BLOCK)
        want = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(at, ask)]
        assert (M.Ranks(bits, more).below(ask) == want).all()
