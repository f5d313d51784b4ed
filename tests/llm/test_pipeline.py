import collections

import corpus_pipeline as pipeline
from profilewatch.llm import decontam, langid, mixing
from tests.llm.corpus import documents
from tests.llm.test_minhash import brute as near
from tests.llm.test_token_ids import brute as token_rows


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {"": documents(sf_dir)}
    last = ""
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if name != pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns
        before, after = rows[last], [r.asDict() for r in found.collect()]
        ids = {r["doc_id"] for r in before}
        if name == "language":
            got = langid.predict(docs, langid.fit(langid.training_rows(docs))).collect()
            want = {r["doc_id"] for r in got if r["lang_pred"] != "und" and r["score"] >= pipeline.MIN_SCORE}
            assert {r["doc_id"] for r in after} == want and len(want) > 0.9 * len(ids)
        elif name == "near_duplicates":
            want = {d for d, *_, kept in near([(r["doc_id"], r["text"]) for r in before], 5) if kept}
            assert {r["doc_id"] for r in after} == want and len(after) == len(want)
        elif name == "decontamination":
            hit = {r["doc_id"] for r in decontam.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in after} == ids - hit
        elif name == "mixture":
            taken, _ = mixing.mix(docs)
            want = {r["doc_id"]: r["repeats"] for r in taken.collect() if r["repeats"]}
            assert collections.Counter(r["doc_id"] for r in after) == want
        else:
            want = token_rows([(r["doc_id"], r["text"]) for r in before])
            assert sorted((tuple(r.values()) for r in after), key=repr) == want
        rows[name], docs, last = after, found, name


def test_run_applies_them_all(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
