import csv
import hashlib

import pytest
from pyspark.sql import functions as F

from profilewatch.sources import manifest as M
from profilewatch.sources import packs

#: Two prompts: one of several lines with a blank one, one with quotes, a comma and a carriage return.
POEM = "Roses, red;\n\nviolets\n"
QUOTE = 'they wrote "no, thanks"\rand left'
WANT = {"k1": POEM.strip("\n"), "k2": QUOTE}


def pack_of(folder, header, lines=()):
    """A pack folder: the columns of its table, and the lines of its text twin."""
    folder.mkdir()
    if header:
        texts = {"k1": '"' + WANT["k1"] + '"', "k2": '"' + QUOTE.replace('"', '""') + '"'}
        body = [",".join({"prompt_id": k, "prompt": v}[c] for c in header) for k, v in texts.items()]
        (folder / "pack.csv").write_bytes("\n".join([",".join(header), *body, ""]).encode())
    if lines:
        (folder / "pack.txt").write_bytes("\n".join(lines).encode())
    return str(folder)


#: Lines of blanks of any kind are no prompts and take no number.
LINES = ["Roses, red;\\n\\nviolets", "", " \t ", "\u00a0", "one more"]


def loaded(spark, folder):
    return {r["prompt_id"]: r["prompt"] for r in packs.read_pack(spark, folder).collect()}


def test_csv_text_is_the_authority(spark, tmp_path):
    assert loaded(spark, pack_of(tmp_path / "p", ["prompt_id", "prompt"], ["other text"])) == WANT


def test_lines_with_numbered_ids(spark, tmp_path):
    got = loaded(spark, pack_of(tmp_path / "p", [], LINES))
    assert got == {"pack-00": WANT["k1"], "pack-01": "one more"}


def test_ids_from_the_csv_text_from_the_lines(spark, tmp_path):
    got = loaded(spark, pack_of(tmp_path / "p", ["prompt_id"], LINES))
    assert got == {"k1": WANT["k1"], "k2": "one more"}


def test_a_repeated_id_keeps_its_last_text(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "pack.csv").write_text("prompt_id,prompt\nx,first\ny,other\nx,last\n")
    assert loaded(spark, str(folder)) == {"x": "last", "y": "other"}


def test_an_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        packs.read_pack(spark, str(tmp_path))


def test_positions_follow_files_and_offsets_not_task_order(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    texts = []
    for part, n in ((0, 3), (1, 400), (2, 50)):         # the largest file is scheduled first
        rows = [f"{part}-{i}" for i in range(n)]
        texts += rows
        (folder / f"part-{part}.txt").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = packs.with_position(spark.read.text(str(folder)), [F.col("value")]).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in got] == texts and [r["position"] for r in got] == list(range(len(texts)))


def test_more_than_a_hundred_lines_keep_unpadded_numbers(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i:03d}",) for i in range(120)], "prompt string").orderBy("prompt")
    packs.write_pack(df, str(tmp_path / "p"), with_csv=False)
    got = loaded(spark, str(tmp_path / "p"))
    assert got["pack-07"] == "t007" and got["pack-119"] == "t119"


@pytest.fixture
def folder(tmp_path):
    ref = tmp_path / "ref"
    ref.mkdir()
    for name, body in (("prompts_v1.csv", b"p\n"), ("scalars_v1.csv", b"s\n" * 5), ("band_v1.bin", bytes(range(9)))):
        (ref / name).write_bytes(body)
    return ref


ROLES = [("prompts", "prompts_v1.csv", False), ("scalars", "scalars_v1.csv", True), ("band", "band_v1.bin", True),
         ("manifold", "manifold_v1.bin", True)]
SUMMARY = {"window": ["2024-01-01", "2024-01-02"], "model_id": "m", "n_requests": 100, "n_complete": 44, "rate": 0.5,
           }


def record_of(spark, folder, **kw):
    roles = spark.createDataFrame(ROLES, "key string, file string, tracked boolean")
    files = M.manifest_files(M.file_digests(spark, str(folder)), roles)
    return M.manifest_record(files, version="v1", **{"summary": SUMMARY, **kw})


def test_record_has_digests_counts_and_roles(spark, folder, tmp_path):
    path = str(tmp_path / "manifest")
    ids = spark.createDataFrame([("a",), ("b",)], "request_id string")
    extra = {"created_by": "me", "runs": [1, 2]}
    M.write_manifest(record_of(spark, folder, metric_layers=[0, 1], complete=ids, extra=extra), path)
    found = M.read_manifest(spark, path)
    row, files = found.header.first(), {r["key"]: r for r in found.files.collect()}
    assert set(files) == {"prompts", "scalars", "band"}          # a file not produced is left out
    entry = files["scalars"]
    assert entry["sha256"] == hashlib.sha256(b"s\n" * 5).hexdigest() and entry["bytes"] == 10 and entry["tracked"]
    assert not files["prompts"]["tracked"]
    assert row["counts"] == {"n_requests": 100, "n_complete": 44} and row["window"] == SUMMARY["window"]
    assert row["metric_layers"] == [0, 1] and row["extra"] == {"created_by": "me", "runs": "[1, 2]"}
    assert sorted(r["request_id"] for r in found.complete.collect()) == ["a", "b"]


def statuses(spark, record, folder):
    found = M.verify_manifest(record, M.file_digests(spark, str(folder)))
    return {r["file"]: r["status"] for r in found.collect()}


def test_verify_reports_every_file(spark, folder, tmp_path):
    path = str(tmp_path / "manifest")
    M.write_manifest(record_of(spark, folder), path)
    record = M.read_manifest(spark, path)
    assert set(statuses(spark, record, folder).values()) == {"ok"}
    (folder / "scalars_v1.csv").write_bytes(b"changed")
    (folder / "band_v1.bin").unlink()
    assert statuses(spark, record, folder) == {
        "prompts_v1.csv": "ok", "scalars_v1.csv": "changed", "band_v1.bin": "missing"
    }


def test_refresh_rehashes_and_carries_the_rest(spark, folder, tmp_path):
    path = str(tmp_path / "manifest")
    M.write_manifest(record_of(spark, folder, extra={"source_created_utc": "then"}), path)
    (folder / "manifold_v1.bin").write_bytes(b"new")
    (folder / "scalars_v1.csv").write_bytes(b"newer")
    again = M.refresh_manifest(M.read_manifest(spark, path), record_of(spark, folder, summary={}))
    row, files = again.header.first(), {r["key"]: r for r in again.files.collect()}
    assert set(files) == {"prompts", "scalars", "band", "manifold"}
    assert files["scalars"]["sha256"] == hashlib.sha256(b"newer").hexdigest()
    assert row["model_id"] == "m" and row["counts"]["n_complete"] == 44 and row["extra"] == {"source_created_utc": "then"}
    stored = M.read_manifest(spark, path)
    none = M.Manifest(stored.header.filter("false"), stored.files, stored.complete)
    assert M.refresh_manifest(none, record_of(spark, folder)).header.count() == 0


def test_digests_are_read_in_chunks(spark, folder, monkeypatch):
    body = bytes(range(256)) * 40_000                                   # more than one chunk
    (folder / "large.bin").write_bytes(body)
    found = {r["file"]: r for r in M.file_digests(spark, str(folder), "*.bin").collect()}
    assert found["large.bin"]["sha256"] == hashlib.sha256(body).hexdigest() and found["large.bin"]["bytes"] == len(body)
