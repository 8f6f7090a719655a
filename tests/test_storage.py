"""Blocks, listings, documents and histories on real files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from speechtab.operators import corpus, history, ngram
from speechtab.sources import files, listing, tables


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, "block_id long, position long, v string")


def test_blocks_written_again_replace_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "b")
    tables.write_blocks(blocks_of(spark, [(i // 3, i, "old") for i in range(9)]), path)
    tables.write_blocks(blocks_of(spark, [(1, i, "new") for i in range(3, 5)]), path)
    got = sorted((r["block_id"], r["position"], r["v"]) for r in tables.read_blocks(spark, path).collect())
    assert got == [(0, i, "old") for i in range(3)] + [(1, 3, "new"), (1, 4, "new")] + [(2, i, "old") for i in range(6, 9)]
    index = {r["block_id"]: (r["first_position"], r["last_position"], r["rows"]) for r in tables.block_index(spark, path).collect()}
    assert index == {0: (0, 2, 3), 1: (3, 4, 2), 2: (6, 8, 3)}
    # Many blocks share a file.
    assert len(list((tmp_path / "b" / "data").glob("*/*.parquet"))) < 6


def test_a_killed_write_leaves_the_old_blocks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    tables.write_blocks(blocks_of(spark, [(0, 0, "old")]), path)

    def killed(*_):
        raise KeyboardInterrupt

    fail = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception):
        tables.write_blocks(blocks_of(spark, [(0, 0, "new"), (1, 1, "new")]).withColumn("v", fail("v")), path)
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_folder", killed)  # after the data, before anything is committed
        patch.setattr(tables, "_versions", lambda *_: [0])
        with pytest.raises(KeyboardInterrupt):
            tables.write_blocks(blocks_of(spark, [(0, 0, "new"), (1, 1, "new")]), path)
    assert [tuple(r) for r in tables.read_blocks(spark, path).collect()] == [(0, 0, "old")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    tables.write_blocks(blocks_of(spark, [(0, 0, "old")]), path)
    monkeypatch.setattr(tables, "_versions", lambda *_: [])
    with pytest.raises(OSError, match="somebody else"):
        tables.write_blocks(blocks_of(spark, [(0, 0, "new")]), path)
    assert tables.read_blocks(spark, path).first()["v"] == "old"


def test_listing_finds_empty_files(spark, tmp_path):
    rows = [("spk1/ser/video_a/a.mp4", b"xy"), ("spk2/ser/video_a/b.mp4", b""), ("spk2/ser/video_a/c.txt", b"1"),
            ("other/ser/video_a/d.mp4", b"1"), ("spk1/ser/video_a/deep/e.mp4", b"1"), ("spk3/ser/video_a/a.mp4", None)]
    written = listing.write_files(spark.createDataFrame(rows, "relative_path string, content binary"), str(tmp_path))
    assert {r["relative_path"]: r["bytes"] for r in written.collect()} == {p: len(c or b"") for p, c in rows}
    for root in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        found = files.list_files(spark, root, files.MEDIA_GLOB)
        assert {r["relative_path"]: r["bytes"] for r in found.collect()} == {
            "spk1/ser/video_a/a.mp4": 2, "spk2/ser/video_a/b.mp4": 0, "spk3/ser/video_a/a.mp4": 0}
        assert found.rdd.getNumPartitions() == 3
    media = {r["sample_id"]: (r["speaker_id"], r["copies"]) for r in files.discover_files(spark, str(tmp_path)).collect()}
    assert media == {"a": ("spk1", 2), "b": ("spk2", 1)}
    digests = {r["relative_path"]: r["sha256"] for r in files.inventory(spark, str(tmp_path), files.MEDIA_GLOB).collect()}
    assert digests["spk2/ser/video_a/b.mp4"].startswith("e3b0c44298fc1c14")
    assert files.list_files(spark, str(tmp_path / "nowhere"), "*/*").collect() == []
    with pytest.raises(ValueError):
        files.require_files(files.discover_files(spark, str(tmp_path), "spk*/none/*/*.mp4"))


def test_hashing_brings_no_file_to_the_driver(spark, tmp_path):
    rows = [(f"spk{i % 3}/ser/video_a/{i}.mp4", bytes([i]) * i) for i in range(90)]
    listing.write_files(spark.createDataFrame(rows, "relative_path string, content binary"), str(tmp_path)).collect()
    found = files.inventory(spark, str(tmp_path), files.MEDIA_GLOB)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString() and found.inputFiles() == []  # Spark's own readers list each file there
    assert {(r["relative_path"], r["bytes"], r["sha256"]) for r in found.collect()} == {
        (p, len(c), hashlib.sha256(c).hexdigest()) for p, c in rows}


def test_documents_keep_nulls_and_letters(spark, tmp_path):
    rows = spark.createDataFrame([("čaš", None, [1, 2]), (None, 3, [])], "s string, n int, a array<int>")
    tables.write_documents(rows, str(tmp_path / "d"))
    fields = {"s": ("$.s", "string"), "n": ("$.n", "int"), "a": ("$.a", "array<int>"), "none": ("$.x.y", "string")}
    got = {tuple(map(str, r)) for r in tables.read_documents(spark, str(tmp_path / "d"), fields).collect()}
    assert got == {("čaš", "None", "[1, 2]", "None"), ("None", "3", "[]", "None")}


def test_stages_are_stitched(spark, tmp_path):
    (tmp_path / "h.json").write_text(
        '{"run_id": "a", "epoch": 0, "stage": "one", "validation": {"wer": 0.5}, "learning_rates": {"gru": 0.1}}\n'
        '{"run_id": "a", "epoch": 1, "stage": "one", "validation": {"wer": 0.4}, "learning_rates": {}}\n'
        '{"run_id": "a", "epoch": 0, "stage": "two", "validation": {"wer": 0.3}}\n'
        '{"run_id": "b", "epoch": 0, "stage": "two", "train": {"loss": 2.0}}\n'
        '{"run_id": "b", "epoch": 5, "stage": "other"}\n')
    stitched = history.stitch_stages(history.read_history(spark, str(tmp_path / "h.json")), "one", "two")
    got = sorted((r["run_id"], r["epoch"], r["stage"], r["validation"] and r["validation"]["wer"]) for r in stitched.collect())
    assert got == [("a", 0, "one", 0.5), ("a", 1, "one", 0.4), ("a", 2, "two", 0.3), ("b", 0, "two", None)]
    best = history.best_epochs(stitched.select("run_id", "epoch", F.col("validation.wer").alias("wer")), 1.0).collect()
    assert [(r["run_id"], r["best_epoch"]) for r in best] == [("a", 2)]


def test_speakers_that_disagree(spark):
    media = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, None), (4, None)], "sample_id int, speaker_id string")
    notes = spark.createDataFrame([(1, "s1"), (2, "s9"), (3, "s3"), (4, None), (5, "s5")], "sample_id int, speaker_id string")
    got = sorted(map(tuple, corpus.speaker_disagreements(media, notes).collect()))
    assert got == [(2, "s2", "s9"), (3, None, "s3")]


def test_a_stored_model_stays_in_place(spark, tmp_path):
    rows = spark.createDataFrame([(s,) for s in ("ab ba", "abba", "b a b")], "s string")
    model = ngram.store_model(ngram.estimate(ngram.count_ngrams(rows, "s", 3), 3), str(tmp_path / "m"), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("a",), ("b a",)], "ngram string").join(model, "ngram")
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(ngram") == 1 and asked.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
