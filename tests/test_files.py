"""Readers, writers, user functions and the intake on real files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from speechtab.functions import models
from speechtab.operators import corpus, keypoints, selection, tuning
from speechtab.sources import alignment, files, tables
from speechtab.streaming import intake


@pytest.fixture
def corpus_root(tmp_path):
    for speaker, clip in (("spk01", "spk01_a"), ("spk01", "spk01_b"), ("spk02", "spk02_a")):
        media = tmp_path / speaker / "ser" / "video_a"
        media.mkdir(parents=True, exist_ok=True)
        (media / f"{clip}.mp4").write_bytes(clip.encode())
        if clip != "spk01_b":
            notes = tmp_path / speaker / "alignment"
            notes.mkdir(parents=True, exist_ok=True)
            (notes / f"{clip}.align").write_text(
                "﻿0\t5\tsil\n5\t9\tDobar\n9\t12\tdan\n", encoding="utf-8")
    return tmp_path


def test_discovery_and_pairing(spark, corpus_root):
    media = files.require_files(files.discover_files(spark, str(corpus_root)))
    assert {(r["sample_id"], r["speaker_id"], r["copies"]) for r in media.collect()} == {
        ("spk01_a", "spk01", 1), ("spk01_b", "spk01", 1), ("spk02_a", "spk02", 1)}
    notes = files.discover_files(spark, str(corpus_root), files.ANNOTATION_GLOB)
    paired = corpus.pair_media(media.select("sample_id"), notes.select("sample_id"))
    assert {r["sample_id"]: r["status"] for r in paired.collect()}["spk01_b"] == "no_annotation"
    with pytest.raises(ValueError):
        files.require_files(media.filter("false"))


def test_annotation_folder(spark, corpus_root):
    rows = alignment.read_alignment_tsv(spark, f"{corpus_root}/{files.ANNOTATION_GLOB}")
    spoken = alignment.speech_lines(rows).orderBy("sample_id", "line_no").collect()
    assert [(r["sample_id"], r["token"]) for r in spoken] == [
        ("spk01_a", "dobar"), ("spk01_a", "dan"), ("spk02_a", "dobar"), ("spk02_a", "dan")]


def test_inventory_hashes(spark, corpus_root):
    rows = files.inventory(spark, str(corpus_root), files.MEDIA_GLOB).collect()
    assert {r["relative_path"]: r["sha256"] for r in rows}["spk02/ser/video_a/spk02_a.mp4"] == \
        hashlib.sha256(b"spk02_a").hexdigest()


def test_frame_folders(spark, tmp_path):
    folder = tmp_path / "spk01" / "video" / "video_a" / "clip"
    folder.mkdir(parents=True)
    for name in ("1.jpg", "10.JPEG", "2.jpg", "x.jpg", "notes.txt"):
        (folder / name).write_bytes(b"x")
    row = files.scan_frame_folders(spark, str(tmp_path)).first()
    assert (row["folder"], row["frames"], row["bad_names"]) == ("spk01/video/video_a/clip", 3, 1)


def test_file_list(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("s1/video/mpg/a\n\n  s2/video/mpg/b  \nshort/x\n")
    rows = files.read_file_list(spark, str(path)).collect()
    assert [(r["speaker_id"], r["name"], r["error"]) for r in rows] == [
        ("s1", "a", None), ("s2", "b", None), (None, None, "path_too_short")]


def test_tables_round_trip(spark, tmp_path):
    row = ("spk01_a", "spk01", "v", "a", 'rekla je "da", č', 1.25, 30, 25.0, 1, 2, 3, 4)
    manifest = spark.createDataFrame([row], tables.MANIFEST_SCHEMA)
    tables.write_manifest(manifest, str(tmp_path / "m"))
    assert tuple(tables.read_manifest(spark, str(tmp_path / "m")).first()) == row
    box = ("spk01_a", 0.1, 0.2, 0.3, 0.4, 5, 5, "detected")
    tables.write_boxes(spark.createDataFrame([box], tables.BOX_SCHEMA), str(tmp_path / "b"))
    assert tuple(tables.read_boxes(spark, str(tmp_path / "b")).first()) == box
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("a\nspk,0.1,no,0.3,0.4,5,5,detected\n")
    with pytest.raises(Exception):
        tables.read_boxes(spark, str(tmp_path / "bad")).collect()


def test_log_keeps_the_latest(spark, tmp_path):
    for frames in (12, 10):
        result = spark.createDataFrame(
            [("a", "s", "v", "o", frames, frames, 0), ("b", "s", "v", "o", 1, 1, 0)],
            tables.RESULT_SCHEMA)
        # The later append has the smaller values.
        tables.append_log(result.limit(2 if frames == 12 else 1), str(tmp_path / "log"), 12 - frames, F.lit(0))
    log = tables.read_log(spark, str(tmp_path / "log"))
    latest = tables.latest_results(log).collect()
    assert {r["sample_id"]: r["decoded_frames"] for r in latest} == {"a": 10, "b": 1}


def test_intake_is_incremental(spark, tmp_path):
    source, schema = tmp_path / "in", "id int, ok boolean"
    shape = spark.createDataFrame([], schema).schema
    batch = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    seen = []
    sink = intake.Intake(str(tmp_path / "out"), "id", ~F.col("ok"), lambda df: seen.append(df) or df)
    stream = lambda: intake.file_stream(spark, str(source), shape, "*.parquet", 1)
    for rows in ([(1, True), (2, False), (1, True)], [(2, True), (3, True), (1, True)], [(4, False), (1, False), (3, True)]):
        batch(rows)
        sink.run(stream())
        sink.run(stream())
    assert sorted(r["id"] for r in sink.results(spark, shape).collect()) == [1, 3]
    assert sorted(r["id"] for r in sink.rejects(spark, shape).collect()) == [2, 4]
    assert sink.progress(spark).agg(F.sum("n")).first()[0] == 4
    # The state tells what was seen; no batch reads what earlier ones have written.
    assert len(seen) >= 3 and not any("outcomes" in f for df in seen for f in df.inputFiles())


def test_a_repeated_batch_replaces_its_folder(spark, tmp_path):
    shape = "id int, ok boolean"
    sink = intake.Intake(str(tmp_path / "out"), "id", ~F.col("ok"))
    for _ in range(2):
        sink.take(spark.createDataFrame([(2, True), (3, False)], shape), 1)
    assert [tuple(r) for r in sink.results(spark, spark.createDataFrame([], shape).schema).collect()] == [(2, True)]
    assert sink.progress(spark).agg(F.sum("n")).first()[0] == 2


def test_detector_errors_are_kept(spark):
    frames = spark.createDataFrame([("c", 1, 2.0), ("c", 2, -1.0), ("c", 3, 0.0)],
                                   "clip string, frame int, v double")

    def factory():
        def detect(v):
            if v < 0:
                raise ValueError("negative")
            return [[(v, v + 1)], [(9, 9)]] if v else None
        return detect

    found = models.apply_detector(frames, factory, ["clip", "frame"], "v").cache()
    rows = {r["frame"]: (r["points"], r["error"]) for r in found.collect()}
    assert rows[1][0][0]["y"] == 3.0 and rows[2] == (None, "ValueError: negative")
    assert rows[3] == (None, None)
    summary = keypoints.frame_summary(found, ["clip"], F.col("points").isNotNull()).first()
    assert (summary["decoded_frames"], summary["dropped_frames"]) == (3, 2)


def test_selection_and_resume(spark):
    results = spark.createDataFrame(
        [("s1", "s1_a", 10, 0), ("s1", "s1_b", 9, 5), ("s1", "s1_c", 30, 5), ("s2", "s2_a", 8, 1)],
        "speaker_id string, sample_id string, num_frames int, dropped_frames int")
    picks = {(r["role"], r["sample_id"]) for r in selection.review_clips(results).collect()}
    assert picks == {("first", "s1_a"), ("worst", "s1_c"), ("first", "s2_a")}
    sample = {(r["role"], r["sample_id"]) for r in selection.quality_sample(results, 3).collect()}
    assert sample == {("first", "s1_a"), ("first", "s2_a"), ("longest", "s1_c")}
    assert selection.quality_sample(results, 1).count() == 2


def test_no_candidates_predict_nothing(spark):
    candidates = spark.createDataFrame(
        [("a", 1.0, "x y", -1.0, -2.0), ("a", 1.0, "x", -1.0, -2.5), ("a", 1.0, "x", -3.0, 0.0)],
        "sample_id string, alpha double, text string, am_score double, lm_score double")
    references = spark.createDataFrame([("a", "x y"), ("b", "z")], "sample_id string, reference string")
    best = tuning.best_per_text(candidates)
    assert {r["text"]: r["base_score"] for r in best.collect()} == {"x y": -3.0, "x": -3.0}
    rates = tuning.grid_rates(best, references, [1.0], [0.0, 1.0]).collect()
    assert {r["beta"]: round(r["wer"], 6) for r in rates} == {0.0: round(2 / 3, 6), 1.0: round(1 / 3, 6)}




def test_candidates_of_several_weights(spark):
    """Weights in an array give what one row for each weight gives, and clips that were dealt by id don't move again."""
    rows = spark.createDataFrame(
        [("a", "x y", -1.0, -2.0), ("a", "x y", -1.5, -0.5), ("a", "x", -3.0, -1.0), ("a", "", 0.0, 0.0), ("b", "z", -1.0, -1.0)],
        "sample_id string, text string, am_score double, lm_score double")
    weights = F.array(F.lit(1.0), F.lit(0.1))
    dealt = rows.repartition(4, "sample_id").withColumn("alpha", weights)
    best = tuning.best_per_text(dealt)
    single = tuning.best_per_text(rows.withColumn("alpha", F.explode(weights)))
    assert sorted(best.collect()) == sorted(single.select(*best.columns).collect())
    plan = tuning.select_best(best, [0.0, 1.0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
