"""Cases that once lost or changed rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from speechtab.functions.nfc import nfc
from speechtab.operators import history
from speechtab.plans import catalog
from speechtab.sources import files, tables
from speechtab.streaming import intake


@pytest.mark.parametrize("epochs", [[0, 1, 2, 3, 4], [1, 2, 3, 4, 5], [3, 5, 6, 10, 11]])
def test_waiting_counts_rows(spark, epochs):
    rates = [float("nan"), 0.5, 0.6, 0.7, 0.4]
    runs = spark.createDataFrame([("r", e, w) for e, w in zip(epochs, rates)], "run_id string, epoch int, wer double")
    got = history.track(runs, patience=2, chunk_size=2).orderBy("epoch").collect()
    assert [r["without_improvement"] for r in got] == [1, 0, 1, 2, 0]
    assert [r["stops"] for r in got] == [False, False, False, True, False]


def test_intake_keeps_rows_without_key_or_outcome(spark, tmp_path):
    rows = [(1, True, "b"), (1, None, "a"), (2, None, "x"), (None, True, "y"), (None, False, "z"), (3, True, "w")]
    spark.createDataFrame(rows, "id int, ok boolean, note string").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    sink = intake.Intake(str(tmp_path / "out"), "id", ~F.col("ok"))
    for _ in range(2):
        sink.run(intake.file_stream(spark, str(tmp_path / "in"), schema, "*.parquet"))
    good, bad = (read(spark, schema).collect() for read in (sink.results, sink.rejects))
    assert len([r for r in good + bad if r["id"] == 1]) == 1
    assert {r["id"] for r in good} <= {1, 3} and {r["note"] for r in bad} >= {"x", "y", "z"}
    assert len(good + bad) == 5


def test_paths_below_a_root_whose_name_comes_again(spark, tmp_path):
    place = tmp_path / "a" / "spk1" / "ser" / "video_a"
    place.mkdir(parents=True)
    (place / "x.mp4").write_bytes(b"1")
    for root in (tmp_path / "a", f"file:{tmp_path}/a/"):
        found = files.discover_files(spark, str(root), files.MEDIA_GLOB).first()
        assert (found["sample_id"], found["speaker_id"], found["path"]) == ("x", "spk1", "spk1/ser/video_a/x.mp4")


def test_blanks_survive_the_manifest(spark, tmp_path):
    row = ("s", "p", " v", "a ", "  da  ", 1.25, 30, 25.0, 1, 2, 3, 4)
    tables.write_manifest(spark.createDataFrame([row], tables.MANIFEST_SCHEMA), str(tmp_path / "m"))
    assert tuple(tables.read_manifest(spark, str(tmp_path / "m")).first()) == row


def test_heavy_medians_of_a_null_key(spark):
    from speechtab import skew

    data = [(k, float(i)) for k, n in ((None, 9), ("a", 8), ("b", 3)) for i in range(n)]
    rows = spark.createDataFrame(data, "k string, v double")
    want = {(None, 4.0), ("a", 3.5), ("b", 1.0)}
    got = [tuple(r) for r in skew.exact_median(rows, ["k"], ["v"]).collect()]
    assert len(got) == 3 and set(got) == want


def test_words_of_dealt_documents_stay(spark):
    """Documents move once, before they are taken apart; their words don't move again to become transcripts."""
    plan = catalog.transcripts_from_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_plain_texts_stay_out_of_python(spark):
    texts = ["plain", "", None, "c\u030caš", "\u1100\u1161", "é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfc("t").alias("n"))
    assert [r["n"] for r in rows.collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert "octet_length" in rows._jdf.queryExecution().optimizedPlan().toString()
    catalog.QUERIES["nfc_text"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
