"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab.operators import batching, corpus, ctc, history, metrics, text, validate
from speechtab.sources import alignment


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit_file(spark, content, name="spk01_0"):
    return spark.createDataFrame([(name, content)], "sample_id string, value string")


@pytest.mark.parametrize("content, expected", [
    ("0\t10\tsil\n10\t20\tPošalji\n20\t30\ta\n30\t40\tsil\n", "pošalji a"),
    ("0\t10\ta\n20\t15\tsil\n", "a"),
    ("0\t10\tsil\n10\t20\tPošalji\n20\t30\tsp\n30\t40\ta\n", "pošalji a"),
    ("﻿0\t10\tA\r\n\r\n10\t20\tč\r\n", "a č"),
])
def test_annotation_to_transcript(spark, content, expected):
    rows = alignment.parse_alignment(lit_file(spark, content))
    spoken = alignment.speech_lines(rows)
    out = text.transcripts(spoken, ["sample_id"], "line_no", "token").first()
    assert out["transcript"] == expected
    direct = alignment.clip_transcripts(lit_file(spark, content)).first()["transcript"]
    assert direct == expected


def test_annotation_errors(spark):
    content = "0\t10\ta\textra\nx\t5\tb\nx\ty\tsil\n5\t9\tc"
    rows = alignment.parse_alignment(lit_file(spark, content)).orderBy("line_no").collect()
    assert [r["error"] for r in rows] == ["column_count", "not_a_number", None, None]
    old = alignment.parse_alignment(lit_file(spark, content), legacy=True).orderBy("line_no")
    assert [r["error"] for r in old.collect()] == [
        "column_count", "not_a_number", "not_a_number", None]


def test_empty_token_only_doubles_a_space_in_the_old_form(spark):
    content = "0\t1\ta\n1\t2\t \n2\t3\tb"
    new = alignment.clip_transcripts(lit_file(spark, content)).first()["transcript"]
    old = alignment.clip_transcripts(
        lit_file(spark, content), silence=K.LEGACY_SILENCE_TOKENS, keep_empty=True
    ).first()["transcript"]
    assert (new, old) == ("a b", "a  b")


def test_interval_rules(spark):
    content = "0\t10\ta\n10\t20\tb\n15\t30\tc\n-1\t40\td\n50\t50\te\n60\t70\tf"
    lines = alignment.speech_lines(alignment.parse_alignment(lit_file(spark, content)))
    for chunk in (1, 2, 100):
        checked = validate.interval_checks(
            lines, "sample_id", ["line_no"], F.floor(F.col("line_no") / chunk))
        found = [r["violation"] for r in checked.orderBy("line_no").collect()]
        assert found == [None, None, "overlap", "negative_start", "empty_interval", None]
        first = validate.first_violations(checked, "sample_id", ["line_no"]).first()
        assert (first["line_no"], first["violation"], first["violations"]) == (3, "overlap", 3)


def test_spaced_annotation(spark):
    content = "0 10 sil\n10 20 bin\n20 30 Blue extra\n30 40\n40 50 SP\n"
    third = alignment.parse_spaced(lit_file(spark, content)).orderBy("line_no")
    assert [r["token"] for r in third.collect()] == ["BIN", "BLUE"]
    last = alignment.parse_spaced(lit_file(spark, content), last_field=True).orderBy("line_no")
    assert [r["token"] for r in last.collect()] == ["BIN", "EXTRA", "40"]


@pytest.mark.parametrize("word, steps", [("anna", 5), ("", 0), ("a", 1), ("aaa", 5), ("ab", 2)])
def test_minimum_steps(spark, word, steps):
    assert one(spark, ctc.minimum_steps(F.lit(word))) == steps
    ids = text.encode_text(F.lit(word))
    assert one(spark, ctc.minimum_steps_of_ids(ids)) == steps


def test_vocabulary(spark):
    rows = text.vocabulary(spark).orderBy("id").collect()
    assert len(rows) == 29 == len({r["symbol"] for r in rows})
    assert rows[K.BLANK_ID]["symbol"] == "<blank>" and rows[K.SPACE_ID]["symbol"] == " "


def test_encoding_round_trip(spark):
    letters = K.SERBIAN_LETTERS.strip()
    assert one(spark, text.decode_ids(text.encode_text(F.lit(letters)))) == letters
    assert one(spark, text.encode_text(F.lit("aq"))) == [2, -1]
    assert one(spark, text.unknown_characters(F.lit("qaxq"))) == ["q", "x"]


def test_collapse(spark):
    ids = F.array(*[F.lit(i) for i in (0, 2, 2, 0, 1, 3, 3)])
    assert one(spark, ctc.collapse_ids(ids, K.ENGLISH_LETTERS)) == "A B"
    path = F.array(*[F.lit(i) for i in (-1, 2, -1, 2, 0, 2, 1, 0, 1, 3)])
    assert one(spark, ctc.collapse_path(path, K.ENGLISH_LETTERS)) == "AA B"


def test_old_collapse_keeps_doubled_spaces(spark):
    steps = spark.createDataFrame(
        [("s", t, i) for t, i in enumerate((2, 1, 0, 1, 3))], "k string, t int, token int")
    new = ctc.collapse_steps(steps, "k", K.ENGLISH_LETTERS, chunk_size=2).first()["text"]
    old = ctc.collapse_steps(steps, "k", K.ENGLISH_LETTERS, merge_spaces=False).first()["text"]
    assert (new, old) == ("A B", "A  B")


def test_greedy_decode_honours_length(spark):
    row = lambda best: [10.0 if c == best else -10.0 for c in range(29)]
    steps = [row(2), row(0), row(3), row(3)]
    clips = spark.createDataFrame(
        [("short", 2, steps), ("full", 4, steps)],
        "sample_id string, length int, steps array<array<double>>")
    assert {r[0]: r[1] for r in ctc.greedy_decode(clips).collect()} == {"short": "a", "full": "ab"}


def test_argmax_takes_the_first_of_equals(spark):
    assert one(spark, ctc.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1


def test_shuffled_split_matches_the_known_lists(spark):
    speakers = spark.createDataFrame([(f"spk{i:02d}",) for i in range(1, 23)], "speaker_id string")
    parts = {}
    names = [r[0] for r in speakers.collect()]
    for name, part in corpus.shuffled_split(names).items():
        parts.setdefault(part, set()).add(name)
    assert parts["validation"] == {"spk10", "spk13", "spk16"}
    assert parts["test"] == {"spk03", "spk06", "spk22"}
    assert len(parts["train"]) == 16


def test_split_is_disjoint_and_needs_three_speakers(spark):
    rows = [(f"spk{s:02d}", f"spk{s:02d}_{i}") for s in range(6) for i in range(2)]
    clips = spark.createDataFrame(rows, "speaker_id string, sample_id string")
    assigned = corpus.assign_split(clips, corpus.split_speakers(clips))
    assert assigned.count() == 12 and assigned.select("split").distinct().count() == 3
    assert corpus.leaks(assigned, "speaker_id").isEmpty()
    few = corpus.split_speakers(clips.filter("speaker_id < 'spk02'"))
    assert {r["split"] for r in few.collect()} == {None}
    with pytest.raises(ValueError):
        corpus.shuffled_split(["spk00", "spk01"])


def test_inventory(spark):
    schema = "name string, shape string"
    current = spark.createDataFrame(
        [("conv1.w", "3"), ("FC.weight", "29x512"), ("FC.bias", "29"), ("gone", "1")], schema)
    offered = spark.createDataFrame(
        [("conv1.w", "3"), ("FC.weight", "28x512"), ("FC.bias", "28"), ("new", "1")], schema)
    status = corpus.reconcile_inventory(current, offered)
    assert {r["name"]: r["status"] for r in status.collect()} == {
        "conv1.w": "loaded", "FC.weight": "skipped_shape", "FC.bias": "skipped_shape",
        "gone": "missing", "new": "unexpected"}
    allowed = ["FC.weight", "FC.bias"]
    assert corpus.unexpected_differences(
        status.filter("name NOT IN ('gone', 'new')"), allowed).isEmpty()
    assert corpus.unexpected_differences(status, allowed).count() == 2


def test_padding(spark):
    rows = spark.createDataFrame(
        [(0, [1, 2, 3]), (0, [1, 2]), (1, [4])], "batch_id int, seq array<int>")
    padded = batching.pad_to_batch(rows, ["batch_id"], "seq").collect()
    assert sorted((r["padded"], r["true_length"]) for r in padded) == [
        ([1, 2, 0], 2), ([1, 2, 3], 3), ([4], 1)]
    fixed = batching.pad_to_length(rows, "seq", 2).collect()
    assert sorted((r["too_long"], r["padded"]) for r in fixed if not r["too_long"]) == [
        (False, [1, 2]), (False, [4, 0])]


def test_feasibility(spark):
    clips = spark.createDataFrame([(0, "aa", 3), (1, "aa", 2)],
                                  "i int, transcript string, num_frames int")
    flagged = validate.feasibility(clips)
    assert {r["i"]: r["feasible"] for r in flagged.collect()} == {0: True, 1: False}
    report = validate.feasibility_report(flagged).first()
    assert (report["valid"], report["invalid"], report["usable"]) == (1, 1, True)


@pytest.mark.parametrize("value, before, better", [(0.4, 0.5, True), (0.5, 0.5, False), (0.6, 0.5, False)])
def test_strict_improvement(spark, value, before, better):
    runs = spark.createDataFrame([("r", 0, before), ("r", 1, value)],
                                 "run_id string, epoch int, wer double")
    last = history.track(runs, patience=5).filter("epoch = 1").first()
    assert last["improved"] is better


def test_empty_texts_in_both_conventions(spark):
    pairs = spark.createDataFrame(
        [("", ""), ("", "a b"), ("a", ""), ("ab", "ab"), ("a  b", "a b")],
        "prediction string, reference string")
    rows = [
        (r["word_errors_macro"], r["words_macro"], r["word_errors_micro"], r["words_micro"],
         r["char_errors"], r["chars"])
        for r in metrics.score_pairs(pairs).collect()]
    assert rows == [(0, 1, 0, 0, 0, 0), (2, 2, 2, 2, 3, 3), (1, 1, 1, 0, 1, 0), (0, 1, 0, 1, 0, 2),
                    (1, 2, 0, 2, 1, 3)]
    empty = metrics.micro_rates(metrics.score_pairs(pairs.limit(1))).first()
    assert empty["micro_wer"] is None


def test_names(spark):
    assert one(spark, text.strip_prefix(F.lit("module.conv1.weight"))) == "conv1.weight"
    assert one(spark, text.prefix_group(F.lit("gru2.bias"))) == "gru2"
    assert one(spark, text.prefix_group(F.lit("pool.bias"))) == "error"


def test_all_line_ends_part_lines(spark):
    for end in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"):
        content = end.join(("\ufeff0\t10\tA", "", "\u3000", "\t ", "\u300020\u3000\t\x0130\t\xa0b", "x\t1\tc", "1\t\ta", "é")) + end
        rows = alignment.parse_alignment(lit_file(spark, content), silence=["a"]).orderBy("line_no").collect()
        assert [(r["line_no"], r["start"], r["end"], r["token"], r["error"]) for r in rows] == [
            (1, 0, 10, "a", None), (5, 20, 30, "b", None), (6, None, 1, "c", "not_a_number"), (7, 1, None, "a", None),
            (8, None, None, None, "column_count")], end
        spaced = alignment.parse_spaced(lit_file(spark, end.join((" 1 2 q ", "", "1 2", "3 4 p p"))), silence=["a"])
        assert [(r["line_no"], r["token"]) for r in spaced.orderBy("line_no").collect()] == [(1, "Q"), (4, "P")], end


def test_filters_do_not_split_lines_again(spark):
    _, bad = alignment.split_rejects(alignment.parse_alignment(lit_file(spark, "1\t2\ta\n1\ta")))
    spaced = alignment.parse_spaced(lit_file(spark, "1 2 a\n1 a"))
    for rows in (bad.select("line_no"), spaced):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert all("split(" not in line for line in plan.splitlines() if "Filter" in line), plan
