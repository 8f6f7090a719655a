"""Named queries: every operator bound to whole tables. Each takes (spark, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab import session, skew
from speechtab.functions import beam, models
from speechtab.functions.nfc import nfc
from speechtab.operators import (
    batching, boxes, corpus, ctc, history, keypoints, metrics, ngram, selection, text, tuning,
    validate,
)
from speechtab.plans import bindings as B
from speechtab.sources import alignment, files, listing, tables
from speechtab.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FORBIDDEN = ("password", "secret", "license", "the", "http", "der")
BASELINE_RATE = 1.0


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, negative zero removed."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


# --- transcripts, error rates ---------------------------------------------------------------


def scored_pairs(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return metrics.score_pairs(B.predictions(spark, root).select(*columns, "prediction", "reference"))


@query
def error_rates_by_split(spark, root):
    """Sums per speaker come before the join with the speakers' splits."""
    sums = metrics.rate_sums(scored_pairs(spark, root, "speaker_id"), ["speaker_id"])
    speakers = B.table(spark, root, "documents").select(F.col("source").alias("speaker_id"))
    return rounded(metrics.rates_of(corpus.assign_split(sums, corpus.split_speakers(speakers)), ["split"]))


@query
def error_counts_by_clip(spark, root):
    return scored_pairs(spark, root, "sample_id").select(
        "sample_id", "word_errors_macro", "words_macro", "word_errors_micro", "words_micro",
        "char_errors", "chars", "exact",
    )


@query
def macro_error_rates(spark, root):
    return rounded(metrics.macro_rates(scored_pairs(spark, root, "speaker_id"), ["speaker_id"]))


@query
def micro_error_rates(spark, root):
    return rounded(metrics.micro_rates(scored_pairs(spark, root, "lang"), ["lang"]))


@query
def prediction_pairing(spark, root):
    docs = B.table(spark, root, "documents").select(F.col("doc_id").alias("sample_id"), "n_chars")
    labels = B.table(spark, root, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    return metrics.pair_predictions(labels, docs)


@query
def run_parity(spark, root):
    docs = B.table(spark, root, "documents")
    labels = B.table(spark, root, "labels").select("doc_id", "quality")
    expected = docs.select("doc_id", F.sha2("text", 256).alias("label"),
                           F.col("n_chars").cast("double").alias("score"))
    actual = docs.join(labels, "doc_id").select(
        "doc_id", F.sha2(F.trim("text"), 256).alias("label"),
        (F.length("text") + F.col("quality") * 0.5).alias("score"),
    )
    return metrics.run_parity(actual, expected, "doc_id", ["label"], ["score"])


@query
def weighted_loss(spark, root):
    lines = B.table(spark, root, "lineitem")
    return rounded(metrics.weighted_mean(
        lines.select("l_returnflag", F.col("l_discount").alias("loss"), "l_quantity"),
        "loss", "l_quantity", ["l_returnflag"],
    ))


# --- annotations ----------------------------------------------------------------------------


def document_words(spark: SparkSession, root: str) -> DataFrame:
    """Words of documents that are dealt by id, so that words grouped by document don't move."""
    docs = B.by_clip(B.table(spark, root, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(
        "doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1))
        .alias("i", "word"),
    ).select("doc_id", (F.col("i") + 1).alias("line_no"), "word")


@query
def transcripts_from_lines(spark, root):
    lines = document_words(spark, root)
    spoken = lines.filter(~text.is_silence(F.col("word"), B.SILENCE)).select(
        "doc_id", "line_no", text.normalize_token(F.col("word")).alias("token")
    )
    return text.transcripts(spoken.filter("token <> ''"), ["doc_id"], "line_no", "token")


def annotation_files(spark: SparkSession, root: str, separator: str) -> DataFrame:
    """Each document spelled as an annotation file: one timed line per word.

    Words whose hash starts with 0 come on a line with two columns only.
    """
    words = F.split(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")),
                    " ", -1)
    line = F.transform(words, lambda w, i: F.concat_ws(
        separator, (i * 10).cast("string"),
        F.when(~F.startswith(F.md5(w), F.lit("0")), (i * 10 + 10).cast("string")), w,
    ))
    return B.documents(spark, root, "doc_id", "text").select(
        "doc_id", F.concat(F.lit("﻿"), F.array_join(line, "\r\n")).alias("value")
    )


@query
def alignment_rows(spark, root):
    rows = alignment.parse_alignment(annotation_files(spark, root, "\t"), silence=B.SILENCE)
    return rows.select("doc_id", "line_no", "start", "end", "token",
                       F.coalesce("is_silence", F.lit(False)).alias("is_silence"), "error")


@query
def alignment_spaced_tokens(spark, root):
    rows = alignment.parse_spaced(annotation_files(spark, root, " "), silence=B.SILENCE)
    return rows.select("doc_id", "line_no", "token")


@query
def interval_checks(spark, root):
    lines = B.annotation_lines(spark, root).filter("event_type <> 'error'")
    checked = validate.interval_checks(
        lines, "user_id", ["start", "event_id"], F.floor(F.col("start") / B.MINUTE_MICROS)
    )
    return checked.select("user_id", "event_id", "start", "end", "previous_end", "violation")


@query
def first_interval_violations(spark, root):
    lines = B.annotation_lines(spark, root).filter("event_type <> 'error'")
    checked = validate.interval_checks(
        lines, "user_id", ["start", "event_id"], F.floor(F.col("start") / B.MINUTE_MICROS)
    )
    return validate.first_violations(checked, "user_id", ["start", "event_id"])


@query
def rejects_log(spark, root):
    rows = alignment.parse_alignment(annotation_files(spark, root, "\t"), silence=B.SILENCE)
    _, bad = alignment.split_rejects(rows)
    return tables.reject_lines(
        bad, "doc_id", F.lit("ValueError"),
        F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" "), F.col("error")),
    )


# --- validation -----------------------------------------------------------------------------


@query
def speaker_mismatches(spark, root):
    docs = B.table(spark, root, "documents").select(
        F.concat_ws("_", "source", "doc_id").alias("sample_id"),
        F.concat(F.lit("src"), F.length("text") % 20).alias("path_speaker"),
    )
    return validate.speaker_mismatches(docs)


@query
def unknown_characters(spark, root):
    docs = B.documents(spark, root, "doc_id", "text").select(
        "doc_id", F.lower("text").alias("transcript"))
    checked = validate.transcript_checks(docs, "transcript", K.SERBIAN_LETTERS)
    return checked.select("doc_id", F.array_join("unknown", " ").alias("unknown"), "problem")


@query
def required_steps(spark, root):
    return validate.feasibility(B.clips(spark, root)).select(
        "sample_id", "num_frames", "required_steps", "feasible"
    )


@query
def feasibility_report(spark, root):
    return validate.feasibility_report(validate.feasibility(B.clips(spark, root)), ["speaker_id"])


@query
def shortest_feasible(spark, root):
    return selection.shortest_feasible(validate.feasibility(B.clips(spark, root)), 25).select(
        "sample_id", "num_frames", "required_steps"
    )


@query
def duplicate_texts(spark, root):
    docs = B.table(spark, root, "documents").select(F.md5("text").alias("text_key"))
    return validate.duplicate_keys(docs, ["text_key"])


@query
def rule_report(spark, root):
    events = B.table(spark, root, "events")
    return validate.rule_report(events, {
        "value_not_negative": F.col("value") >= 0,
        "value_below_400": F.col("value") < 400,
        "known_type": F.col("event_type").isin("view", "signup", "error", "purchase", "click"),
        "has_props": F.get_json_object("props", "$.k").isNotNull(),
        "props_in_unit_range": F.get_json_object("props", "$.k").cast("double") / 100 < 0.95,
    })


@query
def allowed_speakers(spark, root):
    manifest = B.clips(spark, root).select("sample_id", "speaker_id", "num_frames")
    return validate.allow_list(manifest, ["src1", "src3", "src11"])


@query
def forbidden_tokens(spark, root):
    docs = B.table(spark, root, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("document"), "text")
    pages = B.table(spark, root, "pages").select(
        F.concat(F.lit("page"), F.col("page_id")).alias("document"), F.col("html").alias("text"))
    return text.find_tokens(docs.unionByName(pages), ["document"], "text", FORBIDDEN)


@query
def encoded_targets(spark, root):
    rows = B.dialogue_clips(spark, root)
    ids = text.encode_text(F.col("reference"))
    return rows.withColumn("ids", ids).select(
        "sample_id", joined(F.col("ids")).alias("ids"),
        text.decode_ids(F.col("ids")).alias("decoded"),
        ctc.minimum_steps_of_ids(F.col("ids")).alias("required_steps"),
    )


@query
def language_model_tokens(spark, root):
    return B.dialogue_clips(spark, root).select(
        "sample_id", F.array_join(text.language_model_tokens(F.col("reference")), " ").alias("tokens")
    )


@query
def inventory_names(spark, root):
    group = F.element_at(F.array(*[F.lit(p) for p in (
        "conv1.", "gru2.", "FC.", "pool.", "conv3.", "gru1.", "conv2.")]), (F.col("p_size") % 7 + 1).cast("int"))
    raw = F.concat(F.when(F.col("p_size") > 25, "module.").otherwise(""), group, F.col("p_partkey"))
    parts = B.table(spark, root, "part").select("p_partkey", raw.alias("raw"))
    name = text.strip_prefix(F.col("raw"))
    return parts.select("p_partkey", name.alias("name"), text.prefix_group(name).alias("grouped"))


@query
def nfc_text(spark, root):
    session.light_batches(spark)
    docs = B.documents(spark, root, "doc_id", "text")
    return docs.select("doc_id", F.sha2(nfc("text"), 256).alias("nfc_sha256"))


# --- corpus ---------------------------------------------------------------------------------


def media_and_annotations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    media = B.table(spark, root, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker_id"),
        F.col("n_chars").alias("num_frames"))
    notes = B.table(spark, root, "labels").select(
        F.col("doc_id").alias("sample_id"), "quality", "toxic")
    return media, notes


@query
def media_pairing(spark, root):
    return corpus.pair_media(*media_and_annotations(spark, root))


@query
def unpaired_examples(spark, root):
    return corpus.unpaired_examples(corpus.pair_media(*media_and_annotations(spark, root)))


@query
def key_differences(spark, root):
    media, notes = media_and_annotations(spark, root)
    return corpus.key_differences(media, notes, "sample_id")


@query
def manifest(spark, root):
    docs = B.documents(spark, root, "doc_id", "source", "lang", "text", "n_chars")
    pairs = B.table(spark, root, "labels").select(F.col("doc_id").alias("sample_id"))
    spoken = docs.select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker_id"),
        text.normalize_sentence(F.replace("text", F.lit("\n"), F.lit(" ")), B.SILENCE)
        .alias("transcript"),
    )
    media = docs.select(
        F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("num_frames"),
        (F.lit(24.0) + F.length("lang") + F.length("source") / 7).alias("fps"),
        F.lit(128).alias("width"), F.lit(64).alias("height"),
    )
    rows = corpus.assemble_manifest(pairs, spoken, media)
    return rows.withColumn("transcript", F.md5("transcript"))


@query
def distinct_speakers(spark, root):
    return B.table(spark, root, "documents").select(F.col("source").alias("speaker_id")).distinct()


def document_split(spark: SparkSession, root: str) -> DataFrame:
    docs = B.table(spark, root, "documents").select(
        "doc_id", F.col("source").alias("speaker_id"), F.md5("text").alias("text_key"))
    return corpus.assign_split(docs, corpus.split_speakers(docs))


@query
def split_assignment(spark, root):
    return document_split(spark, root).select("doc_id", "speaker_id", "split")


@query
def split_counts(spark, root):
    per = document_split(spark, root).groupBy("split", "speaker_id").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(
        F.sum("n").alias("samples"), F.count("*").alias("speakers"))


@query
def split_leaks(spark, root):
    assigned = document_split(spark, root)
    by_text = corpus.leaks(assigned, "text_key").withColumn("kind", F.lit("text"))
    by_speaker = corpus.leaks(assigned, "speaker_id").withColumn("kind", F.lit("speaker"))
    return by_text.withColumnRenamed("text_key", "leaked").unionByName(
        by_speaker.withColumnRenamed("speaker_id", "leaked"))


@query
def split_documents(spark, root):
    return corpus.split_documents(document_split(spark, root))


@query
def first_existing_path(spark, root):
    labels = B.table(spark, root, "labels")
    listing = labels.select(
        F.col("doc_id").alias("sample_id"),
        F.explode(F.filter(F.array(
            F.when(F.col("quality") == 1, F.lit("align")),
            F.when(F.col("toxic") == 1, F.lit("alignment")),
        ), lambda f: f.isNotNull())).alias("folder"),
    ).withColumn("path", F.concat_ws("/", "folder", F.concat(F.col("sample_id"), F.lit(".align"))))
    wanted = B.table(spark, root, "documents").select(F.col("doc_id").alias("sample_id"))
    return corpus.first_existing(wanted, listing, "sample_id", ["alignment", "align"])


def reconciled_parts(spark: SparkSession, root: str) -> DataFrame:
    current = B.table(spark, root, "part").select(
        F.col("p_partkey").alias("name"), F.col("p_size").alias("shape"))
    offered = B.table(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(
        F.max("l_quantity").cast("int").alias("shape"))
    return corpus.reconcile_inventory(current, offered)


@query
def inventory_reconciliation(spark, root):
    return reconciled_parts(spark, root)


@query
def inventory_differences(spark, root):
    named = reconciled_parts(spark, root).withColumn("name", F.col("name").cast("string"))
    return corpus.unexpected_differences(named, ["1", "2", "3", "no_such_part"])


@query
def resume_states(spark, root):
    work, notes = media_and_annotations(spark, root)
    outputs = notes.select("sample_id", (F.col("quality") * 40 + F.col("toxic") * 5).alias("frames"))
    log = B.table(spark, root, "labels").filter("toxic = 1").select(
        F.col("doc_id").alias("sample_id"), F.lit(60).alias("decoded_frames"),
        (F.lit(45) + F.col("quality")).alias("landmark_frames"),
        (F.lit(15) - F.col("quality")).alias("dropped_frames"))
    return corpus.resume(work.select("sample_id", "speaker_id"), log, outputs)


@query
def work_left(spark, root):
    work, notes = media_and_annotations(spark, root)
    outputs = notes.select("sample_id", (F.col("quality") * 40 + F.col("toxic") * 5).alias("frames"))
    return corpus.work_left(work, outputs)


@query
def reusable_evaluations(spark, root):
    requests = B.table(spark, root, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.lit(1).alias("best_epoch"))
    cache = B.table(spark, root, "documents").join(
        B.table(spark, root, "labels"), "doc_id"
    ).select(F.sha2("text", 256).alias("sha256"), F.col("quality").alias("best_epoch"))
    hits, misses = corpus.reusable(requests, cache, ["sha256", "best_epoch"])
    return hits.select("doc_id", F.lit("reuse").alias("action")).unionByName(
        misses.select("doc_id", F.lit("evaluate").alias("action")))


@query
def file_list(spark, root):
    lines = B.table(spark, root, "pages").select("page_id", F.col("url").alias("value"))
    return files.parse_file_list(lines).drop("value")


@query
def content_fingerprints(spark, root):
    docs = B.table(spark, root, "documents")
    return docs.select(
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("relative_path"),
        F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query
def selected_paths(spark, root):
    docs = B.table(spark, root, "documents").select(F.concat(
        F.lit("/"), F.col("source"),
        F.when(F.col("n_chars") > 1500, "/alignment/").otherwise("/video/"), F.col("doc_id"),
        F.when(F.col("lang").isin("en", "de"), ".align").otherwise(".txt"),
    ).alias("path"))
    return files.select_paths(docs)


@query
def frame_folders(spark, root):
    """Pages as picture folders: the host is the folder, the last path part the picture."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    last = F.regexp_replace(F.element_at(F.split("url", "/", -1), -1), r"[?#].*$", "")
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    pages = B.table(spark, root, "pages").select(F.concat(
        host, F.lit("/"), stem, F.when(F.length("html") > 1500, ".JPG").otherwise(".jpeg")
    ).alias("relative_path"))
    return files.frame_folders(pages)


def file_tree(spark: SparkSession, root: str) -> str:
    """Documents as files in speakers' folders, every third one empty and every tenth in a second folder as well."""
    name = F.concat(F.lit("/ser/video_a/"), F.col("doc_id"), F.lit(".mp4"))
    folders = F.array_compact(F.array(
        F.concat(F.lit("spk"), "source", name), F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("spk~"), name))))
    content = F.when(F.col("n_chars") % 3 != 0, F.col("text")).otherwise("").cast("binary")
    path = session.scratch_path(spark, "files")
    rows = B.table(spark, root, "documents").select(F.explode(folders).alias("relative_path"), content.alias("content"))
    listing.write_files(rows, path).agg(F.sum("bytes")).collect()
    return path


@query
def listed_files(spark, root):
    found = files.list_files(spark, file_tree(spark, root), files.MEDIA_GLOB)
    return found.select("relative_path", "bytes")


@query
def discovered_files(spark, root):
    return files.discover_files(spark, file_tree(spark, root))


@query
def file_inventory(spark, root):
    return files.inventory(spark, file_tree(spark, root), files.MEDIA_GLOB)


@query
def folder_disagreements(spark, root):
    media, notes = media_and_annotations(spark, root)
    named = notes.withColumn("speaker_id", F.concat(F.lit("src"), (F.col("sample_id") + F.col("toxic")) % 20))
    return corpus.speaker_disagreements(media, named)


# --- documents ------------------------------------------------------------------------------


@query
def vocabulary_documents(spark, root):
    """Symbols and ids of each language's characters, as one document a language."""
    seen = B.documents(spark, root, "lang", "text").select(
        "lang", F.explode(F.array_distinct(text.characters(F.lower("text")))).alias("symbol")).distinct()
    symbols = seen.groupBy("lang").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))
    made = symbols.select(
        "lang", F.lit(K.BLANK_SYMBOL).alias("blank"), "symbols",
        F.map_from_arrays("symbols", F.sequence(F.lit(1), F.size("symbols"))).alias("ids"))
    path = session.scratch_path(spark, "vocabulary")
    tables.write_documents(made, path)
    read = tables.read_documents(spark, path, {
        "lang": ("$.lang", "string"), "blank": ("$.blank", "string"), "symbols": ("$.symbols", "array<string>"),
        "id_of_e": ("$.ids.e", "int"), "id_of_zero": ("$.ids['0']", "int")})
    return read.select("lang", "blank", F.size("symbols").alias("n_symbols"),
                       F.array_join("symbols", "").alias("symbols"), "id_of_e", "id_of_zero")


@query
def quality_documents(spark, root):
    path = session.scratch_path(spark, "quality")
    tables.write_documents(quality_sample(spark, root), path)
    return tables.read_documents(spark, path, {
        "sample_id": ("$.sample_id", "bigint"), "speaker_id": ("$.speaker_id", "string"),
        "num_frames": ("$.num_frames", "bigint"), "role": ("$.role", "string"), "quality": ("$.quality", "int")})


@query
def audit_documents(spark, root):
    path = session.scratch_path(spark, "audit")
    tables.write_documents(feasibility_report(spark, root), path)
    return tables.read_documents(spark, path, {
        "speaker_id": ("$.speaker_id", "string"), "valid": ("$.valid", "bigint"),
        "invalid": ("$.invalid", "bigint"), "usable": ("$.usable", "boolean")})


# --- blocks, logs, streaming ----------------------------------------------------------------


def document_blocks(spark: SparkSession, root: str) -> DataFrame:
    docs = B.table(spark, root, "documents").select("doc_id", "source", "n_chars")
    return batching.assign_blocks(docs, "doc_id", 100)


@query
def block_summary(spark, root):
    return batching.block_summary(document_blocks(spark, root), F.col("n_chars") < 1000)


@query
def restored_blocks(spark, root):
    """All blocks are written, then every second one again with other rows, which take the place of the first."""
    rows, even = document_blocks(spark, root), F.col("block_id") % 2 == 0
    path = session.scratch_path(spark, "blocks")
    tables.write_blocks(rows.withColumn("n_chars", F.when(even, -1).otherwise(F.col("n_chars"))), path)
    tables.write_blocks(rows.filter(even), path)
    return tables.read_blocks(spark, path).select("doc_id", "source", "n_chars", "position", "block_id")


@query
def block_index(spark, root):
    path = session.scratch_path(spark, "blocks")
    tables.write_blocks(document_blocks(spark, root), path)
    return tables.block_index(spark, path).drop("attempt")


@query
def manifest_roundtrip(spark, root):
    path = session.scratch_path(spark, "manifest")
    rows = validate.media_measures(B.clips(spark, root).withColumns({
        "fps": F.lit(25.0), "width": F.lit(128), "height": F.lit(64),
        "video_path": F.concat_ws("/", "speaker_id", F.concat("sample_id", F.lit(".mp4"))),
        "alignment_path": F.concat_ws("/", "speaker_id", F.concat("sample_id", F.lit(".align"))),
    }))
    tables.write_manifest(rows, path)
    return tables.read_manifest(spark, path)


@query
def results_log(spark, root):
    path = session.scratch_path(spark, "log")
    events = B.table(spark, root, "events").select(
        F.col("user_id").cast("string").alias("sample_id"),
        F.col("event_type").alias("speaker"), F.lit("v").alias("video"), F.lit("o").alias("output"),
        F.col("event_id").alias("decoded_frames"), F.col("event_id").alias("landmark_frames"),
        F.lit(0).cast("bigint").alias("dropped_frames"))
    # Two appends; the later one comes first in the order of the ids.
    late = F.col("decoded_frames") % 2 == 0
    tables.append_log(events.filter(~late), path, 0, F.col("decoded_frames"))
    tables.append_log(events.filter(late), path, 1, -F.col("decoded_frames"))
    return tables.latest_results(tables.read_log(spark, path))


@query
def incremental_intake(spark, root):
    """Three drops of events into one folder, each with rows of the drop before; every event counts once."""
    events = B.table(spark, root, "events")
    inbox = session.scratch_path(spark, "inbox")
    sink = intake.Intake(
        session.scratch_path(spark, "intake"), "event_id",
        # Null, thus a failure, for searches without a value above ten.
        F.when((F.col("event_type") == "error") | (F.col("value") > 10), F.col("event_type") == "error"))
    number = F.col("event_id") % 6
    for drop in ([0, 1], [1, 2, 3], [3, 4, 5]):
        events.filter(number.isin(drop)).write.mode("append").parquet(inbox)
        sink.run(intake.file_stream(spark, inbox, events.schema, "*.parquet"))
    done = sink.results(spark, events.schema).withColumn("status", F.lit("result"))
    bad = sink.rejects(spark, events.schema).withColumn("status", F.lit("failure"))
    return done.unionByName(bad).select("event_id", "user_id", "event_type", "value", "status")


# --- boxes, landmarks -----------------------------------------------------------------------


@query
def frame_boxes(spark, root):
    return rounded(B.detections(spark, root), 10)


def clip_table(spark: SparkSession, root: str) -> DataFrame:
    """Clip boxes, written once because several medians are taken over them."""
    return session.cut_lineage(
        boxes.clip_boxes(B.detections(spark, root), ["clip_id", "speaker_id"]))


@query
def clip_boxes(spark, root):
    return rounded(boxes.clip_boxes(B.detections(spark, root), ["clip_id", "speaker_id"]), 10)


@query
def speaker_medians(spark, root):
    return rounded(boxes.speaker_and_global_medians(clip_table(spark, root)), 10)


def located(spark: SparkSession, root: str) -> DataFrame:
    return boxes.fallback_boxes(clip_table(spark, root))


@query
def fallback_boxes(spark, root):
    return rounded(located(spark, root), 10)


@query
def box_roundtrip(spark, root):
    path = session.scratch_path(spark, "boxes")
    tables.write_boxes(located(spark, root).withColumnRenamed("clip_id", "sample_id"), path)
    return rounded(tables.read_boxes(spark, path), 10)


@query
def fallback_counts(spark, root):
    return located(spark, root).groupBy("source").agg(F.count("*").alias("clips"))


@query
def heavy_medians(spark, root):
    """Medians over all frames of a clip, however many they are."""
    rows = B.frames(spark, root).filter("x IS NOT NULL")
    return rounded(skew.exact_median(rows, ["clip"], ["x", "y"]), 10)


@query
def pixel_boxes(spark, root):
    clips = boxes.clip_boxes(B.detections(spark, root), ["clip_id", "speaker_id"])
    found = clips.filter("x1 IS NOT NULL")
    return found.select(
        "clip_id", F.inline(F.array(boxes.pixel_box(F.lit(1280), F.lit(720))))
    )


@query
def sampling_positions(spark, root):
    docs = B.table(spark, root, "documents").select("doc_id", "n_chars")
    return docs.select(
        "doc_id", joined(boxes.sample_positions(F.col("n_chars"))).alias("sampled"),
        joined(boxes.spread_positions(F.col("n_chars"))).alias("spread"),
        F.round(boxes.detection_scale(F.col("n_chars"), F.lit(720), 1024), 9).alias("scale"))


@query
def sampled_frames(spark, root):
    turns = B.table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("bigint").alias("frame"),
        "l_partkey")
    clips = turns.groupBy("clip").agg(F.max("frame").alias("n"))
    return boxes.sampled_frames(turns, clips, "clip", boxes.sample_positions(F.col("n") + 1, 3))


@query
def quality_sample(spark, root):
    docs = B.table(spark, root, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker_id"),
        F.col("n_chars").alias("num_frames"))
    chosen = selection.quality_sample(docs, 30)
    measures = B.table(spark, root, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    return chosen.join(measures, "sample_id", "left")


@query
def processing_summary(spark, root):
    return keypoints.frame_summary(B.frames(spark, root), ["clip"], F.col("x").isNotNull())


@query
def review_clips(spark, root):
    day = F.floor(F.col("at") / B.DAY_MICROS)
    rows = B.frames(spark, root).withColumn("sample_id", F.concat_ws("_", "clip", day))
    results = keypoints.frame_summary(rows, ["clip", "sample_id"], F.col("x").isNotNull())
    return selection.review_clips(results, "clip")


@query
def gap_fill(spark, root):
    return keypoints.fill_gaps(
        B.frames(spark, root).drop("at"), ["clip"], "frame", ["x", "y"], chunk_size=4096)


@query
def renumbered_frames(spark, root):
    return keypoints.renumber(
        B.frames(spark, root), ["clip"], "frame", F.col("x").isNotNull(), chunk_size=4096
    ).select("clip", "frame", "frame_no", "stem")


@query
def point_extents(spark, root):
    return rounded(keypoints.extents(B.landmark_points(spark, root), ["sample_id"]))


def template_fit(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    points = B.landmark_points(spark, root)
    matched = keypoints.match_template(points)
    return points, keypoints.fit_similarity(matched, ["sample_id"])


@query
def similarity_fit(spark, root):
    return rounded(template_fit(spark, root)[1], 4)


@query
def crop_windows(spark, root):
    points, fitted = template_fit(spark, root)
    moved = keypoints.apply_similarity(points, fitted, ["sample_id"]).select(
        "sample_id", "point", F.col("moved_x").alias("x"), F.col("moved_y").alias("y"))
    return keypoints.crop_windows(moved, ["sample_id"], first_point=12)


@query
def mirrored_pixels(spark, root):
    rows = B.table(spark, root, "embeddings")
    mirrored = keypoints.mirror_coin(F.col("vec_id"), 42)
    pixels = F.when(mirrored, keypoints.mirror_rows(F.col("embedding"), 8)).otherwise(
        F.col("embedding"))
    scaled = keypoints.scale_pixels(pixels)
    return rows.select("vec_id", mirrored.alias("mirrored"), F.posexplode(scaled).alias("i", "v")) \
        .select("vec_id", "mirrored", "i", F.round("v", 9).alias("v"))


@query
def detector_frames(spark, root):
    """A toy detector: the embedding's first half as points, nothing when it starts below zero."""
    rows = B.table(spark, root, "embeddings").select("vec_id", "embedding")

    def factory():
        def detect(values):
            if values[0] < 0:
                return []
            return [[(values[2 * i], values[2 * i + 1]) for i in range(16)], [(0.0, 0.0)]]
        return detect

    found = models.apply_detector(rows, factory, ["vec_id"], "embedding")
    return rounded(models.points_table(found, ["vec_id"]))


# --- score tables ---------------------------------------------------------------------------


@query
def argmax_steps(spark, root):
    return ctc.argmax_steps(B.logit_steps(spark, root)).select("sample_id", "t", "token")


@query
def log_softmax(spark, root):
    return B.logit_steps(spark, root).select(
        "sample_id", "t", F.posexplode(ctc.log_softmax(F.col("scores"))).alias("class", "lp")
    ).select("sample_id", "t", "class", F.round("lp", 6).alias("lp"))


@query
def greedy_decode(spark, root):
    return ctc.greedy_decode(B.logits(spark, root), alphabet=B.LOGIT_LETTERS)


@query
def greedy_decode_by_steps(spark, root):
    steps = ctc.argmax_steps(B.logit_steps(spark, root)).select("sample_id", "t", "token")
    return ctc.collapse_steps(steps, "sample_id", B.LOGIT_LETTERS, chunk_size=4)


@query
def scored_clips(spark, root):
    """A toy score model: the embedding folded into steps of eight classes."""
    rows = B.table(spark, root, "embeddings").select(
        "vec_id", "embedding", (F.lit(5) + F.col("label")).alias("length"))

    def factory():
        return lambda values: [values[i:i + 8] for i in range(0, 64, 8)]

    scored = models.score_model(rows, factory, ["vec_id"], "embedding")
    return models.logits_table(scored, ["vec_id"]).select(
        "vec_id", "length", "t", ctc.argmax(F.col("scores")).alias("token"))


# --- language model, rescoring --------------------------------------------------------------


@query
def ngram_counts(spark, root):
    return ngram.count_ngrams(B.sentences(spark, root), "sentence")


def dialogue_model(spark: SparkSession, root: str, order: int = K.LM_ORDER) -> DataFrame:
    """Model of the conversations, stored once and then reused."""
    counts = ngram.count_ngrams(B.sentences(spark, root), "sentence", order)
    return ngram.store_model(ngram.estimate(counts, order), session.scratch_path(spark, "model"))


@query
def kneser_ney_model(spark, root):
    counts = ngram.count_ngrams(B.sentences(spark, root), "sentence")
    return rounded(ngram.estimate(counts), 8)


@query
def sentence_scores(spark, root):
    model = dialogue_model(spark, root)
    rows = B.table(spark, root, "benchmark").select("item_id", F.lower("text").alias("sentence"))
    return rounded(ngram.score_sentences(rows, ["item_id"], "sentence", model), 6)


@query
def beam_candidates(spark, root):
    model = dialogue_model(spark, root)
    return rounded(beam.beam_decode(
        B.logits(spark, root), model, width=100, alpha=0.5, beta=0.5, letters=B.LOGIT_LETTERS,
        order=K.LM_ORDER))


@query
def words_per_sentence(spark, root):
    return text.word_count_histogram(B.dialogue_clips(spark, root), "reference")


@query
def words_by_position(spark, root):
    return text.words_by_position(B.dialogue_clips(spark, root), "reference")


@query
def position_sizes(spark, root):
    return text.position_sizes(text.words_by_position(B.dialogue_clips(spark, root), "reference"))


@query
def best_per_text(spark, root):
    return rounded(tuning.best_per_text(B.nbest(spark, root)))


def grid(spark: SparkSession, root: str) -> DataFrame:
    return tuning.grid_rates(
        tuning.best_per_text(B.nbest(spark, root)), B.dialogue_clips(spark, root),
        K.TUNING_ALPHAS, K.TUNING_BETAS)


@query
def selected_candidates(spark, root):
    return tuning.select_best(tuning.best_per_text(B.nbest(spark, root)), K.TUNING_BETAS)


@query
def grid_rates(spark, root):
    return rounded(grid(spark, root), 9)


@query
def grid_ranking(spark, root):
    ranked = tuning.rank_grid(grid(spark, root), 10)
    return rounded(ranked, 9)


# --- run history, batches, reports ----------------------------------------------------------


@query
def stitched_history(spark, root):
    """Turns as epochs of two stages with nested metrics, written as JSON, read back and numbered through."""
    turn = F.col("turn").cast("int")
    second = turn >= 2
    size = F.length("text").cast("double")
    measures = lambda value: F.struct(
        value.alias("loss"), (value / 2).alias("wer"), (value / 4).alias("cer"), F.lit(0.0).alias("sentence_exact_match"))
    rows = B.table(spark, root, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"), F.when(second, turn - 2).otherwise(turn).alias("epoch"),
        F.when(second, "second").otherwise("first").alias("stage"),
        measures(size).alias("train"), measures(size + 1).alias("validation"),
        F.create_map(F.lit("head"), 1 / (turn + 1), F.lit("role"), F.length("role").cast("double")).alias("learning_rates"))
    path = session.scratch_path(spark, "history")
    rows.write.json(path)
    stitched = history.stitch_stages(history.read_history(spark, path), "first", "second")
    return rounded(stitched.select(
        "run_id", "epoch", "stage", F.col("train.loss").alias("train_loss"), F.col("validation.wer").alias("validation_wer"),
        F.col("validation.cer").alias("validation_cer"), F.col("learning_rates.head").alias("head_rate"),
        F.col("learning_rates.role").alias("role_rate")), 9)


@query
def early_stopping(spark, root):
    tracked = history.track(B.run_histories(spark, root), patience=2, warmup=1, chunk_size=3)
    return history.until_stop(tracked)


@query
def best_epochs(spark, root):
    return rounded(history.best_epochs(B.run_histories(spark, root), BASELINE_RATE), 9)


@query
def epoch_batches(spark, root):
    orders = B.table(spark, root, "orders").select("o_orderkey")
    return batching.epoch_batches(orders, "o_orderkey", [0, 1])


@query
def ordered_batches(spark, root):
    """Unshuffled batches over keys that are names."""
    named = B.table(spark, root, "customer").select("c_name")
    return batching.epoch_batches(named, "c_name", [0, 1], size=3, shuffled=False)


def order_sequences(spark: SparkSession, root: str) -> DataFrame:
    """The lines of an order as one sequence, batched by two in key order."""
    sequences = B.table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
        lambda p: p["l_partkey"]).alias("sequence"))
    return batching.assign_blocks(sequences, "l_orderkey", 2).withColumnRenamed(
        "block_id", "batch_id")


@query
def batch_lengths(spark, root):
    return batching.batch_lengths(order_sequences(spark, root), ["batch_id"], F.size("sequence"))


@query
def padded_batches(spark, root):
    padded = batching.pad_to_batch(order_sequences(spark, root), ["batch_id"], "sequence")
    return padded.select(
        "l_orderkey", "batch_id", "true_length", "padded_length",
        joined(F.col("padded")).alias("padded"))


@query
def padded_to_length(spark, root):
    padded = batching.pad_to_length(order_sequences(spark, root), "sequence", 5)
    return padded.select("l_orderkey", "too_long", joined(F.col("padded")).alias("padded"))


@query
def numeric_order(spark, root):
    names = B.table(spark, root, "customer").select(
        F.regexp_replace("c_name", "^Customer#", "").alias("stem"))
    ordered = selection.numeric_order(names, "stem")
    return ordered


@query
def first_examples(spark, root):
    pairs = B.predictions(spark, root).select("sample_id", "prediction", "reference")
    return selection.examples(pairs, "sample_id", 10)
