"""How the star-schema and text tables play the roles of a speech corpus.

Every binding reads whole tables and whole texts: a document is cut into utterances, and each
utterance is a clip with its own transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab.operators import boxes, text
from speechtab.session import epoch_micros, spread

UTTERANCE_ENDS = r"[.!?\n]+"
# Frequent short words play the silence tokens.
SILENCE = ("the", "der", "la", "de", "en")
# A character no text contains; it stands for what a hypothesis got wrong.
BLOT = "■"
DAY_MICROS = 86_400_000_000
MINUTE_MICROS = 60_000_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def documents(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Documents spread over the cores, for work that is costly per text."""
    return spread(table(spark, root, "documents").select(*columns))


def utterances(texts: DataFrame, keys: list[str], silence: tuple[str, ...], column: str = "text"
               ) -> DataFrame:
    """(keys, part, transcript, num_frames): the pieces of a text that say anything.

    The transcripts are made inside the generator, so the filter does not compute them again.
    """
    pieces = F.transform(F.split(column, UTTERANCE_ENDS, -1), lambda raw, i: F.struct(
        (i + 1).alias("part"), text.normalize_sentence(raw, silence).alias("transcript"),
        F.length(raw).alias("num_frames"),
    ))
    return texts.select(*keys, F.explode(pieces).alias("u")).select(*keys, "u.*").filter(
        "transcript <> ''"
    )


def clips(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, speaker_id, lang, doc_id, part, transcript, num_frames) from the documents."""
    docs = documents(spark, root, "doc_id", "source", "lang", "text")
    return utterances(docs, ["doc_id", "source", "lang"], SILENCE).select(
        F.concat_ws("_", "source", "doc_id", "part").alias("sample_id"),
        F.col("source").alias("speaker_id"), "lang", "doc_id", "part", "transcript", "num_frames",
    )


def hypothesis(transcript: Column, *ids: Column | str, seed: str = "0") -> Column:
    """A repeatable imperfect copy.

    By the digits of one hash a sixteenth of the words each is lost, blotted out, said twice, followed by two
    spaces, replaced by the word that follows, or turned round; one text in 256 is empty.
    """
    digits = F.md5(F.concat_ws("|", F.lit(seed), *ids))

    def heard(said: Column) -> Column:
        drawn = F.transform(said["words"], lambda w, i: F.struct(
            w.alias("word"), F.coalesce(F.get(said["words"], i + 1), w).alias("following"),
            F.substring(said["digits"], (i * 7 + 7) % 32 + 1, F.lit(1)).alias("digit"),
        ))
        spoken = F.transform(drawn, lambda d: _heard_word(d["word"], d["following"], d["digit"]))
        return F.when(F.startswith(said["digits"], F.lit("00")), "").otherwise(
            F.array_join(F.filter(spoken, lambda w: w.isNotNull()), " ")
        )

    said = F.struct(text.words_micro(transcript).alias("words"), digits.alias("digits"))
    return F.get(F.transform(F.array(said), heard), F.lit(0))


def _heard_word(word: Column, following: Column, digit: Column) -> Column:
    return (
        F.when(digit == "0", F.lit(None).cast("string"))
        .when(digit == "1", F.repeat(F.lit(BLOT), F.length(word)))
        .when(digit == "2", F.concat_ws(" ", word, word))
        .when(digit == "3", F.concat(word, F.lit(" ")))
        .when(digit == "4", following)
        .when(digit == "5", F.concat(F.substring(word, F.lit(2), F.length(word)), F.substring(word, 1, 1)))
        .otherwise(word)
    )


def predictions(spark: SparkSession, root: str, seed: str = "0") -> DataFrame:
    rows = clips(spark, root)
    return rows.withColumn("reference", F.col("transcript")).withColumn(
        "prediction", hypothesis(F.col("transcript"), "doc_id", "part", seed=seed)
    ).drop("transcript")


def dialogue_clips(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, reference) from the utterances of the conversations."""
    turns = spread(table(spark, root, "conversations").select("conv_id", "turn", "text"))
    return utterances(turns, ["conv_id", "turn"], ()).select(
        F.concat_ws("_", "conv_id", "turn", "part").alias("sample_id"),
        F.col("transcript").alias("reference"),
    )


def by_clip(clips: DataFrame, key: str = "sample_id") -> DataFrame:
    """Clips dealt by their id, in more parts than a join would have, as each row will become many."""
    parts = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return clips.repartition(2 * parts, key)


def nbest(spark: SparkSession, root: str) -> DataFrame:
    """Four hypotheses per dialogue clip, with scores drawn from md5; ``alpha`` has all weights they were decoded under.

    Clips are dealt before their hypotheses are made, so what is grouped by clip later on moves once, as one text.
    """
    rows = by_clip(dialogue_clips(spark, root))
    variants = rows.select("sample_id", "reference", F.explode(
        F.array(*[F.lit(str(s)) for s in range(4)])
    ).alias("seed"))
    spelled = variants.select("sample_id", "seed", F.array_join(F.transform(
        F.filter(
            F.transform(text.words_micro(F.col("reference")), lambda w, i: F.struct(
                w.alias("w"), F.substring(F.md5(F.concat_ws(
                    "|", F.col("seed"), F.col("sample_id"), (i + 1).cast("string")
                )), 1, 1).alias("h"),
            )),
            lambda p: p["h"] != "0",
        ),
        lambda p: F.when(p["h"] == "1", F.repeat(F.lit(BLOT), F.length(p["w"]))).otherwise(p["w"]),
    ), " ").alias("text"))
    draw = lambda kind: F.conv(F.substring(
        F.md5(F.concat_ws("|", F.lit(kind), "seed", "sample_id")), 1, 4), 16, 10).cast("double")
    return spelled.select(
        "sample_id", "text", (-draw("am") / 4096).alias("am_score"),
        (-draw("lm") / 8192).alias("lm_score"),
        F.array(*[F.lit(a) for a in K.TUNING_ALPHAS]).alias("alpha"),
    )


def annotation_lines(spark: SparkSession, root: str) -> DataFrame:
    """events as annotation lines: (user_id, event_id, ts, event_type, start, end)."""
    start = epoch_micros(F.col("ts"))
    return table(spark, root, "events").select(
        "user_id", "event_id", "ts", "event_type", start.alias("start"),
        (start + F.rint(F.col("value") * 1_000_000).cast("bigint")).alias("end"),
    )


# Events that stand for pictures without a detection.
UNSEEN = ("error", "signup", "view")


def frames(spark: SparkSession, root: str, unseen: tuple[str, ...] = UNSEEN) -> DataFrame:
    """events as frames of a clip: (clip, frame, at, x, y); unseen rows have null coordinates."""
    seen = ~F.col("event_type").isin(*unseen)
    y = F.get_json_object("props", "$.k").cast("double")
    return table(spark, root, "events").select(
        F.col("user_id").alias("clip"), F.col("event_id").alias("frame"),
        epoch_micros(F.col("ts")).alias("at"),
        F.when(seen, F.col("value") / 1000).alias("x"), F.when(seen, y / 100).alias("y"),
    )


def detections(spark: SparkSession, root: str) -> DataFrame:
    """(clip_id, speaker_id, picture, box): a clip is a user's day, a picture one hour of it.

    A speaker is a user over three days, so that some clips and some speakers have no detection.
    """
    day = F.floor(F.col("at") / DAY_MICROS)
    points = frames(spark, root).select(
        F.concat_ws("_", "clip", day).alias("clip_id"),
        F.concat_ws("_", "clip", F.floor(day / 3)).alias("speaker_id"),
        F.floor(F.col("at") / (DAY_MICROS // 24)).alias("picture"), "x", "y",
    )
    return boxes.frame_boxes(points, ["clip_id", "speaker_id", "picture"])


def logits(spark: SparkSession, root: str) -> DataFrame:
    """embeddings as score tables of 8 steps x 8 classes: (sample_id, length, steps)."""
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.least(F.lit(8), F.lit(4) + F.col("label")).alias("length"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice(
            F.col("embedding"), s * 8 + 1, F.lit(8))).alias("steps"),
    )


LOGIT_LETTERS = " abcdef"


def logit_steps(spark: SparkSession, root: str) -> DataFrame:
    return logits(spark, root).select(
        "sample_id", "length", F.posexplode("steps").alias("t", "scores")
    )


def landmark_points(spark: SparkSession, root: str) -> DataFrame:
    """embeddings as 32 landmarks: (sample_id, point, x, y)."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        F.element_at("embedding", i * 2 + 1).cast("double").alias("x"),
        F.element_at("embedding", i * 2 + 2).cast("double").alias("y"),
    ))
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.posexplode(pairs).alias("point", "p")
    ).select("sample_id", "point", "p.x", "p.y")


def run_histories(spark: SparkSession, root: str) -> DataFrame:
    """conversations as training runs: turn = epoch, text length = error rate."""
    return table(spark, root, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("epoch"),
        (F.length("text") / 1000).alias("wer"),
    )


def sentences(spark: SparkSession, root: str) -> DataFrame:
    turns = spread(table(spark, root, "conversations").select("conv_id", "turn", "text"))
    return turns.select(
        "conv_id", "turn", F.lower(F.replace("text", F.lit("\n"), F.lit(" "))).alias("sentence")
    )
