"""Pairing, manifest assembly, splits, leakage, inventories, reuse of earlier work."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab import session, skew
from speechtab.operators import validate


def pair_media(media: DataFrame, annotations: DataFrame, key: str = "sample_id") -> DataFrame:
    """Full outer pairing by key with a status; both inputs need unique keys."""
    m = media.withColumn("__m", F.lit(True))
    a = annotations.withColumn("__a", F.lit(True))
    return m.join(a, key, "full_outer").withColumn(
        "status",
        F.when(F.col("__a").isNull(), "no_annotation")
        .when(F.col("__m").isNull(), "no_media")
        .otherwise("paired"),
    ).drop("__m", "__a")


def unpaired_examples(paired: DataFrame, key: str = "sample_id", n: int = 5) -> DataFrame:
    """The first ``n`` unpaired keys of either kind (a report, hence the limit)."""
    sides = [
        paired.filter(F.col("status") == s).select("status", key).orderBy(key).limit(n)
        for s in ("no_annotation", "no_media")
    ]
    return sides[0].unionByName(sides[1])


def speaker_disagreements(media: DataFrame, annotations: DataFrame, key: str = "sample_id") -> DataFrame:
    """Pairs whose media and annotation lie in folders of different speakers; a missing speaker differs."""
    named = annotations.select(key, F.col("speaker_id").alias("annotation_speaker"))
    return media.select(key, F.col("speaker_id").alias("media_speaker")).join(named, key).filter(
        ~F.col("media_speaker").eqNullSafe(F.col("annotation_speaker"))
    )


def assemble_manifest(pairs: DataFrame, transcripts: DataFrame, media: DataFrame,
                      key: str = "sample_id") -> DataFrame:
    """Pairs, transcripts and media measures in one row per clip."""
    joined = pairs.join(transcripts, key).join(media, key)
    return validate.media_measures(joined)


def holdout_size(speakers: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(speakers * F.lit(K.HOLDOUT_SHARE)).cast("long"))


def split_speakers(speakers: DataFrame, seed: int = K.SPLIT_SEED) -> DataFrame:
    """(speaker_id, split) from a repeatable md5 order: test, then validation, then train.

    With fewer than three speakers the split is null, an error the caller can test for.
    """
    keyed = speakers.select("speaker_id").distinct().withColumn(
        "__k", session.random_key(F.col("speaker_id"), seed=seed)
    )
    ranked = skew.number_rows(
        keyed, [F.col("__k"), F.col("speaker_id")], skew.hash_bucket(F.col("__k")), "__rank"
    )
    total = keyed.agg(F.count("*").alias("n")).scalar()
    held = holdout_size(F.col("__total"))
    return ranked.withColumn("__total", total).select(
        "speaker_id",
        F.when(F.col("__total") < 3, F.lit(None))
        .when(F.col("__rank") <= held, "test")
        .when(F.col("__rank") <= 2 * held, "validation")
        .otherwise("train")
        .alias("split"),
    )


def shuffled_split(names: Sequence[str], seed: int = K.SPLIT_SEED) -> dict[str, str]:
    """Compatibility mode for a known list: the order of a seeded shuffle of the sorted names.

    The result joins like the dimension of ``split_speakers`` once it is made a table.
    """
    ordered = sorted(set(names))
    if len(ordered) < 3:
        raise ValueError("a split needs at least 3 speakers")
    random.Random(seed).shuffle(ordered)
    held = max(1, round(len(ordered) * K.HOLDOUT_SHARE))
    part = ["test"] * held + ["validation"] * held
    return {s: part[i] if i < len(part) else "train" for i, s in enumerate(ordered)}


def assign_split(df: DataFrame, split_dim: DataFrame) -> DataFrame:
    """The dimension is one row per speaker; the optimizer broadcasts it when it is small."""
    return df.join(split_dim, "speaker_id")


def leaks(assigned: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one split (extremes suffice, so the check combines early)."""
    return (
        assigned.groupBy(key)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter("first_split <> last_split")
    )


def first_existing(wanted: DataFrame, listing: DataFrame, key: str, folders: Sequence[str]
                   ) -> DataFrame:
    """First folder, in the given order, that holds the file of a key; null folder = error.

    ``listing`` has (key, folder, path).
    """
    rank = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder"))
    best = (
        listing.filter(F.col("folder").isin(*folders))
        .groupBy(key)
        .agg(F.min(F.struct(rank.alias("r"), "folder", "path")).alias("__b"))
        .select(key, "__b.folder", "__b.path")
    )
    return wanted.join(best, key, "left")


def reconcile_inventory(
    current: DataFrame, offered: DataFrame, name: str = "name", shape: str = "shape"
) -> DataFrame:
    """Status per name of two (name, shape) tables."""
    c = current.select(name, F.col(shape).alias("current_shape"), F.lit(True).alias("__c"))
    o = offered.select(name, F.col(shape).alias("offered_shape"), F.lit(True).alias("__o"))
    return c.join(o, name, "full_outer").select(
        name,
        "current_shape",
        "offered_shape",
        F.when(F.col("__o").isNull(), "missing")
        .when(F.col("__c").isNull(), "unexpected")
        .when(F.col("current_shape").eqNullSafe(F.col("offered_shape")), "loaded")
        .otherwise("skipped_shape")
        .alias("status"),
    )


def unexpected_differences(reconciled: DataFrame, allowed: Sequence[str], name: str = "name"
                           ) -> DataFrame:
    """Names that differ without permission, and permitted names that do not differ.

    An empty result means the differing set equals the allowed set.
    """
    spark = reconciled.sparkSession
    differing = reconciled.filter("status <> 'loaded'").select(name).distinct()
    permitted = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in allowed])).alias(name))
    return differing.exceptAll(permitted).withColumn("problem", F.lit("not_allowed")).unionByName(
        permitted.exceptAll(differing).withColumn("problem", F.lit("not_differing"))
    )


def resume(work: DataFrame, log: DataFrame, outputs: DataFrame, key: str = "sample_id"
           ) -> DataFrame:
    """Per clip: ``todo``, the logged result, or one rebuilt from the frames already written.

    ``outputs`` has (key, frames); a clip is done when it has frames.
    """
    done = outputs.filter("frames > 0").select(key, "frames")
    logged = log.select(
        key, "decoded_frames", "landmark_frames", "dropped_frames", F.lit(True).alias("__l")
    )
    joined = work.join(done, key, "left").join(logged, key, "left")
    finished, known = F.col("frames").isNotNull(), F.col("__l").isNotNull()

    def carried(name: str, rebuilt: Column) -> Column:
        return F.when(finished & known, F.col(name)).when(finished, rebuilt).alias(name)

    return joined.select(
        *work.columns,
        F.when(~finished, "todo").when(known, "carried").otherwise("rebuilt").alias("state"),
        carried("decoded_frames", F.col("frames")),
        carried("landmark_frames", F.col("frames")),
        carried("dropped_frames", F.lit(0).cast("long")),
    )


def work_left(work: DataFrame, outputs: DataFrame, key: str = "sample_id") -> DataFrame:
    return work.join(outputs.filter("frames > 0"), key, "left_anti")


def reusable(
    requests: DataFrame, cache: DataFrame, on: Sequence[str], *, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests against an earlier evaluation; ``force`` redoes everything."""
    if force:
        return requests.filter(F.lit(False)), requests
    return requests.join(cache, list(on), "left_semi"), requests.join(cache, list(on), "left_anti")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, labelled by side."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return (
        l.join(r, key, "left_anti").withColumn("side", F.lit("left"))
        .unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))
    )


def split_documents(assigned: DataFrame, split: str = "split") -> DataFrame:
    """The split as JSON lines, one per speaker with its sample count; grows with the speakers only."""
    return assigned.groupBy(split, "speaker_id").agg(F.count("*").alias("samples")).select(
        split, F.to_json(F.struct(split, "speaker_id", "samples")).alias("document")
    )
