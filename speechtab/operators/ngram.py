"""Character n-gram language models: counting, interpolated Kneser-Ney, scoring.

N-grams are strings of tokens joined with one space, ``<s> a <sp> b``. Tokens are single
characters (the space spelled out), so the form is unambiguous.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab import session
from speechtab.operators import text


def sentence_tokens(sentence: Column) -> Column:
    """Language-model tokens between start and end of sentence."""
    return F.concat(
        F.array(F.lit(K.LM_START)), text.language_model_tokens(sentence), F.array(F.lit(K.LM_END))
    )


def _windows(tokens: Column, order: int) -> Column:
    """For every position the window that starts there, up to ``order`` tokens, as a string."""
    return F.transform(tokens, lambda t, i: F.concat_ws(
        " ", t, *[F.get(tokens, i + k) for k in range(1, order)]
    ))


def count_ngrams(sentences: DataFrame, sentence: str, order: int = K.LM_ORDER) -> DataFrame:
    """(order, ngram, count) for orders 1..``order``.

    Only one window per character is exploded and pre-aggregated; the lower orders are prefixes of
    the distinct windows, so they are derived after the heavy aggregation.
    """
    spelled = sentences.select(sentence_tokens(F.col(sentence)).alias("tokens"))
    windows = (
        spelled.select(F.explode(_windows(F.col("tokens"), order)).alias("w"))
        .groupBy("w")
        .agg(F.count("*").alias("n"))
    )
    parts = F.split(F.col("w"), " ")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("p")),
        lambda k: F.struct(
            k.cast("int").alias("order"), F.array_join(F.slice(F.col("p"), F.lit(1), k), " ").alias("ngram")
        ),
    )
    return (
        windows.select(parts.alias("p"), "n")
        .select("n", F.explode(prefixes).alias("g"))
        .groupBy(F.col("g.order").alias("order"), F.col("g.ngram").alias("ngram"))
        .agg(F.sum("n").alias("count"))
    )


def _context(ngram: Column) -> Column:
    """All tokens but the last; empty for one token."""
    return F.regexp_replace(ngram, r" ?[^ ]+$", "")


def _suffix(ngram: Column) -> Column:
    """All tokens but the first; empty for one token."""
    return F.regexp_replace(ngram, r"^[^ ]+ ?", "")


def adjusted_counts(counts: DataFrame, order: int = K.LM_ORDER) -> DataFrame:
    """Counts used for smoothing, with the context of each n-gram.

    The highest order and n-grams at the start of a sentence keep raw counts, the others count
    their distinct left neighbours; the start token itself has no probability.
    """
    begins = F.startswith(F.col("ngram"), F.lit(K.LM_START))
    raw = counts.filter((F.col("order") == order) | (begins & (F.col("order") > 1)))
    left = (
        counts.filter("order > 1")
        .groupBy((F.col("order") - 1).alias("order"), _suffix(F.col("ngram")).alias("ngram"))
        .agg(F.count("*").alias("count"))
        .filter(F.col("order") < order)
    )
    return raw.select("order", "ngram", "count").unionByName(left).withColumn(
        "context", _context(F.col("ngram"))
    )


def discounts(adjusted: DataFrame) -> DataFrame:
    """(order, d1, d2, d3) from counts of counts, with fixed ones where the estimate fails."""
    tallies = adjusted.groupBy("order").agg(
        *[F.count_if(F.col("count") == k).cast("double").alias(f"n{k}") for k in range(1, 5)]
    )
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    raw = [
        k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)
    ]
    ok = F.lit(True)
    for k, d in enumerate(raw, 1):
        ok = ok & F.coalesce((d >= 0) & (d <= k), F.lit(False))
    fallback = (0.5, 1.0, 1.5)
    return tallies.select(
        "order", *[F.when(ok, d).otherwise(F.lit(f)).alias(f"d{i}")
                   for i, (d, f) in enumerate(zip(raw, fallback), 1)]
    )


def _by_order(column: str, values: dict[int, float]) -> Column:
    """The value of the row's order, as a literal."""
    found = F.lit(None).cast("double")
    for order, value in values.items():
        found = F.when(F.col(column) == order, F.lit(value)).otherwise(found)
    return found


def estimate(counts: DataFrame, order: int = K.LM_ORDER) -> DataFrame:
    """Interpolated modified Kneser-Ney model: (order, ngram, log10_prob, log10_backoff).

    Discounts are a few numbers for each order and become literals. What a context owns is summed over its own
    rows. Probabilities are built one order after the other, each from the written one below: an n-gram's suffix
    has at most as many longer n-grams as there are tokens, so no key of these joins is hot.
    """
    adjusted = session.cut_lineage(adjusted_counts(counts, order))
    c = F.col("count")
    found = {r["order"]: r for r in discounts(adjusted).collect()}  # a row for each order
    d1, d2, d3 = (_by_order("order", {n: r[f"d{k}"] for n, r in found.items()}) for k in (1, 2, 3))
    discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
    inside = Window.partitionBy("order", "context")
    shares = session.cut_lineage(adjusted.withColumn("discount", discount).select(
        "order", "ngram", "context",
        (F.greatest(c - F.col("discount"), F.lit(0.0)) / F.sum(c).over(inside)).alias("share"),
        (F.sum(F.least(F.col("discount"), c.cast("double"))).over(inside) / F.sum(c).over(inside)).alias("gamma"),
    ))
    # The unknown token counts as one more word.
    uniform = 1.0 / (shares.filter("order = 1").agg(F.count("*").alias("n")).scalar() + 1)
    of_order = lambda n: shares.filter(F.col("order") == n)
    below = session.cut_lineage(of_order(1).withColumn("uniform", uniform).select(
        "order", "ngram", (F.col("share") + F.col("gamma") * F.col("uniform")).alias("prob")
    ))
    probabilities = [below]
    for n in range(2, order + 1):
        shorter = below.select(F.col("ngram").alias("suffix"), F.col("prob").alias("below"))
        below = session.cut_lineage(of_order(n).withColumn("suffix", _suffix(F.col("ngram"))).join(shorter, "suffix").select(
            "order", "ngram", (F.col("share") + F.col("gamma") * F.col("below")).alias("prob")
        ))
        probabilities.append(below)
    contexts = shares.groupBy("order", "context").agg(F.max("gamma").alias("gamma"))
    unknown = contexts.filter("order = 1").withColumn("uniform", uniform).select(
        "order", F.lit(K.LM_UNKNOWN).alias("ngram"), (F.col("gamma") * F.col("uniform")).alias("prob")
    )
    # The context of order n+1 is an n-gram; the start token enters the model only as a context.
    backoff = contexts.filter("order > 1").select(
        (F.col("order") - 1).alias("order"), F.col("context").alias("ngram"),
        F.log10("gamma").alias("log10_backoff"),
    )
    known = reduce(DataFrame.unionByName, [*probabilities, unknown])
    return known.join(backoff, ["ngram", "order"], "full_outer").select(
        "order", "ngram", F.log10("prob").alias("log10_prob"), "log10_backoff"
    )


def store_model(model: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Write a model in buckets by n-gram, so that joins with it leave it where it is."""
    spark = model.sparkSession
    name = f"ngrams_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The rows of a bucket come from one task, so each bucket is one sorted file.
    model.repartition(buckets, "ngram").write.bucketBy(buckets, "ngram").sortBy("ngram").option("path", path).saveAsTable(name)
    return spark.table(name)


def score_sentences(
    sentences: DataFrame, key: Sequence[str], sentence: str, model: DataFrame,
    order: int = K.LM_ORDER,
) -> DataFrame:
    """log10 and natural-log probability of every sentence, start and end tokens included.

    Each distinct window is scored once: longest known n-gram plus the back-off weights of the
    longer contexts. Unknown characters take the unknown-token probability.
    """
    tokens = sentence_tokens(F.col(sentence))
    # The window that ends at a position, with at most order-1 tokens before it.
    ending = F.transform(
        F.sequence(F.lit(2), F.size("tokens")),
        lambda i: F.array_join(F.slice(
            F.col("tokens"), F.greatest(i - (order - 1), F.lit(1)),
            i - F.greatest(i - (order - 1), F.lit(1)) + 1,
        ), " "),
    )
    windows = (
        sentences.select(*key, tokens.alias("tokens"))
        .select(*key, F.explode(ending).alias("w"))
        .groupBy(*key, "w")
        .agg(F.count("*").alias("n"))
    )
    scored = score_windows(windows.select("w").distinct(), model)
    return (
        windows.join(scored, "w")
        .groupBy(*key)
        .agg(F.sum(F.col("n") * F.col("log10_prob")).alias("log10_prob"),
             F.sum("n").alias("tokens"))
        .withColumn("ln_prob", F.col("log10_prob") * F.ln(F.lit(10.0)))
    )


def score_windows(windows: DataFrame, model: DataFrame) -> DataFrame:
    """log10 probability of the last token of each window given the tokens before it.

    Each ending of a window looks for its probability, and each but the last token alone for the back-off of its
    context; both are one join with the model on the n-gram, which a stored model answers in place.
    """
    parts = F.split("w", " ")
    unknown = (
        model.filter((F.col("order") == 1) & (F.col("ngram") == K.LM_UNKNOWN))
        .agg(F.max("log10_prob")).scalar()
    )
    # (k, false, ending of k tokens) and, for k > 1, (k, true, the same without its last token).
    ending = lambda k, n: F.array_join(F.slice("p", F.size("p") - k + 1, n), " ")
    asked = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size("p")),
        lambda k: F.filter(
            F.array(
                F.struct(k.alias("k"), F.lit(False).alias("is_context"), ending(k, k).alias("ngram")),
                F.struct(k.alias("k"), F.lit(True).alias("is_context"), ending(k, k - 1).alias("ngram")),
            ),
            lambda a: ~a["is_context"] | (a["k"] > 1),
        ),
    ))
    pieces = windows.select("w", parts.alias("p")).select("w", F.explode(asked).alias("a")).select("w", "a.*")
    # Equal n-grams of many windows are looked up once.
    looked_up = pieces.select("ngram").distinct().join(model.select("ngram", "log10_prob", "log10_backoff"), "ngram")
    found = pieces.join(looked_up, "ngram", "left")
    hit = ~F.col("is_context") & F.col("log10_prob").isNotNull()
    gathered = found.groupBy("w").agg(
        F.max(F.when(hit, F.struct("k", "log10_prob"))).alias("hit"),
        F.collect_list(F.when(
            F.col("is_context"), F.struct("k", F.coalesce("log10_backoff", F.lit(0.0)).alias("b"))
        )).alias("bs"),
    )
    longest = F.coalesce(F.col("hit.k"), F.lit(1))
    penalty = F.aggregate(
        F.array_sort(F.filter("bs", lambda s: s["k"] > longest)), F.lit(0.0),
        lambda acc, s: acc + s["b"],
    )
    return gathered.select(
        "w", (F.coalesce(F.col("hit.log10_prob"), unknown) + penalty).alias("log10_prob")
    )
