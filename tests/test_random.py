"""Two independent forms of the same operator on random input."""

import itertools
import math
import random
import statistics

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab import skew
from speechtab.functions import beam, distance
from speechtab.operators import batching, boxes, ctc, history, keypoints, metrics, ngram


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_distances(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("aćb") for _ in range(draw.randrange(1, 3)))
    phrase = lambda n: [word() for _ in range(draw.randrange(0, n))]
    pairs = [(phrase(12), phrase(12)) for _ in range(150)] + [(phrase(400), phrase(400)) for _ in range(6)]
    rows = spark.createDataFrame(
        [(i, a, b, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)],
        "i int, a array<string>, b array<string>, s string, t string")
    got = rows.select(
        "i", metrics.word_distance(F.col("a"), F.col("b")).alias("w"),
        metrics.char_distance(F.col("s"), F.col("t")).alias("c")).collect()
    for r in got:
        a, b = pairs[r["i"]]
        assert r["w"] == table_distance(a, b)
        assert r["c"] == table_distance(" ".join(a), " ".join(b))


def test_distances_over_blocks(monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 7)
    draw = random.Random(8)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(40))] for _ in range(2))
        assert distance.edit_distance(a, b) == table_distance(a, b)


def test_distances_of_a_batch(monkeypatch):
    """Pairs of one batch advance together, whatever their lengths; equal, empty, null and long ones are among them."""
    monkeypatch.setattr(distance, "LONG", 150)
    monkeypatch.setattr(distance, "LANES", 40)
    draw = random.Random(9)
    for letters in ("ab ", "a b\t", "".join(map(chr, range(0x4e00, 0x4f90))), "aé😀 \u3000"):
        text = lambda: draw.choice([None, "", "".join(draw.choice(letters) for _ in range(draw.choice((1, 7, 64, 65, 129, 170))))])
        pairs = [(a, b if draw.randrange(9) else a) for a, b in ((text(), text()) for _ in range(60))]
        found = zip(*(c.to_pylist() for c in distance.pair_distances(
            pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()))))
        for (a, b), got in zip(pairs, found):
            words = (len(b.split(" ")), len(b.split())) if b is not None else (None, None)
            errors = [None] * 3 if a is None or b is None else [
                table_distance(a.split(" "), b.split(" ")), table_distance(a.split(), b.split()), table_distance(a, b)]
            assert got == (errors[0], words[0], errors[1], words[1], errors[2])


def test_distances_of_nulls(spark):
    rows = spark.createDataFrame([(None, "a b"), ("a", None), (None, None)], "prediction string, reference string")
    scored = metrics.score_pairs(rows).collect()
    assert [(r["word_errors_macro"], r["char_errors"], r["words_micro"]) for r in scored] == [
        (None, None, 2), (None, None, None), (None, None, None)]


def test_collapse_forms_agree(spark):
    draw = random.Random(3)
    clips = [(i, [draw.choice((0, 0, 1, 1, 2, 3)) for _ in range(draw.randrange(1, 30))]) for i in range(80)]
    arrays = spark.createDataFrame(clips, "k int, ids array<int>")
    steps = arrays.select("k", F.posexplode("ids").alias("t", "token"))
    a = {r[0]: r[1] for r in arrays.select("k", ctc.collapse_ids(F.col("ids"))).collect()}
    for size in (1, 4, 1000):
        b = {r[0]: r[1] for r in ctc.collapse_steps(steps, "k", chunk_size=size).collect()}
        assert a == b


def test_running_equals_plain_loop(spark):
    draw = random.Random(4)
    rows = [(draw.choice("xxxy"), i, draw.choice([None, draw.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    value = F.col("v")
    out = skew.running(df, ["k"], ["o"], F.floor(F.col("o") / 7), {
        "low": ("min", value), "high": ("max", value), "total": ("sum", F.lit(1)),
        "latest": ("last", value)}, exclusive=True)
    got = {r["o"]: r for r in out.collect()}
    assert len(got) == 200
    for k, o, _ in rows:
        past = [v for kk, oo, v in rows if kk == k and oo < o]
        known = [v for v in past if v is not None]
        r = got[o]
        assert r["low"] == (min(known) if known else None)
        assert r["high"] == (max(known) if known else None)
        assert r["total"] == len(past)
        assert r["latest"] == (known[-1] if known else None)


def test_medians(spark):
    draw = random.Random(5)
    value = lambda: draw.choice([draw.random(), 0.5, -draw.random() * 1e6, draw.random() * 1e-300, 0.0, -0.0, None])
    rows = [(draw.choice(["a", "a", "a", "b", None]), value(), value()) for _ in range(700)] + [
        ("c", 1.0, None), ("d", 2.0, 1.0), ("d", 4.0, 3.0), ("e", None, None), ("f", math.inf, -math.inf), ("f", 1.0, -math.inf),
        ("g", math.nan, 1.0), ("g", math.nan, math.inf), ("g", 7.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)

    def middle(values):
        values = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        if not values:
            return None
        a, b = values[(len(values) - 1) // 2], values[len(values) // 2]
        return a if a == b or math.isnan(a) else (a + b) / 2

    same = lambda x, y: x == y or (x is not None and y is not None and (x == pytest.approx(y, rel=1e-12, nan_ok=True)))
    got = skew.exact_median(df, ["k"], ["v", "w"]).collect()
    assert len(got) == 8
    for r in got:
        assert same(r["v"], middle(v for k, v, _ in rows if k == r["k"])), r
        assert same(r["w"], middle(w for k, _, w in rows if k == r["k"])), r
    overall = skew.exact_median(df, [], ["v"]).collect()
    assert len(overall) == 1 and same(overall[0]["v"], middle(v for _, v, _ in rows))
    assert skew.exact_median(df.limit(0), ["k"], ["v"]).collect() == []


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    for r in batching.assign_blocks(df, "id", 64).collect():
        assert r["position"] == r["id"] + 1 and r["block_id"] == r["id"] // 64
    named = df.select(F.format_string("clip_with_a_long_name_%04d", "id").alias("id"))
    for r in batching.assign_blocks(named, "id", 64).collect():
        assert r["position"] == int(r["id"][-4:]) + 1
    for frame in (df, named):
        batches = batching.epoch_batches(frame, "id", [0, 1], size=3, shuffled=False)
        assert all(r["position"] == int(str(r["id"])[-4:]) + 1 for r in batches.collect())
    batches = batching.epoch_batches(df, "id", [0, 1], size=3)
    sizes = [r["count"] for r in batches.groupBy("epoch", "batch_id").count().collect()]
    assert sorted(sizes) == [1, 1] + [3] * 666
    orders = batches.orderBy("epoch", "position").collect()
    assert [r["id"] for r in orders[:1000]] != [r["id"] for r in orders[1000:]]


def svd_fit(source, target):
    cs, ct = source.mean(0), target.mean(0)
    s, t = source - cs, target - ct
    ks, kt = s.std(), t.std()
    u, _, v = np.linalg.svd((s / ks).T @ (t / kt))
    m = kt / ks * (u @ v).T
    return np.column_stack((m, ct - m @ cs))


def test_similarity_equals_svd(spark):
    draw = np.random.default_rng(6)
    clouds = [(draw.normal(size=(9, 2)), draw.normal(size=(9, 2))) for _ in range(40)]
    rows = [(i, *map(float, (*p, *q))) for i, (a, b) in enumerate(clouds) for p, q in zip(a, b)]
    rows += [(99, 1.0, 1.0, float(i), 2.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, x double, y double, u double, v double")
    for r in keypoints.fit_similarity(df, ["k"]).collect():
        if r["k"] == 99:
            assert r["m00"] is None
            continue
        want = svd_fit(*clouds[r["k"]])
        got = [[r["m00"], r["m01"], r["tx"]], [r["m10"], r["m11"], r["ty"]]]
        assert np.allclose(got, want, atol=1e-9)


def test_gap_filling_equals_interp(spark):
    draw = random.Random(7)
    rows = [(c, f, None if draw.random() < 0.6 else draw.random()) for c in range(6) for f in range(40)]
    rows += [(50, f, None) for f in range(3)]
    df = spark.createDataFrame(rows, "clip int, frame int, x double")
    got = {(r["clip"], r["frame"]): r["x_filled"]
           for r in keypoints.fill_gaps(df, ["clip"], "frame", ["x"], chunk_size=8).collect()}
    for c in range(6):
        known = [(f, x) for cc, f, x in rows if cc == c and x is not None]
        want = np.interp(range(40), [f for f, _ in known], [x for _, x in known])
        assert np.allclose([got[c, f] for f in range(40)], want)
    assert got[50, 1] is None


def stop_loop(rates, warmup, patience):
    best, waited, ran = math.inf, 0, []
    for epoch, rate in enumerate(rates):
        better = rate < best
        best = min(best, rate)
        waited = 0 if better or epoch < warmup else waited + 1
        ran.append((epoch, better, waited))
        if epoch >= warmup and waited >= patience:
            break
    return ran


def test_early_stopping_equals_loop(spark):
    draw = random.Random(8)
    runs = {i: [draw.choice([draw.random(), 0.5]) for _ in range(25)] for i in range(30)}
    df = spark.createDataFrame(
        [(i, e, w) for i, rates in runs.items() for e, w in enumerate(rates)],
        "run_id int, epoch int, wer double")
    for warmup, patience in ((3, 5), (0, 2)):
        tracked = history.until_stop(
            history.track(df, patience=patience, warmup=warmup, chunk_size=4))
        got = {}
        for r in tracked.orderBy("run_id", "epoch").collect():
            got.setdefault(r["run_id"], []).append(
                (r["epoch"], r["improved"], r["without_improvement"]))
        assert got == {i: stop_loop(rates, warmup, patience) for i, rates in runs.items()}


def test_box_stays_inside(spark):
    df = spark.createDataFrame([(0.0, 0.02, 0.95, 0.99), (0.4, 0.6, 0.4, 0.5)],
                               "a double, b double, c double, d double")
    for r in df.select(boxes.box_from_extent(*map(F.col, "abcd")).alias("b")).collect():
        b = r["b"]
        assert b["x1"] >= 0 and b["y2"] <= 1 + 1e-12
        assert (b["x2"] - b["x1"]) == pytest.approx(2 * (b["y2"] - b["y1"]))


SENTENCES = ["ab ba", "abba", "b a b", "aab", "ba ab ba"]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(s,) for s in SENTENCES], "s string")
    return ngram.estimate(ngram.count_ngrams(rows, "s", 3), 3).cache()


def test_model_sums_to_one(spark, model):
    words = ["a", "b", "<sp>", "</s>", "zzz"]
    contexts = ["", "<s> ", "a ", "<s> a ", "b a ", "zzz a ", "<sp> b "]
    windows = spark.createDataFrame([(c + w,) for c in contexts for w in words], "w string")
    sums = dict.fromkeys(contexts, 0.0)
    for r in ngram.score_windows(windows, model).collect():
        sums[r["w"].rpartition(" ")[0] + (" " if " " in r["w"] else "")] += 10 ** r["log10_prob"]
    assert sums == pytest.approx(dict.fromkeys(contexts, 1.0))


def brute_force(log_probs, letters):
    """Probability of every text: all paths, collapsed."""
    totals = {}
    for path in itertools.product(range(log_probs.shape[1]), repeat=len(log_probs)):
        out = "".join(letters[c - 1] for c, _ in itertools.groupby(path) if c)
        score = sum(log_probs[t, c] for t, c in enumerate(path))
        totals[out] = np.logaddexp(totals.get(out, -np.inf), score)
    return totals


def test_beam_is_exact_when_wide(spark):
    draw = np.random.default_rng(9)
    letters, clips = " ab", [draw.normal(size=(4, 4)) for _ in range(4)]
    logits = spark.createDataFrame(
        [(i, 4, c.tolist()) for i, c in enumerate(clips)],
        "sample_id int, length int, steps array<array<float>>")
    found = {}
    for r in beam.beam_decode(logits, None, width=10_000, letters=letters).collect():
        key = (r["sample_id"], r["text"])
        found[key] = np.logaddexp(found.get(key, -np.inf), r["am_score"])
    for i, c in enumerate(clips):
        lp = c.astype(np.float32).astype(float)
        lp = lp - np.log(np.exp(lp).sum(1, keepdims=True))
        want = {}
        for out, score in brute_force(lp, letters).items():
            out = " ".join(out.split())
            want[i, out] = np.logaddexp(want.get((i, out), -np.inf), score)
        assert {k: v for k, v in found.items() if k[0] == i} == pytest.approx(want, abs=1e-6)


def test_beam_forms_agree(spark, model):
    draw = np.random.default_rng(10)
    logits = spark.createDataFrame(
        [(i, 2 + i, draw.normal(size=(4, 4)).tolist()) for i in range(3)],
        "sample_id int, length int, steps array<array<float>>")
    options = dict(width=6, alpha=0.7, beta=0.3, letters=" ab", order=3)
    row = lambda r: (r["sample_id"], r["text"], r["word_count"], round(r["am_score"], 6),
                     round(r["lm_score"], 6))
    near = sorted(map(row, beam.beam_decode(logits, model, **options).collect()))
    far = sorted(map(row, beam.beam_decode_by_joins(logits, model, **options).collect()))
    assert near == far and len(near) == 18
    assert len({r[0] for r in near}) == 3 and K.LM_ORDER == 5


def test_too_large_alphabets_are_refused(spark, model, monkeypatch):
    monkeypatch.setattr(beam, "TABLE_CELLS", 10)
    with pytest.raises(ValueError, match="by_joins"):
        beam.cost_table(model, " ab", 3)


def test_beam_keeps_the_best_of_a_narrow_width():
    draw = np.random.default_rng(12)
    for _ in range(20):
        lp = np.log(draw.dirichlet(np.ones(4), size=5))
        wide = beam._search(lp, " ab", None, 3, 10_000, 0.5, 0.3)
        assert len({p for p, _, _ in wide}) == len(wide)
        narrow = beam._search(lp, " ab", None, 3, 12, 0.5, 0.3)
        every = {p: a for p, a, _ in wide}
        assert len(narrow) == 12 and all(a <= every[p] + 1e-9 for p, a, _ in narrow)


def test_beam_query_has_the_reference_width_and_order(spark, monkeypatch):
    from speechtab.plans import catalog

    seen = {}
    monkeypatch.setattr(catalog, "dialogue_model", lambda spark, root, order=K.LM_ORDER: seen.update(model=order))
    monkeypatch.setattr(catalog.B, "logits", lambda spark, root: None)
    monkeypatch.setattr(catalog.beam, "beam_decode", lambda logits, model, **options: seen.update(options))
    monkeypatch.setattr(catalog, "rounded", lambda df: df)
    catalog.QUERIES["beam_candidates"](spark, "")
    assert (seen["width"], seen["order"], seen["model"]) == (100, 5, 5)


def test_clips_share_frames_of_candidates(monkeypatch):
    draw = np.random.default_rng(4)
    rows = pd.DataFrame({
        "sample_id": range(50), "length": [5] * 49 + [0], "steps": [list(draw.normal(size=(5, 4))) for _ in range(50)]})
    search = lambda scores: beam._search(scores, " ab", None, 3, 10, 0.5, 0.3)
    (whole,) = beam._candidates(iter([rows[:20], rows[20:]]), "sample_id", search)
    alone = [f for i in range(50) for f in beam._candidates(iter([rows[i:i + 1]]), "sample_id", search)]
    assert len(alone) == 50 and set(whole["sample_id"]) == set(range(50))
    pd.testing.assert_frame_equal(whole, pd.concat(alone, ignore_index=True))
    monkeypatch.setattr(beam, "FRAME_ROWS", 100)
    frames = list(beam._candidates(iter([rows]), "sample_id", search))
    assert max(map(len, frames)) < 110
    pd.testing.assert_frame_equal(whole, pd.concat(frames, ignore_index=True))


def test_beam_of_100_with_order_5_is_exact_on_short_clips():
    draw = np.random.default_rng(11)
    tokens = ["<s>", "a", "b", K.LM_SPACE, "</s>"]
    table = {K.LM_UNKNOWN: (-3.0, None)}
    for n in range(1, 6):
        for gram in itertools.product(tokens, repeat=n):
            if n == 1 or draw.random() < 0.4:
                table[" ".join(gram)] = (-draw.random(), -draw.random())

    def log10(context, token):
        hit = table.get(" ".join([*context, token]))
        if hit or not context:
            return hit[0] if hit else table[K.LM_UNKNOWN][0]
        return (table.get(" ".join(context)) or (0, 0.0))[1] + log10(context[1:], token)

    spelled = [" " if t == K.LM_SPACE else t for t in (K.LM_SPACE, "a", "b", "</s>")]
    assert spelled[:3] == list(" ab")
    costs = np.array([
        [log10([*["<s>"] * (n < 4), *(K.LM_SPACE if c == " " else c for c in context)], K.LM_SPACE if t == " " else t) for t in spelled]
        for n in range(5) for context in itertools.product(" ab", repeat=n)
    ]) * np.log(10)
    for _ in range(4):
        lp = draw.normal(size=(3, 4))
        lp = lp - np.log(np.exp(lp).sum(1, keepdims=True))
        want = {}
        for out, score in brute_force(lp, " ab").items():
            line = ["<s>", *[K.LM_SPACE if c == " " else c for c in out], "</s>"]
            lm = sum(log10(line[max(0, i - 4):i], line[i]) for i in range(1, len(line)))
            want[out] = (score, lm * np.log(10))
        found = {p: (a, m) for p, a, m in beam._search(lp, " ab", costs, 5, 100, 0.5, 0.5)}
        assert found.keys() == want.keys()
        assert all(found[p] == pytest.approx(want[p]) for p in want)
