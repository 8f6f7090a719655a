"""Rows without ids, repeated ids, hot texts and tables of many parts."""

import hashlib
import random
import re
import struct

import xxhash

import corpus_pipeline
from speechtab.llm import embedding_dedup, fingerprint, neighbours, sharding, simhash


def test_vectors_without_or_with_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [1.0, 0.01, 0.0, 0.1]
    rows = [(None, a, "x"), (None, b, "x"), (7, b, "x"), (7, [0.0, 1.0, 0.0, 0.0], "x"), (None, [0.0, 0.0, 1.0, 0.0], "x"),
            (None, None, "x"), (7, b, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class_id string")
    got = sorted(map(str, map(tuple, embedding_dedup.link_vectors(frame).collect())))
    assert got == sorted(map(str, [
        (None, 3, 7, False), (None, 3, 7, False), (7, 3, 7, True), (7, 3, 7, True), (7, 0, 7, True), (None, 0, None, True),
        (None, 0, None, True),
    ]))


def test_documents_without_ids_link(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(None, base), (None, base + " more"), (None, "alone in the world"), (4, "some other text here"), (4, None), (9, "")]
    got = simhash.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert sorted(r["component_id"] for r in got if r["doc_id"] is not None) == [4, 4, 4]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] * 3
    near = [(None, base), (12, base + " more"), (3, base)]
    got = simhash.link_documents(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {3}


def test_next_rows_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RANGES", 4)
    monkeypatch.setattr(neighbours, "PART_ROWS", 5)
    draw = random.Random(1)
    for ids in ([draw.randrange(10 ** 6) for _ in range(400)], [5] * 60, list(range(300)), [3]):
        ids = sorted(set(ids)) if len(set(ids)) > 1 else ids
        rows = [(d, f"t{i:04d}") for i, d in enumerate(ids)]
        found = neighbours.with_next(spark.createDataFrame(rows, "d long, t string").repartition(3), "d", "t").collect()
        assert sorted((r["d"], r["t"], r["next_t"]) for r in found) == [
            (*row, rows[(i + 1) % len(rows)][1]) for i, row in enumerate(rows)
        ]


def test_next_rows_without_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 2)
    rows = [(None, f"n{i}") for i in range(9)] + [(i, f"t{i}") for i in range(5)]
    found = neighbours.with_next(spark.createDataFrame(rows, "d long, t string"), "d", "t").collect()
    following = {r["t"]: r["next_t"] for r in found}
    assert sorted(following.values()) == sorted(t for _, t in rows)
    walked, at = [], "t0"
    for _ in rows:
        walked.append(at)
        at = following[at]
    assert at == "t0" and walked[:5] == [f"t{i}" for i in range(5)]


def sharded_sizes(spark, texts, shards=10):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = sharding.shard_documents(frame, shards).collect()
    by_text = {}
    for r in placed:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    sizes = [0] * shards
    for r in placed:
        sizes[r["shard"]] += r["size"]
        assert 0 <= r["shard"] < shards
    return sizes, placed


def test_a_hot_text_leaves_the_other_shards_even(spark):
    others = [f"{i} " * 8 for i in range(10_000, 13_000)]
    sizes, placed = sharded_sizes(spark, others + ["hot text, again and again, of many words"] * 1800, 40)
    hot = max(sizes)
    assert hot == 1800 * (40 + 16)
    rest = sorted(sizes)[:-1]
    assert rest[-1] <= 1.1 * rest[0]
    for shard in range(40):
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_more_hot_texts_than_room_between_them(spark):
    sizes, _ = sharded_sizes(spark, ["a" * 100] * 50 + ["b" * 100] * 50 + ["c" * 100] * 50 + ["d", "e", "f"], 4)
    assert sum(sizes) == 150 * 116 + 3 * 17 and max(sizes) < 51 * 116
    assert sharded_sizes(spark, ["same"] * 20, 3)[0].count(0) == 2
    assert sharded_sizes(spark, [], 3)[0] == [0, 0, 0]


def test_one_of_each_repeated_row_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text), (None, "no id"), (3, "another text"), (3, "quite some more words of another kind")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], *rows[3:]]))


def brute_lanes(text):
    parts = re.split(r"\n|(?<=[.!?,;|])(?= )", text)
    totals, lanes = [0, 0], [0] * (fingerprint.LEVELS * fingerprint.WIDTH)
    for part in parts:
        first = xxhash.xxh64_intdigest(part.encode(), 42)
        other = xxhash.xxh64_intdigest(struct.pack("<i", 1), first)
        low = first & (1 << fingerprint.LEVELS - 1) - 1 | 1 << fingerprint.LEVELS - 1
        level = (low & -low).bit_length() - 1
        totals[0] += other
        totals[1] += other >> 32
        lanes[level * fingerprint.WIDTH + (other >> 8 & 0xFFFFFF) % fingerprint.WIDTH] += first >> 32
    return [x % 2 ** 32 for x in totals + lanes]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    dense = [0, 0]
    sparse = [0, 0]
    for level in range(fingerprint.LEVELS):
        at = slice(2 + level * fingerprint.WIDTH, 2 + (level + 1) * fingerprint.WIDTH)
        pairs = [(x, y) for x, y in zip(a[at], b[at]) if x or y]
        same = sum(x == y for x, y in pairs)
        for sums in ([dense, sparse] if len(pairs) <= fingerprint.WIDTH * 2 // 3 else [dense]):
            sums[0] += same
            sums[1] += len(pairs)
    same, used = sparse if sparse[1] else dense
    return 2 * same / (same + used) if used else 0.0


def test_fingerprints_equal_brute_force(spark):
    draw = random.Random(4)
    sentence = lambda: " ".join(draw.choice(["der", "wort", "été", "🙂", "x"]) for _ in range(draw.randrange(1, 9))) + draw.choice(".,!|\n")
    texts = [None, "", "one"] + [" ".join(sentence() for _ in range(draw.randrange(1, 80))) for _ in range(25)]
    texts += [texts[5], texts[6] + " and more."]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    own = [brute_lanes(t or "") for t in texts]
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        changed = brute_lanes(edited)
        assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in own[i])
        assert got[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in changed)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - brute_likeness(own[i], changed)) < 1e-12
        assert abs(got[i]["near_next"] - brute_likeness(own[i], own[(i + 1) % len(own)])) < 1e-12
