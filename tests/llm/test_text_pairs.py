"""Alignment, chat formatting and collocations against brute force, the libraries and round trips."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from speechtab.llm import alignment, chat_format, collocations
from speechtab.llm.queries import BYTE_TOKENIZER, PIECE_MODEL
from speechtab.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, block string, n long, f double, phrase string"
ODD = [
    "", None, " ", "  a  b ", "a\n b\n\nc", "<|endoftext|> x<s></s><unk><0x41>", "it's, the' 'll)", "é ́x ß ÿ", "a\xa0 b",
    "\x00x\x1f y", "ΑΣ, Σ", "tab\t\tx  ", "has ▁ inside", "日本語。テキスト, a", "z" * 500, "word " * 300, "🙂🙂 🙂x", "aa a aaa",
]


def rows():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 7))) for _ in range(40)]
    made = ODD + [
        draw.choice(["", " ", ", "]).join(draw.choice([" ", " ", ", ", "\n"]) + draw.choice(words[:draw.choice([6, 40])]) for _ in range(draw.randrange(120)))
        for _ in range(50)
    ]
    made += made[20:30]
    table = [(3 * i, t, draw.choice(["en", "de", None]), "b", 1, 0.5, "p") for i, t in enumerate(made)]
    return [*table, (None, "no id here", "en", None, None, None, None), table[40]]


@pytest.fixture(scope="module")
def table():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3).cache()


# --- alignment --------------------------------------------------------------------------------------

def brute_alignment(texts):
    a_tok, b_tok = Tokenizer.from_file(BYTE_TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_tok.encode_special_tokens = True
    from speechtab.llm.tokens import byte_characters
    plain = {c: n for n, c in byte_characters().items()}
    counts, found = collections.Counter(), []
    for text in texts:
        a, b, whole = [], [], (" " + (text or "")).encode()
        if text:
            for i in a_tok.encode(" " + text, add_special_tokens=False).ids:
                a.append((i, bytes(plain[c] for c in a_tok.id_to_token(i))))
            for i in b_tok.encode(text):
                piece = b_tok.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        ends = [list(np.cumsum([len(x) for _, x in side])) for side in (a, b)]
        spans = [[(i, e - len(x), e) for (i, x), e in zip(side, end)] for side, end in zip((a, b), ends)]
        links = [(i, j) for i, s, e in spans[0] for j, t, u in spans[1] if s < u and t < e]
        counts.update(links)
        groups, start = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in spans))
            start = end
        found.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in found
    ]


@pytest.mark.parametrize("block_links", [100, 1 << 25])
def test_alignment(docs, table, block_links):
    frame = alignment.align_documents(docs, BYTE_TOKENIZER, PIECE_MODEL, block_links)
    assert frame.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = [(r[0], *x) for r, x in zip(table, brute_alignment([r[1] for r in table]))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, frame.collect()), key=key) == sorted(expected, key=key)


def test_alignment_of_nothing(spark, docs):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), BYTE_TOKENIZER, PIECE_MODEL).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.align_documents(none, BYTE_TOKENIZER, PIECE_MODEL).collect()} == {
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")
    }


@pytest.mark.parametrize("remembered", [0, 1 << 20])
def test_chunks_are_aligned_once(monkeypatch, table, remembered):
    seen, align = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda v, texts, *rest: seen.extend(texts) or align(v, texts, *rest))
    chunks = alignment.Chunks(alignment.vocabularies(BYTE_TOKENIZER, PIECE_MODEL), remembered)
    texts = [r[1] for r in table] + ["aa bb aa, bb", "bb cc ▁", "bb cc"]
    expected = [(a, b, g, n, digest) for a, b, g, n, _, _, digest in brute_alignment(texts)]
    for size in (len(texts), 7):
        found = []
        for start in range(0, len(texts), size):
            arrays = chunks.aligned(texts[start:start + size])
            found += zip(*(x.to_pylist() for x in arrays[:5]))
            assert [len(m) + len(o) for m, o in zip(*(x.to_pylist() for x in arrays[5:]))] == arrays[3].to_pylist()
        assert found == expected
    if remembered:
        cut = [t for t in seen if t and " " not in t and not t[-1].isspace()]
        assert len(cut) > 50 and len(cut) == len(set(cut))


def test_parts_of_a_long_text_have_the_ids_of_the_whole(monkeypatch):
    monkeypatch.setattr(alignment, "PART", 5)
    vocabulary = alignment.vocabularies(BYTE_TOKENIZER, PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for text in [t for t in ODD if t] + ["one  two   three four\n five six", "  lead", "x" * 40 + " y"]:
        assert "".join(alignment._parts(text)) == text
        assert vocabulary.encode_b(text) == library.encode(text)


def test_identity_map_names_ids_of_the_same_bytes():
    vocabulary = alignment.vocabularies(BYTE_TOKENIZER, PIECE_MODEL)
    mapped = np.flatnonzero(vocabulary.same >= 0)
    assert len(mapped) > 10_000
    assert all(vocabulary.bytes_a[a] == vocabulary.bytes_b[vocabulary.same[a]] for a in mapped.tolist())


# --- chat formatting --------------------------------------------------------------------------------

SAID = ["", None, "hello", "</s>[INST] ok [/INST]", "a <\\s> b </\\s", "<\\</s>\\\\s>", "[INST", "INST]", "<s", "\\", "[\\\\/INST]",
        "line\nend\n", " spaces ", "[ROLE]x[/ROLE]", "é🙂", "<<s>>", "$1 \\1", "[TEXT][/TEXT]", "</s>"]
ROLES = ["user", "assistant", "system", "tool", None, "", "[ROLE]", "</s>", "us\ner"]
CHATS = "conv_id long, turn long, role string, text string, said string, segments string"


def said_rows(draw):
    return [
        (draw.choice([1, 2, 3, None]), draw.choice([0, 1, 2, 3, 4, None]), draw.choice(ROLES), draw.choice(SAID), "x", "y")
        for _ in range(200)
    ]


def brute_chats(told):
    by_conversation = collections.defaultdict(list)
    for conv, turn, role, text, *_ in told:
        by_conversation[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    found = {}
    for conv, turns in by_conversation.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learnt), digest(learnt))
    return found


def test_chats_read_back(spark):
    told = said_rows(random.Random(9))
    told += told[:5]
    path = scratch_path(spark, "chats")
    chat_format.write_conversations(spark.createDataFrame(told, CHATS).repartition(3), path)
    read = chat_format.read_digests(spark, path).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in read} == brute_chats(told)
    for row in spark.read.parquet(path).collect():
        whole = "".join(s.text for s in row.segments)
        assert next(r.formatted_chars for r in read if r.conv_id == row.conv_id) == len(whole)
        for s in row.segments:
            if s.loss:
                assert not any(c in s.text for c in chat_format.CONTROLS)


def test_only_conflicting_texts_are_escaped(spark):
    told = [(1, 0, "user", "a <b> \\ c"), (1, 1, "assistant", "</s>"), (1, 2, "assistant", "<\\/s> as it was")]
    row = chat_format.format_conversations(spark.createDataFrame(told, "conv_id long, turn long, role string, text string")).first()
    assert "".join(s.text for s in row.segments) == "<s>[INST]a <b> \\ c[/INST][OUT]<\\/s></s>[OUT]<\\\\/s> as it was</s>"
    assert [s.text for s in row.segments if s.loss] == ["<\\/s>", "<\\\\/s> as it was"]


def test_other_texts_are_not_parsed(spark):
    bad = ["", "<s>", "[INST]a[/INST]", "<s>[INST]a", "<s>[INST]a</s>", "<s>x[INST]a[/INST]", "<s>[INST]a[/INST]x", "<s>[ROLE]a[/ROLE]",
           "<s>[TEXT]a[/TEXT]", "<s>[INST]a[/INST][TEXT]b[/TEXT]", "<s>[ROLE]a[/ROLE][INST]a[/INST]", "<s><s>[INST]a[/INST]"]
    frame = spark.createDataFrame([(b,) for b in bad], "t string")
    assert [r[0] for r in frame.select(chat_format.parse(F.col("t"))).collect()] == [None] * len(bad)


def test_no_conversations(spark):
    path = scratch_path(spark, "chats")
    chat_format.write_conversations(spark.createDataFrame([], CHATS), path)
    assert chat_format.read_digests(spark, path).collect() == []


def test_escapes_are_taken_back(spark):
    draw = random.Random(2)
    made = ["".join(draw.choices(["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "x", "SYS]"], k=draw.randrange(12))) for _ in range(500)]
    frame = spark.createDataFrame([(m,) for m in made], "t string")
    escaped = chat_format.escape(F.col("t"))
    for text, there, back in frame.select("t", escaped, chat_format.unescape(escaped)).collect():
        assert back == text and not any(c in there for c in chat_format.CONTROLS)


# --- collocations -----------------------------------------------------------------------------------

def brute_collocations(told, threshold, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in told:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, *words[i:i + size]) for i in range(len(words) - size + 1))
    candidates = {p: a for p, a in f.items() if a >= threshold and len(p) > 2}
    ranked = collections.defaultdict(list)
    for (lang, *words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            l, r = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        size = len(words)
        if any(
            100 * b >= 80 * a and other[0] == lang and len(other) - 1 > size
            and any(list(other[i:i + size]) == words for i in range(1, len(other) - size + 1))
            for other, b in candidates.items()
        ):
            continue
        score, _, l, r = min(cuts)
        ranked[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return [
        (lang, i + 1, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in ranked.items() for i, (score, a, phrase, l, r) in enumerate(sorted(found)[:top])
    ]


@pytest.mark.parametrize("part_bytes, entries", [(1 << 20, 1 << 23), (40, 200)])
def test_collocations(docs, table, monkeypatch, part_bytes, entries):
    monkeypatch.setattr(collocations, "PART_BYTES", part_bytes)
    monkeypatch.setattr(collocations, "TABLE_ENTRIES", entries)
    monkeypatch.setattr(collocations, "PHRASES", entries)
    threshold = 3
    expected = brute_collocations(table, threshold, 50)
    assert len(expected) > 40
    assert sorted(map(tuple, collocations.mine(docs, threshold, 50).collect())) == sorted(expected)


def test_no_collocations(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    few = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " . ", "en")], "doc_id long, text string, lang string")
    assert collocations.mine(few, 1).collect() == []


def test_large_counts_do_not_overflow(spark):
    huge = 4 * 10 ** 18
    counts = spark.createDataFrame(
        [("x", None, huge), ("x", "a", huge), ("x", "b", huge), ("x", "a b", huge - 1)], "lang string, phrase string, f long"
    )
    assert [tuple(r) for r in collocations.score(counts).collect()] == [
        ("x", 1, "a b", huge - 1, huge, huge, huge, 2_000_000 * (huge - 1) // (2 * huge))
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=600), st.integers(2, 12), st.integers(1, 7))
def test_frequent_keys_survive_in_a_summary(keys, threshold, tasks):
    summary = collocations.Summary(len(keys), threshold)
    for task in range(tasks):
        own, counts = np.unique(np.array(keys[task::tasks], np.uint32), return_counts=True)
        summary.add(own, counts.astype(np.int64))
        summary.merge()
        assert len(summary.keys) <= summary.capacity
    assert summary.lowered < threshold
    exact = collections.Counter(keys)
    assert {k for k, n in exact.items() if n >= threshold} <= set(summary.survivors().tolist())
