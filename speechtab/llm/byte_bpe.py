"""Byte-level BPE encoding and decoding through a sentencepiece model made from the ranks.

The model is written directly from the vocabulary: each token's bytes as printable characters are a
piece whose score is the negative rank, so the pair that the ranks merge first has the best score; the
normaliser is the identity. Pre-tokens are encoded one by one, ids are ranks, and decoding joins the
tokens' bytes.

A null text counts as the empty one: no tokens. Repeated rows keep a row each. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from speechtab.llm import tokens
from speechtab.llm.common import map_batches, whole_text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; the unknown piece stands behind the last rank.

    Fixed values of that public format: field numbers, piece kinds (1 normal, 2 unknown, 5 unused)
    and the model kind (2: BPE).
    """
    written = tokens.byte_characters()
    size = max(ranks.values(), default=-1) + 1
    by_rank = {rank: token for token, rank in ranks.items()}
    pieces = []
    for rank in range(size):
        token = by_rank.get(rank)
        name = f"<unused {rank}>" if token is None else "".join(written[b] for b in token)
        pieces.append(
            _block(1, name.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank)
            + _number(3, 5 if token is None else 1)
        )
    pieces.append(_block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _number(3, 2))
    trainer = _number(3, 2) + _number(40, size) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _block(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, normalizer)


class Codec:
    """Ids as decimal numbers, each with a space behind it; that is what the digest needs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks)).encode
        written, find = tokens.byte_characters(), regex.compile(pattern).findall
        self.decoded = {b"%d" % rank: token for token, rank in ranks.items()}

        def piece(text: str) -> bytes:
            seen = text.encode().decode("latin-1").translate(written)
            return "".join([f"{i} " for i in encode(seen)]).encode()

        self.encode = tokens.ChunkEncoder(lambda chunk: b"".join(map(piece, find(chunk))), piece, True)

    def decode(self, numbers: bytes) -> bytes:
        return b"".join(map(self.decoded.__getitem__, numbers.split()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes that they decode to.

    ``ranks`` is a file of base64 tokens and ranks, ``pattern`` finds the pre-tokens.
    """

    def step(batches):
        coder = codec(ranks, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                ids = coder.encode(text)
                rows.append((
                    ids.count(b" "), hashlib.sha256(ids[:-1]).hexdigest(),
                    hashlib.sha256(coder.decode(ids)).hexdigest(),
                ))
            counts, codes, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(
        docs.select("doc_id", whole_text().alias("text")), step,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
