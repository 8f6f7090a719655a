"""Encoding of many texts with a public tokenizer, each distinct chunk once per worker.

A text is cut at places where the tokenizer always cuts as well, so the ids of the chunks in a row
are the ids of the text:

* before a space that follows a non-space character. No pattern of these tokenizers matches a
  non-space and then a space, none looks back, and normal forms never combine across a space;
* between a Latin letter and closing punctuation at the end of such a chunk.

Chunks repeat, so the library encodes those that a worker hasn't met and the others come from a
bounded memory. A chunk of Latin letters needs no normal form and no pattern; the library's model
takes it directly. Any other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Unicode's White_Space.
SPACES = "\t-\r \x85\xa0  -     　"
CLOSING = ".,;:!?)"
#: Chunks that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000

_PIECES = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ENDS_IN_SPACE = re.compile(f"[{SPACES}]\\Z")
_STARTS_WITH_SPACE = re.compile(f"[{SPACES}]")


class _Memory(dict):
    """Asks ``make`` for what it hasn't got; starts anew when full."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    ``encode`` gives the ids of any chunk, ``encode_letters`` those of Latin letters, with a space
    before them where ``spaces_matter``; it is false where the tokenizer drops white space.
    """

    def __init__(
        self, encode: Callable[[str], bytes], encode_letters: Callable[[str], bytes], spaces_matter: bool
    ):
        self.encode = encode
        self.encode_letters = encode_letters
        self.spaces_matter = spaces_matter
        self.lead = " " if spaces_matter else ""
        self.words, self.heads = _Memory(self._word), _Memory(self._head)
        self.cores = _Memory(lambda core: encode_letters(self.lead + core))
        self.bare = _Memory(encode_letters)
        self.others = _Memory(encode)

    def __call__(self, text: str) -> bytes:
        if not self.spaces_matter:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        head, *rest = text.split(" ")
        if not head and not rest:
            return b""
        try:
            return b"".join((self.heads[head], *map(self.words.__getitem__, rest)))
        except TypeError:  # white space in a row: cut where it starts
            return self._by_pieces(text)

    def _word(self, word: str) -> bytes | None:
        """Ids of a chunk that stands behind a space; none if a space beside it is no place to cut."""
        return self._chunk(word, self.lead, self.cores)

    def _head(self, word: str) -> bytes | None:
        """Ids of a chunk that starts a text or follows a line end."""
        return self._chunk(word, "", self.bare)

    def _chunk(self, word: str, lead: str, cores: _Memory) -> bytes | None:
        if self.spaces_matter:
            if not word or _ENDS_IN_SPACE.search(word):
                return None
            if "\n" in word[1:]:  # a single line end between other characters is cut off on both sides
                first, *rest = word.split("\n")
                parts = [self._chunk(first, lead, cores)]
                for line in rest:
                    parts += [self.others["\n"], None if _STARTS_WITH_SPACE.match(line) else self._head(line)]
                return None if None in parts else b"".join(parts)
        core = word.rstrip(CLOSING)
        if core.isalpha() and core.isascii() or _LETTERS.fullmatch(core):
            tail = word[len(core):]
            return cores[core] + self.others[tail] if tail else cores[core]
        return self.encode(lead + word)

    def _by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.encode, _PIECES.findall(text)))


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def json_encoder(path: str, *, lower: bool, spaces_matter: bool) -> ChunkEncoder:
    """Encoder for a byte-level file of the tokenizers library, one for each worker.

    ``lower``: the file's normaliser makes letters lower case.
    """
    tokenizer = load(path)
    model, written = tokenizer.model, byte_characters()

    def packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def encode(chunk: str) -> bytes:
        return packed(tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode_letters(chunk: str) -> bytes:
        seen = (chunk.lower() if lower else chunk).encode().decode("latin-1").translate(written)
        return packed([t.id for t in model.tokenize(seen)])

    return ChunkEncoder(encode, encode_letters, spaces_matter)


def word_encoder(path: str) -> ChunkEncoder:
    """For word_bpe_49k.json."""
    return json_encoder(path, lower=True, spaces_matter=False)


def byte_encoder(path: str) -> ChunkEncoder:
    """For byte_bpe_50k.json."""
    return json_encoder(path, lower=False, spaces_matter=True)
