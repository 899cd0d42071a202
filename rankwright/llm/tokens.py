"""Exact byte-pair encoding with the public tokenizer files, word by word.

Both vocabularies cut a text into pieces that never reach over the start of a
white-space run, so a text may be encoded as the sequence of its words.  Each
worker keeps a bounded memory of the words it has met; a word it has not met is
merged by the BPE core of tiktoken, which is loaded with the ranks of the very
JSON file.  Words with characters outside Latin-1, and texts that hold a special
token, go to the tokenizers library itself.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: Words remembered by one worker before it starts afresh (about 150 MB).
MEMORY_WORDS = 600_000
#: White space outside ASCII, as the Unicode property White_Space has it (fixed values).
WIDE_SPACES = "\x85\xa0                　"
#: Piece pattern of word_bpe_49k.json (fixed value of that file).
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = b"\xff"

_ASCII_SPACES = " \t\n\r\x0b\x0c"
#: Two white-space characters in a row of which the second would start a word.
_DOUBLE = tuple(a + b for b in " \n" for a in _ASCII_SPACES + "\x1c\x1d\x1e\x1f" + WIDE_SPACES)
_ASCII_DOUBLE = tuple(x for x in _DOUBLE if x.isascii())
_CHUNKS = regex.compile(r"\s*[^\s]+|\s+")
#: Separators that the library takes for white space and the word cutter here doesn't.
ODD = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """Letter of byte-level vocabularies -> byte: printable bytes stand for themselves, others for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    suffix = spec["model"]["end_of_word_suffix"] or ""
    ranks: dict[bytes, int] = {}
    for token, rank in spec["model"]["vocab"].items():
        if token in special:
            continue
        ends = bool(suffix) and token.endswith(suffix)
        raw = bytes(letters[c] for c in (token[: -len(suffix)] if ends else token))
        ranks[raw + END if ends else raw] = rank
    return ranks, special


def pack(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    return a.tobytes()


class _Memory(dict):
    """word -> packed ids, filled on demand and bounded."""

    def __init__(self, encode, share: int = 1):
        super().__init__()
        self.encode, self.share = encode, share

    def __missing__(self, word):
        if len(self) * self.share >= MEMORY_WORDS:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class ByteLevel:
    """byte_bpe_50k.json: every byte is encoded, a word carries the white space before it."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(self.path)
        self.library.no_padding()
        self.library.no_truncation()
        ranks, special = _ranks(self.path)
        self.special = tuple(special)
        self.core = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merge = self.core._core_bpe.encode_ordinary
        self.bytes_of = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in special.items()}
        self.spaced = _Memory(lambda w: self.chunk(w if w[:1] == "\n" else " " + w))
        self.exact = _Memory(self.chunk, 3)

    def chunk(self, text: str) -> bytes:
        return pack(self.merge(text))

    def words(self, text: str) -> list[str] | None:
        """Words of a text that has no two white-space characters in a row where a word starts, else None.

        The first word stands as it is; any later one is meant with the space before it, or starts with a line feed.
        """
        if any(s in text for s in (_ASCII_DOUBLE if text.isascii() else _DOUBLE)) or text[:1] == "\n":
            return None
        return text.replace("\n", " \n").split(" ")

    def chunks(self, text: str) -> list[str]:
        """Pieces of any text, cut before each white-space run."""
        return _CHUNKS.findall(text)

    def whole(self, text: str) -> bytes:
        return pack(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or ODD.search(text):
            return self.whole(text)
        words = self.words(text)
        if words is None:
            return b"".join(map(self.exact.__getitem__, self.chunks(text)))
        first = self.exact[words[0]] if words[0] else b""
        del words[0]
        return first + b"".join(map(self.spaced.__getitem__, words))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


class WordLevel:
    """word_bpe_49k.json: lower-cased words with end marks, white space dropped."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        self.path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(self.path)
        self.library.no_padding()
        self.library.no_truncation()
        ranks, special = _ranks(self.path)
        self.special = tuple(special)
        self.core = tiktoken.Encoding(name, pat_str=WORD_PIECES, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(WORD_PIECES)
        self.memory = _Memory(self.word, 2)

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        if max(text) > "\xff":
            return pack(self.library.encode(text, add_special_tokens=False).ids)
        one = self.core._encode_single_piece
        return b"".join(pack(one(p.encode() + END)) for p in self.pieces.findall(text.lower()))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return pack(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.memory.__getitem__, text.encode().split()))


@lru_cache(maxsize=None)
def byte_level(name: str = "byte_bpe_50k.json") -> ByteLevel:
    return ByteLevel(name)


@lru_cache(maxsize=None)
def word_level(name: str = "word_bpe_49k.json") -> WordLevel:
    return WordLevel(name)
