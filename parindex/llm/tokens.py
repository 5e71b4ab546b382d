"""Byte-level BPE ids of whole texts, with a bounded cache of encoded chunks.

The vocabulary file is a parameter and is read where Python runs.  A text is
cut only where the tokenizer's own pre-tokenizer always cuts (before a blank
that a non-blank follows, around line breaks between non-blanks, after a run
of Latin letters that plain punctuation or a blank follows), so joining the
ids of the chunks gives the ids of the text; repeated chunks are looked up.
The added tokens of the file are taken out of the text first, the longest at
the leftmost place, and have their own id, as in the tokenizer.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np

#: fixed value: the pre-tokenizer's pattern of the byte-level vocabulary
PRE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: letters of the first Unicode blocks; a run of them is one piece of the pre-tokenizer
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_CHUNK = re.compile(rf" ?[{_LATIN}]+(?=[ \n.,;:!?|]|\Z)|[.,;:!?|]+(?=[ \n]|\Z)| ?\S+|\s+(?=\s\S)|\s+")
_ONE_PIECE = re.compile(rf" ?[{_LATIN}]+")
#: a blank that another blank or the end follows: no cut by single blanks
_UNEVEN = re.compile(r" (?:\s|\Z)")
#: blanks for Python's patterns but not for the tokenizer's
_ODD = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_of_sign() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """Pattern that splits at the file's added tokens, and their ids as bytes."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in found for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: added tokens that take blanks or whole words only are not supported")
    ids = {t["content"]: pack("<I", t["id"]) for t in found}
    longest = sorted(ids, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest)) + ")") if ids else None, ids


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    sign = _byte_of_sign()
    ranks = {bytes(sign[c] for c in tok): i for tok, i in data["model"]["vocab"].items()
             if tok not in special}
    return tiktoken.Encoding("byte-level", pat_str=PRE_PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


class _Pieces(dict):
    """chunk -> its ids as little-endian 32-bit bytes; takes no more when full."""

    def __init__(self, path: str, limit: int):
        encoding = _encoding(path)
        self.encode, self.limit = encoding.encode_ordinary, limit
        self.encode_piece = encoding._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        if _ONE_PIECE.fullmatch(chunk):
            ids = self.encode_piece(chunk.encode())
        else:
            ids = self.encode(chunk)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(self) < self.limit and len(chunk) <= 64:
            self[chunk] = packed
        return packed


class _Words(dict):
    """word -> the ids of a blank and that word, by way of the pieces."""

    def __init__(self, pieces: _Pieces):
        self.pieces, self.limit = pieces, pieces.limit

    def __missing__(self, word: str) -> bytes:
        packed = b"".join(map(self.pieces.__getitem__, _CHUNK.findall(" " + word)))
        if len(self) < self.limit and len(word) <= 64:
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def _words(path: str, limit: int = 400_000) -> _Words:
    return _Words(_Pieces(path, limit))


def _ordinary(text: str, path: str) -> bytes:
    """Ids of a text without added tokens."""
    words = _words(path)
    if _ODD.search(text):
        return np.array(words.pieces.encode(text), "<u4").tobytes()
    if _UNEVEN.search(text):
        return b"".join(map(words.pieces.__getitem__, _CHUNK.findall(text)))
    first, *rest = text.split(" ")
    return b"".join([*map(words.pieces.__getitem__, _CHUNK.findall(first)),
                     *map(words.__getitem__, rest)])


def encode(text: str, path: str) -> bytes:
    """Ids of the whole text as little-endian unsigned 32-bit integers."""
    marks, ids = _added(path)
    if marks is None or not marks.search(text):
        return _ordinary(text, path)
    return b"".join(ids[x] if k % 2 else _ordinary(x, path) for k, x in enumerate(marks.split(text)))
