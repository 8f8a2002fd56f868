"""Byte-level BPE ids of whole texts, with caches of the pieces between single blanks.

The tokenizer splits a text into pre-tokens before it merges bytes: a blank belongs to the word after
it, and a run of white space gives its last blank to that word. So every place before a blank that
is followed by other than white space is a border, as is either side of a single line feed between
other characters, and what stands between two borders has the same ids wherever it stands.
"""

from __future__ import annotations

import base64
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

#: Entries of a cache before it starts afresh; about 25 MB. A worker has two, and lives on after its stage.
CACHE = 120_000
_BORDER = re.compile(r"(?= \S)")
#: Fixed value: how the vocabulary's byte-level tokenizer splits a text into pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _odd(text: str) -> bool:
    """Does it have white space at an end, two in a row, or of another kind than blank and line feed?"""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text or text[0] in " \n" or text[-1] in " \n":
        return True
    return len(text) - sum(map(len, text.split())) != text.count(" ") + text.count("\n")


class _Cache(dict):
    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.encode(self.lead + part)
        if len(part) <= 64:
            self[part] = ids
        return ids


class TokenBytes:
    """``of(text)``: the ids of a text, as little-endian unsigned 32-bit integers in one string of bytes.

    ``path`` is the tokenizer's file; ``ranks``, if given, a file of the same vocabulary as ranks, by
    which parts without special tokens are encoded faster and to the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encode = self.whole
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            plain = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=table, special_tokens={}).encode_ordinary
            self.encode = lambda part: array("I", plain(part)).tobytes()
        self.bare, self.led = _Cache(self.encode, ""), _Cache(self.encode, " ")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        bare, led = self.bare, self.led
        if _odd(text):
            return b"".join([bare[p] for p in _BORDER.split(text) if p])
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append((bare[first] if first else b"") + b"".join(map(led.__getitem__, rest)))
        return bare["\n"].join(lines)


_made: dict[tuple[str, str | None], TokenBytes] = {}


def token_bytes(path: str, ranks: str | None = None) -> TokenBytes:
    """One per process and files."""
    if (path, ranks) not in _made:
        _made[path, ranks] = TokenBytes(path, ranks)
    return _made[path, ranks]
