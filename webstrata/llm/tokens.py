"""Token ids of a ``tokenizers`` file, with a bounded memory for repeated words."""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: White space other than the space itself.
_OTHER_SPACE = [chr(c) for c in range(sys.maxunicode + 1) if chr(c) != " " and re.match(r"\s", chr(c))]
_ASCII_SPACE = [c for c in _OTHER_SPACE if c.isascii()]
#: The word pattern that a byte-level tokenizer applies before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and parts of words remembered by one Python worker (about 70 MB, twice the
#: number of words: those met since the last renewal, and those before).
CACHE_WORDS, CACHE_PIECES = 150_000, 50_000
#: Signs that begin a token of their own behind a letter.
_STOPS = ",.;:!?"


def _latin(word: str) -> bool:
    """Letters only, of the range on whose letters all Unicode versions agree."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def _byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> tuple[dict[bytes, int] | None, list[str]]:
    """Bytes to id if the file is a plain byte-level BPE whose ids are merge ranks, and its added tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens") or []]
    if (
        model.get("type", "BPE") != "BPE" or spec.get("normalizer") or splitter.get("type") != "ByteLevel"
        or splitter.get("add_prefix_space") or not splitter.get("use_regex", True)
    ):
        return None, added
    alphabet, own = _byte_alphabet(), set(added)
    return {bytes(alphabet[c] for c in word): i for word, i in model["vocab"].items() if word not in own}, added


def _loose(text: str) -> bool:
    """White space beside a space, where the next token may reach over the space."""
    if not text or text[0] == " " or text[-1] == " " or "  " in text:
        return True
    found = [c for c in (_ASCII_SPACE if text.isascii() else _OTHER_SPACE) if c in text]
    return any(c + " " in text or " " + c in text for c in found)


class Encoder:
    """``encode(text)``: ids as little-endian unsigned 32-bit bytes, no special tokens added.

    Between two characters that are not white space, a single space always
    begins a token, so a text is cut there and repeated words are looked up. A
    word seen for the first time is split by the pattern and its parts are merged
    by the vocabulary's ranks; so is a text with other white space, whose runs may
    be of any length. Texts that hold an added token, and vocabularies of another
    kind, go through ``tokenizers`` whole. Equality with ``tokenizers`` is tested.
    """

    def __init__(self, path: str):
        self.path = path
        ranks, self.added = _ranks(path)
        self.plain = ranks is not None
        if not self.plain:
            return
        merge = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.split = split = regex.compile(_PATTERN).findall

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= CACHE_PIECES:
                    self.clear()
                ids = self[piece] = array("I", merge(piece.encode())).tobytes()
                return ids

        piece = self.piece = Pieces().__getitem__

        class Words(dict):
            before: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_WORDS:  # words that are met again survive
                    self.before = dict(self)
                    self.clear()
                ids = self.before.get(word)
                if ids is not None:
                    pass
                elif _latin(word):
                    ids = array("I", merge((" " + word).encode())).tobytes()
                elif word[-1:] in _STOPS and _latin(word[:-1]):
                    ids = self[word[:-1]] + piece(word[-1])
                else:
                    ids = b"".join(map(piece, split(" " + word)))
                self[word] = ids
                return ids

        self.word = Words().__getitem__

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)  # few texts need it, and it is large

    def encode(self, text: str) -> bytes:
        if not self.plain or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _loose(text):
            return b"".join(map(self.piece, self.split(text)))
        first, *words = text.split(" ")
        return b"".join((*map(self.piece, self.split(first)), *map(self.word, words)))


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, whose remembered words serve all its tasks."""
    return Encoder(path)
