"""Exact token ids of whole texts, word by word through a worker's cache.

The pre-tokenizers of the two supported families never join characters across a change from
non-space to space, so a text may be cut there and each piece encoded alone by the library. The
cut is made only where the text has no white space but spaces and line feeds and no special
string; any other text goes to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from probanza.llm.texts import Cache

#: White space, separators and control characters other than space and line feed.
_ODD_SPACE = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿]")
#: Characters whose lower case and normal form do not depend on their neighbours are kept in the cut path.
_NOT_LATIN = re.compile("[^\x0a\x20-\x7eÀ-įı-ɏ]")
_RUNS = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: A word of Latin letters, then ASCII marks other than the apostrophe: two pre-tokens in both families.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)$")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies, as a translation of Latin-1."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_SYMBOLS = byte_symbols()


def pre_token_ids(tokenizer: Tokenizer, piece: str) -> list[int]:
    """Ids of one pre-token by the library's model alone, which is far cheaper than a whole call."""
    if piece.isascii() and piece.isalnum():
        symbols = piece
    else:
        symbols = piece.encode("utf-8").decode("latin-1").translate(_SYMBOLS)
    return [t.id for t in tokenizer.model.tokenize(symbols)]


class Encoder:
    """``ids(text)`` as little-endian bytes of ``dtype``, equal to the library's ids of the whole text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        #: Two bytes an id where the vocabulary allows it, else four.
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds = self.tokenizer.normalizer is not None
        self.cache = Cache(self._piece_ids)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _pre_token(self, piece: str) -> bytes:
        return array(self.code, pre_token_ids(self, piece)).tobytes()

    def _piece_ids(self, key: str) -> bytes:
        """A key is a word that follows one space, or begins with a line feed, or has \\x00 or \\x01 before the piece as it is.

        After \\x01 the piece is one pre-token.
        """
        if key.isalpha() and key.isascii():  # most misses
            own = key if self.folds else _SYMBOLS[32] + key
            return array(self.code, [t.id for t in self.model.tokenize(own)]).tobytes()
        if key.startswith("\x01"):
            return self._pre_token(key[1:])
        word = _WORD.match(key)
        if word:
            marks = self.cache["\x01" + word[2]] if word[2] else b""
            if word[1].isascii():
                own = word[1] if self.folds else _SYMBOLS[32] + word[1]
                return array(self.code, [t.id for t in self.model.tokenize(own)]).tobytes() + marks
            return self._pre_token(word[1] if self.folds else " " + word[1]) + marks
        if self.folds or key.startswith("\n"):
            return self._library(key)
        return self._library(key[1:] if key.startswith("\x00") else " " + key)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or (_NOT_LATIN if self.folds else _ODD_SPACE).search(text):
            return self._library(text)
        if self.folds:  # white space and case are dropped by the normalizer
            keys = text.lower().split()
        elif "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            keys = [
                p[1:] if p[0] == " " and p[1:2] not in (" ", "\n") else p if p[0] == "\n" and p[1:2] not in (" ", "\n", "")
                else "\x00" + p
                for p in _RUNS.findall(text)
            ]
        else:
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = "\x00" + keys[0]
        return b"".join(map(self.cache.__getitem__, keys))

    def ids32(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit integers."""
        ids = self.ids(text)
        return ids if self.dtype == "<u4" else np.frombuffer(ids, dtype=self.dtype).astype("<u4").tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
