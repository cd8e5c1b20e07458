"""Ids of a word-level BPE tokenizer file, exactly as the tokenizers library gives them.

White space always ends a token, so texts are pre-split by the file's own word pattern
and each distinct word goes through the library's merge model once for a worker.  Words
of ASCII and plain Latin letters take that path; anything else (combining marks, other
scripts, special tokens) is encoded by the library itself, a chunk between spaces at a
time, or the whole text where it holds a special token.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

from medlake.llm.words import Memo

#: The letters that lower-casing and composition leave as they are, and the word pattern of the file.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-įı-ſ]*")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ſ]+")
SPACES = re.compile("[ \t-\r]+")
FILE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words in the younger of two generations of the memo; the older one holds as many.
MEMO = 200_000
#: The array type of four unsigned bytes.
ID_CODE = next(c for c in "IL" if array(c).itemsize == 4)


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordIds:
    """Encoder for one tokenizer file; subclasses say how its words are found and spelled."""

    FILE_MARK = FILE_PATTERN
    WORDS = WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:  # as text: its parsed form would take far more memory
            if not any(json.dumps(self.FILE_MARK)[1:-1] in x or self.FILE_MARK in x.replace('": ', '":') for x in f):
                raise ValueError("the tokenizer file has another word pattern")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.memo = Memo(self._word, MEMO)
        self.odd = Memo(self._library, MEMO // 8)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _prepared(self, text: str) -> str:
        return text.lower()

    def _mapped(self, word: str) -> str:
        return word if word.isascii() else "".join(self.alphabet[b] for b in word.encode())

    def _word(self, word: str) -> bytes:
        ids = array(ID_CODE, [t.id for t in self.model.tokenize(self._mapped(word))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.WORDS.findall(self._prepared(text))))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._library(text)
        if PLAIN.fullmatch(text):
            return self._plain(text)
        return self._mixed(text)

    def _mixed(self, text: str) -> bytes:
        return b"".join(self._plain(chunk) if PLAIN.fullmatch(chunk) else self.odd[chunk] for chunk in SPACES.split(text))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
