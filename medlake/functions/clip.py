"""Fixed-length token ids for a text tower: cleaning, byte-pair ids from a vocabulary file, truncation and padding."""

from __future__ import annotations

import html
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: str) -> str:
    """HTML entities undone twice, white space collapsed, lower case."""
    return " ".join(html.unescape(html.unescape(text)).split()).lower()


#: Steps of a tokenizer file that never look across a blank, and drop it.
NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
WORDS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _ends_at_blanks(t) -> bool:
    """Whether a text's ids are those of its parts between blanks, one after another; False where that isn't known."""
    if None in (t.normalizer, t.pre_tokenizer) or (t.post_processor, t.truncation, t.padding) != (None, None, None):
        return False
    steps = json.loads(t.normalizer.__getstate__())
    if not all(s in NORMALIZERS for s in steps.get("normalizers", [steps])) or getattr(t.model, "dropout", None):
        return False
    if json.loads(t.pre_tokenizer.__getstate__()) != {"type": "Sequence", "pretokenizers": [WORDS, BYTES]}:
        return False
    return not any(" " in a.content or a.normalized or a.lstrip or a.rstrip or a.single_word for a in t.get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, _ends_at_blanks(t)


def first_ids(t, text: str, most: int, parts: bool) -> list[int]:
    """The first ``most`` of the ids of the whole ``text``.

    An encoding takes over a hundred bytes for each byte of its text.  With ``parts``, what
    lies between blanks is encoded on its own, some words at a time, until the ids are there
    (a run without blanks whole); otherwise an id may depend on all of the text.
    """
    if not parts:
        return t.encode(text, add_special_tokens=False).ids[:most]
    out: list[int] = []
    at = 0
    while at < len(text) and len(out) < most:
        stop = text.find(" ", at + 4 * most)
        stop = len(text) if stop < 0 else stop
        out += t.encode(text[at:stop], add_special_tokens=False).ids
        at = stop
    return out[:most]


def token_ids(text: Column, path: str, context: int = 77, start: str = "<|startoftext|>", end: str = "<|endoftext|>") -> Column:
    """Array of ``context`` ids: start, the text's ids cut to ``context`` - 2, end, zeros.

    ``path`` is a tokenizer file that has the two marks.  A null text gives the marks alone.
    Texts of a batch are encoded one after another, never together.
    """

    @F.arrow_udf("array<int>")
    def ids(rows: pa.Array) -> pa.Array:
        t, parts = _tokenizer(path)
        marks = [t.token_to_id(start), t.token_to_id(end)]
        if None in marks:
            raise ValueError(f"{path} lacks {start} or {end}")
        out = np.zeros((len(rows), context), np.int32)
        for row, x in zip(out, rows):
            own = [marks[0], *first_ids(t, clean_text(x.as_py() or ""), context - 2, parts), marks[1]]
            row[: len(own)] = own
        return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * context, out.reshape(-1))

    return ids(text)
