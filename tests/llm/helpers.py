"""Brute-force versions of the training-data operators, and awkward rows."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score int, row string"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward(extra: list[tuple] = ()) -> list[tuple]:
    """Null, empty, blank, tiny, repeated and very long texts, with columns whose names clash with the operators' own."""
    texts = [None, "", " \n\t ", "a", "a b", "A  B", "é ß 日本 🙂", "x" * 5000, "word " * 3000, "one two three four five six", "one two three four five six", "12 34 !!"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None if t is None else len(t), "z", 1, "r") for i, t in enumerate(texts)]
    return rows + [(100 + i, *r) for i, r in enumerate(extra)]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = WORDS.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {i: i for i in ids}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_components(texts: dict[int, str | None], k: int, percent: int = 80) -> dict[int, int]:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(ids, links)


def repeats(texts: dict[int, str | None], length: int) -> dict[int, tuple[list[str], list[str]]]:
    """Words and kept words of each text."""
    words = {i: WORDS.findall(t or "") for i, t in texts.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for s in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][s : s + length]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone.update(range(s, s + length))
        out[i] = w, [x for j, x in enumerate(w) if j not in gone]
    return out
