"""Registered queries against brute-force versions of their contracts, on whole small tables."""

import hashlib

import numpy as np
import pytest
from helpers import components, near_components, repeats, shingles

from medlake.llm import queries

P = pytest.importorskip("public_tokenizers")
SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_op5_finds_every_link(spark):
    """All 1000 documents against all pairs; recall of links, and of components, is 1 here."""
    t = texts(spark, SF)
    got = queries.op5_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(t, 2)
    assert all(r.n_shingles == len(shingles(t[r.doc_id], 2)) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_op6_removes_exactly_the_repeats(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, SF).collect()}
    want = {i: (len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, (w, k) in repeats(texts(spark, SF), 50).items()}
    assert got == want


def test_op7_finds_every_link(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    ids = [r.vec_id for r in rows]
    comp = components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(hit)))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op7_epsilon_join(spark, SF).collect()}
    assert got == {i: (int(hit[k].sum()), comp[i], comp[i] == i) for k, i in enumerate(ids)}


def test_op9_packs_every_token_once(spark):
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts(spark, TINY).items()}
    rows = queries.op9_packing(spark, TINY).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = {}
    for s, o, n in places:
        assert o == at.get(s, 0) and o + n <= 2048
        at[s] = o + n
    assert sorted(at) == list(range(len(at))) and all(n == 2048 for s, n in at.items() if s < len(at) - 1)
    by: dict = {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, pieces in by.items():
        pieces.sort()
        assert [s for s, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1]) and sum(n for _, n in pieces) == len(ids[i])
    assert by.keys() == ids.keys()


def plain_sections(library, fields, rule):
    """Counts by the library's own character offsets: one section at a time, one token at a time."""
    text = "\n".join(x or "" for x in fields)
    bounds, at = [], 0
    for x in fields[:-1]:
        at += len(x or "") + 1
        bounds.append(at)
    lines = (fields[-1] or "").split("\n")
    for i, line in enumerate(lines):
        if i < len(lines) - 1:
            at += len(line) + 1
            bounds.append(at)
        elif line or len(lines) == 1:
            at += len(line)
            bounds.append(at)
    spans = [(s, e) for s, e in zip([0, *bounds[:-1]], bounds)]
    size = lambda s, e: len(text[s:e].encode())
    count, over = [0] * len(spans), [0] * len(spans)
    for s, e in library.encode(text, add_special_tokens=False).offsets:
        shared = [size(max(s, a), min(e, b)) if min(e, b) > max(s, a) else 0 for a, b in spans]
        touched = [i for i, n in enumerate(shared) if n]
        own = {"first": touched[0], "last": touched[-1], "most": max(touched, key=lambda i: (shared[i], -i))}[rule]
        count[own] += 1
        over[own] += len(touched) > 1
    return [(i, size(*spans[i]), count[i], over[i]) for i in range(len(spans))]


def test_op10_counts_match_the_library_offsets(spark):
    """On texts whose tokens never cut a character, so that the library's offsets are exact."""
    from tokenizers import Tokenizer

    from medlake.llm import token_counts

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, "src", "en", "one two\n\n\n  three\nfour"), (2, "a b", None, ""), (3, None, None, None), (4, "x\ny", "z\n", "\n\n"), (5, "s", "l", "tail\n"), (6, " ", " ", " lead   \n  gap\n\n    code(x):\n")]
    rows += [(100 + r.doc_id, r.source, r.lang, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect() if r.text and r.text.isascii()][:60]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    for rule in token_counts.RULES:
        got: dict = {}
        for r in token_counts.section_tokens(df, path, ["source", "lang", "text"], rule).collect():
            got.setdefault(r.doc_id, []).append((r.section, r.n_bytes, r.n_tokens, r.n_boundary))
        for own, *fields in rows:
            assert sorted(got[own]) == plain_sections(library, fields, rule), (rule, own)


def test_op3_matches_a_slow_version(spark):
    """Features one by one, the softmax and the temperature spelled out; and the held-out accuracy."""
    import math

    from medlake.llm import language_id as li

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = li.train(docs)

    def slow(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else 0x20 if b in (9, 10, 11, 12, 13) else b for b in f" {text} ".encode())
        total, n = np.zeros(len(model.langs)), 0
        for size in li.GRAMS:
            for s in range(len(raw) - size + 1):
                gram = raw[s : s + size]
                if b" " in gram[1:-1] or gram == b"  ":
                    continue
                v = int.from_bytes(gram, "little") ^ (size * 0x9E3779B1 & 0xFFFFFFFF)
                total += model.table[(v * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - li.BITS)]
                n += 1
        z = total / max(n, 1) / model.temperature
        e = [math.exp(x - max(z)) for x in z]
        return model.langs[int(np.argmax(z))], max(e) / sum(e)

    got = {r.doc_id: r for r in li.predict(docs, model).collect()}
    for r in docs.collect():
        if r.text and any(map(str.isalpha, r.text)):
            lang, score = slow(r.text)
            assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9
            assert got[r.doc_id].accepted == (score >= model.least)


def test_op3_scores_are_calibrated(spark):
    """On all held-out documents: nearly all right, few rejected, and the mean score near the accuracy."""
    got = queries.op3_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert right >= 0.99 and sum(not r.accepted for r in got) / len(got) <= 0.01
    assert abs(sum(r.score for r in got) / len(got) - right) < 0.03


def test_texts_beyond_a_slice_and_a_batch(spark):
    """Two texts of some 9 MB that differ in a few words, beside short ones, through the operators that slice."""
    from medlake.llm import language_id, minhash_dedup, order_minhash, substring_dedup, token_counts
    from medlake.plans.shared import small_batches

    r = np.random.default_rng(2)
    words = [f"{i:05d}x" for i in r.integers(0, 90_000, 1_250_000)]
    other = words[:]
    changed = sorted(r.choice(len(words), 40, replace=False).tolist())
    for i in changed:
        other[i] = "changed"
    assert min(np.diff(changed)) > 50 and changed[0] > 50 and len(words) - changed[-1] > 50
    rows = [(1, "a short text", "en", "s"), (2, " ".join(words), "en", "s"), (3, " ".join(other), "en", "s"), (4, "another short text", "en", None)]
    small_batches(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    assert {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(df, shingle=2).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.remove_repeats(df).collect()}
    assert got[2][1] == 0 and got[3] == (len(words), len(words) - 40, " ".join(["changed"] * 40)) and got[4][1] == 0
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = language_id.train(docs)
    french = " ".join(x.text for x in docs.where("lang = 'fr' and length(text) > 200").collect())
    long = spark.createDataFrame([(1, french * (9_000_000 // len(french))), (2, french)], "doc_id long, text string")
    found = {x.doc_id: (x.lang_pred, round(x.score, 3)) for x in language_id.predict(long, model).collect()}
    assert found[1] == found[2] and found[1][0] == "fr"
    f = {x.doc_id: x for x in order_minhash.compare_edits(df, ranges=2).collect()}
    assert f[2].near_next > 0.9 and f[2].n_chars == len(rows[1][1]) and 0.2 < f[2].near_edited <= 1
    tokens = {x.doc_id: x.n for x in token_counts.section_tokens(df, P.path("byte_bpe_50k.json"), ["source", "text"]).groupBy("doc_id").agg({"n_bytes": "sum"}).withColumnRenamed("sum(n_bytes)", "n").collect()}
    assert tokens[2] == len(rows[1][1]) + 2 and tokens[4] == len(rows[3][1]) + 1


def test_op7_ignores_columns_named_as_its_own(spark):
    from medlake.llm import epsilon_join

    names = "vec_id long, embedding array<float>, id string, unit int, n int, cell int, block int, leaf int, side int, component_id int"
    rows = [(i, [1.0, i / 100, 0.0], "z", *range(7)) for i in range(30)] + [(None, [1.0, 0.0, 0.0], "z", *range(7))]
    got = epsilon_join.near_vectors(spark.createDataFrame(rows, names)).collect()
    assert len(got) == 31 and {r.component_id for r in got} == {0, None} and all(r.n_links == (29 if r.vec_id is not None else 0) for r in got)
