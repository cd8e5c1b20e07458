import random

from helpers import SCHEMA, awkward, documents, near_components, repeats, shingles
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from medlake.llm import minhash_dedup as md
from medlake.llm import setsketch as ss
from medlake.llm import substring_dedup as sd
from medlake.llm.components import connected_components
from medlake.llm import skew
from medlake.llm.words import split_words, string_bytes, window_hash
from pyspark.sql import functions as F


def corpus(seed: int, n: int = 60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(n):
        if i and r.random() < 0.6:
            w = texts[r.randrange(len(texts))].split()
            for _ in range(r.choice([0, 1, 3, 8])):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        texts.append(" ".join(w))
    return awkward([(t, "en", "s", len(t), "z", 1, "r") for t in texts])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAzé日 \n\t\x0b. ", max_size=30), max_size=6))
def test_words_match_the_pattern(texts):
    from helpers import WORDS, lower

    data, at = string_bytes(pa.array(texts, pa.string()))
    w = split_words(data, at, lower=True)
    spans = [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    assert spans == [x for t in texts for x in WORDS.findall(t)]
    assert w.count().tolist() == [len(WORDS.findall(t)) for t in texts]
    seen: dict = {}
    for x, h in zip(spans, w.hash.tolist()):
        assert seen.setdefault(lower(x), h) == h
    assert len(set(seen.values())) == len(seen)


def test_near_duplicates_match_brute_force(spark):
    for k in (2, 5):
        rows = corpus(k)
        got = md.near_duplicates(documents(spark, rows), shingle=k).collect()
        texts = {r[0]: r[1] for r in rows}
        assert {r.doc_id: r.component_id for r in got} == near_components(texts, k)
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, k)) for i, t in texts.items()}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_of_links_that_no_hub_sees(spark):
    """Neighbours are similar, far ends are not: the component needs links between non-hubs."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[i * 8 : i * 8 + 100]), None, None, None, None, None, None) for i in range(20)]
    got = {r.doc_id: r.component_id for r in md.near_duplicates(documents(spark, rows), shingle=2).collect()}
    assert got == near_components({r[0]: r[1] for r in rows}, 2)


def test_two_open_rows_without_their_hub_are_verified(spark):
    """Open rows 5 and 6 of hub 1, which is unlike both; and a pair below the threshold."""
    sets = {5: range(100), 6: range(5, 105), 8: range(200, 300), 9: range(250, 350)}
    tables = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in sets.items()], "id long, shingles binary")
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 8), (2, 9)], "hub long, id long")
    comp = spark.createDataFrame([], "id long, component long")
    assert {(min(r), max(r)) for r in md._open_links(rows, tables, comp, 80).collect()} == {(5, 6)}


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """Families of texts of middling similarity with near pairs inside, in blocks of a few rows."""
    monkeypatch.setattr(md, "BLOCK_ROWS", 7)
    monkeypatch.setattr(md, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(md, "HUB_ROWS", 5)
    r = random.Random(8)
    common = [f"c{i}" for i in range(120)]
    texts = []
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(60)]
        texts.append(common + own)
        if i % 5 == 0:
            near = common + own
            near[r.randrange(len(near))] = "changed"
            texts.append(near)
    r.shuffle(texts)
    rows = [(i, " ".join(t), None, None, None, None, None, None) for i, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in md.near_duplicates(documents(spark, rows), shingle=2).collect()}
    assert got == near_components({r[0]: r[1] for r in rows}, 2)


def test_empty_and_null_ids(spark):
    assert md.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", *[None] * 6), (3, "a b c", *[None] * 6), (4, "a b c", *[None] * 6)]
    got = md.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got if r.doc_id) == [(False, 3, False), (False, 3, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    both = np.concatenate([a, b, np.union1d(a, b)])
    regs = ss.registers(both, np.cumsum([0, len(a), len(b), len(np.union1d(a, b))]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    est = ss.joint_jaccard(regs[:1], regs[1:2], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 0.6) < 0.15
    assert (ss.registers(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats_match_brute_force(spark):
    for length, chunk in ((50, 4 << 20), (10, 2000), (7, 1)):
        rows = corpus(length)
        got = sd.remove_repeats(documents(spark, rows).repartition(3), length=length, chunk_bytes=chunk).collect()
        want = repeats({r[0]: r[1] for r in rows}, length)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == {i: (len(w), len(w) - len(k), " ".join(k)) for i, (w, k) in want.items()}


def test_clean_texts_can_stay_as_they_are(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a\n\nb  {passage}", *[None] * 6), (2, f"c {passage} d", *[None] * 6), (3, "left\t alone ", *[None] * 6), (4, passage, *[None] * 6), (4, passage, *[None] * 6)]
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in sd.remove_repeats(documents(spark, rows), keep_clean=True).collect())
    assert got == [(1, 0, f"a\n\nb  {passage}"), (2, 60, "c d"), (3, 0, "left\t alone "), (4, 60, ""), (4, 60, "")]


def test_words_of_two_letters_do_not_collide():
    """Sums over powers modulo 2**64 cancel out on this pair, whatever the codes of a and b are."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    w = split_words(*string_bytes(pa.array([f"{a} {b}"], pa.string())))
    assert w.hash[0] != w.hash[1] and w.other[0] != w.other[1]
    words = np.array([w.hash[0], w.hash[1]])[[int(bin(i).count("1") % 2) for i in range(64)]]
    flipped = words[::-1]
    for k in (2, 5, 50, 64):
        one, two = window_hash(words, np.array([0]), k), window_hash(flipped, np.array([0]), k)
        assert (words[:k] == flipped[:k]).all() or one != two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3]), min_size=1, max_size=40), st.integers(1, 40))
def test_window_hashes_tell_windows_apart(words, k):
    h = np.array(words, np.uint64)
    at = np.arange(max(0, len(h) - k + 1))
    got = window_hash(h, at, k)
    for i in at:
        for j in at:
            assert (got[i] == got[j]) == (words[i : i + k] == words[j : j + k])


def test_hot_classes_join_whole(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i, 0 if i < 20 else i // 3) for i in range(60)], "id long, k long")
    classes = rows.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    got = sorted((r.id, r.rep) for r in skew.join_classes(rows, classes, ["k"]).collect())
    by: dict = {}
    for i in range(60):
        by.setdefault(0 if i < 20 else i // 3, []).append(i)
    assert got == sorted((i, min(v)) for v in by.values() if len(v) > 1 for i in v)
