import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from medlake.llm import packing, sentencepiece_codec, token_counts
from medlake.llm.word_tokens import WordIds
from medlake.plans.shared import small_batches

P = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = st.text(alphabet=" \n\t'sStTdaeéÀİßſ日🙂12.,!▁́<|endoftext|>\x85\xa0\x00", max_size=40)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_equal_the_library(library, text):
    c = sentencepiece_codec.codec(PIECE)
    ids = np.frombuffer(c.encode(text), "<i4").tolist()
    assert ids == library[0].encode(text, add_eos=True)
    assert c.decode(ids) == library[0].decode(ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_and_bytes_equal_the_library(library, text):
    for make, own in ((WordIds, library[1]), (token_counts.ByteIds, library[2])):
        t = CACHE.setdefault(make, None) or CACHE.update({make: make(WORD if make is WordIds else BYTE)}) or CACHE[make]
        ids = np.frombuffer(t.encode(text), "<u4").tolist()
        assert ids == own.encode(text, add_special_tokens=False).ids
    assert t.lengths[np.array(ids, int)].sum() == len(text.encode())


CACHE: dict = {}


def test_codec_rows(spark, library):
    df = documents(spark, awkward() + [(None, "null id", *[None] * 6), (3, "again", *[None] * 6)])
    got = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(df, PIECE), PIECE).collect()
    want = sorted((str(r.doc_id), library[0].encode(r.text or "", add_eos=True)) for r in df.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(r.decoded == library[0].decode(list(r.ids)) for r in got)
    assert sentencepiece_codec.encode_texts(spark.createDataFrame([], SCHEMA), PIECE).count() == 0


def check_packing(rows, texts, library, window):
    """``texts`` maps ids to lists of texts."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    ids = {i: [np.array([*library[1].encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in ts] for i, ts in texts.items()}
    assert by.keys() == ids.keys()
    for i, pieces in by.items():
        assert sum(r.length for r in pieces) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            pieces.sort(key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in pieces) == ids[i][0].tobytes()
            assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
            assert all(zlib.crc32(bytes(r.ids)) == zlib.crc32(ids[i][0][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[i][0]) for r in pieces)
    seq: dict = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for s in sorted(seq):
        at = 0
        for offset, n in sorted(seq[s]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sorted(seq) == list(range(len(seq)))
    assert all(n == window for n in sizes[:-1]) and 0 < sizes[-1] <= window


def test_packing_is_whole(spark, library):
    extra = [("lorem ipsum dolor " * (i % 9 * 30 + 1), "en", "hot" if i % 3 else f"s{i % 7}", 1, "z", 1, "r") for i in range(80)]
    rows = awkward(extra)
    for window, packet in ((64, 16), (128, 128), (2048, 256)):
        got = packing.pack(documents(spark, rows).repartition(5), WORD, window=window, packet=packet).collect()
        check_packing(got, {r[0]: [r[1]] for r in rows}, library, window)
    twice = documents(spark, rows + rows[:5] + [(None, "null id", *[None] * 6)])
    check_packing(packing.pack(twice, WORD, window=64, packet=16).collect(), {**{r[0]: [r[1]] * (2 if i < 5 else 1) for i, r in enumerate(rows)}, None: ["null id"]}, library, 64)
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_windows_keep_the_mixture(spark):
    rows = [(i, "lorem ipsum dolor sit amet " * 20, None, "a" if i % 4 else "b", 1, "z", 1, "r") for i in range(200)]
    got = packing.pack(documents(spark, rows), WORD, window=1024, packet=64).collect()
    source = {r[0]: r[3] for r in rows}
    seq: dict = {}
    for r in got:
        seq.setdefault(r.sequence_id, {"a": 0, "b": 0})[source[r.doc_id]] += r.length
    whole = [s for s in seq.values() if sum(s.values()) == 1024]
    assert len(whole) > 10 and all(abs(s["b"] / 1024 - 0.25) <= 2 * 64 / 1024 for s in whole)


def test_target_shares_hold_until_a_queue_runs_dry(spark, library):
    """Shares of 3 to 1, a source without a target, and one that is short: windows keep the target while both have tokens."""
    text = "lorem ipsum dolor sit amet " * 20
    rows = [(i, text, None, "a", 1, "z", 1, "r") for i in range(60)] + [(100 + i, text, None, "b", 1, "z", 1, "r") for i in range(60)] + [(200 + i, text, None, "c" if i else None, 1, "z", 1, "r") for i in range(5)]
    got = packing.pack(documents(spark, rows), WORD, window=512, packet=32, shares={"a": 3.0, "b": 1.0}).collect()
    check_packing(got, {r[0]: [r[1]] for r in rows}, library, 512)
    source = {r[0]: r[3] for r in rows}
    seq: dict = {}
    for r in got:
        seq.setdefault(r.sequence_id, {}).setdefault(source[r.doc_id], []).append(r.length)
    total = sum(r.length for r in got if source[r.doc_id] == "a")
    dry = int(total / 0.75 / 512)  # windows until queue a is empty
    for s in range(dry - 1):
        assert abs(sum(seq[s].get("a", [])) / 512 - 0.75) <= 2 * 32 / 512 and set(seq[s]) == {"a", "b"}
    carried = sum(sum(seq[s].get("a", [])) for s in range(dry - 1))
    assert abs(carried - 0.75 * 512 * (dry - 1)) <= 2 * 32  # deficits are carried on, not lost
    last = [s for s in seq if "c" in seq[s] or None in seq[s]]
    assert min(last) > dry - 2 and max(last) == max(seq)  # sources without a target come last


def test_a_text_beyond_a_batch(spark, library):
    """One text of some 9 MB, longer than a slice and an Arrow batch, beside small ones."""
    r = np.random.default_rng(1)
    words = ["".join(chr(97 + x) for x in r.integers(0, 26, 6)) for _ in range(500)]
    long = " ".join(words[i] for i in r.integers(0, 500, 1_300_000))
    rows = [(1, "small one", None, "a", 1, "z", 1, "r"), (2, long, None, "a", 1, "z", 1, "r"), (3, "small two", None, "b", 1, "z", 1, "r")]
    small_batches(spark)
    got = packing.pack(documents(spark, rows), WORD).collect()
    check_packing(got, {x[0]: [x[1]] for x in rows}, library, 2048)
    ids = {x.doc_id: list(x.ids) for x in sentencepiece_codec.encode_texts(documents(spark, rows), PIECE).collect()}
    assert ids[2] == library[0].encode(long, add_eos=True) and ids[3] == library[0].encode("small two", add_eos=True)


def test_allocation_rules():
    lengths, ends = np.array([2, 4, 3]), np.array([3, 5, 9])  # the second token covers bytes 2 to 5
    assert token_counts.allocate(lengths, ends, "first")[0].tolist() == [0, 0, 2]
    assert token_counts.allocate(lengths, ends, "last")[0].tolist() == [0, 2, 2]
    own, cross = token_counts.allocate(lengths, ends, "most")
    assert own.tolist() == [0, 1, 2] and cross.tolist() == [False, True, False]
    assert token_counts.allocate(lengths, np.array([4, 4, 9]), "most")[0].tolist() == [0, 0, 2]


def test_section_counts_add_up(spark, library):
    rows = awkward([("\n\n a\n\n\nb \n", "en", "s\n", 1, "z", 1, "r")])
    for rule in token_counts.RULES:
        got = token_counts.section_tokens(documents(spark, rows), BYTE, ["source", "lang", "text"], rule).collect()
        for r in rows:
            own = [g for g in got if g.doc_id == r[0]]
            text = "\n".join(x or "" for x in (r[3], r[2], r[1]))
            assert sum(g.n_tokens for g in own) == len(library[2].encode(text, add_special_tokens=False).ids)
            assert sum(g.n_bytes for g in own) == len(text.encode())
            assert sorted(g.section for g in own) == list(range(len(own)))
    with pytest.raises(ValueError):
        token_counts.section_tokens(documents(spark, rows), BYTE, ["text"], "other")
    assert token_counts.section_tokens(spark.createDataFrame([], SCHEMA), BYTE, ["text"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "   ", "▁", "a", "the", "\n", "日"]), max_size=60))
def test_runs_of_spaces_go_through_the_table(library, parts):
    c, text = sentencepiece_codec.codec(PIECE), "".join(parts)
    assert np.frombuffer(c.encode(text), "<i4").tolist() == library[0].encode(text, add_eos=True)


def test_long_texts_and_small_memos_give_the_same_ids(library, monkeypatch):
    r = np.random.default_rng(0)
    text = " ".join("".join(chr(97 + x) for x in r.integers(0, 26, r.integers(1, 12))) for _ in range(20_000)) + " " * 5000
    want = library[0].encode(text, add_eos=True)
    monkeypatch.setattr(sentencepiece_codec, "MEMO", 400)
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 100)
    c = sentencepiece_codec.Codec(PIECE)
    assert np.frombuffer(c.encode(text), "<i4").tolist() == want
    assert c.decode(want) == library[0].decode(want) == text.rstrip(" ") + " " * 5000
