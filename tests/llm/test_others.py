import datetime
import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from helpers import SCHEMA, awkward, components, documents
from pyspark.sql import functions as F

from medlake.llm import epsilon_join, language_id, order_minhash, url_filter, warc, zip_ranges
from medlake.plans.shared import new_path

SF = "/root/testdata/sf0.01"


def test_zip_both_ways():
    for wide in (False, True):
        sink = io.BytesIO()
        z = zip_ranges.StoredWriter(sink, wide)
        z.add("a/b.txt", [b"hello ", b"world"])
        z.add("ü", [])
        z.open("late")
        z.write(b"one ")
        z.write(b"two")
        z.shut()
        z.close()
        with zipfile.ZipFile(io.BytesIO(sink.getvalue())) as other:
            assert other.namelist() == ["a/b.txt", "ü", "late"] and other.read("late") == b"one two" and other.read("a/b.txt") == b"hello world" and other.testzip() is None
        members = zip_ranges.directory(sink, len(sink.getvalue()))
        at = zip_ranges.data_at(sink, members[0])
        assert sink.getvalue()[at : at + members[0].size] == b"hello world"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 100)
        z.comment = b"PK\x05\x06 in a comment"
    m = zip_ranges.directory(other, len(other.getvalue()))[0]
    with pytest.raises(ValueError):
        zip_ranges.data_at(other, m)
    with pytest.raises(ValueError):
        zip_ranges.directory(io.BytesIO(b"no package"), 10)


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "u 1", big, "x"), (2, None, big, "x"), (3, "a", big, "x"), (None, "b", big, "x"), (5, "c", None, "x"), (6, "c", "", "x"), (7, "d", "s", "x"), (8, "d", "s", "x"), (9, "e", "z" * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for wide in (False, True):
        packages = warc.write_packages(warc.mark_revisits(df), new_path(spark, "t"), roll_bytes=300, wide=wide)
        got = {r.page_id: r for r in warc.read_packages(packages, payload=True, task_records=2).collect()}
        assert len(got) == len(rows)
        for own, _, html, _ in rows:
            raw, r = (html or "").encode(), got[own]
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            revisit = own in (1, 2)
            assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
            assert bytes(r.payload) == (b"" if revisit else raw)
    assert warc.round_trip(df.limit(0)).count() == 0
    again = warc.round_trip(df.union(df)).collect()  # repeated ids: each row is a record
    assert len(again) == 2 * len(rows) and {r.refers_to for r in again if r.page_id in (1, 2)} == {3} and all(r.record_type == "response" for r in again if r.page_id == 3)


def test_warc_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "body " * 300)], "page_id long, url string, html string").coalesce(1)
    packages = warc.write_packages(warc.mark_revisits(df), f"file://{tmp_path}/p")
    path = next((tmp_path / "p").glob("*.wacz"))
    whole = path.read_bytes()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.getinfo(warc.ARCHIVE).compress_type == 0
    for at in (100, whole.index(b"20240101000000")):  # in the record, in the index
        path.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(Exception):
            warc.read_packages(packages).collect()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out(F.col("doc_id"))).collect()
    assert all(language_id.crc32_text(r.doc_id) % 4 == 2 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.99
    odd = {r.doc_id: r for r in language_id.predict(documents(spark, awkward()), model).collect()}
    assert len(odd) == len(awkward())
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and not odd[i].accepted for i in (0, 1, 2, 11))
    assert odd[6].lang_pred != "und" and 0 <= odd[6].score <= 1
    kept = language_id.keep_accepted(documents(spark, awkward()), model)
    assert kept.columns == documents(spark, awkward()).columns and not {0, 1, 2, 11} & {r.doc_id for r in kept.collect()}
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs.limit(3), none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_url_filter(spark):
    day = lambda n: datetime.date(2024, 1, n)
    entries = [("bad.com", day(5), "add", "x"), ("bad.com", day(10), "remove", None), ("bad.com", day(20), "add", "y"), ("a.bad.com", day(6), "add", "z"), ("ok.org/p", day(1), "add", "p"), ("tie.net", day(3), "add", "t"), ("tie.net", day(3), "remove", "t"), (None, day(1), "add", "n"), ("null.at", None, "add", "n")]
    rows = [(1, "http://bad.com/", 4), (2, "http://bad.com/", 5), (3, "http://bad.com/", 10), (4, "HTTPS://u@A.bad.com:8/x", 7), (5, "http://b.bad.com", 25), (6, "http://ok.org/p/q", 2), (7, "http://ok.org/q", 2), (8, "http://tie.net", 9), (9, None, 9), (10, "not a url", 9), (11, "http://bad.com/", None), (2, "http://bad.com/", 5)]
    caps = spark.createDataFrame([(i, u, None if d is None else day(d), "key", "cat") for i, u, d in rows], "page_id long, url string, fetched_at date, key string, category string")
    lists = spark.createDataFrame(entries, "key string, at date, action string, category string")
    got = url_filter.filter_urls(caps, lists, "page_id").collect()
    assert len(got) == len(rows)
    addresses = [("10.1.2.3", day(1), "add", "ip"), ("2.3", day(1), "add", "no parent"), ("[::1]", day(1), "add", "six"), ("[", day(1), "add", "no")]
    asked = spark.createDataFrame([(1, "http://10.1.2.3:80/x", day(2)), (2, "http://9.1.2.3/", day(2)), (3, "http://[::1]:8080/a", day(2)), (4, "http://[::2]/a", day(2))], "page_id long, url string, fetched_at date")
    own = {r.page_id: r.matched_key for r in url_filter.filter_urls(asked, spark.createDataFrame(addresses, "key string, at date, action string, category string"), "page_id").collect()}
    assert own == {1: "10.1.2.3", 2: None, 3: "[::1]", 4: None}
    want = {1: None, 2: "bad.com", 3: None, 4: "a.bad.com", 5: "bad.com", 6: "ok.org/p", 7: None, 8: None, 9: None, 10: None, 11: None}
    assert all(r.matched_key == want[r.page_id] and r.blocked == (want[r.page_id] is not None) for r in got)
    assert url_filter.filter_urls(caps.limit(0), lists, "page_id").count() == 0
    assert not any(r.blocked for r in url_filter.filter_urls(caps, lists.limit(0), "page_id").collect())


def test_as_of_join_matches_every_interval(spark):
    """Many intervals and times of few keys, one of them hot, against a look at every interval."""
    r = random.Random(6)
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    entries = [(f"k{min(r.randrange(9), 2)}.com", at(r.randrange(5000)), r.choice(["add", "add", "remove"]), f"c{i}") for i in range(400)]
    caps = [(i, f"http://k{min(r.randrange(9), 3)}.com/p{r.randrange(3)}", at(r.randrange(-100, 5200))) for i in range(2000)]
    lists = spark.createDataFrame(entries, "key string, at timestamp, action string, category string")
    got = {x.page_id: (x.blocked, x.category, x.listed_since) for x in url_filter.filter_urls(spark.createDataFrame(caps, "page_id long, url string, fetched_at timestamp"), lists, "page_id").collect()}
    for i, url, t in caps:
        own = [e for e in entries if e[0] == url.split("/")[2] and e[1] <= t]
        last = max((e[1] for e in own), default=None)
        now = sorted((e[2] != "add", e[3]) for e in own if e[1] == last)
        want = (True, now[-1][1], last) if now and not now[-1][0] else (False, None, None)
        assert got[i] == want, (i, url, t)


def test_epsilon_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    x = [(centre[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])).tolist() for i in range(300)]
    x += [x[0]] * 40
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, [], 1), (1005, [1.0, 0.0], 1), (1006, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    a = np.array(x, np.float32).astype(float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    hit = a @ a.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = components(list(range(len(x))), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(hit)))])
    for block in (4096, 50):
        got = {r.vec_id: r for r in epsilon_join.near_vectors(df, 0.9, block=block).collect()}
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum(), comp[i], comp[i] == i) for i in range(len(x)))
        assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(1000, 1005))
        assert (got[1005].n_links, got[1006].component_id) == (1, 1005)
    assert epsilon_join.near_vectors(df.limit(0)).count() == 0


def test_links_of_earlier_leaves_stay(spark):
    """Sparse chains of several thousand vectors: most trees are met in more than one leaf."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 1, 16)) + np.cumsum(0.35 * rng.normal(size=(60, 50, 16)), axis=1)
    x = x.reshape(-1, 16)[rng.permutation(3000)].astype(np.float32).astype(float)
    a = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = np.triu(a @ a.T >= 0.9, 1)
    links = hit.sum(0) + hit.sum(1)
    comp = components(list(range(len(x))), [(int(i), int(j)) for i, j in zip(*np.nonzero(hit))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for block in (4096, 700):
        got = {r.vec_id: r for r in epsilon_join.near_vectors(df, 0.9, block=block).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], comp[i], comp[i] == i) for i in range(len(x))}


def test_order_minhash(spark):
    rows = awkward([("the quick brown fox jumps over the lazy dog " * 20, "en", "s", 1, "z", 1, "r"), (" ".join(f"w{i}" for i in range(400)), "en", "s", 1, "z", 1, "r")])
    got = {r.doc_id: r for r in order_minhash.compare_edits(documents(spark, rows).repartition(4), ranges=5).collect()}
    ids = sorted(got)
    texts = {r[0]: r[1] or "" for r in rows}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[a], len(texts[a]) // 4
        edited = t[: len(t) - n] + texts[b][:n]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
        same = lambda x, y: sum(x[i : i + 16] == y[i : i + 16] for i in range(0, len(x), 16)) * 16 / len(x)
        assert abs(got[a].near_next - same(got[a].fingerprint, got[b].fingerprint)) < 1e-9
        assert abs(got[a].near_edited - same(got[a].fingerprint, got[a].edited_fingerprint)) < 1e-9
    assert got[9].fingerprint == got[10].fingerprint and got[9].near_next == 1
    assert got[0].fingerprint == got[1].fingerprint
    assert got[101].near_edited > got[101].near_next
    assert order_minhash.compare_edits(spark.createDataFrame([], SCHEMA), ranges=3).count() == 0


def plain_fingerprint(text, k=order_minhash.K, l=order_minhash.L, m=order_minhash.M):  # noqa: E741
    """Order MinHash in plain Python: for each order, sort all numbered k-mers by their way round the ring."""
    import regex
    import xxhash

    def xx(*parts):
        seed = 42
        for x in parts:
            if x is not None:
                seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x % 2**64).to_bytes(8, "little"), seed)
        return seed - 2**64 if seed >= 2**63 else seed

    p = regex.findall(order_minhash.PIECES, text)
    seen, items = {}, []
    for i in range(len(p)):
        h = xx(*(p[i + n] if i + n < len(p) else None for n in range(k)))
        items.append((xx(h, seen.get(h, 0)), i))
        seen[h] = seen.get(h, 0) + 1
    if not items:
        return [xxhash.xxh64_intdigest(j.to_bytes(4, "little"), 42) for j in range(1, m + 1)]
    out = []
    for c in order_minhash.ring_points(m):
        near = sorted(items, key=lambda x: ((x[0] - c) % 2**64, x[1]))
        chosen = [near[t % len(near)] for t in range(l)]
        out.append(xx(*(o for _, o in sorted((i, o) for o, i in chosen))))
    return out


def test_fingerprints_match_brute_force(spark):
    r = random.Random(2)
    texts = ["", "a", "a a", "a b a b a b", "x" * 50, "日本語のテキスト" * 9, "if(a==b){return c+d;}" * 4, "é\tü  ß\n", "0123456789abcdef" * 3]
    texts += [" ".join(r.choice(["w", "word", "another", "internationalization"]) + str(r.randrange(n)) for _ in range(n)) for n in (3, 30, 300, 3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", order_minhash.fingerprint(F.col("text")).alias("f")).collect()
    for row in got:
        assert [x % 2**64 for x in row.f] == [x % 2**64 for x in plain_fingerprint(texts[row.i])], texts[row.i][:40]


def test_fingerprints_follow_edit_distance(spark):
    """Means over many texts, of any length: few edits stay near, the same words in another order do not."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 400, 3000]))]
        edited, moved = words[:], words[:]
        for _ in range(len(words) // 50):
            edited[r.randrange(len(words))] = "other"
        r.shuffle(moved)
        half = words[: len(words) // 2] + [f"v{r.randrange(10**6)}" for _ in range(len(words) // 2)]
        run = "".join(words)
        rows.append((i, " ".join(words), " ".join(edited), " ".join(half), " ".join(moved), run, "x" + run))
    df = spark.createDataFrame(rows, "i int, a string, edited string, half string, moved string, run string, shifted string")
    near = lambda a, b: order_minhash.likeness(order_minhash.fingerprint(F.col(a)), order_minhash.fingerprint(F.col(b)))
    got = df.agg(*(F.avg(near(a, b)).alias(b) for a, b in (("a", "edited"), ("a", "half"), ("a", "moved"), ("run", "shifted")))).first()
    assert got.edited > 0.8 and 0.05 < got.half < 0.35 and got.moved < 0.02 and got.shifted > 0.9


def test_next_texts_with_null_and_repeated_ids(spark):
    rows = [(None, t, *[None] * 6) for t in ("p q", "p q", "r s t u", "v")] + [(i // 2, f"t{i} " * (i + 1), *[None] * 6) for i in range(21)]
    got = order_minhash.compare_edits(documents(spark, rows).repartition(3), ranges=4).collect()
    one = order_minhash.compare_edits(documents(spark, rows), ranges=1).collect()
    key = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256, r.near_next) for r in rs)
    assert len(got) == len(rows) and key(got) == key(one)
