"""Study designs, probes, report rules and the sources that no query reads."""

import gzip
import math
import os
import plistlib
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medlake.functions import clip
from medlake.functions import text as tx
from medlake.operators import evaluation, ml, probes, relational, rules, studies, textmine
from medlake.plans.cache import cached, content_key
from medlake.plans.ordinal import with_ordinal
from medlake.sources import readers as rd
from medlake.streaming import calls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ordinals_are_global(spark):
    got = with_ordinal(spark.range(1000).repartition(7), [-F.col("id")]).collect()
    assert all(r.ordinal == 999 - r.id for r in got) and len(got) == 1000
    assert with_ordinal(spark.range(0), [F.col("id")]).count() == 0


def test_splits_match_their_definition(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"c{i % 3}") for i in range(200)], "k int, c string")
    got = relational.share_split(rows, "k", {"test": 0.25, "train": 0.75}, "x", by=["c"], least=1).collect()
    assert len(got) == 200
    for c in {r.c for r in got}:
        n = sum(r.c == c for r in got)
        assert sum(r.c == c and r.part == "test" for r in got) == max(1, round(n * 0.25))


def test_cache_is_keyed_by_content(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.read.parquet(str(tmp_path / "in")).selectExpr("sum(id) as s")
    first = cached(read(), "t", str(tmp_path / "cache"))
    assert first.first().s == 10 and content_key(read()) == content_key(read()) != content_key(read(), "other")
    folders = set((tmp_path / "cache").iterdir())
    assert cached(read(), "t", str(tmp_path / "cache")).first().s == 10 and set((tmp_path / "cache").iterdir()) == folders
    (folders.pop() / "_SUCCESS").unlink()  # a run that was lost halfway
    assert cached(read(), "t", str(tmp_path / "cache")).first().s == 10
    spark.range(7).write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert cached(read(), "t", str(tmp_path / "cache")).first().s == 21


def test_checks_raise(spark):
    rows = spark.createDataFrame([(0,), (5,), (None,)], "k int")
    with pytest.raises(ValueError, match="outside"):
        relational.require(rows, {"outside": relational.in_range(F.col("k"), 5)})
    assert relational.require(rows, {"negative": F.col("k") < 0}).count() == 3
    with pytest.raises(ValueError, match="lacking|columns"):
        relational.profile(rows, {}, ["k", "text"])
    with pytest.raises(ValueError, match="3 arrays but 2 texts"):
        relational.paired({"a": (rows, rows.limit(2))}, "k", "text")


def linkage(d):
    """Complete linkage by its definition."""
    clusters, out = [[i] for i in range(len(d))], []
    while len(clusters) > 1:
        gap, i, j = min((max(d[a][b] for a in x for b in y), min(min(x), min(y)), max(min(x), min(y))) for k, x in enumerate(clusters) for y in clusters[k + 1 :])
        x, y = (next(c for c in clusters if min(c) == m) for m in (i, j))
        out.append((i, j, gap, len(x) + len(y)))
        clusters = [c for c in clusters if c not in (x, y)] + [x + y]
    return out


def test_complete_linkage(spark):
    rng = np.random.default_rng(1)
    for points in (rng.normal(size=(12, 3)), rng.integers(0, 3, (9, 2)).astype(float)):
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
        pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))], "a int, b int, distance double")
        got = [(r.a, r.b, r.height, r.size) for r in studies.complete_linkage(pairs).orderBy("step").collect()]
        assert [(a, b, round(h, 9), n) for a, b, h, n in got] == [(a, b, round(h, 9), n) for a, b, h, n in linkage(d)]
    with pytest.raises(ValueError):
        studies.complete_linkage(pairs, labels=3)


def test_barycentre_weights(spark):
    near = spark.createDataFrame([(1, 10, 0.0), (1, 11, 0.0), (1, 12, 5.0), (2, 10, 1.0), (2, 12, 1.0)], "query_id int, bank_id int, distance double")
    places = spark.createDataFrame([(10, 0.0, 0.0), (11, 2.0, 0.0), (12, 1.0, 9.0)], "bank_id int, x double, y double")
    got = {r.query_id: (r.x, r.y) for r in studies.barycentre(near, places).collect()}
    assert got[2] == pytest.approx((0.5, 4.5)) and got[1][0] == pytest.approx(1.0) and 0 <= got[1][1] < 1


def test_first_fit_and_parts_on_hand_cases(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("b", 1, 4), ("c", 2, 3), ("d", 3, 3)], "n string, o int, s int")
    assert {r.n: r.bin for r in studies.first_fit(rows, "n", "s", ["o"], 2).collect()} == {"a": 0, "b": 1, "c": 0, "d": 1}
    got = {r.n: r.part for r in studies.contiguous_parts(rows, "n", "s", ["o"], 2).collect()}
    loads = [sum(s for n, _, s in (("a", 0, 5), ("b", 1, 4), ("c", 2, 3), ("d", 3, 3)) if got[n] == p) for p in (0, 1)]
    assert max(abs(x - 7.5) for x in loads) == 1.5


def test_report_rules(spark):
    status = lambda text, p, veto="": one(spark, textmine.status(tx.sentences(F.lit(text)), p, veto))
    eff, nod = textmine.CHEST["pleural_effusion"], textmine.CHEST["lung_nodule"]
    assert status("No pleural effusion.", *eff) == 0
    assert status("No consolidation, mass or pleural effusion.", *eff) == 0
    assert status("No fever but pleural effusion.", *eff) == 1
    assert status("Possible pleural effusion.", *eff) == -1
    assert status("Pleural effusion cannot be excluded.", *eff) == 0  # "excluded" negates first
    assert status("Pleural effusion versus thickening.", *eff) == -1
    assert status("No significant change in pleural effusion.", *eff) == 1
    assert status("Pleural effusion has resolved. Pleural effusion is noted.", *eff) == 1
    assert status("Nodules: none.", *nod) == 0 and status("Thyroid nodule.", *nod) == 0 and status("A nodule.", *nod) == 1
    assert status("", *nod) == 0
    assert one(spark, F.size(textmine.finding_status(F.lit(None).cast("array<string>"), textmine.CHEST | textmine.ABDOMEN))) == 48
    assert len(textmine.CHEST) == 18 and len(textmine.ABDOMEN) == 30


def test_anatomy_scopes(spark):
    scopes = {"CHEST": (["lung", "pleura"], 2), "ABDOMEN": (["liver", "spleen"], 2)}
    get = lambda t: tuple(one(spark, textmine.anatomy(F.lit(t), scopes, [("device", "DEVICE")])))[:4]
    assert get("lung and pleura near liver") == ("CHEST", 4, "primary", False)
    assert get("lesion with liver disease") == ("ABDOMEN", 2, "full", False)
    assert get("lung lesion due to liver and spleen") == ("CHEST", 2, "primary", False)
    assert get("liver lung") == ("ABDOMEN", 2, "primary", False)
    assert get("lung device") == ("DEVICE", 0, "override", False)
    assert get("nothing")[0] == "NONE" and get(None)[0] == "NONE"
    assert tuple(one(spark, textmine.anatomy(F.lit("aorta"), {"A": (["aort"], 1), "B": (["aorta"], 1)})))[:4] == ("OTHER", 1, "primary", True)


def test_profiles_resolve_in_order(spark):
    a, b = rules.Profile(direct=("x",)), rules.Profile(direct=("y",))
    get = lambda label, kind, text: tuple(one(spark, rules.resolve(F.lit(text), F.lit(label), F.lit(kind), [("lung", "ct", a), ("lung", None, b)])))[:2]
    assert get("lung", "ct", "x") == (0, "direct") and get("lung", "mr", "x") == (1, "rejected") and get("heart", "ct", "x") == (-1, "rejected")


def test_sections_and_unicode(spark):
    text = "Intro. Technique: helical scan.\nFindings: clear lungs.\nComparison Study: none\nImpression: fine"
    got = one(spark, tx.drop_sections(F.lit(text), ["technique", "comparison"]))
    assert "helical" not in got and "none" not in got and "clear lungs." in got and "Impression: fine" in got and got.startswith("Intro")
    assert one(spark, tx.nfkc(F.lit("  ﬁbrosis  ①  É́ "))) == "fibrosis 1 é́"
    assert one(spark, tx.nfkc(F.lit("Plain  TEXT"))) == "plain text" and one(spark, tx.nfkc(F.lit(None).cast("string"))) is None
    assert one(spark, tx.tex(F.lit("a\\b {c} ~^ 5%"))) == r"a\textbackslash{}b \{c\} \textasciitilde{}\textasciicircum{} 5\%"


def test_welch_against_known_values(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    rows = spark.createDataFrame([("g", 1, x) for x in b] + [("g", 0, x) for x in a], "l string, g int, v double")
    got = evaluation.welch(rows, ["l"], "g", "v").first().asDict()
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    t = (np.mean(b) - np.mean(a)) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    grid = np.linspace(abs(t), abs(t) + 400, 2_000_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
    tail = float(((density[1:] + density[:-1]) / 2 * np.diff(grid)).sum())
    assert any(abs(abs(v) - abs(t)) < 1e-6 for v in got.values() if isinstance(v, float))
    assert any(min(abs(v - tail), abs(v - (1 - tail)), abs(v - 2 * tail)) < 1e-5 for v in got.values() if isinstance(v, float))


def logistic(x, y, weight, penalty):
    """The same optimum by Newton's method."""
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ w))
        g = x1.T @ (weight * (p - y)) / weight.sum() + penalty * np.append(w[:-1], 0)
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 / weight.sum() + penalty * np.diag([1.0] * x.shape[1] + [0.0])
        w -= np.linalg.solve(h, g)
    return w


def test_probes_reach_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0.8).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    got = ml.probe(df, "v", "y").first()
    want = logistic(x, y, np.ones(300), 1 / 300)
    assert np.allclose([*got.coefficients, got.intercept], want, atol=1e-3)
    even = probes.per_label(df, "v", "y", [1, 7], balanced=True).collect()
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    assert np.allclose([*even[0].coefficients, even[0].intercept], logistic(x, y, weight, 1 / 300), atol=1e-3)
    assert even[1].coefficients == [] and even[1].intercept == pytest.approx(math.log(1e-6 / (1 - 1e-6)))
    head = probes.multilabel(df, "id", "v", "y", [0, 1]).first()
    assert head.val_auroc > 0.9 and 1 <= head.best_epoch <= head.epochs <= 30
    signs = {r.dimension: r.consistency for r in probes.bootstrap_signs(df, "id", "v", "y", seeds=4).collect()}
    assert signs == {0: 1.0, 1: 1.0, 2: 1.0}


def test_bootstrap_weights_have_mean_one(spark):
    n = spark.range(20000).select(probes.bootstrap_weight(F.col("id"), 3).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(n[0] - 1) < 0.03 and abs(n[1] - 1) < 0.05


def test_components_and_clusters(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1] + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([r.p for r in ml.pca(df, "v", 2, "p").orderBy("id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    far = spark.createDataFrame([(i, [float(i % 3) * 100 + rng.normal(), rng.normal()], i % 3) for i in range(90)], "id long, v array<double>, label int")
    found = ml.kmeans(far, "v", 3)
    assert ml.adjusted_rand(found, "label", "cluster").first().ari == pytest.approx(1.0)
    assert probes.adjusted_mutual_information(found, "label", "cluster").first().ami == pytest.approx(1.0)
    flat = spark.createDataFrame([(a, b) for a, b in zip(rng.integers(0, 4, 400).tolist(), rng.integers(0, 5, 400).tolist())], "label int, cluster int")
    assert abs(probes.adjusted_mutual_information(flat, "label", "cluster").first().ami) < 0.05


def test_ontology_plists_sheets_and_volumes(spark, tmp_path):
    ns = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"'
    (tmp_path / "o.owl").write_text(
        f'<rdf:RDF {ns}><owl:Class rdf:about="http://x/#R1"><rdfs:label xml:lang="en">organ</rdfs:label></owl:Class>'
        '<owl:Class rdf:about="http://x/#R2"><rdfs:subClassOf rdf:resource="http://x/#R1"/></owl:Class>'
        '<rdf:Description rdf:about="http://x/#R2"><rdfs:label xml:lang="en">lung</rdfs:label><rdfs:label xml:lang="de">Lunge</rdfs:label><Synonym>pulmo</Synonym><Obsolete_Name>old</Obsolete_Name></rdf:Description>'
        '<rdf:Description rdf:about="http://x/#R9"><rdfs:label>stranger</rdfs:label></rdf:Description></rdf:RDF>'
    )
    edges, terms, obsolete = rd.read_ontology(spark, str(tmp_path / "o.owl"))
    assert [tuple(r) for r in edges.collect()] == [("R1", "R2")]
    assert {tuple(r) for r in terms.collect()} == {("R1", "organ", True), ("R2", "lung", True), ("R2", "pulmo", False)}
    assert [r.node for r in obsolete.collect()] == ["R2"]

    (tmp_path / "a.plist").write_bytes(plistlib.dumps({"Images": [{"ROIs": [{"Name": "LAD", "Area": 2.0, "Max": 250}, {"Area": 1.5, "Max": 420.0}]}, {}]}))
    (tmp_path / "b.plist").write_bytes(b"<not a plist")
    rois = {(r.file[-7:], r.name, r.area, r.max_hu) for r in rd.read_roi_plists(spark, str(tmp_path / "*.plist")).collect()}
    assert rois == {("a.plist", "LAD", 2.0, 250.0), ("a.plist", "Unknown", 1.5, 420.0), ("b.plist", None, None, None)}

    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>7</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert [(r.row, list(r.cells)) for r in rd.read_excel(spark, str(tmp_path / "t.xlsx")).orderBy("row").collect()] == [(1, ["id", None, "name"]), (3, ["7", "x"])]

    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 2, 1, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.5, 2.0, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 2.0, -1.0)
    (tmp_path / "v.nii.gz").write_bytes(gzip.compress(bytes(head) + np.array([0, 1, 2, 3], "<i2").tobytes()))
    v = rd.read_nifti(spark, str(tmp_path / "v.nii.gz"), voxels=True).first()
    assert (list(v.shape), list(v.spacing), list(v.voxels)) == ([2, 2, 1], [0.5, 0.5, 2.0], [-1.0, 1.0, 3.0, 5.0]) and v.affine[10] == 2.0


def test_shards_sinks_and_tables(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 2).write.parquet(str(tmp_path / f"s{i}"))
    paths = [str(tmp_path / f"s{i}") for i in range(3)]
    assert [tuple(r) for r in rd.read_shards(spark, paths, rows=6).orderBy("id").collect()] == [(0, 0), (1, 0), (10, 1), (11, 1), (20, 2), (21, 2)]
    with pytest.raises(FileNotFoundError):
        rd.read_shards(spark, [*paths, str(tmp_path / "none")])
    with pytest.raises(ValueError):
        rd.read_shards(spark, paths, rows=7)
    df = spark.createDataFrame([('a "b" & c_d', 1.5), (None, 2.0)], "x_1 string, y double")
    for kind, read in (("csv", lambda p: spark.read.schema(df.schema).csv(p, header=True, escape='"')), ("json", spark.read.json), ("parquet", spark.read.parquet)):
        rd.write_table(df, str(tmp_path / kind), kind)
        assert read(str(tmp_path / kind)).select("x_1", "y").exceptAll(df).count() == 0
    rd.write_table(df, str(tmp_path / "json"), "append")
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    tex = rd.latex(df, "T")
    assert r"x\_1 & y \\" in tex and r'a "b" \& c\_d & 1.5000 \\' in tex and tex.startswith(r"\begin{longtable}{ll}")
    assert len(rd.markdown(spark.range(500)).splitlines()) == 502


def test_array_rows_by_ranges(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1000, 3)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    np.savez(tmp_path / "y.npz", other=np.zeros(5), emb=x)
    np.savez_compressed(tmp_path / "z.npz", emb=x)
    for path, member in (("x.npy", None), ("y.npz", "emb")):
        df = rd.read_array_rows(spark, str(tmp_path / path), member, task_rows=300)
        assert df.rdd.getNumPartitions() == 4
        assert np.array_equal(np.array([r.v for r in df.orderBy("row").collect()], np.float32), x)
    with pytest.raises(ValueError, match="compressed"):
        rd.read_array_rows(spark, str(tmp_path / "z.npz"), "emb")


def dicom(path, z, number, pixels):
    def tag(group, element, kind, value):
        value += b" " * (len(value) % 2) if kind not in (b"US", b"OW") else b""
        head = struct.pack("<HH2s", group, element, kind)
        return head + (struct.pack("<HI", 0, len(value)) if kind == b"OW" else struct.pack("<H", len(value))) + value

    body = b"".join([
        tag(0x2, 0x10, b"UI", b"1.2.840.10008.1.2.1"), tag(0x20, 0xE, b"UI", b"1.2.3"), tag(0x20, 0x13, b"IS", str(number).encode()), tag(0x20, 0x32, b"DS", f"0\\0\\{z}".encode()),
        tag(0x28, 0x10, b"US", struct.pack("<H", 2)), tag(0x28, 0x11, b"US", struct.pack("<H", 2)), tag(0x28, 0x30, b"DS", b"0.5\\0.5"), tag(0x28, 0x100, b"US", struct.pack("<H", 16)),
        tag(0x28, 0x103, b"US", struct.pack("<H", 1)), tag(0x28, 0x1052, b"DS", b"-10"), tag(0x28, 0x1053, b"DS", b"2"), tag(0x7FE0, 0x10, b"OW", np.array(pixels, "<i2").tobytes()),
    ])
    path.write_bytes(b"\0" * 128 + b"DICM" + body)


def test_dicom_series(spark, tmp_path):
    for i, z in enumerate((4.0, 0.0, 2.0)):
        dicom(tmp_path / f"{i}.dcm", z, i, [i, -i, 5, 6])
    slices = rd.read_dicom(spark, str(tmp_path / "*.dcm"))
    v = rd.stack_series(slices).first()
    assert (v.series, list(v.shape), list(v.spacing)) == ("1.2.3", [2, 2, 3], [0.5, 0.5, 2.0])
    assert list(v.voxels) == [-8.0, -12.0, 0.0, 2.0, -6.0, -14.0, 0.0, 2.0, -10.0, -10.0, 0.0, 2.0]


def test_calls_are_tried_again_and_resumed(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "late"), (3, "never"), (4, None)], "k int, t string")

    def call(text, attempt):
        if text == "never" or (text == "late" and attempt < 2):
            raise ConnectionError("busy")
        return text.upper()

    done = calls.call_each(rows, "k", "t", call, attempts=2, wait=0.0)
    assert {(r.k, r.result, r.error, r.attempts) for r in done.collect()} == {(1, "OK", None, 1), (2, "LATE", None, 2), (3, None, "ConnectionError: busy", 2), (4, None, None, 0)}
    assert {r.k for r in calls.pending(rows, done, "k").collect()} == {3, 4}


def test_clip_ids_match_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["A  cat &amp;amp; a dog", "", None, "word " * 200]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clip.token_ids(F.col("t"), path).alias("ids")).orderBy("i").collect()
    marks = [t.token_to_id("<|startoftext|>"), t.token_to_id("<|endoftext|>")]
    for r, text in zip(got, ["a cat & a dog", "", "", "word " * 200]):
        own = t.encode(text, add_special_tokens=False).ids[:75]
        assert list(r.ids) == [marks[0], *own, marks[1]] + [0] * (75 - len(own))


def test_clip_ids_of_long_and_odd_texts(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    words, other = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
    glued = str(tmp_path / "glued.json")  # a file whose tokens reach across blanks
    t = Tokenizer.from_file(words)
    t.pre_tokenizer = Tokenizer.from_file(other).pre_tokenizer
    t.save(glued)
    rare = ["é ́e", "ΣΣ Σ. Σ", "가 각", "<|startoftext|> <|endoftext|>a <|end oftext|>", "x&amp;nbsp;y", "it's 'S ' s", "12 ٣½", "中。中", "\x1c᠎ ​﻿"]
    texts = [*(r * n for r in rare for n in (1, 40)), " ".join(rare * 20), "a" * 5000, "1" * 75, "1" * 76, "1 " * 75, "1 " * 74 + "a"]
    for path in (words, glued):
        t = Tokenizer.from_file(path)
        for context in (2, 3, 77):
            got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(clip.token_ids(F.col("t"), path, context).alias("ids")).coalesce(1)
            ids = sorted(tuple(r.ids) for r in got.collect())
            own = [t.encode(clip.clean_text(x), add_special_tokens=False).ids[: context - 2] for x in texts]
            assert ids == sorted((49406, *x, 49407, *[0] * (context - 2 - len(x))) for x in own)


def test_clip_ids_hold_one_text_at_a_time(spark):
    public = pytest.importorskip("public_tokenizers")
    if not os.access("/proc/self/clear_refs", os.W_OK):
        pytest.skip("peaks of memory can't be reset here")

    def held(name: str) -> int:
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith(name)) // 1024

    @F.arrow_udf("string")
    def begin(rows: pa.Array) -> pa.Array:
        with open("/proc/self/clear_refs", "w") as f:
            f.write("5")  # the peak counts from here
        os.environ["HELD"] = str(held("VmRSS"))
        return rows

    @F.arrow_udf("long")
    def more(ids: pa.Array) -> pa.Array:
        return pa.array([held("VmHWM") - int(os.environ["HELD"])] * len(ids), pa.int64())

    text = F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" of a report ")), 500)
    rows = spark.range(0, 3000, 1, 1).select(text.alias("t"))  # one batch of 28 MB
    path = public.path("word_bpe_49k.json")
    assert rows.select(more(clip.token_ids(begin("t"), path)).alias("mb")).agg(F.max("mb")).first()[0] < 250
