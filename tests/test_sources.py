import numpy as np
from pyspark.sql import functions as F

from medlake.sources import readers as rd
from medlake.streaming import resume


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,code,note\n1,250.10,"two\nlines"\n2,,x\n')
    df = rd.read_csv(spark, str(tmp_path / "a.csv"), rd.all_text(["id", "code", "note"]), columns=["code", "note"])
    assert [tuple(r) for r in df.collect()] == [("250.10", "two\nlines"), (None, "x")]
    (tmp_path / "b.txt").write_text("id\tcode\n1\t2\n")
    assert rd.sniff_separator(spark, str(tmp_path / "b.txt")) == "\t"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\nbroken\n{"id": "b"}\n')
    good, bad = rd.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int")
    assert sorted((r.id, r.n) for r in good.collect()) == [("a", 1), ("b", None)]
    assert [r.value for r in bad.collect()] == ["broken"]


def test_arrays_and_listing(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    np.savez(tmp_path / "y.npz", emb=x)
    assert [r.v for r in rd.read_arrays(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == x.tolist()
    assert rd.read_arrays(spark, str(tmp_path / "y.npz"), "emb").count() == 4
    files = rd.list_files(spark, str(tmp_path), "*.np?")
    assert {r.name for r in files.collect()} == {"x.npy", "y.npz"}
    want = spark.createDataFrame([("x",), ("z",)], "k string").withColumn("file", rd.native_path("{k}.npy", k=F.col("k")))
    assert [r.k for r in rd.existing(want, files, "file").collect()] == ["x"]


def test_xml_and_markdown(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<all><roi><name>a</name><area>1.5</area></roi><roi><name>b</name></roi></all>")
    df = rd.read_xml(spark, str(tmp_path / "r.xml"), "roi", "name string, area double").orderBy("name")
    assert [tuple(r) for r in df.collect()] == [("a", 1.5), ("b", None)]
    assert rd.markdown(df).splitlines()[2] == "| a | 1.5000 |"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:01:00"), ("b", 1, "2024-01-01 00:02:00")], "k string, v int, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    resume.append_new(stream, "k", "at", "1 hour", str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    resume.upsert_summary(stream, ["k"], "v", str(tmp_path / "sum"), str(tmp_path / "c2")).awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "sum" / "0")).collect()} == {("a", 2), ("b", 1)}
