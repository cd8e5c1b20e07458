"""Scans and sinks with explicit schemas: text tables, JSON lines, arrays in NPY/NPZ, XML lists, file listings."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_text(columns: list[str]) -> T.StructType:
    """A schema that keeps every column as text, so that codes such as 250.10 survive."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", columns: list[str] | None = None, broken_lines: bool = True) -> DataFrame:
    """Delimited text with a header (S1, S3); ``columns`` prunes the scan.

    Files whose fields hold no line breaks can be split between tasks: say so by ``broken_lines``.
    """
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=broken_lines, escape='"', enforceSchema=False)
    return df.select(*columns) if columns else df


def sniff_separator(spark: SparkSession, path: str, options: str = ",\t;|") -> str:
    """The most frequent of the usual separators in the header line."""
    line = spark.read.text(path).first()
    return max(options, key=line[0].count) if line else ","


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the lines that don't parse."""
    raw = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r").isNotNull() & F.expr("exists(map_values(from_json(value, 'map<string,string>')), x -> true)")
    return raw.where(good).select("r.*"), raw.where(~F.coalesce(good, F.lit(False))).select("value")


def read_arrays(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(file, row, v) from NPY files, or from one member of NPZ files (S7); a file is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                x = np.load(io.BytesIO(raw), allow_pickle=False)
                x = x[member] if member else x
                for s in range(0, len(x), 4096):
                    part = x[s : s + 4096].astype("float64").reshape(-1, int(np.prod(x.shape[1:])) if x.ndim > 1 else 1)
                    yield pd.DataFrame({"file": name, "row": np.arange(s, s + len(part)), "v": list(part)})

    return files.mapInPandas(unpack, "file string, row long, v array<double>")


def _array_head(path: str, member: str | None):
    """The open array file, where its numbers begin, its shape and its type."""
    import zipfile

    import numpy as np
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    store, inside = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    source = store.open_input_file(inside)
    if member is not None:
        with zipfile.ZipFile(source) as z:
            info = z.getinfo(f"{member}.npy" if f"{member}.npy" in z.namelist() else member)
        if info.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"{member} is compressed; only stored members have rows at known places")
        source = store.open_input_file(inside)
        source.seek(info.header_offset + 26)
        name, extra = (int.from_bytes(source.read(2), "little") for _ in range(2))
        source.seek(info.header_offset + 30 + name + extra)
    version = np.lib.format.read_magic(source)
    shape, by_column, kind = np.lib.format.read_array_header_1_0(source) if version == (1, 0) else np.lib.format.read_array_header_2_0(source)
    if by_column and len(shape) > 1:
        raise ValueError("rows of an array stored by columns aren't together")
    return source, source.tell(), shape, kind


def read_array_rows(spark: SparkSession, path: str, member: str | None = None, task_rows: int = 65_536) -> DataFrame:
    """(row, v) of one NPY file, or of a stored member of one NPZ file, by byte ranges.

    Only the header is read on the driver; each task reads its own rows, so an array may
    be larger than any worker's memory.
    """
    import numpy as np

    source, _, shape, _ = _array_head(path, member)
    source.close()
    starts = spark.range(0, max(shape[0], 1), task_rows, max(1, -(-shape[0] // task_rows)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, at, shape, kind = _array_head(path, member)
        width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
        for b in batches:
            for first in b["id"]:
                for s in range(first, min(first + task_rows, shape[0]), 4096):
                    n = min(4096, first + task_rows - s, shape[0] - s)
                    source.seek(at + s * width * kind.itemsize)
                    x = np.frombuffer(source.read(n * width * kind.itemsize), kind).astype("float64").reshape(n, width)
                    yield pd.DataFrame({"row": np.arange(s, s + n), "v": list(x)})

    return starts.mapInPandas(work, "row long, v array<double>")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of XML files as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name) of the files under a folder that match a glob (S12); contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def existing(expected: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Rows whose expected file is there."""
    return expected.join(files.select(F.col("name").alias(name)).distinct(), name, "left_semi")


def native_path(template: str, **parts: Column) -> Column:
    """A path from a template such as ``root/{a}/{b}.nii.gz``."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        out += [F.lit(text), parts[key].cast("string")]
    return F.concat(*out, F.lit(rest))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows with the latest version of each key."""
    from medlake.operators.relational import keep_one

    return keep_one(old.unionByName(new), keys, [F.col(version).desc()])


def read_shards(spark: SparkSession, paths: list[str], rows: int | None = None, column: str = "shard") -> DataFrame:
    """Parquet shards in the given order under one column of their places.

    A missing shard is an error, and so is another number of rows than ``rows``.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]
    if missing:
        raise FileNotFoundError(f"missing shards: {missing}")
    parts = [spark.read.parquet(p).withColumn(column, F.lit(i)) for i, p in enumerate(paths)]
    out = reduce(DataFrame.unionByName, parts)
    if rows is not None and (found := out.count()) != rows:
        raise ValueError(f"{found} rows in the shards, {rows} expected")
    return out


def _shown(x: object) -> str:
    return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def markdown(rows: DataFrame) -> str:
    """A table as Markdown, all of its rows (S18); for summaries, as the text is one value."""
    line = lambda xs: "| " + " | ".join(map(_shown, xs)) + " |"
    return "\n".join([line(rows.columns), line(["-"] * len(rows.columns)), *map(line, rows.toLocalIterator())])


def latex(rows: DataFrame, caption: str = "") -> str:
    """A table as a LaTeX longtable with its cells escaped, all of its rows."""
    from medlake.functions.text import tex

    kinds = dict(rows.dtypes)
    cells = rows.select(*(F.col(c) if kinds[c] in ("double", "float") else tex(F.col(c).cast("string")).alias(c) for c in rows.columns))
    heads = rows.sparkSession.range(1).select(*(tex(F.lit(c)).alias(f"c{i}") for i, c in enumerate(rows.columns))).first()
    body = [" & ".join(map(_shown, r)) + r" \\" for r in cells.toLocalIterator()]
    begin = [rf"\begin{{longtable}}{{{'l' * len(rows.columns)}}}"] + ([rf"\caption{{{caption}}} \\"] if caption else [])
    return "\n".join([*begin, r"\toprule", " & ".join(heads) + r" \\", r"\midrule", r"\endhead", *body, r"\bottomrule", r"\end{longtable}"])


def write_table(rows: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    """A table as CSV with a header, Parquet, JSON lines, or appended JSON lines (S14); written whole or not at all by the commit protocol."""
    if kind == "csv":
        rows.write.mode(mode).csv(path, header=True, escape='"')
    elif kind in ("json", "append"):
        rows.write.mode("append" if kind == "append" else mode).json(path)
    elif kind == "parquet":
        rows.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no sink {kind}")


def read_ontology(spark: SparkSession, path: str, root: str = "rdf:RDF") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, terms, obsolete) of an ontology in RDF/XML.

    Edges are (parent, child) of direct subclasses; terms are (node, term, preferred) from
    English labels, synonyms and acronyms of classes and of descriptions of known classes;
    obsolete ones are nodes with an obsolete name.  Two scans by row tag; nodes are named by
    what follows the last # or / of their address.
    """
    text = "array<struct<_VALUE:string,`_xml:lang`:string>>"
    shape = f"`_rdf:about` string, `rdfs:label` {text}, Synonym {text}, Acronym {text}, Obsolete_Name array<string>"
    up = "`rdfs:subClassOf` array<struct<`_rdf:resource`:string>>"
    scan = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "false").schema(schema).load(path)
    name = lambda c: F.regexp_extract(c, "([^#/]+)$", 1)
    own = name(F.col("`_rdf:about`")).alias("node")
    classes, notes = scan("owl:Class", f"{shape}, {up}"), scan("rdf:Description", shape)
    edges = classes.select(own, F.explode("`rdfs:subClassOf`").alias("p")).select(name(F.col("p.`_rdf:resource`")).alias("parent"), F.col("node").alias("child")).where("parent <> '' and child <> ''").distinct()
    known = classes.select(own).where("node <> ''").distinct()
    every = classes.drop("rdfs:subClassOf").unionByName(notes).select("*", own).join(known, "node", "left_semi")

    def english(column: str, preferred: bool) -> DataFrame:
        one = every.select("node", F.explode(column).alias("t")).select("node", F.trim("t._VALUE").alias("term"), F.col("t.`_xml:lang`").alias("lang"))
        return one.where("term <> '' and (lang is null or lang = '' or lower(lang) like 'en%')").select("node", "term", F.lit(preferred).alias("preferred"))

    terms = english("`rdfs:label`", True).union(english("Synonym", False)).union(english("Acronym", False))
    return edges, terms.groupBy("node", "term").agg(F.max("preferred").alias("preferred")), every.where(F.size("Obsolete_Name") > 0).select("node").distinct()


def read_roi_plists(spark: SparkSession, path: str) -> DataFrame:
    """(file, roi, name, area, max_hu) of the regions in property lists (S10); an unreadable file has one row of nulls."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import plistlib

        for b in batches:
            out = []
            for name, raw in zip(b["path"], b["content"]):
                try:
                    images = plistlib.loads(raw).get("Images", [])
                except (plistlib.InvalidFileException, ValueError, AttributeError, SyntaxError):
                    images = None
                except Exception as e:  # the XML parser's own error has no common base
                    if type(e).__name__ != "ExpatError":
                        raise
                    images = None
                rois = [r for i in images or [] for r in i.get("ROIs", [])]
                out += [(name, k, str(r.get("Name", "Unknown")), float(r.get("Area", 0)), float(r.get("Max", 0))) for k, r in enumerate(rois)] if images is not None else [(name, None, None, None, None)]
            yield pd.DataFrame(out, columns=["file", "roi", "name", "area", "max_hu"])

    return files.mapInPandas(unpack, "file string, roi int, name string, area double, max_hu double")


def read_excel(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(file, row, cells) of a sheet of XLSX workbooks, as text (S4); rows from 1, blank cells null.

    A workbook is a ZIP of XML parts: the sheet's cells, and the table of shared strings.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zipfile
        from xml.etree import ElementTree

        tag = lambda e: e.tag.rpartition("}")[2]
        said = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    shared = [said(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
                    tree = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
                out = []
                for number, row in enumerate((e for e in tree.iter() if tag(e) == "row"), 1):
                    cells: list = []
                    for c in (e for e in row if tag(e) == "c"):
                        place = re.match("[A-Z]+", c.get("r", ""))
                        at = 0
                        for letter in place.group() if place else "":
                            at = 26 * at + ord(letter) - 64
                        cells += [None] * ((at - 1 if place else len(cells)) - len(cells))
                        value = next((e.text for e in c if tag(e) == "v"), None)
                        kind = c.get("t")
                        cells.append(said(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value)
                    out.append((name, int(row.get("r", number)), cells))
                yield pd.DataFrame(out, columns=["file", "row", "cells"])

    return files.mapInPandas(unpack, "file string, row int, cells array<string>")


def read_nifti(spark: SparkSession, path: str, voxels: bool = False) -> DataFrame:
    """(file, shape, spacing, affine, voxels) of NIfTI-1 volumes, gzipped or not.

    The affine is the sform, row by row in 16 doubles, else the spacing's diagonal; voxels,
    where asked for, are scaled and flat in file order.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    #: Data type codes of the format.
    kinds = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import struct

        import numpy as np

        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                end = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
                dim, pix = struct.unpack_from(f"{end}8h", raw, 40), struct.unpack_from(f"{end}8f", raw, 76)
                code, offset, slope, inter = struct.unpack_from(f"{end}h", raw, 70)[0], *struct.unpack_from(f"{end}3f", raw, 108)
                shape, spacing = list(dim[1 : 1 + dim[0]]), [float(x) for x in pix[1 : 1 + dim[0]]]
                if struct.unpack_from(f"{end}h", raw, 254)[0] > 0:
                    affine = [float(x) for x in struct.unpack_from(f"{end}12f", raw, 280)] + [0.0, 0.0, 0.0, 1.0]
                else:
                    affine = np.diag([*(spacing + [1.0] * 3)[:3], 1.0]).reshape(-1).tolist()
                x = None
                if voxels:
                    x = np.frombuffer(raw, np.dtype(end + kinds[code]), int(np.prod(shape)), int(offset)).astype(float)
                    x = x * slope + inter if slope and np.isfinite(slope) else x
                yield pd.DataFrame({"file": [name], "shape": [shape], "spacing": [spacing], "affine": [affine], "voxels": [x]})

    return files.mapInPandas(unpack, "file string, shape array<int>, spacing array<double>, affine array<double>, voxels array<double>")


#: Explicit value representations with a long length field, and the tags that are read.
_LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
_TAGS = {0x00020010: "syntax", 0x0020000E: "series", 0x00200013: "instance", 0x00200032: "position", 0x00280010: "rows", 0x00280011: "columns", 0x00280030: "spacing", 0x00280100: "bits", 0x00280103: "signed", 0x00281052: "intercept", 0x00281053: "slope", 0x7FE00010: "pixels"}


def _dicom(raw: bytes) -> dict[str, bytes]:
    """Values of the wanted tags of an explicit little-endian DICOM file."""
    import struct

    if raw[128:132] != b"DICM":
        raise ValueError("no DICOM file")
    at, out = 132, {}
    while at + 8 <= len(raw):
        group, element, kind = *struct.unpack_from("<HH", raw, at), raw[at + 4 : at + 6]
        if kind in _LONG:
            (size,), at = struct.unpack_from("<I", raw, at + 8), at + 12
        else:
            (size,), at = struct.unpack_from("<H", raw, at + 6), at + 8
        if size == 0xFFFFFFFF:
            raise ValueError("sequences of undefined length and packed pixels aren't read")
        name = _TAGS.get(group << 16 | element)
        if name:
            out[name] = raw[at : at + size]
        at += size
    return out


def read_dicom(spark: SparkSession, path: str, voxels: bool = True) -> DataFrame:
    """(file, series, instance, z, shape, spacing, voxels) of uncompressed DICOM slices (S9); voxels by slope and intercept."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        text = lambda t, name: t.get(name, b"").decode("ascii", "replace").strip("\0 ")
        numbers = lambda t, name: [float(x) for x in text(t, name).split("\\") if x.strip()]
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                t = _dicom(raw)
                size = [int.from_bytes(t[x], "little") for x in ("rows", "columns")]
                kind = f"<{'i' if int.from_bytes(t.get('signed', b''), 'little') else 'u'}{int.from_bytes(t.get('bits', bytes([16])), 'little') // 8}"
                x = None
                if voxels:
                    x = np.frombuffer(t["pixels"], kind, size[0] * size[1]) * (numbers(t, "slope") or [1.0])[0] + (numbers(t, "intercept") or [0.0])[0]
                place = numbers(t, "position")
                yield pd.DataFrame({"file": [name], "series": [text(t, "series")], "instance": [int(text(t, "instance") or 0)], "z": [place[2] if len(place) == 3 else None], "shape": [size], "spacing": [numbers(t, "spacing")], "voxels": [x]})

    return files.mapInPandas(unpack, "file string, series string, instance int, z double, shape array<int>, spacing array<double>, voxels array<double>")


def stack_series(slices: DataFrame) -> DataFrame:
    """(series, shape, spacing, voxels): each series' slices by place along the axis, then number; the distance between them is the median one."""
    one = F.struct("z", "instance", "voxels")
    s = slices.groupBy("series").agg(F.sort_array(F.collect_list(one)).alias("s"), F.first("shape").alias("plane"), F.first("spacing").alias("inside"))  # a series is one volume
    gaps = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i)["z"] - F.get("s", i - 1)["z"])
    gap = F.when(F.size("s") > 1, F.get(F.sort_array(gaps), F.floor((F.size("s") - 1) / 2).cast("int")))
    return s.select("series", F.concat("plane", F.array(F.size("s"))).alias("shape"), F.concat("inside", F.array(gap)).alias("spacing"), F.flatten(F.transform("s", lambda x: x["voxels"])).alias("voxels"))


@dataclass
class Catalog:
    """Named Parquet tables of a folder, registered as views."""

    root: str
    tables: dict[str, str] = field(default_factory=dict)

    def register(self, spark: SparkSession) -> None:
        for name, where in self.tables.items():
            spark.read.parquet(f"{self.root}/{where}").createOrReplaceTempView(name)

    def to_json(self) -> str:
        return json.dumps({"root": self.root, "tables": self.tables}, sort_keys=True)
