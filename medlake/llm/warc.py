"""WARC records in ZIP packages: writing with revisits, and range-reading without extraction.

A package holds stored members: ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj`` (a line for each record with its offset and length there).  A
reader needs the central directory, the index, and the byte ranges of the records asked
for; neighbouring ranges are fetched together, in bounded reads.

Files are opened through pyarrow file systems from URIs, so a shared folder on any store
serves.  A task writes under a fresh name and renames; only names that a finished task
has reported are read, so a lost executor leaves at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.skew import join_classes
from medlake.llm.words import tidy
from medlake.llm.zip_ranges import StoredWriter, data_at, directory
from medlake.plans.shared import materialize, new_path, scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES, READ_BYTES, TASK_RECORDS = 128 << 20, 8 << 20, 5000


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """``pages`` with _bytes, _sha1 and _refers_to.

    Among rows whose bodies are equal and have at least ``least`` bytes, those with the
    largest id are responses and the others refer to that id.  Null bodies are empty;
    rows with a null id are responses.  Copies of a common page stay where they are: only
    bodies with few copies go through an exchange.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    known = pages.withColumns({"_bytes": F.octet_length(body).cast("long"), "_sha1": F.sha1(body.cast("binary"))})
    many = known.where(F.col("_bytes") >= least).groupBy("_sha1", "_bytes").agg(F.max(id_col).alias("_last"), F.min(id_col).alias("_least"), F.count("*").alias("_n"))
    many = materialize(many.where("_least < _last").drop("_least"), "bodies")
    out = join_classes(known, many, ["_sha1", "_bytes"], "_n", "left")
    return out.withColumn("_refers_to", F.when(F.col(id_col) < F.col("_last"), F.col("_last").cast("long"))).drop("_last")


def record(page_id: int | None, url: str | None, body: bytes, size: int, sha1: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none:' + uuid.uuid4().hex if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub('[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", roll_bytes: int = ROLL_BYTES, wide: bool = False) -> DataFrame:
    """Write the rows of :func:`mark_revisits` and give (uri, records), one row a package; materialized."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        lines: list[bytes] = []
        z, name, at = None, "", 0

        def begin() -> StoredWriter:
            nonlocal name, at
            name, at = f"{uuid.uuid4().hex}.wacz", 0
            fs.create_dir(base, recursive=True)
            out = StoredWriter(fs.open_output_stream(f"{base}/.{name}"), wide)
            out.open(ARCHIVE)
            return out

        def finish() -> pa.RecordBatch:
            z.shut()
            z.add(INDEX, lines)
            z.add("datapackage.json", [json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": p} for p in (ARCHIVE, INDEX)]}).encode()])
            z.close()
            z.sink.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            out = pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"], "records": pa.array([len(lines)], pa.int64())})
            lines.clear()
            return out

        for batch in batches:
            for own, url, body, size, sha1, refers in zip(*(c.to_pylist() for c in batch.columns)):
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = record(own, url, (body or "").encode(), size, sha1, refers)
                raw = pack.compress(raw) + pack.flush()
                z = z or begin()
                where = {"url": url or "", "digest": f"sha1:{sha1}", "offset": at, "length": len(raw), "filename": ARCHIVE}
                lines.append(f"{len(lines):012d} 20240101000000 {json.dumps(where)}\n".encode())
                z.write(raw)
                at += len(raw)
                if at >= roll_bytes:
                    yield finish()
                    z = None
        if z:
            yield finish()

    body = F.when(F.col("_refers_to").isNull(), F.col(body_col)).alias("body")
    rows = pages.select(F.col(id_col).cast("long"), url_col, body, "_bytes", "_sha1", "_refers_to")
    return materialize(rows.mapInArrow(tidy(work), "uri string, records long"), "packages")


def parse(raw: bytes) -> dict:
    """Headers of one record, lower-cased, with its HTTP headers under ``http`` and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(out["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n") if out.get("content-type", "").startswith("application/http") else (b"", b"", block)
    out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return out | {"payload": body}


def members_of(source, size: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the archive member begins, and offset and length of each record in it, from the index."""
    found = {m.name: m for m in directory(source, size)}
    source.seek(data_at(source, found[INDEX]))
    index = bytes(source.read(found[INDEX].size))
    if zlib.crc32(index) != found[INDEX].crc:
        raise ValueError("damaged index")
    lines = index.decode().splitlines()
    spots = [json.loads(x.split(" ", 2)[2]) for x in lines]
    return data_at(source, found[ARCHIVE]), [(s["offset"], s["length"]) for s in spots]


def range_read(source, base: int, spots: list[tuple[int, int]], limit: int = READ_BYTES) -> Iterator[bytes]:
    """Each record, unpacked; spots that adjoin are fetched in one read of about ``limit`` bytes."""
    i = 0
    while i < len(spots):
        j, end = i + 1, sum(spots[i])
        while j < len(spots) and spots[j][0] == end and end - spots[i][0] < limit:
            end, j = sum(spots[j]), j + 1
        source.seek(base + spots[i][0])
        raw = memoryview(source.read(end - spots[i][0]))
        for at, n in spots[i:j]:
            yield zlib.decompress(raw[at - spots[i][0] :][:n], 31)
        i = j


def read_packages(packages: DataFrame, payload: bool = False, task_records: int = TASK_RECORDS) -> DataFrame:
    """Records of (uri, records) packages: page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to[, payload].

    A response's digest and size are computed from the payload read; a digest that differs
    from the record's header is an error, and so are other checksums than those stored for
    the index and behind each record.  A revisit has digest and size in its headers.
    """
    kinds = {"page_id": pa.int64(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    names = [k for k in kinds if k != "payload" or payload]

    def own_id(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = open_fs(uri)
                out: list[list] = [[] for _ in names]
                with fs.open_input_file(path) as source:
                    base, spots = members_of(source, source.size())
                    for raw in range_read(source, base, spots[first:last]):
                        r = parse(raw)
                        stated = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = r["warc-type"]
                        if kind == "response" and hashlib.sha1(r["payload"]).hexdigest() != stated:
                            raise ValueError(f"damaged record in {uri}")
                        size = len(r["payload"]) if kind == "response" else int(r["http"]["content-length"])
                        row = [own_id(r["warc-record-id"]), r["warc-target-uri"], size, stated, kind, own_id(r.get("warc-refers-to")), r["payload"]]
                        for c, v in zip(out, row):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(out, names)], names=names)

    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(task_records).cast("long")))
    tasks = packages.where("records > 0").select("uri", "records", first.alias("first")).select("uri", "first", F.least(F.col("first") + task_records, "records").alias("last"))
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return tasks.repartition("uri", "first").mapInArrow(tidy(work), ", ".join(f"{n} {sql[kinds[n]]}" for n in names))


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` into packages in the shared folder and read the records back."""
    folder = new_path(pages.sparkSession, "warc")
    with scratch() as hand_over:
        packages = write_packages(mark_revisits(pages), folder, **columns)
        hand_over(packages)
    return read_packages(packages)
