"""WARC archives: a writer, and a reader that splits gzip files.

Writing: each record is a gzip member of its own; a task writes one file under a name no other attempt has, and only
files named in the stored manifest count, so a repeated task leaves no second copy. Of records with equal payloads of
at least `least` bytes, that with the largest page id keeps the payload, others revisit it.

Reading: files are cut in byte ranges without regard to members. A task looks for gzip's magic in its range, takes a
place as a member only if it inflates to the head of a WARC record with the fields this reader needs, and owns the
records that start inside its range; the last one is read beyond the range's end. Members follow each other, so after
a valid one the next place is known. Blocks of bounded size are read at a time; one record is in memory at once.

Defined cases: null html is an empty payload; a null page id is written as an empty field and read back as null (it
is never a revisit's target unless all are null); repeated rows with the largest id are all responses; urls are
written in UTF-8 with control characters as percent codes; an empty table has no archive and no records.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, slices, store

MAGIC, BLOCK = b"\x1f\x8b\x08", 1 << 18
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def member(page_id: int | None, url: str | None, html: bytes, digest: str, target: int | None, level: int = 4) -> bytes:
    """One WARC record as a gzip member."""
    name = "" if page_id is None else str(page_id)
    revisit = target is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else html)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(quote(c) if ord(c) < 33 or ord(c) == 127 else c for c in url or "")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(html))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{target}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict | None:
    """The row of a whole record; None if it isn't one."""
    head, found, body = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = dict(x.partition(": ")[::2] for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    if not {"WARC-Type", "WARC-Record-ID", "Content-Length"} <= set(fields):
        return None
    body = body[: int(fields["Content-Length"])]
    number = lambda v: int(n) if (n := v.rpartition(":")[2].rstrip(">")) else None
    payload = body.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields.get("WARC-Payload-Digest", "sha1:").partition(":")[2]).hex()
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
        "payload_bytes": int(fields.get("X-Payload-Length", len(payload))) if revisit else len(payload),
        "payload_digest": digest,
    }


def plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html (binary), digest, and target: the page whose record a revisit refers to."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("html")).withColumn("digest", F.sha1("html")).withColumn("size", F.length("html"))
    copies = (
        pages.select("page_id", body.alias("html")).select("page_id", F.sha1("html").alias("digest"), F.length("html").alias("size"))
        .where(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("target")).where("n > 1").drop("n")
    )
    copies = store(copies, "copies")  # stored, so the join can be split at a hot payload
    other = ~F.col("page_id").eqNullSafe(F.col("target"))
    return rows.join(copies, ["digest", "size"], "left").select("page_id", "url", "html", "digest", F.when(other, F.col("target")).alias("target"))


def write(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write archives under `folder` (default: the shared folder); the stored manifest of (path, size, records)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for whole in batches:
            for b in slices(whole, "html"):
                for r in b.to_pylist():
                    if out is None:
                        fs, place = pa.fs.FileSystem.from_uri(path)
                        fs.create_dir(place.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(place, compression=None, buffer_size=BLOCK)
                    out.write(member(r["page_id"], r["url"], r["html"], r["digest"], r["target"]))
                    n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [n]})

    return store(plan(pages, least).mapInArrow(run, "path string, size long, records long"), "manifest")


class Window:
    """Bytes of a file by place, read in blocks, with those before `drop` let go."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.base, self.data = file, size, start, bytearray()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        got = self.file.read(min(BLOCK, self.size - at))
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.base]
        self.base = upto


def records(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Rows of the records that start in start..end of a file."""
    w, at = Window(file, size, start), start
    while True:
        while (found := w.data.find(MAGIC, at - w.base)) < 0:
            at = max(at, w.base + len(w.data) - 2)
            if at >= end:
                return
            w.drop(at)
            if not w.more():
                return
        at = w.base + found
        if at >= end:
            return
        w.drop(at)
        got = _inflate(w)
        if got is None:
            at += 1
            continue
        row, length = got
        yield row
        at += length
        w.drop(at)


def _inflate(w: Window) -> tuple[dict, int] | None:
    """(row, compressed length) of the member at the window's start, or None if that is no record."""
    unpack, out, used, tested = zlib.decompressobj(31), bytearray(), 0, False
    while True:
        if used >= len(w.data) and not w.more():
            return None
        try:
            out += unpack.decompress(bytes(memoryview(w.data)[used : used + BLOCK]))
        except zlib.error:
            return None
        used = min(len(w.data), used + BLOCK) - len(unpack.unused_data)
        if not tested and len(out) >= 8:
            if not out.startswith(b"WARC/1."):
                return None
            tested = True
        if unpack.eof:
            row = parse(bytes(out))
            return None if row is None else (row, used)


def read(manifest: DataFrame, split: int = 8 << 20) -> DataFrame:
    """Rows of all records of the files in the manifest(path, size), by splits of `split` bytes."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split}L)")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start"))):
                fs, place = pa.fs.FileSystem.from_uri(path)
                held, weight = [], 0
                with fs.open_input_file(place) as file:
                    for row in records(file, size, start, min(start + split, size)):
                        held.append([row[k] for k in names])
                        weight += len(row["payload"] or b"")
                        if weight > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return ranges.repartition(n, "path", "start").mapInArrow(run, RECORD)
