"""WARC records in ZIP packages: written in bounded archives, read back by ranges without extraction.

Layout of an archive: stored members ``archive/data.warc.gz`` (one gzip member for each record) and
``indexes/index.cdxj`` (one line for each record: key, offset and length in the former).  The reader takes the end of
the file, finds the end-of-central-directory record (ZIP64 too), parses the central directory, locates stored members
by their local headers and reads records by their ranges; nothing is unpacked to a disk.

Payloads of at least ``REVISIT_BYTES`` that occur more than once are stored once: the record of the largest id is the
response and the others revisit it.  A revisit keeps the response's HTTP headers, so length and digest of the full
payload are known from it alone.

Archives go to the shared folder through a file system of pyarrow (any URI it knows).  A task writes under names of its
own and reports them; what an attempt that was lost has written is never referred to.

Defined results: null html has an empty payload; a null id refers to the largest id of its payload, if there is one;
repeated rows of the largest id are all responses; control characters in URLs are percent-encoded; an empty table
gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, boxed, materialize, scratch_path

REVISIT_BYTES = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOCD, _EOCD64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def record_kinds(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``refers_to``: the id of the response that a record revisits, or null.

    Copies are found on digests alone, by one grouped count that is stored; a page meets it by its own digest, so no row
    needs a number, and Spark may split a frequent digest's pages."""
    payload = F.coalesce(F.encode(F.col(f"_doc.`{html_col}`"), "UTF-8"), F.lit(b""))
    keyed = boxed(pages).select("_doc", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    marks = keyed.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max(F.col(f"_doc.`{id_col}`")).alias("largest"), F.count("*").alias("copies"))
    groups = materialize(marks.filter("copies > 1 and largest is not null").select("digest", "n", "largest"), "payloads")
    again = F.when(~F.col(f"_doc.`{id_col}`").eqNullSafe(F.col("largest")), F.col("largest"))
    return keyed.join(groups, ["digest", "n"], "left").select("_doc.*", again.alias("refers_to"))


def _urn(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None or page_id != page_id else int(page_id)}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _clean(uri: object) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri) if isinstance(uri, str) else ""


def warc_record(page_id: object, uri: object, payload: bytes, refers_to: object, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of ``refers_to``, uncompressed."""
    again = not (refers_to is None or refers_to != refers_to)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not again:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(uri)}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if again else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers of a record and its payload (None for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    if kind == "response" and len(payload) != told:
        raise ValueError(f"{fields['warc-record-id']}: {len(payload)} bytes of payload, {told} announced")
    return {
        "page_id": _page_of(fields["warc-record-id"]), "uri": fields["warc-target-uri"], "record_type": kind, "told_bytes": told,
        "told_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": payload if kind == "response" else None,
        "refers_to": _page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 24 << 20) -> DataFrame:
    """Write ``pages`` (with ``refers_to``) as archives of about ``archive_bytes`` each; returns (path, records, bytes),
    a written table."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                package.writestr(DATA, data.getbuffer())
                package.writestr(INDEX, "".join(index))
                size = data.tell()
            told = pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(index)], "bytes": [size]})
            data.seek(0)
            data.truncate()
            index.clear()
            return told

        for pdf in batches:
            for page_id, url, html, refers_to in zip(pdf[id_col].astype(object), pdf[url_col], pdf[html_col], pdf["refers_to"].astype(object), strict=True):
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                record = pack.compress(warc_record(page_id, url, as_bytes(html), refers_to)) + pack.flush()
                index.append(f"{_clean(url)} 20240101000000 {json.dumps({'offset': data.tell(), 'length': len(record)})}\n")
                data.write(record)
                if data.tell() >= archive_bytes:
                    yield close()
        if index:
            yield close()

    rows = pages.select(id_col, url_col, html_col, "refers_to").mapInPandas(write, "path string, records long, bytes long")
    return materialize(rows, "archives")


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header starts


def central_directory(read, size: int) -> list[Member]:
    """Members of a ZIP package of ``size`` bytes; ``read(offset, length)`` gives a range."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_EOCD)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<H2I", tail[at + 10 : at + 20])
    if count == _FULL16 or length == _FULL32 or offset == _FULL32:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack("<3Q", end64[32:56])
    entries, at, found = read(offset, length), 0, []
    for _ in range(count):
        if entries[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", entries[at + 10 : at + 12])
        packed, plain = struct.unpack("<2I", entries[at + 20 : at + 28])
        n_name, n_extra, n_comment = struct.unpack("<3H", entries[at + 28 : at + 34])
        header, = struct.unpack("<I", entries[at + 42 : at + 46])
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:  # ZIP64: only the fields that are full above, in this order
            kind, n = struct.unpack("<2H", extra[:4])
            if kind == 1:
                values = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = values.pop(0) if plain == _FULL32 else plain
                packed = values.pop(0) if packed == _FULL32 else packed
                header = values.pop(0) if header == _FULL32 else header
            extra = extra[4 + n :]
        found.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return found


def member_start(read, member: Member) -> int:
    """Where the bytes of a stored member start."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = read(member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"{member.name}: no local header")
    return member.header + 30 + sum(struct.unpack("<2H", head[26:30]))


def records_of(read, size: int, block: int = 8 << 20) -> Iterator[dict]:
    """All records of a package, by its indexes and ranges.  Records that lie together are read in one request of up to
    ``block`` bytes (a larger record in one of its own)."""
    members = {m.name: m for m in central_directory(read, size)}
    for name, m in members.items():
        if not name.startswith("indexes/"):
            continue
        data = members[DATA]
        first = member_start(read, data)
        # a key may hold braces and any line break but newline; it holds no spaces
        lines = filter(None, read(member_start(read, m), m.size).decode().split("\n"))
        places = sorted((x["offset"], x["length"]) for x in (json.loads(line.split(" ", 2)[2]) for line in lines))
        at = 0
        while at < len(places):
            begin, until = places[at][0], at + 1
            while until < len(places) and sum(places[until]) - begin <= block:
                until += 1
            held = read(first + begin, sum(places[until - 1]) - begin)
            for offset, length in places[at:until]:
                yield parse_record(zlib.decompress(held[offset - begin : offset - begin + length], 31))
            at = until


def read_archives(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records of the archives at ``path``: page_id, uri, record_type, told_bytes, told_digest, payload, refers_to."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        columns = ["page_id", "uri", "record_type", "told_bytes", "told_digest", "payload", "refers_to"]

        def frame(rows: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            return out.astype({"page_id": "Int64", "refers_to": "Int64"})

        for pdf in batches:
            for path in pdf["path"]:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    rows, held = [], 0
                    for r in records_of(lambda at, n, f=f: f.read_at(n, at), f.size()):
                        rows.append(r)
                        held += len(r["payload"] or b"")
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    spread = archives.select("path")
    spread = spread.repartition(tasks, "path") if tasks else spread
    return spread.mapInPandas(scan, "page_id long, uri string, record_type string, told_bytes long, told_digest string, payload binary, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest (both of the full payload; a
    response's from the bytes read), record_type, refers_to, uri."""
    spark = pages.sparkSession
    archives = write_archives(record_kinds(pages.select(id_col, url_col, html_col), id_col, html_col), scratch_path(spark, "warc"), id_col, url_col, html_col)
    rows = read_archives(archives, max(1, archives.count()))
    digest = F.when(F.col("payload").isNull(), F.col("told_digest")).otherwise(F.sha1("payload"))
    size = F.when(F.col("payload").isNull(), F.col("told_bytes")).otherwise(F.octet_length("payload").cast("long"))
    return rows.select(F.col("page_id").alias(id_col), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "uri")
