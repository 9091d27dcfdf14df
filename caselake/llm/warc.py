"""WARC files whose records are single Zstandard frames under a dictionary that the file carries in a leading skippable frame.

Each file's dictionary is trained on that file's own records (a file holds about `file_bytes` of them), so a file can be
read alone and no sample of the corpus is needed. Where the trainer refuses them, being too few or too uniform, as at the
end of a small table, their beginning serves as a dictionary of raw content; readers tell the two by its magic number.
Layout: a skippable frame (magic 0x184D2A5D, the WARC-zstd convention) with the dictionary, a frame with the warcinfo
record, then a frame for each record. A payload that several records share is written once, with the record of the largest
id; the others are revisit records that name it and hold its HTTP header alone.

A record's block is an HTTP response whose body is the payload. WARC-Target-URI is the page's address, or urn:page:<id>
without one; WARC-Date is when the job was set up. Record ids hold payload digest, copy and page id, so that a revisit can
name a response in another file; rows alike in id and payload are told apart by copy within their file.

Defined results: a null payload is empty; a null id sorts below all others and is written as an empty id; line ends and
blanks in an address are written percent-encoded; rows alike in id and payload are all responses when that id is the
largest, and all revisit it otherwise; a very long payload is one record; an empty table gives no files; columns beside
those named don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct

import pandas as pd
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_file, put_file, written

MAGIC = 0x184D2A5D
FILE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
#: Files that a reading task looks at, one after the other.
FILES_PER_TASK = 2


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32(sha1: F.Column) -> F.Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal digits, ten of which are 40 bits and eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(sha1, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def hashed(pages: DataFrame, page_id: str, payload: str, url: str | None = None) -> DataFrame:
    """(page_id, payload, url, sha1), the hash as hexadecimal digits."""
    body = F.coalesce(F.col(payload), F.lit(""))
    address = F.col(url).cast("string") if url else F.lit(None).cast("string")
    return pages.select(F.col(page_id).alias("page_id"), body.alias("payload"), address.alias("url"), F.sha1(body.cast("binary")).alias("sha1"))


def originals(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the rows (page_id, payload, sha1) that revisit another.

    Each step is a table: a payload is hashed once, and both sides of a join are plain shuffles, so that Spark can split
    the rows of a hot payload. Only ids and hashes move, a shared hash's rows being summed before they do.
    """
    keyed = written(rows.select("page_id", "sha1", F.octet_length("payload").alias("n")), "warc-digests", lasting=True).where(F.col("n") >= min_bytes)
    leaders = keyed.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers_to is not null")
    leaders = written(leaders.select("sha1", "refers_to"), "warc-leaders", lasting=True)
    found = keyed.join(leaders, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return written(found.select("page_id", "sha1", "refers_to").distinct(), "warc-links", lasting=True)


def _record_id(page_id: str, digest: str, copy: int = 1) -> str:
    return f"<urn:page:{digest}:{copy}:{page_id}>"


def _page_of(record_id: str) -> str:
    return record_id[1:-1].split(":", 4)[4]


def record(page_id: str, payload: bytes, digest: str, refers_to: str | None, url: str | None = None, date: str = "1970-01-01T00:00:00Z", copy: int = 1) -> bytes:
    """A response's record, or that of a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def archive(records: list[bytes], date: str = "1970-01-01T00:00:00Z", name: str = "") -> bytes:
    """The bytes of one file."""
    info = b"software: caselake\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
    try:
        trained = zstd.train_dictionary(max(256, min(DICTIONARY_BYTES, sum(map(len, records)) // 8)), records, k=256, d=8)
    except zstd.ZstdError:
        trained = zstd.ZstdCompressionDict(b"".join([head, *records])[:DICTIONARY_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)
    data = trained.as_bytes()
    trained.precompute_compress(level=3)
    packer = zstd.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
    return b"".join([struct.pack("<II", MAGIC, len(data)), data, *(packer.compress(r) for r in [head, *records])])


def records(data: bytes):
    """Headers (dict) and body of each record of a file."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    raw = data[8 : 8 + size]
    kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=kind))
    at = 8 + size
    while at < len(data):
        one = unpacker.decompressobj()
        whole = one.decompress(data[at:] if len(data) - at < 65536 else data[at : at + 65536])
        fed = min(65536, len(data) - at)
        while not one.eof:
            more = data[at + fed : at + fed + (1 << 20)]
            if not more:
                raise ValueError("a record is cut off")
            whole += one.decompress(more)
            fed += len(more)
        at += fed - len(one.unused_data)
        head, _, rest = whole.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write(pages: DataFrame, folder: str, page_id: str = "page_id", payload: str = "html", url: str | None = "url", min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """Write every row as a record to files in `folder`; a row (name, n_records, n_bytes) for each file. Runs when it is read.

    url: the column of addresses, if there is one; date: WARC-Date of all records, now if not given.
    """
    if date is None:
        date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = hashed(pages, page_id, payload, url if url in pages.columns else None)
    links = originals(rows, min_bytes)
    a, b = rows.alias("a"), links.alias("b")
    plan = a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.sha1") == F.col("b.sha1")), "left").select("a.*", "refers_to")

    def files(it):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        done, last, copy = [], None, 1

        def flush():
            nonlocal k, held, size, last
            if held:
                name = f"part-{part:010d}-{k:06d}.warc.zst"
                data = archive(held, date, name)
                put_file(folder, name, data)
                done.append((name, len(held), len(data)))
                k, held, size, last = k + 1, [], 0, None

        for pdf in it:
            for i, text, address, digest, to in zip(*(pdf[c].tolist() for c in ("page_id", "payload", "url", "digest", "refers_to")), strict=True):
                copy = copy + 1 if (i, digest) == last else 1
                last = i, digest
                held.append(record(_name(i), text.encode(), digest, None if pd.isna(to) else _name(to), None if pd.isna(address) else address, date, copy))
                size += len(held[-1])
                if size >= file_bytes:
                    flush()
        flush()
        yield pd.DataFrame(done, columns=["name", "n_records", "n_bytes"])

    plan = plan.select(F.col("page_id").cast("string").alias("page_id"), "payload", "url", base32(F.col("sha1")).alias("digest"), F.col("refers_to").cast("string").alias("refers_to"))
    # sorted, so that a repeated task cuts the same files whatever order its rows arrive in
    return plan.sortWithinPartitions("digest", "page_id", "url").mapInPandas(files, "name string, n_records long, n_bytes long")


def _name(value) -> str:
    return "" if value is None or value != value else str(value)


def read(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in the files that write() names.

    A response's length and digest are computed anew from its payload; a difference from the record's header is an error,
    as is a file of another length or number of records than write() gave. Other files in the folder are not looked at.
    """

    def rows(it):
        for pdf in it:
            for name, n_records, n_bytes in zip(pdf["name"].tolist(), pdf["n_records"].tolist(), pdf["n_bytes"].tolist(), strict=True):
                data, out = get_file(folder, name), []
                for fields, body in records(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = body.partition(b"\r\n\r\n")
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rpartition(b"Content-Length: ")[2])
                    if fields["WARC-Type"] == "response" and (digest32(payload) != digest or len(payload) != n):
                        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
                    to = fields.get("WARC-Refers-To")
                    out.append((_page_of(fields["WARC-Record-ID"]) or None, n, digest, fields["WARC-Type"], to and _page_of(to)))
                if len(data) != n_bytes or len(out) != n_records:
                    raise ValueError(f"{name} holds {len(out)} records in {len(data)} bytes, but {n_records} in {n_bytes} were written")
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # a stated number of partitions, as Spark would put the few bytes of names in one
    dealt = files.repartition(max(1, files.count() // FILES_PER_TASK), "name")
    return dealt.mapInPandas(rows, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame, folder: str, page_id: str = "page_id", payload: str = "html", url: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """Write the archives, then the rows that they hold, ids in their own type."""
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType
    files = written(write(pages, folder, page_id, payload, url, min_bytes), "warc-manifest")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if files.isEmpty():
        return spark.createDataFrame([], "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string").withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}).select(*names)
    return read(files, folder).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}).select(*names)
