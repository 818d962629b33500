"""WARC archives: a writer with revisit records and a sequential reader.

Writing: every task appends its rows to archives in the shared folder, one gzip member per
record, and starts a new archive when one is full. Archives are written under a name of
their own and become visible by the manifest alone, so what a lost executor left behind is
never read. Of equal payloads of LEAST_BYTES or more the record with the smallest page_id
is a response; the others are revisits that refer to it and repeat its digest.

Reading: archives are streamed in blocks, each member inflated incrementally by its own
zlib object; a record's content-length frames its block. The block's digest is verified, and
a response's payload against its digest and length. A revisit's digest and length are
verified against the response that it refers to, in whatever archive, which gives its payload
too: only ids and digests are shuffled for that, then revisits are dealt to the archives of
their responses. A damaged record, or a revisit without such a response, raises in strict
reads, and else yields a row with an error. A reader holds one record, and a batch of rows.

Defined results: a null html is the empty payload; null and odd urls are percent-encoded;
a null page_id is written as an empty id, reads back as null and is never referred to; equal
page ids are a record each.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fresh_folder, map_arrow, only, shuffle_parts, stash, table

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
BLOCK = 256 << 10
#: Of every record; ISO 8601 as the format asks. Fixed, so that archives don't depend on the clock.
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string, payload binary"
#: Of rows that a reader yields at once.
BATCH_ROWS, BATCH_BYTES = 5000, 8 << 20
#: Revisits of one archive's responses that are read by one pass over it.
REVISIT_ROWS = 20_000


# ---------------------------------------------------------------- one record


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record as a gzip member: a response, or a revisit where refers_to is given."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("ascii") + block + b"\r\n\r\n") + z.flush()


class WarcError(ValueError):
    """A record or archive that breaks the format's rules."""


class CutError(WarcError):
    """The archive ends within a member."""


def members(stream: BinaryIO, block: int = BLOCK) -> Iterator[Callable[[int], bytes]]:
    """Yields, per gzip member, a function that inflates up to n more bytes of it."""
    data = b""
    while True:
        if not data and not (data := stream.read(block)):
            return
        z = zlib.decompressobj(31)
        rest = data

        def inflate(n: int) -> bytes:
            nonlocal rest
            while not z.eof:
                out = z.decompress(rest, n)
                rest = z.unconsumed_tail
                if z.eof:
                    rest = z.unused_data
                if out or z.eof:
                    return out
                if not rest and not (rest := stream.read(block)):
                    raise CutError("the archive ends within a member")
            return b""

        yield inflate
        while not z.eof:  # what the caller left
            inflate(block)
        data = rest


def _fields(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("ascii").split("\r\n")
    if not version.startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def _read_record(inflate: Callable[[int], bytes], block: int, payloads: bool = True) -> dict:
    """Reads one member: headers, a block of content-length bytes, the end; digests verified. Where
    payloads aren't asked for, none is held."""
    buffer = b""
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        if not (more := inflate(block)):
            raise WarcError("a record without a header")
        buffer += more
    fields, buffer = _fields(buffer[:end]), buffer[end + 4 :]
    left, whole, http = int(fields["content-length"]), hashlib.sha256(), b""
    payload, n_payload, in_payload, parts = hashlib.sha256(), 0, False, []
    kind = fields["warc-type"]
    hold = payloads and kind == "response"
    while left:
        if not buffer and not (buffer := inflate(block)):
            raise WarcError("a block shorter than its content-length")
        part, buffer = buffer[:left], buffer[left:]
        left -= len(part)
        whole.update(part)
        if not in_payload:
            http += part
            if (end := http.find(b"\r\n\r\n")) < 0:
                continue
            part, http, in_payload = http[end + 4 :], http[:end], True
        payload.update(part)
        n_payload += len(part)
        if hold:
            parts.append(part)
    while more := inflate(block):
        buffer += more
    if buffer != b"\r\n\r\n":
        raise WarcError("a block longer than its content-length")
    if fields["warc-block-digest"] != f"sha256:{whole.hexdigest()}":
        raise WarcError("the block's digest differs")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    told = int(next(v for k, _, v in (x.partition(": ") for x in http.decode("ascii").split("\r\n")) if k.lower() == "content-length"))
    if kind == "response" and (payload.hexdigest() != digest or n_payload != told):
        raise WarcError("the payload's digest or length differs")
    number = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": number("warc-record-id"), "payload_bytes": told, "payload_digest": digest, "record_type": kind}
    out |= {"refers_to": number("warc-refers-to"), "url": fields["warc-target-uri"], "error": None}
    return out | {"payload": b"".join(parts) if hold else None}


def _failed(error: Exception) -> dict:
    return dict.fromkeys(x.split()[0] for x in READ_SCHEMA.split(", ")) | {"error": str(error)}


def read_records(stream: BinaryIO, strict: bool = True, block: int = BLOCK, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive, in order. Not strict: a record that breaks the rules yields its
    error; a damaged gzip stream ends the archive with one. A revisit has no payload here, and its
    digest and length are as told: read_archives() holds them against the response."""
    try:
        for inflate in members(stream, block):
            try:
                yield _read_record(inflate, block, payloads)
            except (KeyError, ValueError, StopIteration) as e:
                if strict or isinstance(e, CutError):
                    raise WarcError(str(e)) from e
                yield _failed(e)
    except (zlib.error, WarcError) as e:
        if strict:
            raise WarcError(str(e)) from e
        # The rest can't be framed.
        yield _failed(e)


# ---------------------------------------------------------------- on Spark


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))  # Hadoop's names of the same


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of equal payloads, the smallest page_id.

    Only digests and ids are shuffled to find the repeats; they have a row per repeated payload."""
    p = only(pages, page_id="page_id", url="url", html="html").withColumn("digest", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    first = p.where("digest IS NOT NULL AND page_id IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stash(first.where("n > 1").drop("n"), "warc-repeats")
    # Rows without a digest have keys of their own, so that they don't meet in one task.
    key = F.coalesce("digest", F.xxhash64("page_id", "url").cast("string"))
    out = p.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, html, refers_to); the manifest (path, records, bytes) of the archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _file_system(folder)
        fs.create_dir(top, recursive=True)
        out, path, n, size = None, "", 0, 0
        row = lambda: pa.RecordBatch.from_pydict({"path": [f"{folder}/{os.path.basename(path)}"], "records": [n], "bytes": [size]})
        for batch in batches:
            for x in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, url, html, refers_to = (v.as_py() for v in x)
                if out is None:
                    path, n, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = record(page_id, url, (html or "").encode(), refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    return stash(map_arrow(pages.select("page_id", "url", "html", "refers_to"), write, "path string, records long, bytes long"), "warc-manifest")


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["payload"] or b"")
        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _scan(manifest: DataFrame, strict: bool, payloads: bool) -> DataFrame:
    """The records of the archives by rows of _PLACED; archives are dealt to tasks. With payloads,
    revisits are passed over."""

    def rows(path: str) -> Iterator[dict]:
        fs, at = _file_system(path)
        with fs.open_input_stream(at, compression=None) as stream:
            for number, r in enumerate(read_records(stream, strict, payloads=payloads)):
                if not (payloads and r["record_type"] == "revisit"):
                    yield r | {"path": path, "number": number}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for batch in batches for path in batch.column("path").to_pylist() for r in rows(path)), _schema(_PLACED))

    n = max(1, manifest.count())
    return map_arrow(manifest.select("path").repartition(n), read, _PLACED)


def _revisited(revisits: DataFrame) -> DataFrame:
    """Checked revisits with the payload at their place (at: path, number). They are dealt to the
    archives of their responses, so payloads aren't shuffled; one archive's may be many slices."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        group, stream, records, number, payload = None, None, iter(()), -1, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if group != (r["at_path"], r["slice"]):
                        if stream is not None:
                            stream.close()
                        group, number = (r["at_path"], r["slice"]), -1
                        fs, at = _file_system(r["at_path"])
                        stream = fs.open_input_stream(at, compression=None)
                        records = enumerate(members(stream))
                    while number < r["at_number"]:
                        number, inflate = next(records)
                        if number == r["at_number"]:
                            payload = _read_record(inflate, BLOCK)["payload"]
                    yield {k: r.get(k) for k in schema.names} | {"payload": payload}
        finally:
            if stream is not None:
                stream.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema)

    schema, spark = _schema(READ_SCHEMA), revisits.sparkSession
    placed = revisits.withColumns({"at_path": F.col("at.path"), "at_number": F.col("at.number")}).drop("at")
    slices = placed.groupBy("at_path").agg(F.ceil(F.count(F.lit(1)) / REVISIT_ROWS).alias("slices"))
    dealt = placed.join(F.broadcast(slices), "at_path").withColumn("slice", F.pmod(F.xxhash64("path", "number"), F.col("slices"))).drop("slices", "path", "number", "payload")
    return map_arrow(dealt.repartition(shuffle_parts(spark), "at_path", "slice").sortWithinPartitions("at_path", "slice", "at_number"), read, READ_SCHEMA)


def read_archives(manifest: DataFrame, strict: bool = True, payloads: bool = True) -> DataFrame:
    """The records of the archives of a manifest (path), one row of READ_SCHEMA each, with payloads
    unless digests alone are wanted. A first pass lists and checks all records when this is called."""
    index = stash(_scan(manifest, strict, False), "warc-index")
    key, columns = ["refers_to", "payload_digest"], _schema(READ_SCHEMA).names
    revisits = index.where("record_type = 'revisit'")
    responses = index.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.struct("path", "number", "payload_bytes").alias("at"))
    found = responses.join(revisits.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min("at").alias("at"))
    checked = revisits.drop("error").join(stash(found, "warc-referred"), key, "left")
    missing, differs = "a revisit refers to no response with its digest", "a revisit's length differs from its response's"
    checked = checked.withColumn("error", F.when(F.col("at").isNull(), missing).when(F.col("at.payload_bytes") != F.col("payload_bytes"), differs))
    if strict:
        named = F.concat(F.col("error"), F.lit(": "), F.coalesce(F.col("page_id").cast("string"), F.lit("no id")))
        checked = checked.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(named)))
    checked = stash(checked, "warc-revisits")
    if not payloads:
        return index.where("NOT record_type <=> 'revisit'").select(*columns).unionByName(checked.select(*columns))
    failed = checked.where("error IS NOT NULL").select(*columns)
    return _scan(manifest, strict, True).select(*columns).unionByName(_revisited(checked.where("error IS NULL"))).unionByName(failed)


def _schema(columns: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(k, types[v]) for k, v in (x.split() for x in columns.split(", "))])


#: A record with its place in the archives.
_PLACED = f"{READ_SCHEMA}, path string, number long"


def op6_warc_reader(spark, sf_dir):
    pages = with_revisits(table(spark, sf_dir, "pages"))
    manifest = write_archives(pages, fresh_folder(spark, "warc"))
    size, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    return read_archives(manifest).select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
