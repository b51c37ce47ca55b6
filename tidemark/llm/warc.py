"""WARC archives with an index that is written first and read by byte ranges.

Writing: a page whose payload another page of smaller id has becomes a revisit without
a body.  Each task writes one archive, every record a gzip member of its own, and
returns the index: file, offset, length, url, digest.  The index is committed as
Parquet; archives of failed attempts are in no index, so a retry does no harm.

Reading: the selected index rows are sorted by file and offset, near ranges are
coalesced into single reads of bounded size, and the records are parsed from them.

Payload digests are grouped by their hash alone and combined map-side, so a hot group
is a row per task; payloads are moved once, by page id.

Ids are whole numbers or texts.  Nulls, empties, repeats: a null html is an empty
payload, one of any length a single record; empty payloads are equal to each other.  A null url is written as empty; control characters are percent-encoded.
Rows that repeat an id are records of their own; of equal payloads all rows with the
smallest id are responses.  Rows without id count as larger than any id.  Empty
tables give no archives and an empty index.  Further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import file_system, materialize, new_dir

def _index_schema(kind: str) -> str:
    return f"page_id {kind}, file string, `offset` long, length long, url string, payload_digest string, record_type string, refers_to {kind}"


def _id_type(kind: str) -> pa.DataType:
    """Arrow's type of an id column; ids are whole numbers or texts."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in types:
        raise TypeError(f"page_id must be a whole number or a text, not {kind}")
    return types[kind]


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None, date: str) -> bytes:
    """One uncompressed WARC/1.1 record; a page without id has no header for it."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {quote(str(page_id))}")
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        block = b""
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {quote(str(refers_to))}"]
    lines = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"])
    return lines.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""


def write_warc(spark: SparkSession, pages: DataFrame, date: str = "2000-01-01T00:00:00Z", level: int = 4, directory: str | None = None) -> DataFrame:
    """Write the archives and return the committed index, a row per record."""
    directory, kind = directory or new_dir(spark, "warc"), pages.schema["page_id"].dataType.simpleString()
    id_type = _id_type(kind)
    html = F.coalesce("html", F.lit(""))
    digests = materialize(pages.select("page_id", F.sha1(html).alias("sha1")), "sha1")
    heads = digests.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    revisits = digests.join(heads, "sha1").where("not (page_id <=> first_id)").select(F.col("page_id").alias("id"), "sha1", "first_id").distinct()
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"))
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["id"]) & (rows["sha1"] == revisits["sha1"]), "left").select("page_id", "url", "html", "first_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(directory)
        path, out, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        name = f"{directory}/{path.rpartition('/')[2]}"
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                index: list[tuple] = []
                for page_id, url, text, first in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    payload = text.encode()
                    digest = sha1_base32(payload)
                    blob = gzip.compress(record(page_id, url, payload, digest, first, date), level, mtime=0)
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    out.write(blob)
                    index.append((page_id, name, offset, len(blob), url, digest, "response" if first is None else "revisit", first))
                    offset += len(blob)
                kinds = [id_type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), id_type]
                names = ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(write, _index_schema(kind)), "index")


def read_warc(index: DataFrame, span: int = 8 << 20, gap: int = 1 << 16, most: int = 4 << 20, tasks: int = 20_000) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of the index's records.

    The ranges of a file are dealt in spans of ``span`` bytes, to a task for each span of
    the whole (longer spans, where that were more than ``tasks``); ranges no more than
    ``gap`` bytes apart are one read of at most ``most`` bytes.  A response's payload is
    measured and its digest computed anew; a revisit's size is what its header says.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    id_type = _id_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        source, at = None, None

        def page(text: str | None) -> int | str | None:
            return None if text is None else unquote(text) if pa.types.is_string(id_type) else int(text)

        def flush() -> pa.RecordBatch:
            nonlocal source, at
            file, lo = held[0][0], held[0][1]
            if at != file:
                store, path = file_system(file)
                source, at = store.open_input_file(path), file
            data = source.read_at(held[-1][1] + held[-1][2] - lo, lo)
            rows = []
            for _, offset, length in held:
                fields, payload = parse(zlib.decompress(data[offset - lo : offset - lo + length], 31))
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                if fields["WARC-Type"] == "response":
                    if sha1_base32(payload) != digest or len(payload) != size:
                        raise ValueError(f"damaged record at {file}:{offset}")
                    size = len(payload)
                rows.append((page(fields.get("WARC-Page-ID")), fields["WARC-Target-URI"], fields["WARC-Type"], page(fields.get("WARC-Refers-To-Page-ID")), digest, size, payload))
            kinds = [id_type, pa.string(), pa.string(), id_type, pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[-1][0] != file or offset - held[-1][1] - held[-1][2] > gap or offset + length - held[0][1] > most):
                    yield flush()
                    held = []
                held.append((file, offset, length))
        if held:
            yield flush()

    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, min(tasks, -(-total // span)))
    wide = max(span, -(-total // parts))
    ranges = index.select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / wide)).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(read, f"page_id {kind}, url string, record_type string, refers_to {kind}, payload_digest string, payload_bytes long, payload binary")
