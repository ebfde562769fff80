"""WARC archives as chunked record tables.

``write_archives`` writes one WARC 1.1 record per page, gzip member by member, and
returns a manifest of files. ``read_chunks`` streams the archives back as rows of record
identifier and chunk number: a payload is never held whole, and each row carries the
SHA-256 of the payload up to and including its chunk, so that the last row's digest is the payload's.

Deduplication: of records with equal payloads of at least LEAST_REVISIT bytes, the one
with the smallest page_id is a response, the others are revisits that refer to it and
keep the HTTP head (with the length) but no payload. Archives are opened through
pyarrow.fs, by the shared folder's URI; a task that runs twice writes two files, of
which the manifest, committed by Spark, lists one. A record's identifier is a UUID made of its file, its place in it and its
page, so no two records share one, whatever pages repeat; the page's id and the one it refers to are fields of their own.

Edge cases: a null html is an empty payload; null page ids come last and have no Page-ID field; repeated rows of one
page are all responses if the page is the response; a null url leaves the target out;
control characters in a url are percent-encoded; no rows give no files and no rows;
further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import join_facts, new_path, small_enough, stored

LEAST_REVISIT = 100
CHUNK = 1 << 16
#: Bytes of payload after which a task begins a new file.
FILE_BYTES = 1 << 30
MOST_FILTER_BITS = 30
_DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, records long, payload_bytes long"
CHUNKS = "record_id string, chunk_no long, page_id long, record_type string, refers_to long, chunk_offset long, data binary, chunk_sha256 string, running_sha256 string, is_last boolean, payload_bytes long, payload_digest string"


def decide(pages: DataFrame) -> DataFrame:
    """The pages with url, html, record_type, refers_to and digest.

    The digests that occur more than once decide. They are broadcast while they are few; beyond that only pages that a
    Bloom filter takes for copies are shuffled with their html.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    long = rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    several = stored(long.filter("n > 1 and first is not null"), "warc-copies")
    if small_enough(several):
        met = join_facts(rows, several, ["digest"], "n", ["page_id"])
    else:
        tested = _maybe_copies(rows, several)
        alone = tested.filter("not maybe").drop("maybe").withColumn("first", F.lit(None).cast("long"))
        met = join_facts(tested.filter("maybe").drop("maybe"), several, ["digest"], "n", ["page_id"]).unionByName(alone)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("bytes") >= LEAST_REVISIT)
    return met.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _maybe_copies(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Add maybe, false where a Bloom filter knows that a digest isn't among several, so that the page needs no shuffle.

    The filter has 16 bits for each digest, at most 2^MOST_FILTER_BITS; beyond that it lets more through, and stays right.
    """
    bits = min(max(6, (16 * several.count()).bit_length()), MOST_FILTER_BITS)

    def place(k: int):
        return F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1))

    places = several.select(F.explode(F.array(*[place(k) for k in range(4)])).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")).toPandas()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << bits) - 1)
        for batch in batches:
            raw = np.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in batch.column("digest").to_pylist()], dtype=np.uint64).reshape(-1, 4) & low
            maybe = ((sent.value[raw >> np.uint64(6)] >> (raw & np.uint64(63))) & np.uint64(1)).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, "maybe"])

    return rows.mapInArrow(run, "page_id long, url string, html string, digest string, bytes long, maybe boolean")


def record_head(record_id: str, page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, length: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {_DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(http) + (length if kind == 'response' else 0)}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:
        lines.insert(4, "WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else "file://" + uri)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write decided pages to gzip WARC files under folder (the shared folder by default); returns the stored manifest."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        out, file, records, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([records]), pa.array([size])], names=["file", "records", "payload_bytes"])

        for batch in batches:
            html = batch.column("html").cast(pa.large_binary())
            rest = batch.drop_columns(["html"]).to_pylist()
            for k, row in enumerate(rest):
                if out is None:
                    fs.create_dir(at, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    file, records, size = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                payload = memoryview(html[k].as_buffer())
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{records}/{row["page_id"]}')}>"
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(gz.compress(record_head(record_id, row["page_id"], row["url"], row["record_type"], row["refers_to"], row["digest"], len(payload))))
                if row["record_type"] == "response":
                    for b in range(0, len(payload), CHUNK):
                        out.write(gz.compress(payload[b : b + CHUNK]))
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                records, size = records + 1, size + len(payload)
                if size >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(pages.select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(run, MANIFEST), "warc-manifest")


def records(stream) -> Iterator[tuple[dict[str, str], int, io.BufferedReader]]:
    """(WARC fields, bytes of the HTTP head's Content-Length, stream at the payload) of each record; the payload's bytes must be read before the next."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        head, length = 0, 0
        while True:
            line = stream.readline()
            head += len(line)
            if not line.strip():
                break
            k, _, v = line.decode().partition(":")
            if k.lower() == "content-length":
                length = int(v)
        fields["payload-here"] = str(int(fields["content-length"]) - head)
        yield fields, length, stream


def read_chunks(manifest: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in a manifest; data=False leaves the bytes out. A payload that its digest belies raises."""
    files = manifest.select("file")
    files = files.repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for file in (f for b in batches for f in b.column("file").to_pylist()):
            fs, at = _open(file)
            with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, 1 << 17) as stream:
                for fields, length, body in records(stream):
                    name, kind = fields["warc-record-id"], fields["warc-type"]
                    page, refers = (int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page-id"))
                    digest = fields["warc-payload-digest"].partition(":")[2]
                    left = int(fields["payload-here"])
                    total, running, number, offset = left, hashlib.sha256(), 0, 0
                    while True:
                        got = body.read(min(chunk, left))
                        running.update(got)
                        left -= len(got)
                        if left and not got:
                            raise ValueError(f"{file} ends inside {name}")
                        last = not left
                        sofar = running.hexdigest()
                        if last and kind == "response" and (sofar != digest or total != length):
                            raise ValueError(f"payload of {name} in {file} is not what its digest says")
                        rows.append((name, number, page, kind, refers, offset, got if data else None, hashlib.sha256(got).hexdigest() if data else None, sofar if kind == "response" else None, last, length, digest))
                        number, offset, held = number + 1, offset + len(got), held + (len(got) if data else 100)
                        if held > 1 << 22:
                            yield flush()
                            held = 0
                        if last:
                            break
                    body.read(4)
        if rows:
            yield flush()

    return files.mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks of every page, as read back from its archive."""
    decided = decide(pages)
    manifest = write_archives(decided)
    last = read_chunks(manifest, data=False).filter("is_last")
    return last.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"))
