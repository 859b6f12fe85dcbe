"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id, and each sorted range becomes one or more archives: a writer compresses each
record as a gzip member of its own and starts a new file when the compressed size passes a limit. Headers,
record ids and digests are made from the content alone, so a rerun gives the same bytes. A file is written
under a temporary name and renamed when it is complete; the manifest lists the finished files with sizes and
record counts, and readers open only what the manifest lists. A task that is run again replaces its files by
equal ones.

Of the records with equal payloads (of at least ``least_bytes``), that with the largest id is a response and the
others revisit it. A null payload is an empty one. Rows of the largest id that repeat are all responses. A null
id sorts first and is a revisit where any row of its payload has an id, otherwise a response. An empty table
gives no archives and an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import staging_root

from .common import pieces, text_bytes

#: Compressed bytes after which a file is closed, and bytes of payload for each range.
ROLL, RANGE = 64 << 20, 32 << 20
#: All records carry this date: they have no time of their own, and reruns must not differ.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, first_id long, last_id long"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "record_id string, file string, payload binary")


def open_store(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI, for tasks; folders without a scheme are local."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), root


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{kind}')}>"


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "revisit" if is_revisit else "response"
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", f"WARC-Date: {DATE}",
             "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A")]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that are not a response. Winners are aggregated map-side; a
    payload that a third of the rows share meets one winner row in a join that Spark may split."""
    keyed = pages.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    winners = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(winners, "digest").where("refers_to IS NOT NULL AND (page_id IS NULL OR page_id < refers_to)").select("page_id", "digest", "refers_to")


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0, roll: int = ROLL, ranges: int | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``root``; returns the manifest, which is stored there too."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    n = ranges or pieces(text_bytes(rows, "html"), RANGE, least=12)
    marks = revisits(rows, least_bytes).distinct().select("page_id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "refers_to")
    records = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    ordered = marks.unionByName(records).repartitionByRange(n, "page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = open_store(root)
        context, mark, number, sink = TaskContext.get(), None, 0, None
        count = size = 0
        span: list = [None, None]

        def close() -> pa.RecordBatch:
            nonlocal sink, number
            sink.close()
            name = f"part-{context.partitionId():06d}-{number:05d}.warc.gz"
            store.move(temporary, f"{folder}/{name}")
            sink, number = None, number + 1
            return pa.RecordBatch.from_pydict({
                "file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64()),
                "first_id": pa.array([span[0]], pa.int64()), "last_id": pa.array([span[1]], pa.int64())})

        for batch in batches:
            for page_id, digest, kind, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    mark = (page_id, digest, refers)
                    continue
                is_revisit = mark is not None and mark[:2] == (page_id, digest)
                member = gzip.compress(record_bytes(page_id, url, html.encode(), mark[2] if is_revisit else None, is_revisit), 6, mtime=0)
                if sink is None:
                    store.create_dir(folder, recursive=True)
                    temporary = f"{folder}/.tmp-{context.taskAttemptId()}-{number}"
                    sink, count, size, span = store.open_output_stream(temporary), 0, 0, [page_id, None]
                sink.write(member)
                count, size, span[1] = count + 1, size + len(member), page_id
                if size >= roll:
                    yield close()
        if sink is not None:
            yield close()

    manifest = ordered.select("page_id", "digest", "kind", "url", "html", "refers_to").mapInArrow(write, MANIFEST)
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest")


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if f"sha1:{base32_sha1(block)}" != headers["warc-block-digest"]:
            raise ValueError(f"block digest of {headers['warc-record-id']} differs")
        yield headers, block


def read_archives(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """The records of all files that the manifest lists. Checks block and payload digests and record counts."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        names = [part.split()[0] for part in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[part.split()[1]] for part in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in records_of(io.BufferedReader(stream)):
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["warc-payload-length"])
                        if h["warc-type"] == "response" and (base32_sha1(payload), len(payload)) != (digest, length):
                            raise ValueError(f"payload of {h['warc-record-id']} differs")
                        page, refers = h.get("warc-page-id"), h.get("warc-refers-to-page-id")
                        rows.append((page and int(page), h["warc-target-uri"], length, digest, h["warc-type"], refers and int(refers),
                                     h["warc-record-id"], name, payload if with_payload else None))
                        seen, held = seen + 1, held + len(payload) * with_payload
                        if len(rows) == 10_000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, the manifest says {expected}")
                yield batch_of(rows)

    listed = manifest.select("file", "records")
    return listed.repartition(pieces(listed.count(), 1), "file").mapInArrow(read, RECORD)


def archive_root(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
