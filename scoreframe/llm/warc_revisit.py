"""WARC archives in which equal payloads are stored once: one response, revisit records for the rest.

Headers (ids, digest, size; no payload) are grouped by payload digest, each revisit is joined to the
response it refers to, and the records are written to gzip archives with new headers. Reading takes
the archives back apart, checks each payload against its digest and joins revisits to responses by
record id.

At scale: only digests that occur more than once are kept, found by a map-side maximum, so a payload
that a third of all pages share costs one row per task. Revisits meet their responses on headers;
the payloads are dealt once, by row number, evenly. Tasks write archives of bounded size and report
them in a table, so a lost attempt's files are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import shared_dir, stored
from scoreframe.llm.files import reading, writing

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, page_id {id}, payload_bytes long, payload_digest string, refers_to string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, id_col: str, url_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """``uid, page_id, url, payload, refers_uid``: the row whose payload a row repeats, or null.

    Of equal payloads of at least ``min_bytes`` the row with the largest id is the response (null ids
    are smallest; of repeated rows, one); smaller payloads are all responses.
    """
    payload = F.encode(F.coalesce(pages[text_col], F.lit("")), "UTF-8")
    rows = pages.select(
        F.monotonically_increasing_id().alias("uid"), pages[id_col].alias("page_id"), pages[url_col].alias("url"),
        payload.alias("payload"),
    )
    # Row numbers must stay as they are; later steps read them from this table.
    rows = stored(rows, "pages")
    heads = rows.select(
        "uid", "page_id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("sha2"),
    ).where(F.col("size") >= min_bytes)
    heads = stored(heads.select("uid", "page_id", F.concat("sha1", "sha2").alias("digest")), "heads")
    groups = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "uid")).alias("keep"))
    groups = stored(groups.where("n > 1").select("digest", F.col("keep.uid").alias("refers_uid")), "groups")
    revisits = stored(heads.join(groups, "digest").where("uid != refers_uid").select("uid", "refers_uid"), "revisits")
    return rows.join(revisits, "uid", "left")


def _record(kind: str, rid: str, url: str | None, page_id, payload: bytes, refers: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{rid}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"] if refers else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(
    pages: DataFrame, directory: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE,
) -> DataFrame:
    """Write a record per row; ``archive`` (path), ``records``, ``bytes`` of each archive.

    Null payloads are empty ones, null urls and ids have no header; other columns are not read; an
    empty table writes nothing.
    """
    directory = directory or shared_dir(pages.sparkSession, "archives")
    planned = plan_records(pages, id_col, url_col, text_col, min_bytes)

    def name(uid: int) -> str:
        return uuid.uuid5(uuid.NAMESPACE_URL, f"{directory}#{uid}").urn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (r for b in batches for r in zip(*(b.column(k) for k in range(5)), strict=True))
        row, number = next(rows, None), 0
        while row is not None:
            path = f"{directory}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
            records = size = 0
            with writing(path) as out:
                while row is not None and size < archive_bytes:
                    uid, page_id, url, payload, refers = (v.as_py() for v in row)
                    kind = "response" if refers is None else "revisit"
                    to = None if refers is None else name(refers)
                    data = _record(kind, name(uid), url, page_id, payload, to, date)
                    out.write(data)
                    records, size, row = records + 1, size + len(data), next(rows, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": [records], "bytes": [size]})

    chosen = planned.select("uid", "page_id", "url", "payload", "refers_uid")
    return stored(chosen.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            head[key.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """A row per record of the archives in ``manifest``: type, id, payload size and digest, what it refers to.

    A payload that doesn't match its digest raises. Sizes of revisits come from their HTTP head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for b in batches for p in b.column("archive")):
            rows = []
            with reading(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for head, block in _parse(io.BufferedReader(stream)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
                        raise ValueError(f"{path}: payload of {head['warc-record-id']} is damaged")
                    refers = head.get("warc-refers-to")
                    rows.append({
                        "record_id": head["warc-record-id"], "record_type": head["warc-type"], "page_id": head.get("x-page-id"),
                        "payload_bytes": size, "payload_digest": digest, "refers_to": refers,
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([(k, pa.int64() if k == "payload_bytes" else pa.string()) for k in (
        "record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to")])
    # An explicit number: a few paths would else end up in one task, whatever their archives hold.
    files = manifest.select("archive").repartition(max(manifest.count(), 1))
    found = files.mapInArrow(run, RECORD.format(id="string"))
    return found.withColumn("page_id", F.col("page_id").cast(id_type))


def resolve(records: DataFrame) -> DataFrame:
    """The records with ``refers_to`` as the id of the response's page; revisits of unknown records raise no error but get null."""
    records = stored(records, "records")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    first = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page")
    )
    # Records that refer to nothing stay out of the join, where they would all have one key.
    found = records.where("refers_to IS NOT NULL").join(first, "refers_to", "left").select(*names, F.col("to_page").alias("refers_to"))
    alone = records.where("refers_to IS NULL").select(*names, F.lit(None).cast(records.schema["page_id"].dataType).alias("refers_to"))
    return found.unionByName(alone)
