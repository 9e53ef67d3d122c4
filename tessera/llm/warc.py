"""WARC archives: written from page rows, read back as a table of chunks.

A payload is never held whole by the reader: a record comes as rows of (record, chunk number), each with the
digest of the payload up to and with that chunk, and the last one marked. Pages whose payload repeats that of
an earlier page are revisit records, which carry the digest and the length but no payload.

Defined results: a null html is an empty payload; a null url is written as an empty target; a null page_id is
written without an id and read as null, and never referred to; rows that repeat a page_id with the same payload
are of the same type; payloads below ``SMALLEST`` bytes are always responses; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.lean import lean
from tessera.llm.store import bounded_batches, filesystem, new_path, put, saved

#: Payloads from this size on may be revisits.
SMALLEST = 100
CHUNK_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
SCHEMA = "record_id string, page_id long, target_uri string, record_type string, refers_to long, chunk_no int, start long, data binary, digest_so_far string, last boolean, payload_bytes long, payload_digest string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> list[bytes]:
    """The parts of one record."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    body = len(http) + (len(payload) if refers_to is None else 0)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}:{digest}')}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if refers_to is not None:
        head += [f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}"]
    return ["\r\n".join(head).encode() + _END, http, *([payload] if refers_to is None else []), _END]


def first_pages(pages: DataFrame) -> DataFrame:
    """(digest, first_page) of the payloads that occur more than once; two sums a digest, combined before they are shuffled."""
    return pages.where(F.col("payload_bytes") >= SMALLEST).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").select("digest", "first_page")


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, list[str]]:
    """Write one archive a partition; (folder, names). The join of digests is one that AQE splits at hot digests."""
    folder = folder or new_path(pages.sparkSession, "warc")
    bounded_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    repeated = saved(first_pages(rows.drop("payload", "url")), "repeated")
    known = rows.join(repeated.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left")
    known = known.withColumn("refers_to", F.when(F.col("page_id") != F.col("first_page"), F.col("first_page"))).select("page_id", "url", "payload", "digest", "refers_to")

    @lean
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, count = f"{TaskContext.get().partitionId():07d}.warc", [0]

        def records(stream):
            for batch in batches:
                for p, u, b, d, r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    for part in record(p.as_py(), u.as_py(), b.as_py(), d.as_py(), r.as_py()):
                        stream.write(part)
                    count[0] += 1

        put(f"{folder}/{name}", records)
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [count[0]]})

    names = known.mapInArrow(archive, "name string, records long").where("records > 0").collect()
    return folder, sorted(r["name"] for r in names)


def _header(stream) -> dict[str, str] | None:
    """The next header block's fields; None at the end of the file."""
    lines = []
    while True:
        line = stream.readline()
        if not line:
            return None
        line = line.strip(b"\r\n")
        if line:
            lines.append(line.decode("utf-8", "replace"))
        elif lines:
            return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def chunks(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of an open archive; holds one chunk at a time."""
    while (head := _header(stream)) is not None:
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            before = stream.tell()
            _header(stream)
            left -= stream.tell() - before
        known = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        row = {"record_id": head.get("warc-record-id"), "page_id": int(head["x-page-id"]) if "x-page-id" in head else None, "target_uri": head.get("warc-target-uri"), "record_type": head.get("warc-type")}
        row["refers_to"] = int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None
        digest, at, number = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left)) if left else b""
            if len(data) < min(chunk_bytes, left):
                raise ValueError(f"{row['record_id']} is cut short")
            digest.update(data)
            left -= len(data)
            last = left == 0
            full = {"payload_bytes": None, "payload_digest": None}
            if last and row["record_type"] == "revisit":
                full = {"payload_bytes": int(head["x-payload-length"]), "payload_digest": known}
            elif last:
                if known and known != digest.hexdigest():
                    raise ValueError(f"{row['record_id']} differs from its digest")
                full = {"payload_bytes": at + len(data), "payload_digest": digest.hexdigest()}
            yield row | {"chunk_no": number, "start": at, "data": data, "digest_so_far": digest.copy().hexdigest(), "last": last} | full
            at, number = at + len(data), number + 1
            if last:
                break


def read(spark: SparkSession, folder: str, names: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of archives, a task for each archive."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if not names:
        return spark.createDataFrame([], SCHEMA)
    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                system, path = filesystem(f"{folder}/{name}")
                held, size = [], 0
                with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as stream:
                    for row in chunks(stream, chunk_bytes):
                        held.append(row)
                        size += len(row["data"])
                        if size >= 4 * chunk_bytes or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names)).mapInArrow(rows, SCHEMA)


def archived(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` and return a row per record from their last chunks."""
    folder, names = write(pages)
    return read(pages.sparkSession, folder, names).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_page from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_page then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and page_id <> first_page then first_page end as refers_to from f
"""
