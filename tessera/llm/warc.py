"""WARC archives that are written with their index and read through it.

Writing: every task writes one archive of gzip members (one per record) and returns an index row for
each record, with archive, offset, length, URL and payload digest. The index is a Parquet table, so it lists only
archives of tasks that Spark committed; what a lost task left is never read. Of records with equal payloads
one is a response and the others revisit it.

Reading: the index comes first. Selected rows are sorted by archive and offset, neighbours whose gap is small are
coalesced into one byte range, and each range is one read. Records are parsed from the ranges and checked
against the digest of the index.

Files go through ``pyarrow.fs``, so the folder may be local, HDFS or an object store.

Defined results: null html is an empty payload; null URLs become ``urn:page:<id>``; a null page_id takes no part in choosing the response unless
all are null; rows that repeat the
response's page_id and payload are stored each; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch, broadcast_if_small

#: Bytes between two selected records that are read rather than skipped, and bytes of one read at most.
GAP, MOST_READ = 64 << 10, 8 << 20
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 0
_DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id {kind}, archive string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to {kind}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, url: str, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    """One WARC/1.1 record with an HTTP response block; a revisit has the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, size of the full payload, and the payload (empty for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, size, payload


def _name(page) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}").urn


def _url(url: str | None, page) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page}"


def write_archives(pages: DataFrame, path: str, *, least: int = LEAST_REVISIT) -> str:
    """Write ``pages(page_id, url, html)`` under ``path`` and return the path of the index."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # which page stores each payload: digests and ids only are shuffled, pre-aggregated where a payload is common
    digests = pages.select("page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("size"))
    digests = scratch.table(digests, "digests")
    keepers = digests.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "keeper")
    keepers = scratch.table(keepers, "keepers")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"))
    rows = rows.join(broadcast_if_small(keepers, keepers.count(), 500_000), "sha", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            index = []
            for page, url, html, keeper in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if out is None:
                    store.create_dir(f"{root}/archives", recursive=True)
                    out = store.open_output_stream(f"{root}/archives/{name}", compression=None)
                data = (html or "").encode()
                digest, revisit = digest32(data), keeper is not None and keeper != page
                where = _url(url, page)
                raw = record("revisit" if revisit else "response", _name(page), where, digest, len(data), b"" if revisit else data, _name(keeper) if revisit else None)
                packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                index.append((page, name, at, len(member), where, digest, len(data), "revisit" if revisit else "response", keeper if revisit else None))
                at += len(member)
            id_type = batch.column(0).type
            types = [id_type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), id_type]
            columns = list(zip(*index, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "archive", "offset", "length", "url", "digest", "payload_bytes", "record_type", "refers_to"])
        if out is not None:
            out.close()

    index = f"{path}/index"
    rows.select("page_id", "url", "html", "keeper").mapInArrow(run, INDEX.format(kind=kind)).write.mode("overwrite").parquet(index)
    scratch.drop("digests", "keepers")
    return index


def coalesce_ranges(selected: DataFrame, *, gap: int = GAP, most: int = MOST_READ) -> DataFrame:
    """Index rows with the byte range each is read in: ``archive, range`` plus the row's own columns.

    A range ends where the gap to the next record is over ``gap`` or the range would span more than about ``most`` bytes.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    apart = F.coalesce((F.col("offset") - F.lag(end).over(order) > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(order) / most)), F.lit(True))
    return selected.withColumn("apart", apart.cast("int")).withColumn("range", F.sum("apart").over(order)).drop("apart")


def read_records(spark: SparkSession, path: str, selected: DataFrame, *, payloads: bool = False, gap: int = GAP, most: int = MOST_READ) -> DataFrame:
    """The records that index rows ``selected`` point at, parsed from the archives.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` (and ``payload``). ``page_id`` and ``refers_to`` are those of
    the index once the names in the record's own header agree with them.
    """
    kind = selected.schema["page_id"].dataType.simpleString()
    ranges = coalesce_ranges(selected, gap=gap, most=most)
    wanted = ranges.groupBy("archive", "range").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "page_id", "digest", "refers_to"))).alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            id_type = batch.column(1).type.value_type.field("page_id").type
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lo, hi = records[0]["offset"], max(r["offset"] + r["length"] for r in records)
                with store.open_input_file(f"{root}/archives/{archive}") as f:
                    data = f.read_at(hi - lo, lo)
                out = []
                for r in records:
                    raw = zlib.decompress(data[r["offset"] - lo : r["offset"] - lo + r["length"]], 31)
                    headers, size, payload = parse(raw)
                    digest, sort = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    refers = headers.get("WARC-Refers-To", "").strip("<>")
                    sound = digest == r["digest"] and headers["WARC-Record-ID"] == f"<{_name(r['page_id'])}>" and (refers == _name(r["refers_to"]) if sort == "revisit" else not refers)
                    if sort == "response":
                        sound = sound and len(payload) == size and digest32(payload) == digest
                    if not sound:
                        raise ValueError(f"record at {r['offset']} of {archive} does not agree with the index")
                    out.append((r["page_id"], size, digest, sort, r["refers_to"] if sort == "revisit" else None, headers["WARC-Target-URI"], payload))
                types = [id_type, pa.int64(), pa.string(), pa.string(), id_type, pa.string(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                keep = len(names) if payloads else len(names) - 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*out, strict=True), types, strict=True))[:keep]], names[:keep])

    schema = f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string" + ", payload binary" * payloads
    return wanted.select("archive", "records").mapInArrow(run, schema)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages, then read every record back through the index."""
    index = write_archives(pages.select("page_id", "url", "html"), path)
    return read_records(pages.sparkSession, path, pages.sparkSession.read.parquet(index))
