"""Writing and reading WARC archives.

Archives hold one gzip member per record.  The reader is sequential: it feeds
chunks to an incremental zlib decompressor, frames each record by its
Content-Length and verifies the block's and the payload's digests; it holds
one record at a time.

``archive_pages`` writes pages as ``response`` records; of pages with equal
payloads of at least ``least`` bytes the one with the largest id is the
response and the others are ``revisit`` records that refer to it.  A record's
id is made of the page's id and its payload's digest.  Every task
writes its archives under a temporary name and then moves them, so a repeated
task replaces its files by equal ones.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

CHUNK = 1 << 16


def _b32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def digest_hex(value: str) -> str | None:
    """The hex form of a ``sha1:`` digest field, whether it is base 32 or hex."""
    name, _, text = value.strip().partition(":")
    if name.lower() != "sha1":
        return None
    if len(text) == 40:
        return text.lower()
    try:
        return base64.b32decode(text.upper()).hex()
    except ValueError:
        return None


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _uri(url: str) -> str:
    """A URL that is safe in a header: white space and controls percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def page_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{_b32(digest)}")]
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    return record(headers, http if refers_to else http + payload)


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of concatenated gzip members, decompressed as they come; an empty piece ends each member."""
    unpack = zlib.decompressobj(31)
    begun = False
    for chunk in chunks:
        while chunk:
            begun = True
            out = unpack.decompress(chunk, CHUNK)
            if out:
                yield out
            if unpack.eof:
                chunk = unpack.unused_data
                unpack, begun = zlib.decompressobj(31), False
                yield b""
            else:
                chunk = unpack.unconsumed_tail
    if begun:
        raise EOFError("the archive ends within a gzip member")


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers with lower-case names, block, whether its block digest holds), one record at a time."""
    buffer = bytearray()
    source = inflate(chunks)

    def fill(least: int) -> bool:
        while len(buffer) < least:
            piece = next(source, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while fill(1) and buffer[:1] in (b"\r", b"\n"):
            del buffer[:1]
        if not buffer:
            return
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise EOFError("the archive ends within a record's header")
        first, *lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers: dict[str, str] = {}
        name = ""
        for line in lines:
            if line[:1] in " \t" and name:
                headers[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        del buffer[: end + 4]
        length = int(headers["content-length"])
        if not fill(length):
            raise EOFError("the archive ends within a record's block")
        block = bytes(buffer[:length])
        del buffer[:length]
        told = headers.get("warc-block-digest")
        yield headers, block, told is None or digest_hex(told) in (None, hashlib.sha1(block).hexdigest())


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The entity of an HTTP block, else the block."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _write(batches: Iterator[pa.RecordBatch], where: str, date: str, roll: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(where)
    task = TaskContext.get()
    part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
    paths, counts, sizes = [], [], []
    sink, name, n, size, nulls = None, "", 0, 0, 0

    def close() -> None:
        sink.close()
        store.move(f"{base}/_temporary/{attempt}-{name}", f"{base}/{name}")
        paths.append(f"{where}/{name}")
        counts.append(n)
        sizes.append(size)

    for batch in batches:
        for page_id, url, html, digest, target in zip(*(batch.column(i) for i in range(5)), strict=True):
            page_id, digest = page_id.as_py(), digest.as_py()
            if sink is None:
                name, n, size = f"part-{part:06d}-{len(paths):04d}.warc.gz", 0, 0
                store.create_dir(f"{base}/_temporary", recursive=True)
                sink = store.open_output_stream(f"{base}/_temporary/{attempt}-{name}", compression=None)
            if page_id is None:
                nulls += 1
                rid = f"urn:page:null:{part}-{nulls}"
            else:
                rid = f"urn:page:{page_id}:{digest}"
            target = target.as_py()
            html = html.as_py()
            payload = html.encode("utf-8", "surrogatepass") if html else b""
            made = page_record(rid, url.as_py(), payload, digest, None if target is None else f"urn:page:{target}:{digest}", date)
            sink.write(made)
            n, size = n + 1, size + len(made)
            if size >= roll:
                close()
                sink = None
    if sink is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, digest, target`` of the pages whose payload a page of a larger id also has."""
    sums = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest")).where(F.octet_length("html") >= least).where("page_id is not null")
    groups = sums.groupBy("digest").agg(F.max("page_id").alias("target"), F.min("page_id").alias("least")).where("least < target").drop("least")
    return sums.join(groups, "digest").where("page_id < target").distinct()


def archive_pages(pages: DataFrame, where: str, least: int = 1000, date: str = "2000-01-01T00:00:00Z", roll: int = 64 << 20) -> DataFrame:
    """Write the pages' archives below the URI ``where``; returns the manifest ``path, records, bytes``, lazily."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    rows = rows.join(revisits(pages, least), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "target")
    return rows.sortWithinPartitions("page_id", "digest").mapInArrow(partial(_write, where=where, date=date, roll=roll), "path string, records long, bytes long")


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "verified", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(names) - (not with_payload)], names[: len(names) - (not with_payload)])

    for batch in batches:
        for content in batch.column(0):
            data = memoryview(content.as_buffer())
            rows: list[tuple] = []
            held = 0
            for headers, block, intact in read_records(data[i : i + CHUNK] for i in range(0, len(data), CHUNK)):
                revisit = headers.get("warc-type") == "revisit"
                payload = payload_of(headers, block)
                told = digest_hex(headers["warc-payload-digest"]) if "warc-payload-digest" in headers else None
                found = None if revisit else hashlib.sha1(payload).hexdigest()
                rows.append((headers.get("warc-record-id", "").strip("<>"), headers.get("warc-type"), headers.get("warc-target-uri"), headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None, told or found, None if revisit else len(payload), intact and (revisit or told in (None, found)), payload if with_payload else None))
                held += len(payload) if with_payload else 200
                if held > 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            yield flush(rows)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all ``*.warc.gz`` files below ``path``.

    Columns: ``record_id, record_type, target_uri, refers_to, payload_digest``
    (hex SHA-1), ``payload_bytes`` and ``payload`` (null and empty for
    revisits) and ``verified``: whether all digests hold.  An archive that
    ends within a record raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, verified boolean" + ", payload binary" * with_payload
    return files.select("content").mapInArrow(partial(_read, with_payload=with_payload), schema)


def warc_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in shared scratch and read them back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    verified``, one row per input row.  A null html is an empty payload, a
    null url leaves the target URI out.  Rows with a null id are responses and
    no revisit refers to them; rows that repeat the largest id of a group are
    all responses.  Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    where = scratch.path("archives")
    scratch.save(archive_pages(pages, where, least), "manifest")
    if not _exists(spark, where):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean")
    found = scratch.save(read_warc(spark, where, with_payload=False), "records")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("long")
    responses = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("sum"))
    again = found.where("record_type = 'revisit'").join(responses, "refers_to", "left")
    again = again.select("record_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", (F.col("verified") & F.coalesce(F.col("sum") == F.col("payload_digest"), F.lit(False))).alias("verified"))
    rows = found.where("record_type = 'response'").select(again.columns).unionByName(again)
    return rows.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"), "verified")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
