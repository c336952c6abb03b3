"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

Each task writes its records, one gzip member each, to an archive of its own and returns the index rows (offset,
length, url, digest, ...). The index is a Parquet table that Spark commits as a whole: archives of failed or
repeated attempts are in no index row and are deleted. Reading starts from the index: the selected rows are
sorted by archive and offset, ranges that lie near each other become one read, and records
are cut out of it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.shared import Scratch, attach, small_batches

INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
#: Archives hold records of about so many bytes, before a new one is begun.
ARCHIVE_BYTES = 1 << 30
#: One task reads so many bytes of an archive at most, one read covers so many, and skips gaps of so many.
BLOCK_BYTES, RANGE_BYTES, GAP_BYTES = 64 << 20, 4 << 20, 64 << 10
DATE = "2020-01-01T00:00:00Z"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _id(urn: str) -> int | None:
    key = urn.split(":")[2]
    return int(key) if key else None


def record(url: str | None, payload: bytes, page_id: int | None, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header alone as its block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        try:
            for batch in batches:
                rows = {k: [] for k in ("archive", "offset", "length", "url", "payload_digest", "page_id", "record_type")}
                for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        store, path = pafs.FileSystem.from_uri(name)
                        store.create_dir(path.rpartition("/")[0])
                        out = store.open_output_stream(path, compression=None)
                    data = _member(record(url, (html or "").encode("utf-8", "surrogatepass"), page_id, digest, refers_to, revisit))
                    out.write(data)
                    for k, v in zip(rows, (name, at, len(data), url, digest, page_id, "revisit" if revisit else "response")):
                        rows[k].append(v)
                    at += len(data)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))
        finally:
            if out is not None:
                out.close()

    return write


def payload_digest(html: str = "html"):
    """(digest, bytes) columns of the UTF-8 payload; null is empty."""
    col = F.coalesce(F.col(html), F.lit(""))
    return F.sha1(col.cast("binary")), F.octet_length(col).cast("long")


def write_warc(pages: DataFrame, folder: str, index: str, min_revisit: int = 1000) -> DataFrame:
    """Write a record for each row of (page_id, url, html) and return the index, a table at `index`.

    Of records with equal payloads of `min_revisit` bytes or more, that with the largest page_id is a response and
    the others revisit it. Should rows repeat that page_id too, all of them are responses. Null ids
    lose to any id, null urls are empty, null payloads are empty. A record's id is made from page_id and payload, so that a
    revisit can name its response without knowing where it is: rows that repeat both have one id, and differ in their places.
    """
    spark = pages.sparkSession
    small_batches(spark)
    digest, size = payload_digest()
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), digest.alias("digest"), size.alias("bytes"))
    large = rows.where(F.col("bytes") >= min_revisit)
    work = Scratch(spark, "warc")
    groups = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top"))
    groups = work.save(groups, "groups")
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    found = attach(large, groups, ["digest"], ["page_id", "url"], n_rows)
    none = F.lit(None).cast("long")
    cols = ["page_id", "url", "html", "digest"]
    revisit = (F.col("n") > 1) & ~F.col("page_id").eqNullSafe(F.col("top"))
    told = found.select(*cols, F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))
    told = told.unionByName(rows.where(F.col("bytes") < min_revisit).select(*cols, none.alias("refers_to"), F.lit(False).alias("revisit")))
    told.mapInArrow(_writer(folder), INDEX).write.mode("overwrite").parquet(index)
    work.drop("groups")
    written = spark.read.schema(INDEX).parquet(index)
    _drop_orphans(spark, folder, written)
    return written


def _drop_orphans(spark: SparkSession, folder: str, index: DataFrame) -> None:
    """Delete archives that no index row names: left by attempts that failed or came second."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(conf)
    if not store.exists(top):
        return
    known = {r.archive.rpartition("/")[2] for r in index.select("archive").distinct().toLocalIterator()}  # one name for each task or GB
    for status in store.listStatus(top):
        if status.getPath().getName() not in known:
            store.delete(status.getPath(), False)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows sorted by archive and offset, to records."""

    def ranges(rows):
        group: list[tuple[str, int, int]] = []
        for archive, offset, length in rows:
            if group and (archive != group[0][0] or offset - (group[-1][1] + group[-1][2]) > GAP_BYTES or offset + length - group[0][1] > RANGE_BYTES):
                yield group
                group = []
            group.append((archive, offset, length))
        if group:
            yield group

    opened, source = None, None
    for batch in batches:
        out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")}
        known = iter(batch.column(3).to_pylist())
        for group in ranges(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            archive, start, _ = group[0]
            if archive != opened:
                if source is not None:
                    source.close()
                store, path = pafs.FileSystem.from_uri(archive)
                opened, source = archive, store.open_input_file(path)
            data = source.read_at(group[-1][1] + group[-1][2] - start, start)
            for (_, offset, length), indexed in zip(group, known):
                fields, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
                out["page_id"].append(_id(fields["WARC-Record-ID"]))
                out["payload_bytes"].append(int(fields["X-Payload-Length"]))
                out["payload_digest"].append(digest)
                out["record_type"].append(fields["WARC-Type"])
                out["refers_to"].append(_id(fields["WARC-Refers-To"]) if revisit else None)
                out["verified"].append(None if revisit else hashlib.sha1(payload).hexdigest() == digest == indexed and len(payload) == int(fields["X-Payload-Length"]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))
    if source is not None:
        source.close()


def read_warc(selected: DataFrame) -> DataFrame:
    """Read the records of the index rows `selected`, whichever they are, by coalesced byte ranges.

    `verified` tells whether the payload that was read has the digest of the index and the digest and length that its header
    states; null for revisits, which have no payload.
    """
    block = F.floor(F.col("offset") / BLOCK_BYTES)
    rows = selected.select("archive", "offset", "length", "payload_digest").repartition("archive", block).sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(_reader, READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Archive all rows of (page_id, url, html) in the shared folder and read every record back."""
    work = Scratch(pages.sparkSession, "archives")
    return read_warc(write_warc(pages, work.path("warc"), work.path("index")))
