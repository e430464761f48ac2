"""WARC archives as a Spark data source: one gzip member per record, read back by byte ranges.

Writing: every task writes one file of its own name; the driver's commit lists the files of the tasks that count in a
manifest, so a task that ran twice or died leaves nothing that is read. Reading: archives are cut into byte ranges; a
task looks for the gzip magic from its range's start, takes a candidate only if it decodes to a WARC header, and owns the
records that start inside its range, however far past its end they run.

Defined results: null html is an empty payload; null url gives no target; of rows with equal payloads of at least
min_revisit bytes those with the largest page_id are responses, the others revisits of it; null page_ids never win; an
empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kinfolk.runtime import shared_path, sized_join, stored

MAGIC = b"\x1f\x8b\x08"
MANIFEST = "manifest.json"
CHUNK = 1 << 18
ROWS = 256
PAGE_URN = "urn:page:"
INPUT = "page_id bigint, url string, html string, refers_to bigint"
#: Of a record: both are of the full payload, also for a revisit, which stores none.
OUTPUT = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"


def member(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PAGE_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parsed(record: bytes) -> tuple:
    """A row of OUTPUT from the bytes of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(m[1]) if (m := re.search(rf"{PAGE_URN}(-?\d+)>", fields.get(k, ""))) else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("WARC-Refers-To"), length, digest, payload.decode("utf-8", "surrogatepass") if fields["WARC-Type"] == "response" else None


def starts_record(data: bytes) -> bool | None:
    """Whether data begins a gzip member that holds a WARC record; None: too short to say."""
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(data, 2048)
    except zlib.error:
        return False
    if len(head) < 16 and not z.eof:
        return None if b"WARC/1.".startswith(head[:7]) or head.startswith(b"WARC/1.") else False
    return head.startswith(b"WARC/1.") and b"\r\nWARC-" in head


class _Window:
    """A file read forwards in chunks; holds only the bytes from a moving position on."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, b""
        file.seek(at)

    def more(self) -> bool:
        new = self.file.read(CHUNK)
        self.data += new
        return bool(new)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def records(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end) of a file."""
    w = _Window(file, start, size)
    found = False
    while w.at < end:
        while not found:
            k = w.data.find(MAGIC)
            if k < 0:
                w.skip(max(0, len(w.data) - 2))
                if w.at >= end or not w.more():
                    return
                continue
            w.skip(k)
            if w.at >= end:
                return
            verdict = starts_record(w.data)
            if verdict is None:
                if w.more():
                    continue
                return
            found = verdict
            if not found:
                w.skip(1)
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not w.data and not w.more():
                raise ValueError("an archive ends inside a record")
            n = len(w.data)
            out.append(z.decompress(w.data))
            w.skip(n - len(z.unused_data))
        yield b"".join(out)
        while len(w.data) < 3 and w.more():
            pass
        if not w.data:
            return
        found = w.data.startswith(MAGIC)


class _Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None, records: int, size: int):
        self.name, self.records, self.size = name, records, size


#: Bytes that a read task takes at least, and how many ranges an archive has at most before they grow.
RANGE, MOST_RANGES = 16 << 20, 100_000


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[_Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.load(f)["files"]  # with their sizes: no call per file
        step = max(self.range_bytes, -(-sum(size for _, size in files) // MOST_RANGES))
        out = [_Range(f"{root}/{name}", size, a, min(size, a + step)) for name, size in files for a in range(0, size, step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range):
        schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in OUTPUT.split(", ")])
        if not part.size:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        with store.open_input_file(part.path) as f:
            for record in records(f, part.size, part.start, part.end):
                rows.append(parsed(record))
                if len(rows) >= ROWS:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = fs.FileSystem.from_uri(self.path)
        name, n, file = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in iterator:
                columns = [batch.column(k).to_pylist() for k in range(4)]
                for row in zip(*columns, strict=True):
                    if file is None:
                        store.create_dir(root, recursive=True)
                        file = store.open_output_stream(f"{root}/{name}", compression=None)
                    file.write(member(*row))
                    n += 1
        except BaseException:  # a failed task takes its part with it; parts that no manifest names are never read
            if file is not None:
                file.close()
                store.delete_file(f"{root}/{name}")
            raise
        if file is None:
            return _Written(None, 0, 0)
        size = file.tell()
        file.close()
        return _Written(name, n, size)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None and m.name]
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"files": sorted((m.name, m.size) for m in done), "records": sum(m.records for m in done)}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Delete the parts of the tasks that had finished when the job failed."""
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    """format("warc"): options path, and rangeBytes (the size of a read task's byte range, 16 MB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return OUTPUT

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE))))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id and digest of the records to write as revisits, with the response they refer to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.filter(F.octet_length(html) >= min_revisit).select("page_id", F.sha1(html.cast("binary")).alias("digest"))
    groups = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    return groups


def write_archive(pages: DataFrame, path: str, min_revisit: int = 1000) -> None:
    """Write a record per page (page_id, url, html) under path."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    groups = stored(revisits(pages, min_revisit), "revisits")
    html = F.coalesce(F.col("html"), F.lit(""))
    large = F.when(F.octet_length(html) >= min_revisit, F.sha1(html.cast("binary")))
    keyed = pages.select("page_id", "url", "html", F.coalesce(large, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).alias("digest"))  # small rows meet nothing, each on a key of its own
    rows = sized_join(keyed, groups, "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), None).otherwise(F.col("refers_to"))
    rows.select(F.col("page_id").cast("long"), "url", "html", refers.cast("long").alias("refers_to")).write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records under path; see OUTPUT."""
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("path", path).option("rangeBytes", str(range_bytes)).load()


def round_trip(pages: DataFrame, min_revisit: int = 1000, range_bytes: int = RANGE) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_revisit)
    return read_archive(pages.sparkSession, path, range_bytes)
