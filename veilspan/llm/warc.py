"""WARC archives: written as one gzip stream each, normalised to a member for each record, read back through an offset index.

1. write_streams: each record's text is built from columns and written by Spark's text writer, whose line separator is the end of a
   record; so a file is one whole gzip stream, on any file system that Spark writes to. Payloads that a larger page_id has too become
   revisit records, which hold the HTTP header and the digest only.
2. normalise: each file is inflated once, in chunks; every record is deflated as a gzip member of its own, and `<file>.idx` gets a line
   for each: offset, length, record id. Both appear under their names when they are whole, so a task that runs again does no harm.
3. read: index lines are dealt over tasks, which seek to the members and check each payload against its digest.

Executors open archives with pyarrow.fs, by the URI of a folder that all share (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import _own_dir, batch_bytes, discard, materialize

LEAST_REVISITED = 1000  # bytes of a payload that is not stored twice
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"  # of a header, and of a record
CHUNK = 1 << 20
LEVEL = 4  # of the members' deflate
_GZIP = 16 + zlib.MAX_WBITS


def _payload(html: str = "html") -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit(""))


def _keepers(pages: DataFrame, least: int) -> DataFrame:
    """(digest, keeper) of payloads of least bytes or more that several rows have: the largest page_id of these."""
    rows = pages.select("page_id", _payload().alias("p")).where(F.octet_length("p") >= least).select("page_id", F.sha1(F.col("p").cast("binary")).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper")


def _records(pages: DataFrame, keepers: DataFrame, date: str, least: int) -> Column:
    """One text column: the WARC record of each row, without the separator that ends it."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _payload().alias("p"))
    rows = rows.withColumn("size", F.octet_length("p")).withColumn("sha", F.sha1(F.col("p").cast("binary")))
    rows = rows.withColumn("looked_up", F.when(F.col("size") >= least, F.col("sha"))).join(keepers, F.col("looked_up") == F.col("digest"), "left")
    # the row or rows of the largest page_id are the response; a row without page_id revisits it
    rows = rows.withColumn("revisits", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    none = F.lit("")
    # control characters and spaces would end a header line or be lost
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size")), F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisits").isNull(), "response").otherwise("revisit")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))), F.lit("WARC-Record-ID: <urn:page:>\r\n")),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(line("WARC-Target-URI", url), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("revisits"), F.lit(">"))), none),
        F.when(F.col("revisits").isNull(), none).otherwise(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(http) + F.when(F.col("revisits").isNull(), F.col("size")).otherwise(0)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, http, F.when(F.col("revisits").isNull(), F.col("p")).otherwise("")).alias("value"))


def write_streams(pages: DataFrame, folder: str, date: str = DATE, least: int = LEAST_REVISITED) -> None:
    """Write a WARC record for each row (page_id, url, html) to `*.gz` files in folder, each one gzip stream."""
    keepers = materialize(_keepers(pages, least))  # its size is known when the join is planned: small, it is sent to the rows
    _records(pages, keepers, date, least).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)
    discard(keepers)


class _Stream:
    """Inflated bytes of one gzip file, of one member or many; keeps no more than a record and a chunk."""

    def __init__(self, file):
        self.file, self.inflater, self.rest, self.data = file, zlib.decompressobj(_GZIP), b"", bytearray()

    def _more(self) -> bool:
        raw = self.rest or self.file.read(CHUNK)
        if not raw:
            if not self.inflater.eof:
                raise ValueError("the gzip stream ends too early")
            return False
        if self.inflater.eof:  # another member follows
            self.inflater = zlib.decompressobj(_GZIP)
        self.data += self.inflater.decompress(raw)
        self.rest = self.inflater.unused_data
        return True

    def record(self) -> bytes | None:
        """The next record with its header, without what separates records; None at the end."""
        end = END.encode()
        at, met = -1, 0
        while (at := self.data.find(end, max(0, met - 3))) < 0:
            met = len(self.data)
            if not self._more():
                if self.data:
                    raise ValueError("a record's header is not whole")
                return None
        length = at + 4 + int(fields(bytes(self.data[:at]))["content-length"])
        while len(self.data) < length + 4:
            if not self._more():
                raise ValueError("a record is not whole")
        if self.data[length : length + 4] != end:
            raise ValueError("a record does not end where its header says")
        out = bytes(self.data[:length])
        del self.data[: length + 4]
        return out


def fields(header: bytes) -> dict[str, str]:
    """Named fields of a WARC or HTTP header, names in lower case."""
    lines = header.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _normalised(source: str, folder: str) -> tuple[str, int, int]:
    """Rewrite one stream as an archive with its index in folder; its name, records and bytes."""
    files, path = fs.FileSystem.from_uri(source)
    there, to = fs.FileSystem.from_uri(folder)
    name = path.rpartition("/")[2].partition(".")[0]
    mine = f"{to}/_{name}.{uuid.uuid4().hex}"
    n = at = 0
    with files.open_input_stream(path, compression=None) as file, there.open_output_stream(f"{mine}.gz", compression=None) as out, there.open_output_stream(f"{mine}.idx", compression=None) as index:
        stream = _Stream(file)
        while (record := stream.record()) is not None:
            deflater = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
            member = deflater.compress(record) + deflater.compress(END.encode()) + deflater.flush()
            out.write(member)
            index.write(f"{name}.warc.gz\t{at}\t{len(member)}\t{fields(record[: record.index(END.encode())])['warc-record-id']}\n".encode())
            at += len(member)
            n += 1
    there.move(f"{mine}.gz", f"{to}/{name}.warc.gz")
    there.move(f"{mine}.idx", f"{to}/{name}.warc.idx")  # last: an index stands for a whole archive
    return name, n, at


def normalise(spark: SparkSession, streams: str, folder: str) -> DataFrame:
    """Rewrite all gzip streams of a folder: (archive, n_records, n_bytes) of each. Runs at once."""
    there, to = fs.FileSystem.from_uri(folder)
    there.create_dir(to, recursive=True)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(streams).select("path")  # the content is not read

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column(0).to_pylist():
                name, n, size = _normalised(path, folder)
                yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n], "n_bytes": [size]})

    files = paths.count()
    return materialize(paths.repartition(max(1, files)).mapInArrow(run, "archive string, n_records long, n_bytes long"))


def _read(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, to = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in it:
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "archive", "offset")}
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, there.open_input_file(f"{to}/{archive}")
                record = zlib.decompress(file.read_at(length, offset), _GZIP)
                head, _, block = record.partition(END.encode())
                warc = fields(head)
                http, _, payload = block[: int(warc["content-length"])].partition(END.encode())
                digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(fields(http)["content-length"])
                kind = warc["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{archive} at {offset}: the payload is not what its header says")
                page = lambda field: int(x) if (x := warc.get(field, "").removeprefix("<urn:page:").removesuffix(">")) else None
                url = warc.get("warc-target-uri")
                row = (page("warc-record-id"), None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), size, digest, kind, page("warc-refers-to"), payload.decode() if kind == "response" else None, archive, offset)
                for values, value in zip(out.values(), row):
                    values.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_RECORD)
        if file:
            file.close()

    return run


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string()), ("archive", pa.string()), ("offset", pa.int64())])


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, offset, length, record_id) of all archives of a folder."""
    return spark.read.schema("archive string, offset long, length long, record_id string").option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.warc.idx").csv(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, archive, offset.

    A revisit's payload is null: it is that of the response it refers to. A payload that is not what its header says is an error.
    """
    rows = index(spark, folder).select("archive", "offset", "length")
    return rows.mapInArrow(_read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, archive string, offset long")


def write_and_read(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """Write the archives of pages (page_id, url, html) to the shared folder, read them back, and delete them: one row for each row.

    Null html is an empty payload; null page_ids and urls come back null. Rows of equal payloads of least bytes or more: those of the
    largest page_id are responses (several, where rows share it), the others, also those without a page_id, revisit it; if none has a
    page_id all are responses. Very long pages are records like others, held one at a time. An empty table gives no rows. Other columns
    are not read.
    """
    spark = pages.sparkSession
    base = f"{_own_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_streams(pages, f"{base}/streams", least=least)
    discard(normalise(spark, f"{base}/streams", f"{base}/archives"))
    delete(spark, f"{base}/streams")
    with batch_bytes(spark):
        out = materialize(read(spark, f"{base}/archives").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"))
    delete(spark, base)
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
