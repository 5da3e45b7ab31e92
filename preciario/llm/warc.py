"""WARC archives as a Spark data source, and the assembly of captures from their records.

``WarcSource`` writes one gzip member per record into one file per task; files are
written beside the target under a name of the attempt and moved there when the
job commits, so lost tasks leave nothing behind.  It reads one file per task, as a
stream.  Both go through Arrow's file systems, so the archive may lie in any store
that they and Spark share.

``assemble`` brings the records of a capture together: request and metadata
records name the response (or each other) in WARC-Concurrent-To.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Payloads shorter than this are never replaced by a revisit.
SHORTEST = 100

#: Names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "record_type string, record_id string, concurrent_to string, target_uri string, payload_digest string, "
    "profile string, fields map<string,string>, payload binary"
)
PAYLOAD_IN = ("response", "revisit")


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {clean(v)}".encode("utf-8", "replace") for k, v in headers.items() if v is not None]
    lines.append(b"Content-Length: %d" % len(block))
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def clean(value: str) -> str:
    """Header values can't hold line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def capture_records(row, run: str) -> Iterator[bytes]:
    """The request, response or revisit, and metadata records of one capture."""
    made = {kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{kind}')}>" for kind in ("request", "capture", "metadata")}
    payload = (row["html"] or "").encode("utf-8", "replace")
    same = {"WARC-Date": DATE, "WARC-Target-URI": row["url"]}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = f"sha256:{row['digest']}"
    yield record(
        "request",
        {"WARC-Record-ID": made["request"], "WARC-Concurrent-To": made["capture"], **same, "Content-Type": "application/http;msgtype=request"},
        b"GET / HTTP/1.1\r\n\r\n",
    )
    again = row["record_type"] == "revisit"
    yield record(
        row["record_type"],
        {
            "WARC-Record-ID": made["capture"],
            **same,
            "Content-Type": "application/http;msgtype=response",
            "WARC-Payload-Digest": digest,
            "WARC-Profile": PROFILE if again else None,
        },
        http if again else http + payload,
    )
    fields = {"page-id": row["page_id"], "payload-bytes": row["payload_bytes"], "refers-to-page": row["refers_to"]}
    yield record(
        "metadata",
        {"WARC-Record-ID": made["metadata"], "WARC-Concurrent-To": made["request"], **same, "Content-Type": "application/warc-fields"},
        b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None),
    )


def members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one after the other."""
    unpacker, parts = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(parts)
            data, parts, unpacker = unpacker.unused_data, [], zlib.decompressobj(31)
            data = data or stream.read(1 << 20)
        else:
            data = stream.read(1 << 20)
    if any(parts):
        raise ValueError("the archive ends inside a record")


def named(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return found


def parsed(member: bytes) -> tuple:
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = named(head)
    block = rest[: int(headers.get("content-length", "0"))]
    kind, fields, payload = headers.get("warc-type"), {}, None
    if kind in PAYLOAD_IN:
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "metadata":
        fields = named(block)
    digest = headers.get("warc-payload-digest")
    return (
        kind,
        headers.get("warc-record-id"),
        headers.get("warc-concurrent-to"),
        headers.get("warc-target-uri"),
        digest.partition(":")[2] if digest else None,
        headers.get("warc-profile"),
        fields,
        payload,
    )


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Archive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Archive]:
        store, path = opened(self.path)
        return [
            Archive(x.path) for x in store.get_file_info(pyarrow.fs.FileSelector(path)) if x.is_file and x.base_name.endswith(".warc.gz")
        ] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if partition.name:
            with opened(self.path)[0].open_input_stream(partition.name, compression=None) as stream:
                yield from map(parsed, members(stream))


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        context = TaskContext.get()
        store, path = opened(self.path)
        store.create_dir(f"{path}/_attempts", recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        with store.open_output_stream(f"{path}/_attempts/{name}", compression=None) as out:
            for number, row in enumerate(iterator):
                for member in capture_records(row, f"{path}/{context.partitionId()}/{number}"):
                    out.write(member)
        return Written(name)

    def commit(self, messages) -> None:
        store, path = opened(self.path)
        for message in messages:
            if message is not None:
                store.move(f"{path}/_attempts/{message.name}", f"{path}/{message.name}")

    def abort(self, messages) -> None:
        """Attempts stay in their folder, where the reader never looks."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, record_type, refers_to of every page.

    Of equal payloads of at least ``SHORTEST`` bytes the one of the smallest page_id is the
    response; rows that repeat this page_id as well are responses too, and rows without a page_id
    come after all others.  A null html is an empty payload.  Only digests are aggregated: a payload
    that a third of all pages share is one row per task before the shuffle.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    shared = (
        rows.where(F.col("payload_bytes") >= SHORTEST)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of all pages in the new folder ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    with_revisits(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    A request or metadata record belongs to the response that it names in WARC-Concurrent-To, or
    to the one named by the request that it names.  A record whose chain leads to no response makes a
    capture without response; a record without id is a capture of its own.  Columns of ``records``
    other than record_type, record_id and concurrent_to become fields of the nested records.
    """
    own = [c for c in records.columns if c not in ("record_type", "concurrent_to")]
    kind = F.col("record_type")
    requests = records.where(kind == "request").select(F.col("record_id").alias("__via"), F.col("concurrent_to").alias("__through")).where(F.col("__via").isNotNull())
    through = requests.groupBy("__via").agg(F.min("__through").alias("__through"))
    other = records.where(~kind.isin(*PAYLOAD_IN)).join(through, F.col("concurrent_to") == F.col("__via"), "left")
    nested = F.struct("record_type", *own).alias("__record")
    other = other.select(F.coalesce("__through", "concurrent_to", "record_id").alias("__capture"), kind.alias("__kind"), nested)
    first = records.where(kind.isin(*PAYLOAD_IN)).select(F.col("record_id").alias("__capture"), kind.alias("__kind"), nested)
    kind, record = F.col("__kind"), F.col("__record")
    return (
        first.unionByName(other)
        .withColumn("capture_id", F.coalesce("__capture", F.uuid()))
        .groupBy("capture_id")
        .agg(
            F.any_value(F.when(kind.isin(*PAYLOAD_IN), record), F.lit(True)).alias("response"),
            F.collect_list(F.when(kind == "request", record)).alias("requests"),
            F.collect_list(F.when(kind == "metadata", record)).alias("metadata"),
        )
    )


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages' archives to ``path``, read them back, assemble captures, and give for each page
    page_id, payload_bytes, payload_digest, record_type, refers_to.  For a response both figures are
    taken from the payload that was read; a revisit has none and brings those that were recorded.  A page_id is a whole number;
    one that isn't comes back as null."""
    write_archives(pages, path)
    read = read_archives(pages.sparkSession, path)
    narrow = read.select(
        "record_type",
        "record_id",
        "concurrent_to",
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).alias("n"),
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("digest"),
        F.to_json(F.col("fields")).alias("fields"),
    )
    field = lambda name: F.get_json_object(F.col("metadata")[0]["fields"], f"$['{name}']").cast("long")
    return assemble(narrow).select(
        field("page-id").alias("page_id"),
        F.coalesce(F.col("response.n"), field("payload-bytes")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
    )
