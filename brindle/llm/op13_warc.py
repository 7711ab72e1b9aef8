"""WARC archives: written by Spark, made seekable by a normaliser, read back by offset.

Spark's text writer makes the archives: a record is one row of text and the records' end mark is the line separator,
so each file is a single gzip stream on any file system that Spark writes to. Such a stream can be read from its start
only. The normaliser inflates each file once, as a stream of lines, puts its records together from their lengths, and
writes each as a gzip member of its own; a sidecar beside the archive tells every member's offset and length, so that
afterwards tasks read any stretch of an archive by itself.

Rewritten archives are put in place by renaming, so a task that runs twice leaves one whole file. They are written
with pyarrow's file systems (local and shared folders, HDFS and object stores).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import store

#: The end mark of a record.
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: So many payloads that several pages share go to all tasks (some 20 MB); more are joined, each dealt over SALTS tasks,
#: as one payload may belong to a third of all pages.
BROADCAST, SALTS = 200_000, 32
#: Bytes of a rewritten archive that one task reads back at a time.
STRETCH = 8 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string"


@dataclass(frozen=True)
class Archives:
    """A folder of rewritten archives and the table of their members."""

    folder: str
    index: DataFrame


def base32(hexadecimal: Column) -> Column:
    """40 hexadecimal digits as 32 base32 characters, upper case."""
    value = lambda i: F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda i, s: F.substring(F.lit(ALPHABET), F.shiftright(value(i), s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(i, s) for i in range(8) for s in (15, 10, 5, 0)])


def judged(pages: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, url, html) with payload, digest, and first: the least page_id of those with an equal payload of
    at least `least` bytes, null where the page itself is that page, its id is null, or it shares its payload with none.
    Then the table of payloads that several pages share, which those rows are read with."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    shared = rows.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = store.table(shared.select("key", "first"), "payloads")
    if shared.count() <= BROADCAST:
        rows = rows.join(F.broadcast(shared), "key", "left")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS))).join(salted, ["key", "salt"], "left")
    first = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), first.alias("first")), shared


def record_text(rows: DataFrame) -> Column:
    """The WARC record of judged rows, without its end mark."""
    plain = F.col("url")
    for char, escape in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), ("<", "%3C"), (">", "%3E")):
        plain = F.replace(plain, F.lit(char), F.lit(escape))
    revisit = F.col("first").isNotNull()
    urn = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    http = F.concat(F.lit(HTTP), F.octet_length("payload").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), plain, F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("digest")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END), http, F.when(revisit, "").otherwise(F.col("payload")),
    )


def write(pages: DataFrame, least: int = 0) -> str:
    """Write a record for every row of pages (page_id, url, html) and give the folder: gzip streams of many records each."""
    folder = f"{store.shared_dir(pages.sparkSession)}/brindle/warc-{uuid.uuid4().hex}"
    rows, shared = judged(pages, least)
    rows.select(record_text(rows).alias("value")).write.option("compression", "gzip").option("lineSep", END).text(folder)
    store.drop(shared)
    return folder


class Records:
    """Records put together from the lines of a file (without their \\n), fed one by one."""

    def __init__(self) -> None:
        self.head: list[bytes] = []
        self.body: list[bytes] | None = None
        self.size = self.left = 0

    def feed(self, line: bytes) -> bytes | None:
        """The record that this line ends, if it ends one, with its end mark."""
        if self.body is not None:
            self.body.append(line)
            self.left -= len(line) + 1
            if self.left > 0:
                return None
            block = b"\n".join(self.body)  # and what its last line has of the end mark: at most \r
            if self.left < -1:
                raise ValueError(f"record of more than its length: {self.head[:3]!r}")
            record = b"".join((b"\n".join(self.head), b"\n", block[: self.size], END.encode()))
            self.head, self.body = [], None
            return record
        if not self.head and line in (b"", b"\r"):  # what is left of an end mark
            return None
        if not self.head and not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:80]!r}")
        self.head.append(line)
        if line == b"\r":
            size = next((x.split(b":", 1)[1] for x in self.head if x.lower().startswith(b"content-length:")), None)
            if size is None:
                raise ValueError(f"record without a length: {self.head[:3]!r}")
            self.body, self.size, self.left = [], int(size), int(size) + 1
        return None

    def finish(self) -> None:
        if self.head or self.body is not None:
            raise ValueError(f"archive ends within a record: {self.head[:3]!r}")


def headers(record: bytes) -> dict[str, str]:
    """Named fields of a record's head (or of a block's), names in lower case."""
    head = record.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace")
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.split("\r\n")[1:] if ":" in line)}


def member(record: bytes) -> bytes:
    """One gzip member, the same for the same record."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _Out:
    """A rewritten archive and its sidecar, under names of their own until they are whole."""

    def __init__(self, folder: str, name: int) -> None:
        self.files, self.at = pafs.FileSystem.from_uri(folder)
        self.archive = f"part-{name & (2**64 - 1):016x}.warc.gz"
        self.draft = f"{self.at}/.{self.archive}.{uuid.uuid4().hex}"
        self.stream = self.files.open_output_stream(self.draft, compression=None)
        self.records, self.offset, self.rows = Records(), 0, []

    def feed(self, line: bytes) -> None:
        record = self.records.feed(line)
        if record is not None:
            packed, fields = member(record), headers(record)
            self.stream.write(packed)
            self.rows.append((self.archive, self.offset, len(packed), fields.get("warc-record-id", ""), fields.get("warc-type", "")))
            self.offset += len(packed)

    def close(self) -> list[tuple]:
        self.records.finish()
        self.stream.close()
        self._place(self.draft, f"{self.at}/{self.archive}")
        with self.files.open_output_stream(f"{self.draft}.idx", compression=None) as sidecar:
            for _, offset, length, record_id, kind in self.rows:
                sidecar.write(f"{offset} {length} {kind} {record_id}\n".encode())
        self._place(f"{self.draft}.idx", f"{self.at}/{self.archive}.idx")
        return self.rows

    def _place(self, draft: str, name: str) -> None:
        if self.files.get_file_info(name).type != pafs.FileType.NotFound:  # of a task that was run before
            self.files.delete_file(name)
        self.files.move(draft, name)


def _normalise(folder: str):
    names = [x.split()[0] for x in INDEX.split(", ")]

    def put(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = None, None
        for batch in batches:
            lines = batch.column("value").cast(pa.binary())
            for name, line in zip(batch.column("file").to_pylist(), lines):
                if name != now:
                    if out:
                        yield from put(out.close())
                    out, now = _Out(folder, name), name
                out.feed(line.as_py())
        if out:
            yield from put(out.close())

    return run


def _uri(folder: str) -> str:
    return folder if re.match(r"[a-z][a-z0-9+.-]+:", folder) else f"file://{folder}"


def _make_folder(folder: str) -> None:
    files, at = pafs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)


def normalise(spark: SparkSession, source: str) -> Archives:
    """Rewrite every archive (*.gz, of any number of members) of a folder as one member a record, with a sidecar.

    Records are taken from their lengths. A file that ends within a record, or has one without a length, raises.
    An archive of any size passes through its task as a stream; a record is held whole.
    """
    folder = _uri(f"{store.shared_dir(spark)}/brindle/warc-{uuid.uuid4().hex}")
    _make_folder(folder)
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(source).select(F.xxhash64("_metadata.file_path").alias("file"), "value")
    return Archives(folder, store.table(store.map_arrow(lines, _normalise(folder), INDEX), "warc_index"))


PARSED = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse(record: bytes) -> tuple:
    """A response's or revisit's row of PARSED; a revisit's payload is null, its size and digest those it was recorded with."""
    fields = headers(record)
    block = record.split(b"\r\n\r\n", 1)[1][: int(fields["content-length"])]
    http, payload = headers(block), block.split(b"\r\n\r\n", 1)[1] if b"\r\n\r\n" in block else b""
    page = lambda urn: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+):", urn)) else None
    at = page(fields.get("warc-record-id", "")), fields.get("warc-target-uri", "")
    if fields.get("warc-type") == "revisit":
        return *at, None, int(http.get("content-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:"), "revisit", page(fields.get("warc-refers-to", ""))
    return *at, payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), fields.get("warc-type", ""), None


def _read(folder: str, columns: list[str]):
    names = [x.split()[0] for x in PARSED.split(", ")]
    schema = pa.schema([(n, t) for n, t in zip(names, (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())) if n in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for archive, members in zip(batch.column("archive").to_pylist(), batch.column("members").to_pylist()):
                with files.open_input_file(f"{at}/{archive}") as source:
                    for m in members:
                        record = zlib.decompress(source.read_at(m["length"], m["offset"]), 31)
                        rows.append({k: v for k, v in zip(names, parse(record)) if k in columns})
                        if len(rows) >= 200:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read(archives: Archives, payload: bool = False) -> DataFrame:
    """page_id, url, payload (if asked for), payload_bytes, payload_digest, record_type, refers_to of every record.

    Stretches of an archive are read by different tasks, each member at its own offset.
    """
    columns = [x.split()[0] for x in PARSED.split(", ") if payload or not x.startswith("payload binary")]
    members = archives.index.withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    size = members.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # as many tasks as there are stretches, which are rows too small to be dealt by their size
    members = members.repartition(members.sparkSession.sparkContext.defaultParallelism + size // STRETCH, "archive", "stretch")
    stretches = members.groupBy("archive", "stretch").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))
    schema = ", ".join(x for x in PARSED.split(", ") if x.split()[0] in columns)
    return store.map_arrow(stretches, _read(archives.folder, columns), schema)


def digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written and read back.

    pages: page_id, url, html. Null html is an empty payload, a null url an empty one; line ends in a URL are escaped.
    Rows that repeat page_id and payload have a record each, alike; those with a null id are responses. A payload of
    any length is one record. An empty table has no records. The archives stay under the shared folder.
    """
    source = write(pages.select("page_id", "url", "html"), least)
    archives = normalise(pages.sparkSession, source)
    store.drop_folder(pages.sparkSession, source)
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d"""
