"""WARC archives: write pages as gzip members with revisit records, read them back by byte ranges.

Writing: equal payloads of at least ``least`` bytes are found by an aggregate over (SHA-1, length); of a group the
largest id is a response, the others are revisits that refer to it. Each record is one gzip member. The members are written
by Spark's text sink as raw bytes, so files appear only when its commit protocol says so and any store that Spark writes
works. The sink ends each row with a NUL byte, and so does a member of under 16 MiB (the top byte of its length
field), whose last byte is therefore left to the sink; larger members are followed by an empty member, which ends in NUL too.

Reading: archives are cut into byte ranges. A task looks for the gzip magic within its range, validates a candidate by
inflating its head, which must begin with ``WARC/``, and reads on past the end of its range to finish a record that
starts inside. False magic within a member is never looked at, as the scan goes on behind each member; before the first
member of a range, candidates that don't inflate to a WARC header are skipped.

Defined cases: a null payload is empty, a null url is left out of the header; records with a null id are written and read
back with a null id; rows that repeat the largest id of a group are all responses; an empty table writes an archive
without records. Other columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
ID_PREFIX = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"  # records carry a fixed date, so that a retried task writes the same bytes
BLOCK = 1 << 20
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, path string, start long"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"").cast("binary"))
    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    slim = slim.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = (
        slim.filter(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "size", "response_id")
    )
    # Only large payloads have a join key, so small ones are not shuffled to one place.
    both = slim.join(groups, ["digest", "size"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return both.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("response_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    return MAGIC + b"\x00" + b"\x00" * 4 + b"\x00\xff" + deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def sink_row(data: bytes, level: int = 6) -> bytes:
    """A member without the NUL byte at its end."""
    made = member(data, level)
    if made[-1]:
        made += member(b"", level)
    return made[:-1]


def write(pages: DataFrame, path: str, **columns: object) -> None:
    """Write one archive per task under ``path``."""
    planned = plan_records(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i) for i in range(5)))
            made = [sink_row(record(a.as_py(), b.as_py(), c.as_py(), d.as_py(), e.as_py())) for a, b, c, d, e in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    members = planned.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.mode("errorifexists").option("lineSep", "\u0000").text(path)


def byte_ranges(spark: SparkSession, path: str, size: int = 8 << 20) -> DataFrame:
    """path, start, end of ranges of about ``size`` bytes. Listing files reads none of their content."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = files.filter("length > 0").select("path", F.explode(starts).alias("start"), "length")
    return ranges.select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))


class _Window:
    """Bytes of a file from a position on, read in blocks."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, b""

    def more(self) -> bool:
        got = self.file.read_at(min(BLOCK, max(0, self.size - self.at - len(self.data))), self.at + len(self.data)) if self.at + len(self.data) < self.size else b""
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _inflate(window: _Window) -> bytes | None:
    """The content of the member at the window's start, which is then skipped; None, without a move, if it is none."""
    machine, out, done, checked = zlib.decompressobj(31), [], 0, False
    try:
        while not machine.eof:
            if done == len(window.data) and not window.more():
                return None
            piece = window.data[done:]
            done = len(window.data)
            out.append(machine.decompress(piece))
            if not checked and (head := b"".join(out))[:5]:
                if not b"WARC/".startswith(head[:5]):
                    return None
                checked = len(head) >= 5
    except zlib.error:
        return None
    if not checked:
        return None
    window.skip(done - len(machine.unused_data))
    return b"".join(out)


def range_records(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end) of a file."""
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        window = _Window(file, start, file.size())
        while window.at < end:
            at = window.data.find(MAGIC)
            while at < 0 and window.at + len(window.data) < end + len(MAGIC):
                window.skip(max(0, len(window.data) - len(MAGIC) + 1))  # magic may straddle two blocks
                if not window.more():
                    return
                at = window.data.find(MAGIC)
            if at < 0 or window.at + at >= end:
                return
            window.skip(at)
            offset, content = window.at, _inflate(window)
            if content is None:
                window.skip(1)
            else:
                yield offset, content


def parse(content: bytes) -> dict:
    """Fields of a record; the payload of a revisit is null, its size and digest are those it was written with."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(ID_PREFIX)) else None
    kind = fields.get("warc-type")
    size, digest = len(payload), None
    if kind == "revisit":
        lengths = [line for line in http.decode("latin-1").split("\r\n") if line.lower().startswith("content-length:")]
        size, digest, payload = int(lengths[0].partition(":")[2]) if lengths else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
    else:
        digest = hashlib.sha1(payload).hexdigest()
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload, "payload_bytes": size, "payload_digest": digest}


#: Tasks that read an archive at most; beyond it a task reads several ranges.
MOST_TASKS = 100_000


def read(spark: SparkSession, path: str, size: int = 8 << 20) -> DataFrame:
    """One row per record of the archives under ``path``."""
    names = [part.split(" ")[0] for part in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.to_pylist():
                rows, held = [], 0
                for offset, content in range_records(where["path"], where["start"], where["end"]):
                    rows.append(parse(content) | {"path": where["path"], "start": offset})
                    held += len(content)
                    if held > BLOCK * 4:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    # A number that is given isn't lowered by the adaptive plan, which would see a few small rows.
    ranges = byte_ranges(spark, path, size)
    return ranges.repartitionByRange(max(1, min(ranges.count(), MOST_TASKS)), "path", "start").mapInArrow(run, READ_SCHEMA)


_KINDS = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "start": pa.int64()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS.get(n, pa.string())) for n in names], names=names)


def archive_path(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
