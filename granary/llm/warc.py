"""WARC archives: a writer, and a reader that salvages what it can.

Archives are WARC/1.1 with one gzip member per record. The reader checks each record (the member's own checksum, the header, the
length, the end mark, the digests). After a failed check it searches for the next gzip member or version line that starts a valid
record, goes on there, and logs the bytes between as a quarantined gap. It holds one record and a window of the file, never a
whole archive. Plain (not compressed) archives are read the same way.

Tasks write below a shared folder: a file gets its final name only when it is complete, and a task that runs again writes the
same names, so a lost executor costs its unfinished files only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import checked_broadcast, map_batches, own_folder, settle, table

FILE_BYTES = 32 << 20
PIECE = 1 << 18
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_END = b"\r\n\r\n"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
#: Bytes of a plain record in which its header's end is looked for first; a longer header is searched for piece by piece.
HEADER_BYTES = 1 << 16


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, not yet compressed: a response holds its payload; a revisit holds the HTTP header only, and names the response."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1(payload)}")
    lines.append(f"WARC-Block-Digest: sha1:{sha1(block)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Broken(ValueError):
    pass


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of one record; Broken if a check fails."""
    end = data.find(_END)
    if not data.startswith(_VERSION) or end < 0:
        raise Broken("no header")
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line without a colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not MANDATORY <= fields.keys():
        raise Broken("a mandatory field is missing")
    length = fields["content-length"]
    if not length.isdigit() or len(data) != end + 8 + int(length) or not data.endswith(_END):
        raise Broken("length")
    block = data[end + 4 : -4]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1(block):
        raise Broken("block digest")
    return fields, block


class Window:
    """A file as bytes from a position on, read in pieces as they are needed."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from a position."""
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, PIECE))
        return self.held[at - self.start : at - self.start + n]

    def find(self, patterns: tuple[bytes, ...], at: int) -> int:
        """The first place from a position on where one of the patterns is, or the file's size."""
        while at < self.size:
            piece = self.read(at, PIECE)
            places = [p for p in (piece.find(x) for x in patterns) if p >= 0]
            if places:
                return at + min(places)
            if at + len(piece) >= self.size:
                break
            at += max(1, len(piece) - 8)
        return self.size


def _one(window: Window, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, fields, block) of the record at a position; Broken if there is no valid one."""
    head = window.read(at, 8)
    if head.startswith(_MAGIC):
        z, parts, k = zlib.decompressobj(31), [], at
        while not z.eof:
            piece = window.read(k, PIECE)
            if not piece:
                raise Broken("member is cut off")
            try:
                parts.append(z.decompress(piece))
            except zlib.error as e:
                raise Broken(str(e)) from e
            k += len(piece)
        fields, block = parse(b"".join(parts))
        return k - len(z.unused_data), fields, block
    if head.startswith(_VERSION):
        top = window.read(at, HEADER_BYTES)
        end = top.find(_END)
        if end < 0 and re.match(rb"WARC/1\.[0-9]+\r\n", top):
            # A line that starts a record can't be in a header: where many headers are broken, each search ends at the next one.
            stop = window.find((_END, b"\r\n" + _VERSION), at)
            if window.read(stop, 4) == _END:
                end = stop - at
                top = window.read(at, end + 4)
        length = re.search(rb"\r\n[Cc]ontent-[Ll]ength:[ \t]*([0-9]+)[ \t]*\r\n", top[: end + 2]) if end >= 0 else None
        if not length:
            raise Broken("no header")
        n = end + 8 + int(length[1])
        if at + n > window.size:
            raise Broken("record is cut off")
        fields, block = parse(window.read(at, n))
        return at + n, fields, block
    raise Broken("neither a member nor a version line")


def salvage(file, size: int) -> Iterator[tuple]:
    """('record', start, end, fields, block) and ('gap', start, end, reason, b'') of an archive, in order, covering all its bytes."""
    window, at, gap, why = Window(file, size), 0, None, ""
    while at < size:
        try:
            end, fields, block = _one(window, at)
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = window.find((_MAGIC, _VERSION), at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, why, b""
            gap = None
        yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, size, why, b""


def _file_system(path: str):
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row of pages below folder; (path, records, bytes) of the archives.

    Of rows whose payloads (html as UTF-8, null: empty) are equal and at least least_bytes long, that with the largest id is a response and
    the others, those of a null id too, revisit it; other rows, and those of a payload of which no row has an id, are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    copies = rows.filter("digest is not null").groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    copies = checked_broadcast(settle(copies.select(F.col("digest").alias("copied"), "first")), 200_000)
    told = rows.join(copies, F.col("digest") == F.col("copied"), "left").select("id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        context, number, held, done = TaskContext.get(), 0, [], []

        def flush() -> None:
            nonlocal number, held
            name = f"{base}/part-{context.partitionId():05d}-{number:04d}.warc.gz"
            trial = f"{name}.{context.taskAttemptId()}.tmp"
            data = b"".join(held)
            with fs.open_output_stream(trial, compression=None) as out:
                out.write(data)
            fs.move(trial, name)
            done.append((f"{folder}/{name.rpartition('/')[2]}", len(held), len(data)))
            number, held = number + 1, []

        waiting = 0
        for batch in batches:
            for i, url, payload, other in (row for k in range(0, batch.num_rows, 200) for row in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True)):
                held.append(member(record("response" if other is None else "revisit", i, url, payload, other)))
                waiting += len(held[-1])
                if waiting >= FILE_BYTES:
                    flush()
                    waiting = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["path", "records", "bytes"])

    return settle(map_batches(told, run, "path string, records long, bytes long"))


def read_archives(paths: DataFrame, path_col: str = "path", payloads: bool = True) -> DataFrame:
    """(path, start, end, gap, page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of archives.

    A row is a record, or, with gap not null, a quarantined stretch of bytes and why its first check failed. payloads=False leaves the payload
    null. Each archive is one task's; an archive that is missing fails the job.
    """
    kind = "path string, start long, end long, gap string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in kind.split(", ")]
        out: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(types), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _file_system(path)
                with fs.open_input_file(name) as file:
                    for what, start, end, fields, block in salvage(file, file.size()):
                        if what == "gap":
                            out.append((path, start, end, fields, *[None] * 7))
                            continue
                        head, _, payload = block.partition(_END)
                        length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", head)
                        number = lambda f, fields=fields: int(fields[f]) if re.fullmatch(r"-?\d+", fields.get(f, "")) else None
                        revisit = fields.get("warc-type") == "revisit"
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else sha1(payload)
                        out.append((path, start, end, None, number("page-id"), fields.get("warc-target-uri"), fields.get("warc-type"), digest, int(length[1]) if revisit and length else len(payload), number("refers-to-page-id"), payload if payloads else None))
                        size += len(payload) if payloads else 100
                        if size > 1 << 22 or len(out) > 5000:
                            yield batch_of()
                            out.clear()
                            size = 0
        yield batch_of()

    n = max(1, paths.count())
    return map_batches(paths.select(path_col).repartition(min(n, 100_000)), run, kind)


def op7_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """Per page, as read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The archives were just written, so a gap in one is an error and fails the query: no page is left out in silence.
    """
    folder = own_folder(spark, "warc")
    read = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), payloads=False)
    lost = F.raise_error(F.concat_ws(" ", F.lit("a gap in"), "path", F.lit("at"), F.col("start").cast("string"), "gap"))
    page = F.when(F.col("gap").isNotNull(), lost.cast("long")).otherwise(F.col("page_id"))
    return read.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
