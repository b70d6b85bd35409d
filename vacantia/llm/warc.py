"""WARC archives compressed with Zstandard, one frame per record.

An archive is a skippable frame that holds the dictionary (itself a zstandard
frame, or plain), and then one frame per record, all made with that dictionary.
Archives travel as rows (path, content), the shape of Spark's binaryFile source,
so that they are read from any store Spark reads and written by Spark's writers.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, tune_arrow

#: Magic number of the skippable frame with the dictionary, of plain dictionaries, and of frames (fixed values of the formats).
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")


class WarcError(ValueError):
    """The archive is not whole or not valid."""


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response record with an HTTP head and the payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", "".join(c if " " < c else "%20" for c in uri)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if kind == "revisit":
        lines += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3, dictionary: int = 16384, train_on: int = 1 << 19) -> bytes:
    """An archive of the records. Its dictionary is trained on its first `train_on`
    bytes of records; too few or too uniform records have none, nor its frame."""
    made, out = None, []
    samples, size = [], 0
    for r in records:
        if size >= train_on:
            break
        samples.append(r[:8192])
        size += len(samples[-1])
    if len(samples) >= 16 and size > 8 * dictionary:
        try:
            made = zstandard.train_dictionary(dictionary, samples, d=6, k=256, level=level)
        except zstandard.ZstdError:
            made = None
    if made is not None:
        body = zstandard.ZstdCompressor(level=level).compress(made.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(body)) + body)
    press = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
    return b"".join(out + [press.compress(r) for r in records])


def _frames(content: bytes) -> Iterator[bytes]:
    """The decompressed frames of an archive, one at a time."""
    at, made = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", content, 4)[0]
        body = content[8 : 8 + n]
        if len(body) < n:
            raise WarcError("the dictionary's frame is cut off")
        if struct.unpack_from("<I", body)[0] == FRAME:
            body = zstandard.ZstdDecompressor().decompress(body)
        if len(body) < 8 or struct.unpack_from("<I", body)[0] != DICTIONARY:
            raise WarcError("the leading frame holds no dictionary")
        made, at = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT), 8 + n
    press = zstandard.ZstdDecompressor(dict_data=made)
    while at < len(content):
        if len(content) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", content, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]  # other skippable frames
            continue
        d = press.decompressobj()
        # Feed in steps, so that the rest of the archive is not copied for every record.
        begin, parts = at, []
        while not d.eof and at < len(content):
            chunk = content[at : at + (1 << 14)]
            try:
                parts.append(d.decompress(chunk))
            except zstandard.ZstdError as e:
                raise WarcError(f"the frame at byte {begin} is not valid: {e}") from e
            at += len(chunk) - len(d.unused_data)
        if not d.eof:
            raise WarcError(f"the frame at byte {begin} is cut off")
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """A record's kind, id, uri, date, payload digest and length, refers_to and payload, all checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not mark or not first.startswith(b"WARC/1."):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines.decode("utf-8").split("\r\n"):
        k, colon, v = line.partition(":")
        if not colon:
            raise WarcError(f"a header without a colon: {line[:80]!r}")
        fields.setdefault(k.strip().lower(), v.strip())
    for k in NEEDED:
        if k.lower() not in fields:
            raise WarcError(f"no {k}")
    try:
        length = int(fields["content-length"])
    except ValueError as e:
        raise WarcError("Content-Length is not a number") from e
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the block has {len(rest) - 4}")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("the block differs from its digest")
    kind, payload, size = fields["warc-type"], None, None
    if kind in ("response", "revisit"):
        http, mark, body = block.partition(b"\r\n\r\n")
        if not mark or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP head")
        sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        size = sizes[0] if sizes else len(body)
        if kind == "response":
            payload = body
            if size != len(body):
                raise WarcError(f"the HTTP head says {size} bytes, the payload has {len(body)}")
            if "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{digest(body)}":
                raise WarcError("the payload differs from its digest")
        elif body or "warc-refers-to" not in fields or fields.get("warc-profile") != IDENTICAL:
            raise WarcError("a revisit without its profile or reference, or with a payload")
    strip = lambda v: v.strip("<>") if v is not None else None
    return {"record_type": kind, "record_id": strip(fields["warc-record-id"]), "uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "payload_digest": fields.get("warc-payload-digest", "sha1:").removeprefix("sha1:") or None, "payload_bytes": size, "refers_to": strip(fields.get("warc-refers-to")), "payload": payload}


def plan(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages with _payload and _refers: of equal payloads of at least `least_bytes` bytes the
    one with the smallest id is written in full, all others refer to it.

    A null html is an empty payload. Rows without an id refer to the smallest id too; if
    no row of a payload has an id, all are written in full. Of rows that repeat the
    smallest id one is written in full. Bodies are joined by id, so a payload that many
    pages share is no hot key; who refers to what is settled on slim rows."""
    body = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.withColumn("_pid", F.col(page_id).cast("long")).withColumn("_payload", body).withColumn("_digest", F.sha1("_payload"))
    slim = rows.groupBy("_digest", "_pid").agg(F.count("*").alias("_n"), F.max(F.length("_payload")).alias("_bytes"))
    slim = stored(slim.filter(F.col("_bytes") >= least_bytes), "warc-slim")
    first = slim.filter("_pid IS NOT NULL").groupBy("_digest").agg(F.min(F.struct("_pid", "_n")).alias("f"))
    first = first.select(F.col("_digest").alias("_d"), F.col("f._pid").alias("_first"), F.col("f._n").alias("_times"))
    pairs = slim.join(first, F.col("_digest") == F.col("_d")).filter(F.coalesce(F.col("_pid") != F.col("_first"), F.lit(True)) | (F.col("_times") > 1))
    pairs = stored(pairs.select("_d", F.col("_pid").alias("_p"), "_first", F.coalesce(F.col("_pid") == F.col("_first"), F.lit(False)).alias("_again")), "warc-refers")
    same = F.col("_pid").eqNullSafe(F.col("_p")) & (F.col("_digest") == F.col("_d"))
    out = rows.join(small(pairs), same, "left")
    inner = ["_pid", "_digest", "_d", "_p", "_first", "_again"]
    if pairs.filter("_again").isEmpty():
        return out.withColumn("_refers", F.col("_first")).drop(*inner)
    plain = out.filter("NOT coalesce(_again, false)").withColumn("_refers", F.col("_first"))
    again = stored(out.filter("_again").withColumn("_row", F.monotonically_increasing_id()), "warc-again")
    full = again.groupBy(F.col("_d").alias("_of")).agg(F.min("_row").alias("_least"))
    again = again.join(full.select("_least"), F.col("_row") == F.col("_least"), "left").withColumn("_refers", F.when(F.col("_least").isNull(), F.col("_first")))
    return plain.drop(*inner).unionByName(again.drop(*inner, "_row", "_least"))


def write(pages: DataFrame, page_id: str = "page_id", uri: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """Rows (path, content): archives of about `archive_bytes` of records each.

    A record's id is urn:page: and the page's id (urn:page:none without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{made:05d}.warc.zst"]), pa.array([archive(held, level)], pa.binary())], names=["path", "content"])

        for b in batches:
            for pid, address, payload, first in zip(*(b.column(i) for i in range(4)), strict=True):
                pid, payload, first = pid.as_py(), payload.as_py() or b"", first.as_py()
                own = f"urn:page:{'none' if pid is None else pid}"
                held.append(record("response" if first is None else "revisit", own, address.as_py() or "", date, payload, None if first is None else f"urn:page:{first}"))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    tune_arrow(pages.sparkSession)
    rows = plan(pages, page_id, html).select(F.col(page_id).cast("long").alias("pid"), F.col(uri).cast("string").alias("uri"), "_payload", "_refers")
    return rows.mapInArrow(run, "path string, content binary")


FIELDS = "path string, position long, record_type string, record_id string, uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of archives (path, content): FIELDS; the payload is left out if not asked for.

    Every frame, header and length is checked; a fault raises WarcError with the
    archive's path. An archive without records gives no rows."""

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path, rows, size = path.as_py(), [], 0
                for position, raw in enumerate(_frames(content.as_py() or b"")):
                    try:
                        got = parse(raw)
                    except (WarcError, UnicodeDecodeError) as e:
                        raise WarcError(f"{path}, record {position}: {e}") from e
                    if not payload:
                        got["payload"] = None
                    size += len(got["payload"] or b"")
                    rows.append((path, position, *(got[n] for n in names[2:])))
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    tune_arrow(archives.sparkSession)
    return archives.select("path", "content").mapInArrow(run, FIELDS)
