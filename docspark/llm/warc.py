"""Operator 6: WARC archives, written and read back.

An archive is a row ``(name, content)``: consecutive records, one gzip member each,
of about ``ARCHIVE_BYTES`` together, so every row is a valid ``.warc.gz`` file of
bounded size and any store that Spark writes will hold it.  ``records`` reads such
content, from these rows or from the ``binaryFile`` source: zlib decompression in
steps, header block, content-length framing, digests verified.

Of records with equal payloads the one of least ``page_id`` is the response and the
others are revisits that refer to it.  The payload's SHA-256 and length meet in one
aggregation, so a payload that a third of all pages share is combined before it is
shuffled, and the join back may be split by Spark where one payload is frequent.

Defined results: null html is an empty payload, url null gives no target; rows that
repeat the least ``page_id`` of a payload are all responses; a null ``page_id`` comes
after all others and reads back as null, other ids are whole numbers of 64 bits, each kept
as it is; further columns are not read.  A damaged record of an archive raises, or is a
row with its error, as ``read`` is told.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from docspark.llm.common import settle, text_bytes

ARCHIVE_BYTES = 4 << 20
STEP = 1 << 16
#: Bytes that one step of unpacking gives at most.
PIECE = 1 << 22
#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    sha = digest(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Damaged(ValueError):
    """A record that cannot be taken; ``fields`` are those of its header, as far as it was read."""

    def __init__(self, message: str, fields: dict[str, str] | None = None) -> None:
        super().__init__(message)
        self.fields = fields or {}


class Member:
    """The gzip member at a place of an archive, iterated as the pieces of its data, each once; ``end`` is set after the last.

    A piece is ``PIECE`` bytes at most, however well the member is compressed.
    """

    def __init__(self, content: bytes, at: int) -> None:
        self.end: int | None = None
        self._pieces = self._unpacked(content, at)

    def __iter__(self) -> Iterator[bytes]:
        return self._pieces

    def _unpacked(self, content: bytes, at: int) -> Iterator[bytes]:
        unpack, rest = zlib.decompressobj(31), b""
        while not unpack.eof:
            if not rest and at < len(content):
                rest = content[at : at + STEP]
                at += len(rest)
            ended = not rest
            try:
                piece = unpack.decompress(rest, PIECE)
            except zlib.error as e:
                raise Damaged(f"damaged gzip member: {e}") from None
            rest = unpack.unconsumed_tail
            if ended and not piece and not unpack.eof:
                raise Damaged("truncated gzip member")
            yield piece
        self.end = at - len(unpack.unused_data)


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a header block (lower-case names); a line that begins with white space goes on with the one before it."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            if name is not None:
                fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        key, _, value = line.partition(":")
        name = key.strip().lower()
        fields[name] = value.strip()
    return fields


def told_sha1(value: str) -> str | None:
    """The SHA-1 that a digest field tells, in base32; it may stand there in hexadecimal; null for other algorithms."""
    kind, _, told = value.partition(":")
    if kind.strip().lower() != "sha1":
        return None
    told = told.strip()
    if len(told) == 40:
        try:
            return base64.b32encode(bytes.fromhex(told)).decode()
        except ValueError:
            pass
    return told.upper()


def framed(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record that a member holds; wrong framing or digests raise.

    A member is unpacked no further than its content length allows.
    """
    data, stop, size, fields = bytearray(), -1, 0, {}
    for piece in pieces:
        data += piece
        if stop < 0:
            stop = data.find(b"\r\n\r\n")
            if stop >= 0:
                if not data.startswith(b"WARC/"):
                    raise Damaged("no WARC header")
                fields = header_fields(bytes(data[:stop]))
                told = fields.get("content-length", "")
                if not (told.isascii() and told.isdigit()):
                    raise Damaged("no content length", fields)
                size = int(told)
        if stop >= 0 and len(data) > stop + 8 + size:
            raise Damaged("content length does not frame the record", fields)
    if stop < 0:
        raise Damaged("no WARC header")
    block = bytes(data[stop + 4 : stop + 4 + size])
    if len(block) != size or data[stop + 4 + size :] != b"\r\n\r\n":
        raise Damaged("content length does not frame the record", fields)
    if told_sha1(fields.get("warc-block-digest", "")) not in (None, digest(block)):
        raise Damaged(f"block digest of {fields.get('warc-record-id')}", fields)
    return fields, block


def _resumed(content: bytes, at: int) -> int:
    """The next place from ``at`` on where a gzip member of a record begins, or the end."""
    while (at := content.find(b"\x1f\x8b\x08", at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(content[at : at + STEP], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(content)


def scanned(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Header fields, block and error of each record; where a record is damaged its block is null and reading goes on with the next."""
    at = 0
    while at < len(content):
        member = Member(content, at)
        try:
            yield *framed(iter(member)), None
        except Damaged as e:
            yield e.fields, None, str(e)
            try:
                for _ in member:
                    pass
            except Damaged:
                pass
        # a member that cannot be unpacked to its end does not tell where the next begins
        at = _resumed(content, at + 1) if member.end is None else member.end


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; a damaged one raises."""
    for fields, block, error in scanned(content):
        if error is not None:
            raise Damaged(error, fields)
        yield fields, block


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)``: which pages repeat the payload of which."""
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    first = rows.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id")).alias("first"), F.count("*").alias("n"))
    met = rows.join(settle(first.filter("n > 1"), "payloads"), ["sha", "size"], "left")
    revisit = F.coalesce(F.col("n") > 1, F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return met.select("page_id", "url", "payload", F.when(revisit, F.col("first.page_id")).alias("refers_to"), revisit.alias("revisit"))


def archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives ``(name, content)`` of rows from ``with_revisits``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06}-{number:06}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for row in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "refers_to", "revisit"))):
                member = record(*(x.as_py() for x in row))
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    return rows.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "name string, content binary")


def read(files: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of archives: ``(record_id, page_id, record_type, url, payload, payload_bytes, payload_digest, refers_to)``.

    A damaged record raises if ``strict``.  Otherwise it is a row that tells what its header does
    and why it was not taken, in a further column ``error`` that is null for all others; its payload,
    length and digest are null, and reading goes on with the next record of the archive.

    Any archive of one gzip member a record can be read: ``page_id`` and ``refers_to`` are
    null for ids that ``record`` did not write.  The payload of an HTTP record is what
    follows its header, of any other its whole block; a digest that is not told is taken
    from the payload.  The length of a revisit's payload is that of its HTTP header, if it
    has one; its own payload is null.
    """

    def number(x: str | None) -> int | None:
        found = x is not None and x.startswith("<urn:page:") and x[10:-1]
        return int(found) if found and found.lstrip("-").isdigit() else None

    schema = "record_id string, page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    schema += "" if strict else ", error string"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def row(fields: dict[str, str], block: bytes) -> tuple:
        revisit, name = fields.get("warc-type") == "revisit", fields.get("warc-record-id")
        payload, size = block, None
        if fields.get("content-type", "").lower().startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            told = [line[15:].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            size = int(told[0]) if told and told[0].isdigit() else None
        sha = told_sha1(fields.get("warc-payload-digest", ""))
        if not revisit:
            if sha not in (None, digest(payload)) or (sha is None and size not in (None, len(payload))):
                raise Damaged(f"payload of {name}", fields)
            size, sha = len(payload), sha or digest(payload)
        return name, number(name), fields.get("warc-type"), fields.get("warc-target-uri"), None if revisit or not with_payload else payload, size, sha, number(fields.get("warc-refers-to"))

    def rows_of(content: bytes) -> Iterator[tuple]:
        for fields, block, error in scanned(content):
            try:
                if error is not None:
                    raise Damaged(error, fields)
                yield *row(fields, block), None
            except Damaged:
                if strict:
                    raise
                error = error or f"payload of {fields.get('warc-record-id')}"
                name = fields.get("warc-record-id")
                yield name, number(name), fields.get("warc-type"), fields.get("warc-target-uri"), None, None, None, number(fields.get("warc-refers-to")), error

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        shape = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for found in rows_of(content.as_py()):
                    rows.append(found)
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=shape)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=shape)

    return files.select("content").mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = settle(archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "archives")
    return read(written, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
