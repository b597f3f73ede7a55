"""EPUB archives as tables: entries as they are packed, chapters, errors; and put together again.

Entries travel packed.  Each is unpacked once in small steps to check it, whatever sizes the archive
declares, and only chapters are unpacked to be read.  A book is put together from packed
entries: places come from prefix sums over their sizes, and one ordered concatenation makes the archive.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from posixpath import dirname, join, normpath
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docspark.operators import archive
from docspark.sources import markup
from docspark.sources.markup import replaced as rendered  # noqa: F401  a chapter that is text, rendered anew

#: ``packed`` is what the archive holds, by ``method`` (0 stored, 8 deflated); ``chapters`` are the chapter numbers of the entry.
ENTRIES = "doc_id long, entry_index int, name string, raw_name binary, flags int, method int, modified long, crc long, file_size long, compress_size long, packed binary, chapters array<int>, error string"
_FIELDS = [f.split(" ")[0] for f in ENTRIES.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.string()]
#: Bytes of entries that a worker hands on at once, and of an entry that it unpacks at once.
BATCH_BYTES, STEP = 16 << 20, 1 << 16
#: What a damaged, encrypted or oddly packed archive raises.
_BROKEN = (zipfile.BadZipFile, zlib.error, struct.error, OSError, EOFError, KeyError, RuntimeError, NotImplementedError, UnicodeDecodeError, ValueError, ElementTree.ParseError)
_STORED, _DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
_UTF8_NAME = 0x800


def resolved(base: str, href: str, held: set[str]) -> str:
    """The name of the entry that ``href``, a URI reference in the entry ``base``, points to.

    Escapes are decoded, dot segments taken out, query and fragment ignored; an entry whose name holds
    the escapes as they are is found too.
    """
    parts = urlsplit(href)
    if parts.scheme or parts.netloc:
        raise ValueError(f"chapter outside the archive: {href}")
    for path in (unquote(parts.path, errors="strict"), parts.path, unquote(href, errors="strict"), href):
        name = normpath(join(dirname(base), path))
        if name in held and archive.inside(name):
            return name
    raise ValueError(f"chapter not in the archive: {normpath(join(dirname(base), unquote(parts.path)))}")


class Archive:
    """A ZIP archive in memory whose declared sizes are not believed."""

    def __init__(self, content: bytes, max_bytes: int = archive.MAX_BYTES):
        self.content, self.max_bytes = content, max_bytes
        with zipfile.ZipFile(io.BytesIO(content)) as directory:
            self.infos = directory.infolist()
        if wrong := archive.wrong([(i.filename, i.file_size, i.compress_size) for i in self.infos], max_bytes=max_bytes):
            raise ValueError(wrong)
        self.starts = [self._start(i) for i in self.infos]
        ends = sorted((i.header_offset, start + i.compress_size) for i, start in zip(self.infos, self.starts))
        if any(end > following for (_, end), (following, _) in zip(ends, ends[1:])) or (ends and ends[-1][1] > len(content)):
            raise ValueError("entries overlap")
        # of equal names the last one counts
        self.named = {i.filename: n for n, i in enumerate(self.infos)}

    def _start(self, info: zipfile.ZipInfo) -> int:
        signature, names, extras = struct.unpack("<4s22xHH", self.content[info.header_offset : info.header_offset + 30])
        if signature != b"PK\x03\x04":
            raise ValueError(f"no entry where one is declared: {info.filename}")
        return info.header_offset + 30 + names + extras

    def packed(self, n: int) -> bytes:
        return self.content[self.starts[n] : self.starts[n] + self.infos[n].compress_size]

    def steps(self, n: int) -> Iterator[bytes]:
        """The entry unpacked in pieces of ``STEP`` bytes at most; an error as soon as it is not what is declared."""
        info = self.infos[n]
        if info.flag_bits & 1:
            raise ValueError(f"entry is encrypted: {info.filename}")
        if info.compress_type not in (_STORED, _DEFLATED):
            raise ValueError(f"packed by an unknown method: {info.filename}")
        view, size, crc = memoryview(self.content)[self.starts[n] : self.starts[n] + info.compress_size], 0, 0
        for piece in inflated(view, info.compress_type):
            size += len(piece)
            if size > info.file_size:
                raise ValueError(f"larger than declared: {info.filename}")
            crc = zlib.crc32(piece, crc)
            yield piece
        if size != info.file_size or crc != info.CRC:
            raise ValueError(f"damaged entry: {info.filename}")

    def read(self, name: str) -> bytes:
        return b"".join(self.steps(self.named[name]))

    def reading_order(self) -> list[str]:
        """Names of the content documents of the spine, but for the navigation, in order."""
        held = set(self.named)
        box = ElementTree.fromstring(self.read("META-INF/container.xml"))
        path = next((x.get("full-path") for x in box.iter() if _local(x.tag) == "rootfile"), None)
        if not path:
            raise ValueError("no rootfile")
        opf = resolved("", path, held)
        package = ElementTree.fromstring(self.read(opf))
        items = {x.get("id"): x for x in package.iter() if _local(x.tag) == "item"}
        out = []
        for ref in (x.get("idref") for x in package.iter() if _local(x.tag) == "itemref"):
            item = items.get(ref)
            if item is None:
                raise ValueError(f"spine item not in the manifest: {ref}")
            if item.get("media-type") != "application/xhtml+xml" or "nav" in (item.get("properties") or "").split():
                continue
            out.append(resolved(opf, item.get("href") or "", held))
        return out


def inflated(packed: bytes | memoryview, method: int) -> Iterator[bytes]:
    """What ``packed`` holds, in pieces of ``STEP`` bytes at most."""
    if method == _STORED:
        for at in range(0, len(packed), STEP):
            yield bytes(packed[at : at + STEP])
        return
    stream = zlib.decompressobj(-zlib.MAX_WBITS)
    for at in range(0, len(packed), STEP):
        rest = bytes(packed[at : at + STEP])
        while rest:
            if piece := stream.decompress(rest, STEP):
                yield piece
            rest = stream.unconsumed_tail
        if stream.eof:
            return
    while piece := stream.decompress(b"", STEP):
        yield piece
    if not stream.eof:
        raise ValueError("entry ends too early")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _opened(doc_id: int, content: bytes | None, max_bytes: int) -> Iterator[tuple]:
    """The entries of an archive, one after the other; all are checked before the first is handed on."""
    try:
        box = Archive(content or b"", max_bytes)
        place: dict[str, list[int]] = {}
        for n, name in enumerate(box.reading_order()):
            place.setdefault(name, []).append(n)
        for n, info in enumerate(box.infos):
            if info.filename in place and n == box.named[info.filename]:
                try:
                    markup.decoded(b"".join(box.steps(n)))
                except ValueError as e:
                    raise ValueError(e if info.filename in str(e) else f"{e}, {info.filename}") from None
            else:
                for _ in box.steps(n):
                    pass
    except _BROKEN as e:
        yield (doc_id, -1, *[None] * 10, str(e.args[0] if isinstance(e, KeyError) and e.args else e) or type(e).__name__)
        return
    for n, i in enumerate(box.infos):
        packed, method = box.packed(n), i.compress_type
        if i.filename == "mimetype" and method != _STORED:
            packed, method = b"".join(box.steps(n)), _STORED
        raw = i.filename.encode("utf-8" if i.flag_bits & _UTF8_NAME else "cp437")
        year, month, day, hour, minute, second = i.date_time
        modified = (year - 1980 << 25 | month << 21 | day << 16) | (hour << 11 | minute << 5 | second // 2)
        yield doc_id, n, i.filename, raw, i.flag_bits & _UTF8_NAME, method, modified, i.CRC, i.file_size, len(packed), packed, place.get(i.filename) if n == box.named[i.filename] else None, None


def entries(files: DataFrame, max_bytes: int = archive.MAX_BYTES) -> DataFrame:
    """Entries of ``(doc_id, content)`` archives, each with the numbers of the chapters that it is; numbers have no gaps.

    A broken or unsafe archive gives one row with its ``error`` and nothing else.  Beside its own bytes, a
    worker holds a batch of packed entries and one piece of an unpacked one, or one chapter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_FIELDS)
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id"), batch.column("content")):
                for row in _opened(doc_id.as_py(), content.as_py(), max_bytes):
                    rows.append(row)
                    size += len(row[10] or b"")
                    if size > BATCH_BYTES or len(rows) > 10_000:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return files.select("doc_id", "content").mapInArrow(run, ENTRIES)


def failed(entry_rows: DataFrame) -> DataFrame:
    """``(doc_id, error_message)`` of the archives that could not be read."""
    return entry_rows.filter("error is not null").select("doc_id", F.col("error").alias("error_message"))


def chapters(entry_rows: DataFrame) -> DataFrame:
    """``(doc_id, chapter_index, entry_name, html, last)``: content documents of the spine but the navigation, unpacked.

    ``html`` is in bytes; an entry that is several chapters is a row for each, the ``last`` one marked.
    """
    rows = entry_rows.filter("error is null").select("doc_id", F.explode("chapters").alias("chapter_index"), F.col("name").alias("entry_name"), "method", F.array_max("chapters").alias("most"), "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [b"".join(inflated(p.as_py(), m.as_py())) for p, m in zip(batch.column("packed"), batch.column("method"))]
            last = [a.as_py() == b.as_py() for a, b in zip(batch.column("chapter_index"), batch.column("most"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(html, pa.binary()), pa.array(last, pa.bool_())], names=["doc_id", "chapter_index", "entry_name", "html", "last"])

    return rows.mapInArrow(run, "doc_id long, chapter_index int, entry_name string, html binary, last boolean")


def deflated(content: bytes) -> tuple[int, bytes]:
    """Method and packed bytes: stored where deflating would reach the ratio that readers take for a bomb."""
    stream = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -zlib.MAX_WBITS)
    packed = stream.compress(content) + stream.flush()
    return (_STORED, content) if len(content) > archive.MAX_RATIO * len(packed) else (_DEFLATED, packed)


def render_chapters(chapter_rows: DataFrame, block_rows: DataFrame) -> DataFrame:
    """``(doc_id, name, part, error)`` of chapters, from ``coalesce(translated_text, text)`` of their blocks.

    ``part`` is the new entry, packed: ``(method, crc, file_size, packed)``.  Where blocks do not fit the
    chapter the row has an error and no part.
    """
    texts = block_rows.groupBy("doc_id", "chapter_index").agg(F.array_sort(F.collect_list(F.struct("block_order", F.coalesce("translated_text", "text").alias("t")))).alias("b"))
    return render_texts(chapter_rows, texts.select("doc_id", "chapter_index", F.transform("b", lambda x: x["t"]).alias("texts")))


def render_texts(chapter_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The same from ``(doc_id, chapter_index, texts)``: the texts of a chapter's blocks in order."""
    both = chapter_rows.filter("last").join(texts, ["doc_id", "chapter_index"]).select("doc_id", F.col("entry_name").alias("name"), "html", "texts")
    shape = pa.struct([("method", pa.int32()), ("crc", pa.int64()), ("file_size", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, wrong = [], []
            for html, texts in zip(batch.column("html"), batch.column("texts")):
                try:
                    content = markup.replaced_bytes(html.as_py(), texts.as_py())
                    method, packed = deflated(content)
                    made.append({"method": method, "crc": zlib.crc32(content), "file_size": len(content), "packed": packed})
                    wrong.append(None)
                except ValueError as e:
                    made.append(None)
                    wrong.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(made, shape), pa.array(wrong, pa.string())], names=["doc_id", "name", "part", "error"])

    return both.mapInArrow(run, "doc_id long, name string, part struct<method int, crc long, file_size long, packed binary>, error string")


def missing_entries(entry_rows: DataFrame, rendered_rows: DataFrame) -> DataFrame:
    """``(doc_id, missing)``: the sorted rendered names that an archive lacks."""
    names = entry_rows.filter("error is null").select("doc_id", "name")
    return rendered_rows.select("doc_id", "name").join(names, ["doc_id", "name"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("missing"))


def merge_entries(entry_rows: DataFrame, rendered_rows: DataFrame) -> DataFrame:
    """Every original entry as it is packed, but for those rendered."""
    new = rendered_rows.filter("part is not null").select("doc_id", "name", "part", F.lit(True).alias("chapter"))
    old = entry_rows.filter("error is null").withColumn("chapter", F.when(F.col("chapters").isNotNull(), True))
    both = old.join(new, ["doc_id", "name", "chapter"], "left")
    either = lambda c: F.coalesce(F.col(f"part.{c}"), F.col(c)).alias(c)
    return both.select("doc_id", "entry_index", "name", "raw_name", "flags", "modified", *map(either, ("method", "crc", "file_size", "packed")))


def _little(value: Column | int, size: int) -> Column:
    """A number as ``size`` bytes, the least first."""
    digits = F.lpad(F.hex(value if isinstance(value, Column) else F.lit(value)), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def pack(merged: DataFrame) -> DataFrame:
    """``(doc_id, output)``: archives in entry order, from entries that stay packed as they are.

    Headers are columns, places of entries prefix sums; what a group gathers is the archive itself.
    """
    names, sizes = F.octet_length("raw_name"), F.octet_length("packed")
    common = [_little(20, 2), _little(F.col("flags"), 2), _little(F.col("method"), 2), _little(F.col("modified"), 4), _little(F.col("crc"), 4), _little(sizes, 4), _little(F.col("file_size"), 4), _little(names, 2), _little(0, 2)]
    local = F.concat(F.lit(b"PK\x03\x04"), *common, F.col("raw_name"), F.col("packed"))
    rows = merged.select("doc_id", "entry_index", local.alias("local"), F.concat(F.lit(b"PK\x01\x02"), _little(20, 2), *common).alias("head"), "raw_name")
    before = Window.partitionBy("doc_id").orderBy("entry_index").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.octet_length("local")).over(before), F.lit(0))
    rows = rows.select("doc_id", "entry_index", "local", F.concat("head", F.lit(bytes(10)), _little(offset, 4), "raw_name").alias("central"))
    ordered = lambda c: F.expr(f"listagg({c}, x'') within group (order by entry_index)").alias(c)
    books = rows.groupBy("doc_id").agg(ordered("local"), ordered("central"), F.count("*").alias("n"))
    end = F.concat(F.lit(b"PK\x05\x06" + bytes(4)), _little(F.col("n"), 2), _little(F.col("n"), 2), _little(F.octet_length("central"), 4), _little(F.octet_length("local"), 4), F.lit(bytes(2)))
    return books.select("doc_id", F.concat("local", "central", end).alias("output"))
