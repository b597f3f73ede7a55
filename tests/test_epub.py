"""Archives that lie, names that are written in other ways, encodings, and bytes that stay as they are."""

import io
import random
import re
import struct
import tracemalloc
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docspark.operators import archive
from docspark.sources import epub, html, markup

OPF = "o/p/c.opf"


def book(chapters, extra=(), opf=OPF, spine=None):
    """An archive of ``(entry name, href, bytes)`` chapters."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", f'<container><rootfiles><rootfile full-path="{opf}"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="{href}" media-type="application/xhtml+xml"/>' for n, (_, href, _) in enumerate(chapters))
        z.writestr(opf, f"<package><manifest>{items}</manifest><spine>" + "".join(f'<itemref idref="i{n}"/>' for n in (spine or range(len(chapters)))) + "</spine></package>")
        for name, _, content in chapters:
            if name not in z.namelist():
                z.writestr(name, content)
        for name, content in extra:
            z.writestr(name, content)
    return box.getvalue()


def test_hrefs():
    held = {"o/p/my chapter.xhtml", "o/p/c1.xhtml", "o/Text/c1.xhtml", "o/p/a%20b.xhtml", "o/p/é.xhtml", "top.xhtml", "o/p/100%.xhtml"}
    for href, name in [
        ("my%20chapter.xhtml", "o/p/my chapter.xhtml"), ("./c1.xhtml", "o/p/c1.xhtml"), ("../Text/c1.xhtml", "o/Text/c1.xhtml"), ("c1.xhtml#part", "o/p/c1.xhtml"), ("x/../c1.xhtml?q", "o/p/c1.xhtml"),
        ("a%20b.xhtml", "o/p/a%20b.xhtml"), ("%C3%A9.xhtml", "o/p/é.xhtml"), ("é.xhtml", "o/p/é.xhtml"), ("../../top.xhtml", "top.xhtml"), ("100%.xhtml", "o/p/100%.xhtml"),
    ]:
        assert epub.resolved(OPF, href, held) == name
    for href in ("c2.xhtml", "../../../top.xhtml", "http://x.org/c1.xhtml", "", "c1.xhtml/.."):
        with pytest.raises(ValueError, match="chapter"):
            epub.resolved(OPF, href, held | {"../top.xhtml"})


ENCODED = [
    ("utf-8", b"", None), ("utf-8", b"\xef\xbb\xbf", "utf-8"), ("utf-16-le", b"\xff\xfe", "UTF-16"), ("utf-16-be", b"\xfe\xff", None), ("utf-16-le", b"", "UTF-16LE"), ("utf-16-be", b"", "utf-16"), ("iso-8859-1", b"", "ISO-8859-1"),
    ("cp1252", b"", "windows-1252"), ("koi8-r", b"", "KOI8-R"), ("utf-32-le", b"\xff\xfe\0\0", None), ("utf-8", b"", "UTF-16"),
]


@pytest.mark.parametrize("codec, mark, declared", ENCODED)
def test_bytes_outside_the_leaves_stay(codec, mark, declared):
    sample = "Жизнь" if codec == "koi8-r" else "é" if codec in ("iso-8859-1", "cp1252") else "日本 é 👍"
    head = f"<?xml version='1.0' encoding='{declared}'?>\r\n" if declared else ""
    text = f"{head}<!DOCTYPE html [<!ENTITY x 'y'>]>\r\n<BODY  class = '{sample}>'><!-- <p>no</p> {sample} --><p id=a>{sample}<![CDATA[ & <b> ]]>d</p>\t<div>loose {sample}<li>two&nbsp;&amp; <i>three</i></LI ></div>\n<p> </p><td/>{sample}"
    raw = mark + text.encode(codec)
    assert [x.text for x in markup.leaves(markup.decoded(raw)[0])] == [f"{sample} & <b> d", "two & three"]
    new = markup.replaced_bytes(raw, ["<1> 日", sample])
    place = [(m.start(1), m.end(1)) for m in re.finditer(r"<p id=a>(.*?)</p>|<li>(.*?)</LI", text, re.DOTALL) if m[1]][0]
    second = re.search(r"<li>(.*?)</LI", text).span(1)
    parts = [text[: place[0]], text[place[1] : second[0]], text[second[1] :]]
    want = mark + parts[0].encode(codec) + "&lt;1&gt; 日".encode(codec, "xmlcharrefreplace") + parts[1].encode(codec) + sample.encode(codec) + parts[2].encode(codec)
    assert new == want
    assert [x.text for x in markup.leaves(markup.decoded(new)[0])] == ["<1> 日", sample]


@pytest.mark.parametrize("raw", [b"\xff\xff<p>", b"<?xml version='1.0' encoding='no-such'?><p>a</p>", b"<?xml version='1.0' encoding='ascii'?><p>\xe9</p>", b"<?xml version='1.0' encoding='hex'?><p>a</p>"])
def test_no_encoding_that_fits(raw):
    with pytest.raises(ValueError, match="not in its encoding"):
        markup.decoded(raw)


def test_scanner_against_the_library_parser():
    """On random tag soup: the leaves that the library's parser and a plain tree of tags give."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.found = [], []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                return
            if self.open and self.open[-1][0] in markup._CLOSES.get(tag, ()):
                self.open.pop()
            node = [tag, "", True]
            if tag in markup.TEXT:
                for o in self.open:
                    o[2] = False
                self.found.append(node)
            self.open.append(node)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag != "br":
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    return

        def handle_data(self, data):
            for o in self.open:
                if o[0] in markup.TEXT:
                    o[1] += data

    r = random.Random(1)
    pieces = ["<p>", "</p>", "<div class='a>b'>", "</div>", "<li>", "</li>", "<b>", "</b>", "<br>", "<br/>", "<P ID=x>", "</P >", "<td>", "</td>", "<tr>", "<h2 a b=\"c'>\">", "</h2>", "<!-- <p> -->", "<i/>", "<p/>", "text", " & ", "&amp;", "&eacute;", "\n", "a < b", "1<2", "</ul>", "é"]
    for _ in range(3000):
        text = "".join(r.choices(pieces, k=r.randint(1, 25))) + "<hr>"
        tree = Tree()
        tree.feed(text)
        tree.close()
        want = [" ".join(x[1].split()) for x in tree.found if x[2] and x[1].strip()]
        assert [x.text for x in markup.leaves(text)] == want, text


def test_hostile_markup_is_scanned_in_one_pass():
    for text in ("<p " * 200_000, "<p a='" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<![CDATA[" * 50_000, "<!--" * 50_000, "<?" * 100_000 + ">", "<p =\"" * 50_000 + ">", "<script>" * 50_000):
        markup.leaves(text)


def _lying(name, content, size):
    """An archive in which the entry ``name`` declares ``size`` bytes, in both headers."""
    raw = bytearray(book([("o/p/a.xhtml", "a.xhtml", b"<p>a</p>")], extra=[(name, content)]))
    at = raw.rindex(b"PK\x01\x02", 0, raw.rindex(b"PK\x05\x06"))
    # enough packed bytes are declared for the ratio to pass
    raw[at + 24 : at + 28] = struct.pack("<I", size)
    return bytes(raw)


def test_sizes_are_not_believed():
    liar = _lying("z.bin", b"\0" * 30_000_000, 20_000)
    tracemalloc.start()
    row = next(iter(epub._opened(1, liar, archive.MAX_BYTES)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row[-1] == "larger than declared: z.bin" and row[1] == -1 and peak < 2_000_000 + len(liar)
    assert max(len(x) for x in epub.inflated(zlib.compress(b"\0" * 9_000_000, wbits=-15), 8)) <= epub.STEP
    short = _lying("z.bin", random.Random(1).randbytes(5000), 9000)
    assert next(iter(epub._opened(1, short, archive.MAX_BYTES)))[-1] == "damaged entry: z.bin"
    good = book([("o/p/a.xhtml", "a.xhtml", b"<p>a</p>")], extra=[("z.bin", bytes(range(256)) * 40)])
    broken = bytearray(good)
    start = good.index(b"z.bin") + 5
    broken[start + 30] ^= 255
    assert len(list(epub._opened(1, bytes(broken), archive.MAX_BYTES))) == 1
    assert next(iter(epub._opened(1, good, 5000)))[-1] == "too large unpacked"
    assert next(iter(epub._opened(1, good[:-30], archive.MAX_BYTES)))[-1] == "File is not a zip file"
    # two entries that share their bytes
    twice = bytearray(good)
    ends = [m.start() for m in re.finditer(b"PK\x01\x02", good)]
    twice[ends[-1] + 42 : ends[-1] + 46] = twice[ends[-2] + 42 : ends[-2] + 46]
    assert len(list(epub._opened(1, bytes(twice), archive.MAX_BYTES))) == 1


def test_entries_stay_as_they_are(spark):
    """Entries that are no chapter are packed byte for byte as they were; the archive is a whole one; a chapter may stand twice in the spine."""
    image = random.Random(2).randbytes(70_000)
    chapters = [("o/p/é 1.xhtml", "%C3%A9%201.xhtml", "<p>one</p>".encode("utf-16")), ("o/p/b.xhtml", "b.xhtml", b"<p>two</p>")]
    raw = book(chapters, extra=[("o/i.png", image), ("o/style.css", b"p { } " * 50), ("o/empty", b"")], spine=[0, 1, 0])
    opened = epub.entries(spark.createDataFrame([(1, raw)], "doc_id long, content binary"))
    read = epub.chapters(opened)
    blocks = html.blocks(read).withColumn("translated_text", F.upper("text"))
    assert [(r.chapter_index, r.text) for r in blocks.orderBy("chapter_index").collect()] == [(0, "one"), (1, "two"), (2, "one")]
    out = bytes(epub.pack(epub.merge_entries(opened, epub.render_chapters(read, blocks))).first().output)
    old, new = epub.Archive(raw), epub.Archive(out)
    assert [i.filename for i in old.infos] == [i.filename for i in new.infos]
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert z.testzip() is None and z.read("o/p/b.xhtml") == b"<p>TWO</p>" and z.read("o/p/é 1.xhtml") == "<p>ONE</p>".encode("utf-16")
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and out[30:38] == b"mimetype"
    for n, i in enumerate(old.infos):
        if not i.filename.endswith(".xhtml"):
            assert (old.packed(n), i.CRC, i.date_time, i.compress_type) == (new.packed(n), new.infos[n].CRC, new.infos[n].date_time, new.infos[n].compress_type)


def test_one_rule_for_directories(spark):
    """The verdict on a directory in words is that of the table of entries."""
    r = random.Random(3)
    kinds = {"too many entries": "entries", "compression ratio": "ratio", "too large unpacked": "total", "unsafe name": "name"}
    rows, want = [], {}
    for k in range(200):
        held = [(r.choice(["a", "a/../b", "../x", "/etc", "a\\b", "", "a/./..", "a/../../b", "..a", "x" * 3]), r.choice([0, 5, 50, 900]), r.choice([0, 1, 5, 50])) for _ in range(r.randint(1, 6))]
        rows += [(str(k), n, *e) for n, e in enumerate(held)]
        said = archive.wrong(held, 5, 20.0, 1500)
        want[str(k)] = ("ok", None) if said is None else (kinds[said.partition(":")[0]], said.partition(": ")[2] if said.startswith(("comp", "uns")) else None)
    df = spark.createDataFrame(rows, "path string, entry_index int, name string, file_size long, compress_size long")
    assert {x.path: (x.verdict, x.offender) for x in archive.check(df, 5, 20.0, 1500).collect()} == want
    assert len(set(want.values())) > 8
