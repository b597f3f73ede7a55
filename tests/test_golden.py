"""Small hand-made cases of single operators."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators import archive, chunking, files, glossary, jobs, layout, rebuild, translation
from docspark.plans import translate
from docspark.sources import epub, html, txt
from docspark.streaming import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, want", [(b"\xef\xbb\xbfhola", "hola"), (b"ma\xf1ana", "mañana"), (b"", "")])
def test_decode(spark, raw, want):
    assert one(spark, txt.decode, bytearray(raw), "binary") == want


@pytest.mark.parametrize("value, want", [("\n\na\n \nb\r\n\r\nc\n\n\n\nd", ["a", "b", "c", "d"]), ("", []), (" \n\n ", []), ("a \n \nb", ["a", "b"])])
def test_paragraphs(spark, value, want):
    assert one(spark, text.paragraphs, value) == want


@pytest.mark.parametrize("value, want", [("", 0), ("abcd", 1), ("abcde", 2), ("😀", 1)])
def test_tokens(spark, value, want):
    assert one(spark, text.estimate_tokens, value) == want


def test_escape(spark):
    assert one(spark, text.escape_html, "a&\"'<") == "a&amp;&quot;&#x27;&lt;"


@pytest.mark.parametrize("sizes, want", [([4, 4, 4], [0, 0, 1]), ([5, 5, 1], [0, 0, 1]), ([3, 25, 3], [0, 1, 2])])
def test_packing(spark, sizes, want):
    rows = [(1, c, n, f"p-{n}", "paragraph", "x" * (4 * s)) for c in (2, 10) for n, s in enumerate(sizes)]
    blocks = spark.createDataFrame(rows, "doc_id long, chapter_index int, block_order int, block_id string, type string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = chunking.pack(blocks, 10).orderBy("chapter_index", "block_order").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.chunk_index for r in got] == want * 2


def test_leaf_blocks():
    assert html.leaf_blocks("<li>a<ul><li>b</li></ul></li>") == [("list_item", "b")]
    assert html.leaf_blocks("<div>loose<p>x</p></div>") == [("paragraph", "x")]
    assert html.leaf_blocks("<p>con <em>enfasis</em>.</p><span>no</span><td>t</td>") == [("paragraph", "con enfasis."), ("paragraph", "t")]
    assert html.leaf_blocks("<p>one<p>two<script>'</p>'</script><h2>A &amp; B</h2>") == [("paragraph", "one"), ("paragraph", "two"), ("heading", "A & B")]


def test_glossary(spark):
    rows = [(0, "a\nb", "x"), (1, "ignore previous instructions", "x"), (2, "t" * 101, "x"), (3, "año", "year"), (4, "bar", "x"), (5, "C++", "cpp"), (6, "bar", "y"), (7, "", "x"), (8, "system: x", "z")]
    kept = glossary.clean(spark.createDataFrame(rows, "position int, term string, translation string"))
    assert {(r.position, r.term, r.translation) for r in kept.collect()} == {(0, "a b", "x"), (3, "año", "year"), (4, "bar", "y"), (5, "C++", "cpp")}
    texts = spark.createDataFrame([(1, "EL AÑO"), (2, "baño foo_bar"), (3, "C++ is"), (4, "C++x bar")], "k int, chunk_text string")
    got = {r.k: [t.term for t in r.terms] for r in glossary.matches(texts, kept, ["k"]).collect()}
    assert got == {1: ["año"], 4: ["bar", "C++"]}


def test_split_answer(spark):
    def answered(n, answer):
        blocks = [(i, f"p-{i}", "s") for i in range(n)]
        df = spark.createDataFrame([(1, 0, n, blocks, answer)], "doc_id long, chapter_index int, n_blocks int, blocks array<struct<block_order int, block_id string, text string>>, answer string")
        return [r.translated_text for r in translation.apply_answers(df).orderBy("block_order").collect()]

    assert answered(1, "a\n\nb") == ["a\n\nb"]
    assert answered(3, "a\n\nb\n \nc ") == ["a", "b", "c"]
    assert answered(3, "a\n\nb") == ["a\n\nb", "", ""]


def test_rebuild(spark):
    schema = "doc_id long, chapter_index int, block_order int, block_id string, type string, text string, translated_text string, image_ext string"
    rows = [(1, 2, 0, "a", "paragraph", "a", None, None), (1, 10, 0, "b", "paragraph", "b", "", None), (1, 10, 1, "c", "paragraph", "c", None, None)]
    out = rebuild.text(spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame(rows, schema))
    assert {r.doc_id: r.output for r in out.collect()} == {1: "a\n\n\n\nc", 2: ""}
    kinds = ["heading", "list_item", "list_item", "image", "list_item", "paragraph", "heading"]
    rows = [(1, 0, n, f"b{n}", k, "t", None, "png" if k == "image" else None) for n, k in enumerate(kinds)]
    assert rebuild.html(spark.createDataFrame(rows, schema)).first().html == '<h1>t</h1><ul><li>t</li><li>t</li></ul><img src="b3.png"/><ul><li>t</li></ul><p>t</p><h2>t</h2>'


def test_layout(spark):
    def made(pages):
        rows = [(1, p, b, 0, 0, t, s) for p, bs in pages.items() for b, (t, s) in enumerate(bs)]
        df = spark.createDataFrame(rows, "doc_id long, page_number int, block_no int, line_no int, span_no int, text string, size double")
        return [(r.type, r.text, r.page_number) for r in layout.blocks(df).orderBy("block_order").collect()]

    assert made({1: [("the cat", 11.0)], 3: [("sat.", 11.0)], 4: [("Next", 11.0)]}) == [("paragraph", "the cat sat.", 1), ("paragraph", "Next", 4)]
    assert made({1: [("exam-", 11.0)], 2: [("• x", 11.0), ("12) y", 11.0), ("-z", 11.0), ("- Big", 14.0)]}) == [("paragraph", "exam-", 1), ("list_item", "x", 2), ("list_item", "y", 2), ("paragraph", "-z", 2), ("heading", "- Big", 2)]


def test_archive(spark):
    rows = [("ok", 0, "a/../b", 100, 1), ("bomb", 0, "x", 1001, 10), ("up", 0, "a/../../x", 1, 1), ("abs", 0, "/etc/x", 1, 1), ("back", 0, "a\\b", 1, 1), ("zero", 0, "z", 99, 0)]
    df = spark.createDataFrame(rows, "path string, entry_index int, name string, file_size long, compress_size long")
    assert {r.path: r.verdict for r in archive.check(df).collect()} == {"ok": "ok", "bomb": "ratio", "up": "name", "abs": "name", "back": "name", "zero": "ok"}


@pytest.mark.parametrize("name, want", [("../a b.TXT", "a_b.txt"), ("mañana.pdf", "manana.pdf"), ("???.epub", "archivo.epub"), ("x" * 300 + ".txt", "x" * 196 + ".txt")])
def test_names(spark, name, want):
    assert one(spark, files.safe_name, name) == want


def test_jobs(spark):
    rows = [("j", 1, "created", None, None, None), ("j", 2, "processing", None, None, None), ("j", 3, "progress", 3, 9, None), ("j", 4, "failed", None, None, "bad"), ("k", 5, "processing", None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, seq long, kind string, translated_blocks int, total_blocks int, error_message string").withColumn("ts", F.timestamp_seconds("seq")).withColumn("output_path", F.lit(None).cast("string"))
    got = jobs.view(jobs.states(df)).collect()
    assert [(r.job_id, r.status, r.translated_blocks, r.total_blocks, r.error, r.percent) for r in got] == [("j", "failed", 3, 9, "bad", 33)]
    view = lambda t, n, s: jobs.view(spark.createDataFrame([("j", s, t, n, None)], "job_id string, status string, translated_blocks int, total_blocks int, error_message string")).first()
    assert (view(29, 100, "processing").percent, view(100, 100, "processing").percent, view(100, 100, "processing").stage, view(0, 0, "completed").percent) == (28, 99, "rebuilding", 100)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Dziękuję bardzo za pomoc.".encode("cp1250"), "Dziêkujê bardzo za pomoc."), ("„naïve“ – 5 €".encode("cp1252"), "„naïve“ – 5 €"), ("bœuf \x9d".encode("iso8859_15"), "bœuf \x9d"),
        (b"1\xbd kg \x81", "1½ kg \x81"), (b"\x81" * 9 + b"a", None), (b"\xff\x00\x01\x02", None),
    ],
)
def test_other_encodings(spark, raw, want):
    got = spark.createDataFrame([(bytearray(raw),)], "x binary").select(txt.decoded(F.col("x")).alias("d")).select("d.*").first()
    assert (got.text, got.error) == (want, None if want is not None else txt.NO_ENCODING)


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhola")
    (tmp_path / "b.txt").write_bytes(b"\xff\x00\x00\x00")
    (tmp_path / "c.bin").write_bytes(b"no")
    got = {r.path.rpartition("/")[2]: (r.length, r.text, r.error) for r in txt.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (7, "hola", None), "b.txt": (4, None, txt.NO_ENCODING)}


def test_rendered():
    up = lambda h: epub.rendered(h, [t.upper() for _, t in html.leaf_blocks(h)])
    assert epub.rendered("<p>one<p>two</p><p>three</p>", ["UNO", "DOS", "TRES"]) == "<p>UNO<p>DOS</p><p>TRES</p>"
    assert up("<div><p>a</div>\n<li>x<li>y") == "<div><p>A</div>\n<li>X<li>Y"
    for odd in ("\x85", "\u2028", "\x0b", "\r"):
        assert up(f"<p>a{odd}b</p>\n<p>two</p>") == "<p>A B</p>\n<p>TWO</p>"
    assert epub.rendered("<p>a <b>b</b></p><p/><p> </p><td>c</td>", ["<&", "d"]) == "<p>&lt;&amp;</p><p/><p> </p><td>d</td>"
    with pytest.raises(ValueError):
        epub.rendered("<p>a</p>", ["a", "b"])


def _book(chapters, spine=None, extra=(), method=zipfile.ZIP_DEFLATED):
    box = io.BytesIO()
    names = [f"c{n}" for n in range(len(chapters))]
    with zipfile.ZipFile(box, "w", method) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
        z.writestr("o/c.opf", f"<package><manifest>{items}</manifest><spine>" + "".join(f'<itemref idref="{n}"/>' for n in spine or names) + "</spine></package>")
        for n, c in zip(names, chapters):
            z.writestr(f"o/{n}.xhtml", c)
        for n, c in extra:
            z.writestr(n, c)
    return box.getvalue()


def _loud(path):
    """Makes a translator of capitals that counts its calls in a shared file."""

    class Loud:
        def translate(self, text, context):
            with open(path, "a") as f:
                f.write("x\n")
            if "fail" in text:
                raise RuntimeError("refused")
            return f"\n {text.upper()} ", 1, 2

        def close(self):
            pass

    return Loud


def test_books(spark, tmp_path):
    encrypted = bytearray(_book(["<p>a</p>"]))
    at = encrypted.rindex(b"PK\x01\x02")
    for signature, step in ((b"PK\x01\x02", 8), (b"PK\x03\x04", 6)):
        k = -1
        while (k := encrypted.find(signature, k + 1)) >= 0:
            encrypted[k + step] |= 1
    assert at > 0
    odd = bytearray(_book(["<p>a</p>"]))
    k = -1
    while (k := odd.find(b"PK\x01\x02", k + 1)) >= 0:
        odd[k + 10] = 77
    long = "word " * 40_000
    books = [
        (1, _book(["<p>one</p><p>two</p>", "<h1>three</h1>"])), (2, bytes(encrypted)), (3, bytes(odd)), (4, b"no archive"), (5, _book([f"<p>{long}</p>"], method=zipfile.ZIP_STORED)), (6, _book(["<p>a</p>"], spine=["c0", "c9"])),
        (7, _book(["<p>ok</p>", "<p>fail</p>"])), (8, _book(["<p>up</p>"], extra=[("../x", "")])), (9, None), (10, _book(["<p></p>"])), (11, _book(["<p>a</p>"], extra=[("z", b"0" * 1_000_000)])),
    ]
    files_ = spark.createDataFrame(books, "doc_id long, content binary")
    rows = epub.entries(files_)
    wrong = {r.doc_id: r.error_message for r in epub.failed(rows).collect()}
    assert set(wrong) == {2, 3, 4, 6, 8, 9, 11} and "encrypted" in wrong[2] and "unsafe" in wrong[8] and "ratio" in wrong[11]
    got = {r.doc_id: r for r in translate.translated_epubs(files_, _loud(str(tmp_path / "calls"))).collect()}
    assert len(got) == len(books)
    assert {k for k, r in got.items() if r.status == "failed"} == set(wrong) | {7}
    assert got[7].error_message == "refused" and got[7].output is None
    again = {(r.doc_id, r.chapter_index, r.text) for r in html.blocks(epub.chapters(epub.entries(spark.createDataFrame([(k, r.output) for k, r in got.items() if r.output], "doc_id long, content binary")))).collect()}
    assert {x for x in again if x[0] == 1} == {(1, 0, "ONE"), (1, 0, "TWO"), (1, 1, "THREE")}
    # what would pack a hundred times smaller is stored, so the library reads its own archives
    assert (5, 0, long.strip().upper()) in again
    with zipfile.ZipFile(io.BytesIO(bytes(got[5].output))) as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and z.getinfo("o/c0.xhtml").compress_type == zipfile.ZIP_STORED


def test_translated_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, "c"), (3, "d fail"), (4, ""), (5, None)], "doc_id long, text string")
    answered = translate.answers(translate.requests(docs), _loud(str(tmp_path / "calls")))
    got = {r.doc_id: (r.output, r.status, r.error_message) for r in translate.translated(docs, answered).collect()}
    assert got == {1: ("A\n\nB", "completed", None), 2: ("C", "completed", None), 3: (None, "failed", "refused"), 4: ("", "completed", None), 5: ("", "completed", None)}
    assert translation.usage(answered).count() == 3
    assert (tmp_path / "calls").read_text().count("x") == 3


def test_translator_with_glossary(spark):
    class Terms:
        def translate(self, text, context, glossary):
            return f"{text} {sorted((glossary or {}).items())}", 1, 1

        def close(self):
            pass

    rows = spark.createDataFrame([(1, "a", None, [("x", "y"), ("v", "w")]), (2, "b", None, []), (3, "c", None, None)], "k int, request_text string, request_context string, terms array<struct<term string, translation string>>")
    assert {r.k: r.text for r in translation.translate(rows, Terms, ["k"], "terms").collect()} == {1: "a [('v', 'w'), ('x', 'y')]", 2: "b []", 3: "c []"}


def test_glossary_by_any_word(spark):
    """Every kind of term against a plain search; the same whatever part of the glossary is matched at once."""
    import re

    names = ["año", "the cat", "C++", ".NET", "a.b", "+++", "Cat", "cat's", "-", "foo_bar", "the", "x-y z", "ÉTÉ", "no such"]
    texts = ["The cat's año", "EL AÑO a+++b .NET c.net", "a.b axb x-y z", "C++x foo_bar été", "x-y  z a +++ b", "", None, "cat-the cat the"]
    terms = spark.createDataFrame([(i, t, t.upper()) for i, t in enumerate(names)], "position int, term string, translation string")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, chunk_text string")
    want = {k: found for k, t in enumerate(texts) if (found := [n for n in names if re.search(rf"\b{re.escape(n)}\b", t or "", re.I)])}
    assert {r.k: [t.term for t in r.terms] for r in glossary.matches(rows, terms, ["k"]).collect()} == want
    assert glossary.size(terms) == len(names) and glossary.size(terms.limit(0)) == 0
    bare = glossary.with_terms(rows, terms.limit(0), ["k"])
    assert bare.count() == len(texts) and bare.filter("terms is not null").count() == 0


def test_glossary_from_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"sea": "mar", "sun": "sol"})[:-1] + ', "sea": "océano"}')
    got = glossary.clean(glossary.from_json(spark, str(tmp_path / "g.json"))).orderBy("position").collect()
    assert [(r.term, r.translation) for r in got] == [("sea", "océano"), ("sun", "sol")]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="no JSON object"):
        glossary.from_json(spark, str(tmp_path / "bad.json")).collect()


def test_glossary_prompts(spark):
    terms = "array(struct('sea' as term, 'mar' as translation))"
    rows = spark.sql(f"select 2 as n_blocks, 'a' as chunk_text, 'before' as context, {terms} as terms union all select 1, 'b', null, null")
    got = chunking.requests(rows).select("request_context", chunking.system_prompt(F.col("context"), F.col("terms")).alias("p")).collect()
    assert got[0].request_context == "\n\n".join([chunking.STRUCTURE.replace("%1$d", "2"), f"{chunking.TERMS}\n- sea → mar", chunking.PREVIOUS.replace("%s", "before")])
    assert got[0].p == "\n\n".join([chunking.SYSTEM, f"{chunking.TERMS}\n- sea -> mar", chunking.EXTRA.replace("%s", "before")])
    assert (got[1].request_context, got[1].p) == (None, chunking.SYSTEM)


def test_images_stay_out_of_chunks(spark):
    rows = [(1, 0, 0, "b0", "image", "", None, "png", b"x"), (1, 0, 1, "b1", "paragraph", "text", None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, chapter_index int, block_order int, block_id string, type string, text string, translated_text string, image_ext string, image_data binary")
    assert [r.block_id for r in chunking.pack(blocks).collect()] == ["b1"]
    assert [(r.filename, bytes(r.image_data)) for r in rebuild.images(blocks).collect()] == [("b0.png", b"x")]


def test_block_of_lines_and_spans(spark):
    rows = [(1, 1, 0, 1, 0, " end. ", 11.0), (1, 1, 0, 0, 1, "tw", 11.0), (1, 1, 0, 0, 0, " one ", 11.0), (1, 1, 0, 0, 2, "o", 12.0), (1, 1, 0, 2, 0, "  ", 30.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, block_no int, line_no int, span_no int, text string, size double")
    got = layout.block_texts(df).first()
    assert (got.text, got.max_size) == ("one two end.", 30.0)


def test_formats_and_outputs(spark):
    assert {r.format: r.output_ext for r in files.formats(spark).collect()} == {"txt": ".txt", "epub": ".epub", "pdf": ".html"}
    row = files.output_names(spark.createDataFrame([("epub", "a b.epub")], "format string, original_filename string"), spark).first()
    assert (row.output_name, row.download_name, row.media_type) == ("output.epub", "translated_a b.epub", "application/epub+zip")
    assert [files.max_size(x) for x in (None, "10", "ten", " 7 ")] == [files.MAX_SIZE, 10, files.MAX_SIZE, 7]


@pytest.mark.parametrize("content, name, want", [(b"%PDF-1.7", "a.pdf", None), (b"PK\x03\x04" + b"0" * 26 + b"mimetypeapplication/epub+zip", "a.epub", None), (b"PK\x03\x04rest", "a.epub", None), (b"text", "a.pdf", "content"), (b"a\x00", "a.txt", "content"), (b"", "a.pdf", None), (b"x" * 11, "a.txt", "size")])
def test_checks(spark, content, name, want):
    df = spark.createDataFrame([(name, len(content), bytearray(content))], "name string, length long, content binary")
    assert files.checked(df, 10 if want == "size" else 1000).first().reason == want


def test_paths(spark):
    assert [one(spark, f, v) for f, v in ((text.dirname, "a/b/c"), (text.dirname, "c"), (text.basename, "a/b/c"), (text.basename, "c"))] == ["a/b", "", "c", "c"]
    assert one(spark, lambda x: text.path_join(text.dirname(x), F.lit("d")), "a/b") == "a/d" and one(spark, lambda x: text.path_join(text.dirname(x), F.lit("d")), "b") == "d"


def test_ledger(spark, tmp_path):
    """Events appended to a ledger, followed by a stream, are the states that one pass gives."""
    schema = "job_id string, seq long, ts timestamp, kind string, translated_blocks int, total_blocks int, output_path string, error_message string"
    ids = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("a", 1, 3)], "path string, length long, changed long").select(jobs.job_id(F.col("path"), F.col("length"), F.col("changed")).alias("j"))
    assert len({r.j for r in ids.collect()}) == 3
    first = [("j", 1, "created", None, None), ("j", 2, "processing", None, None), ("k", 3, "created", None, None)]
    later = [("j", 4, "progress", 2, None), ("k", 5, "failed", None, "bad"), ("nobody", 6, "processing", None, None)]
    rows = lambda r: spark.createDataFrame([(j, s, k, t, 9 if t else None, e) for j, s, k, t, e in r], "job_id string, seq long, kind string, translated_blocks int, total_blocks int, error_message string").select("job_id", "seq", F.timestamp_seconds("seq").alias("ts"), "kind", "translated_blocks", "total_blocks", F.lit(None).cast("string").alias("output_path"), "error_message")
    path, seen = str(tmp_path / "events"), {}
    keep = lambda batch, number: seen.update({r.job_id: r.asDict() for r in batch.collect()})
    for part in (first, later):
        jobs.append(rows(part), path)
        ingest.live_states(spark.readStream.schema(schema).parquet(path), keep, str(tmp_path / "state")).awaitTermination()
    assert seen == {r.job_id: r.asDict() for r in jobs.states(spark.read.schema(schema).parquet(path)).collect()}
    assert (seen["k"]["status"], seen["j"]["translated_blocks"], set(seen)) == ("failed", 2, {"j", "k"})
