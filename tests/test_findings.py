"""What reviews of the code found, on small inputs."""

import glob
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.operators import chunking, layout
from docspark.plans import scratch, translate
from docspark.plans.queries import ORACLES, QUERIES, Stub, _epubs
from docspark.sources import html, txt


SF = "/root/testdata/sf0.001"


def _same(spark, name, sf):
    """Whether a query over the tables in ``sf`` gives the rows of its SQL."""
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    df = QUERIES[name](spark, str(sf))
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(repr, con.sql(ORACLES[name]).project(",".join(f'"{c}"' for c in columns)).fetchall()))
    assert got == want
    return got


def test_references_that_are_cut_off(spark, tmp_path):
    """A heading cut in the middle of a reference keeps what is left of it, as the SQL of html_blocks does."""
    pages = [(1, "u", "<h1>a &amp; b&amp</h1><p>c &lt;d&gt; &quot;&#x27;</p><p>e&am</p><p>f &</p><p>&ampg; &amp;lt;</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(_same(spark, "html_blocks", tmp_path)) == 5
    assert html.leaf_blocks("<p>a&amp</p>") == [("paragraph", "a&")]
    assert html.leaf_blocks("<p>a&amp &copy; &#65;&#x42; &nosuch;</p>", closed=True) == [("paragraph", "a&amp © AB &nosuch;")]


def _on_disk(folder):
    """Bytes of data files, by the name of the table they are in; shuffle files under their own."""
    out = {}
    for path, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".parquet") or name.startswith("shuffle"):
                table = "shuffle" if name.startswith("shuffle") else os.path.basename(path).rpartition("-")[0] or os.path.basename(path)
                out[table] = out.get(table, 0) + os.path.getsize(f"{path}/{name}")
    return out


def test_texts_lie_on_disk_while_they_are_needed(spark, tmp_path, monkeypatch):
    """Requests in order, from rows with their blocks, as by packing; when they are answered their texts are gone from the disk, and so are shuffles."""
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(translate, "shared_dir", lambda spark: str(tmp_path))
    r = random.Random(4)
    rows = [(k, "\n\n".join("".join(r.choices("abcdefghij ", k=r.choice([3, 40, 200, 900]))) + "x" for _ in range(r.choice([0, 1, 5, 60])))) for k in range(200)] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "chapter_index", "chunk_index", "n_blocks", "est_tokens", "oversize", "chunk_text", "context"]
    found, want = (sorted(map(tuple, x.select(*columns).collect()), key=repr) for x in (chunking.chunk_rows(txt.chapters(docs), 100, 50), chunking.chunks(chunking.pack(txt.blocks(docs), 100), 100, 50)))
    assert found == want and len(found) > 500
    texts = sum(len(t or "") for _, t in rows)
    answered = translate.answers(translate.requests(docs, None, 100, 50), Stub)
    held = _on_disk(tmp_path)
    # one copy of all texts, packed, is what the answers need; an empty table may keep a file without rows
    assert held["answered"] < texts and sum(v for k, v in held.items() if k != "answered") < texts / 4, held
    assert "doc_id" in answered.columns and answered.count() == len(found)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_spans_are_shuffled_once(spark):
    """Lines of blank and null spans, in any order of rows: the text that lines give which are put together alone."""
    r = random.Random(5)
    spans = [(1, 1, block, line, span, r.choice(["a ", " b", "", " ", "\t", None, "c\n", "d"]), r.choice([9.0, 11.0])) for block in range(60) for line in range(r.randint(1, 6)) for span in range(r.randint(1, 4))]
    want = {}
    for _, _, block, line, _, text, _ in spans:
        want.setdefault(block, {}).setdefault(line, []).append(text or "")
    lines = {block: [" ".join("".join(x).split()) for x in held.values()] for block, held in want.items()}
    r.shuffle(spans)
    df = layout.block_texts(spark.createDataFrame(spans, "doc_id long, page_number int, block_no int, line_no int, span_no int, text string, size double"))
    assert _shuffles(df) == 1
    got = df.collect()
    assert {x.block_no: x.text for x in got} == {block: " ".join(x for x in held if x) for block, held in lines.items()}
    assert {x.block_no: x.max_size for x in got} == {block: max(s[6] for s in spans if s[2] == block) for block in want}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_words_are_not_shuffled_to_make_spans(spark):
    assert _shuffles(QUERIES["pdf_block_texts"](spark, SF)) == 1


def test_ranges_are_told_by_their_blocks():
    """The table of a range grows with its blocks, not with the budget."""
    room, started, end, first, left = chunking.range_steps([5, 0, 7, 300], 1_000_000)
    assert (room, started, end, first, left) == ([0, 5, 12, 312], [1, 1, 1, 0], [312, 307, 300, 312], 0, 312)
    assert [chunking.range_step((room, started, end, first, left), state, 1_000_000) for state in (0, 999_690, 999_994, 1_000_001, 1_000_002)] == [(0, 312), (1, 300), (1, 307), (1, 312), (0, 312)]
    assert max(map(len, chunking.range_steps([3] * 50_000, 10)[:3])) == 4


def test_books_leave_themselves_and_their_new_chapters_on_disk(spark, tmp_path, monkeypatch):
    """Texts of a book's requests and answers are gone when its chapters are rendered."""
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(translate, "shared_dir", lambda spark: str(tmp_path))
    r = random.Random(6)
    lines = [["".join(r.choices("abcdefghij ", k=300)) for _ in range(40)] for _ in range(30)]
    rows = [(k, "\n".join(x)) for k, x in enumerate(lines)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    books = translate.translated_epubs(_epubs(spark, f"{tmp_path}/in"), Stub, None, 1_000, 50)
    held = {k: v for k, v in _on_disk(tmp_path).items() if k not in ("documents.parquet", "")}
    texts = sum(len(t) for _, t in rows)
    assert books.filter("status = 'completed'").count() > 0 and books.count() == 30
    assert held.get("requests", 0) + held.get("answered", 0) + held.get("answers", 0) + held["asked"] < texts / 4, held


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for folder in folders for _, _, names in os.walk(folder.getPath()) for name in names if name.startswith("shuffle")}


@pytest.mark.parametrize("settle", [common.settle, scratch.settle])
def test_settled_tables_leave_no_shuffle_files(spark, settle):
    before = _shuffle_files(spark)
    held = settle(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "swept")
    # they go in the background
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert held.count() == 10 and spark.conf.get(scratch.CLEANUP) == "false"
