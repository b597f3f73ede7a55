"""The ledger with its snapshots, answers kept between runs, and files to outputs in batches that run again."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import jobs, ledger
from docspark.plans import translate
from docspark.sources import epub, html
from docspark.streaming import service
from test_epub import book


def test_snapshots_and_events_are_all_events(spark, tmp_path):
    r = random.Random(4)
    path, kinds = str(tmp_path / "ledger"), ["created", "processing", "progress", "progress", "completed", "failed"]
    rows = [(f"j{r.randint(0, 40)}", n, k := r.choice(kinds), n % 50 if k == "progress" else None, 50 if k == "progress" else None, f"out{n}" if k == "completed" else None, f"bad{n}" if k == "failed" else None) for n in range(400)]
    late = r.sample(rows, 60)
    batches = [[x for x in rows if x[1] // 80 == b and x not in late] for b in range(5)]
    for x in late:  # late, and some of them twice
        for _ in range(r.choice([1, 2])):
            r.choice(batches).append(x)
    batches[3] += batches[0]
    columns = "job_id string, seq long, kind string, translated_blocks int, total_blocks int, output_path string, error_message string"
    made = lambda xs: spark.createDataFrame(xs, columns).withColumn("ts", F.timestamp_seconds(F.col("seq") * 7))
    want = sorted(map(tuple, jobs.states(made(rows)).collect()))
    assert ledger.states(spark, path).count() == 0
    for n, xs in enumerate(batches):
        ledger.record(made(xs), path, str(n))
        if n == 1:
            ledger.record(made(xs), path, str(n))
        if n in (0, 2, 3):
            assert ledger.compact(spark, path) == {0: 1, 2: 2, 3: 3}[n]
    assert sorted(map(tuple, ledger.states(spark, path).collect())) == want
    # only what came after the last snapshot is read again
    assert [f for f in ledger._parts(spark, path)[2] if "batch=4" in f] and ledger.compact(spark, path) == 4
    assert sorted(map(tuple, ledger.states(spark, path).collect())) == want
    assert ledger.events(spark, path).count() == sum(map(len, batches))


def _counting(path, break_at=None):
    """A translator that writes down every call, and takes its task with it at a text of ``break_at``."""

    class Counting:
        def translate(self, text, context):
            with open(path, "a") as f:
                f.write(f"{text}|{context}\n".replace("\n\n", "//"))
            if break_at and break_at in text:
                raise SystemExit("lost")
            if "refuse" in text:
                raise RuntimeError("refused")
            return text.upper(), 1, 2

        def close(self):
            pass

    return Counting


def test_answers_are_kept_between_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(translate, "TASK_REQUESTS", 4)
    docs = spark.createDataFrame([(k, "same text" if k % 3 == 0 else f"text {k}" if k != 20 else "lost") for k in range(40)] + [(50, "refuse"), (51, ""), (52, None)], "doc_id long, text string")
    store, calls = str(tmp_path / "answers"), tmp_path / "calls"
    with pytest.raises(Exception):
        translate.answers(translate.requests(docs), _counting(str(calls), "lost"), store)
    before = set(calls.read_text().splitlines())
    answered = translate.answers(translate.requests(docs), _counting(str(calls)), store)
    got = {r.doc_id: (r.output, r.status, r.error_message) for r in translate.translated(docs, answered).collect()}
    assert got == {k: ("SAME TEXT" if k % 3 == 0 else f"TEXT {k}" if k != 20 else "LOST", "completed", None) for k in range(40)} | {50: (None, "failed", "refused"), 51: ("", "completed", None), 52: ("", "completed", None)}
    seen = calls.read_text().splitlines()
    # what tasks had told before the run broke off is not asked again; of the broken task's own requests at most
    assert len(before) > 10 and seen.count("same text|None") == 1
    twice = {x for x in seen if seen.count(x) > 1}
    assert len(twice - {"lost|None", "refuse|None"}) <= translate.TASK_REQUESTS * spark.sparkContext.defaultParallelism
    translate.answers(translate.requests(docs), _counting(str(calls)), store).collect()
    assert calls.read_text().splitlines() == [*seen, "refuse|None"]
    # another translator is asked anew
    translate.answers(translate.requests(docs.limit(1)), _counting(str(calls)), store, "other").collect()
    assert len(calls.read_text().splitlines()) == len(seen) + 2


def _all(spark, base):
    """Everything a run leaves, but for what depends on when it ran."""
    read = lambda what, *c: sorted(map(repr, spark.read.parquet(f"{base}/{what}").select(*c).collect()))
    return read("quarantine", "job_id", "path", "reason"), read("outputs", "job_id", "output", "output_path", "download_name", "media_type"), read("ledger/events", "*"), sorted(map(repr, ledger.states(spark, f"{base}/ledger").collect()))


def test_files_to_outputs(spark, tmp_path):
    source, base, calls = tmp_path / "in", str(tmp_path / "out"), tmp_path / "calls"
    source.mkdir()
    put = lambda name, content: (source / name).write_bytes(content)
    put("a.txt", "uno\n\ndós".encode("cp1252"))
    put("b.txt", b"\xff\x00\x01\x02")
    put("c.txt", b"refuse this")
    put("d.epub", book([("o/p/1.xhtml", "1.xhtml", b"<p>one</p><p>two</p>")]))
    put("e.epub", b"PK\x03\x04 broken")
    put("f.doc", b"text")
    put("g.pdf", b"%PDF-1.7")
    service.run(service.folder(spark, str(source), 3), base, _counting(str(calls)))
    put("h.txt", b"later")
    put("i.txt", b"\x81" * 9 + b"a")
    service.run(service.folder(spark, str(source), 3), base, _counting(str(calls)))
    left, asked = _all(spark, base), calls.read_text()
    quarantine = {r.path.rpartition("/")[2]: r.reason for r in spark.read.parquet(f"{base}/quarantine").collect()}
    assert quarantine == {"b.txt": "content", "f.doc": "extension", "g.pdf": "layout"}
    states = {r.job_id: r for r in ledger.states(spark, f"{base}/ledger").collect()}
    out = {r.download_name: r for r in spark.read.parquet(f"{base}/outputs").collect()}
    assert {k: bytes(v.output) for k, v in out.items() if k.endswith("txt")} == {"translated_a.txt": "UNO\n\nDÓS".encode(), "translated_h.txt": b"LATER"}
    again = html.blocks(epub.chapters(epub.entries(spark.createDataFrame([(1, out["translated_d.epub"].output)], "doc_id long, content binary"))))
    assert [r.text for r in again.orderBy("block_order").collect()] == ["ONE", "TWO"]
    assert sorted((r.status, r.error_message) for r in states.values() if r.status == "failed") == [("failed", "File is not a zip file"), ("failed", "no encoding fits"), ("failed", "refused")]
    assert all(states[r.job_id].output_path == r.output_path for r in out.values()) and len(states) == 6
    # a batch that is run again changes nothing, and asks nothing but what was refused
    for number in range(2):
        names = [r.path for r in spark.read.parquet(f"{base}/quarantine").filter(F.col("batch") == number).collect()]
        held = spark.read.format("binaryFile").load(str(source))
        ids = [r.job_id for what in ("outputs", "quarantine", "ledger/events") for r in spark.read.parquet(f"{base}/{what}").filter(F.col("batch") == number).select("job_id").distinct().collect()]
        mine = held.filter(jobs.job_id(F.col("path"), F.col("length"), F.unix_micros("modificationTime")).isin(ids))
        assert len(names) <= mine.count() and ids
        service.process(mine, number, base, _counting(str(calls)))
    assert _all(spark, base) == left
    assert set(calls.read_text()[len(asked) :].splitlines()) <= {"refuse this|None"}


def test_files_as_rows(spark, tmp_path):
    """Files that are rows of a table: empty ones too, which no folder gives; a file that is seen twice is one job."""
    rows = [("x/empty.txt", 0, b""), ("x/a.TXT", 3, b"abc"), ("x/a.TXT", 3, b"abc"), ("y/a.txt", 9, b"too large")]
    spark.createDataFrame(rows, "path string, length long, content binary").withColumn("modificationTime", F.timestamp_seconds(F.lit(1))).write.parquet(str(tmp_path / "in"))
    base = str(tmp_path / "out")
    service.run(service.table(spark, str(tmp_path / "in")), base, _counting(str(tmp_path / "calls")), max_size=8)
    assert {r.download_name: bytes(r.output) for r in spark.read.parquet(f"{base}/outputs").collect()} == {"translated_empty.txt": b"", "translated_a.TXT": b"ABC"}
    assert [(r.path, r.reason) for r in spark.read.parquet(f"{base}/quarantine").collect()] == [("y/a.txt", "size")]


def test_states_that_expire(spark, tmp_path):
    """Jobs that ended are let go; what comes later still counts, and the table of merged partial states is that of all events."""
    import time

    from docspark.streaming import live

    r = random.Random(6)
    schema, path, table, seen = ledger.EVENTS, str(tmp_path / "events"), str(tmp_path / "table"), []
    kinds = ["created", "processing", "progress", "completed", "failed"]
    rows = [(f"j{r.randint(0, 12)}", n, k := r.choice(kinds), n % 9 if k == "progress" and n % 4 else None, 9 if k == "progress" else None, f"o{n}" if k == "completed" else None, f"bad{n}" if k == "failed" else None) for n in range(150)]
    r.shuffle(rows)
    made = lambda xs: spark.createDataFrame(xs, "job_id string, seq long, kind string, translated_blocks int, total_blocks int, output_path string, error_message string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 3)).select(*[f.split(" ")[0] for f in schema.split(", ")])

    def keep(batch, number):
        held = batch.collect()
        seen.append(held)
        if held:
            spark.createDataFrame(held, batch.schema).write.mode("append").parquet(table)

    for k in range(3):
        made(rows[k * 50 : k * 50 + 50]).write.mode("append").parquet(path)
        live.expiring_states(spark.readStream.schema(schema).parquet(path), keep, str(tmp_path / "state"), 500).awaitTermination()
        time.sleep(1)
    got = jobs.finished(jobs.merged(spark.read.parquet(table)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.states(made(rows)).collect()))
    # of a job that had ended before, only the new events are known
    ended = {x.job_id for x in seen[0] if x.status and x.status.status in ("completed", "failed")}
    again = [x for held in seen[1:] for x in held if x.job_id in ended]
    assert again and any(x.created_at is None for x in again)
