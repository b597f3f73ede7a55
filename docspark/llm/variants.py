"""Operator 12: spelling variants grouped under their commonest form.

Two words are near if one inserted, deleted or replaced letter turns one into the other.
Near words are found on a bit-sliced position index: for every (position, letter) a bitset of
the words that have that letter there.  A query letter is one step for all words at once: the
words that agree so far are cut to those with the letter at this position; the words with one
letter replaced, one too many or one too few are carried along from the same sets, the latter
two at positions shifted by one.

At scale
  * A vocabulary of millions is cut into blocks that share all letters but those of one zone of
    ``ZONE`` positions; an error lies in one zone, so two near words meet in one block, and an error
    at the border of two zones counts in one of them only.  A block has at most as many words
    as there are fillings of a zone, by one letter more at most: a bound on every block, whatever the vocabulary.
  * Words of a block are numbered by falling count, so the best near word is the lowest bit of
    a set and their number its count of bits: no pair is ever written out.
  * Occurrences are counted within tasks before the shuffle, documents word by distinct word.
  * Chains of forms are followed by pointer doubling: each count is five times the last, so a chain is
    short and its rounds are few.

Defined results: a null or empty text has no words; repeated rows count again; a null
``doc_id`` counts as an empty string in the digest; an empty table gives no rows; further
columns are not read; of near words with equal counts the first in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docspark.llm.common import settle, table

RUN = "[A-Za-zÀ-ÿ]+"
#: Of so many pairs of document and run one loses a letter.
MISSPELT = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as common as its variant.
RATIO = 5
#: Positions that words of one block may differ in; a word has ``ZONES`` zones at most, so those of a long one are wider.
ZONE, ZONES = 3, 16
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all texts, for words of ``LEAST_LETTERS`` letters and more that occur ``LEAST_COUNT`` times."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        runs, lowered, counts = re.compile(RUN).findall, {}, Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for found, n in Counter(runs(text.as_py() or "")).items():
                    held = lowered.get(found)
                    if held is None:
                        if len(lowered) > HELD_WORDS:
                            lowered.clear()
                        low = found.translate(_UPPER)
                        held = lowered[found] = low, low.encode()
                    word, raw = held
                    if len(word) < LEAST_LETTERS:
                        continue
                    digest = zlib.crc32(raw, start)
                    if digest % MISSPELT == 0:
                        at = digest % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield made()
                    counts.clear()
        if counts:
            yield made()

    texts = docs.select(F.col("doc_id").cast("string"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def blocks(words: DataFrame) -> DataFrame:
    """``(block, last, width, middle, word, n)``: every word under every zone, among words of its own length and one letter more, and of one less.

    ``short`` is the length of the shorter words of a block; the ``middle`` is what the block leaves open.
    """
    length = F.length("word")
    short = F.explode(F.array(length, length - 1)).alias("short")
    rows = words.select("word", "n", length.alias("length"), short).filter(F.col("short") >= LEAST_LETTERS)
    rows = rows.withColumn("wide", F.greatest(F.lit(ZONE), F.ceil(F.col("short") / ZONES)).cast("int"))
    rows = rows.withColumn("zone", F.explode(F.expr("sequence(0, cast((short - 1) div wide as int))")))
    first, stop = F.col("zone") * F.col("wide"), F.least(F.col("short"), (F.col("zone") + 1) * F.col("wide"))
    rest: Column = F.col("short") - stop
    shared = F.concat_ws(":", "short", "zone", F.substring("word", F.lit(1), first), F.right("word", rest))
    return rows.select(
        shared.alias("block"), (stop == F.col("short")).alias("last"), (stop - first).cast("int").alias("width"),
        F.substring("word", first + 1, F.col("length") - first - rest).alias("middle"), "word", "n",
    )


class Index:
    """The bit-sliced position index of one block: bit ``k`` of every set is the block's ``k``-th word."""

    def __init__(self, middles: list[str], width: int, last: bool):
        self.width, self.last = width, last
        #: by position, the words that have each letter there
        self.slices: list[dict[str, int]] = [{} for _ in range(width + 2)]
        self.every = (1 << len(middles)) - 1
        self.longer = 0
        for k, middle in enumerate(middles):
            bit = 1 << k
            for position, letter in enumerate(middle):
                held = self.slices[position]
                held[letter] = held.get(letter, 0) | bit
            if len(middle) > width:
                self.longer |= bit

    def near(self, middle: str) -> int:
        """The words that one letter parts from ``middle``, but for errors that belong to the zone behind."""
        exact, replaced, extra, missing = self.every, 0, self.every, 0
        whole = 0
        for at, letter in enumerate(middle):
            if at == self.width:
                whole = exact
            here, behind = self.slices[at].get(letter, 0), self.slices[at + 1].get(letter, 0)
            # one letter of the query left out: what follows stands one place earlier in the word
            missing = (missing & self.slices[at - 1].get(letter, 0) if at else 0) | exact
            replaced = replaced & here | exact & ~here
            exact &= here
            # one letter of the word left out: what follows stands one place later in it
            extra = extra & behind | exact
        if len(middle) > self.width:
            found, beyond = missing & ~self.longer, whole
        else:
            found, beyond = extra & self.longer, exact
        if not self.last:
            # the shorter one stands whole in the longer one: the letter too many stands behind this zone
            found &= ~beyond
        return found if len(middle) > self.width else found | replaced & ~self.longer


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best)``: how many near words each word has, if any, and ``(-n, word)`` of the commonest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def of_block(rows: list[tuple]) -> Iterator[tuple]:
            # by falling count, ties in code-point order: the best of a set is its lowest bit
            rows.sort(key=lambda r: (-r[4], r[3]))
            index = Index([r[2] for r in rows], rows[0][1], rows[0][0])
            for _, _, middle, word, _ in rows:
                found = index.near(middle)
                if found:
                    best = rows[(found & -found).bit_length() - 1]
                    yield word, found.bit_count(), -best[4], best[3]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["word", "n_near", "less", "near"])

        block, rows, out = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, *row in zip(*columns):
                if key != block:
                    if len(rows) > 1:
                        out += of_block(rows)
                        if len(out) > 10_000:
                            yield made(out)
                            out = []
                    block, rows = key, []
                rows.append(tuple(row))
        if len(rows) > 1:
            out += of_block(rows)
        yield made(out)

    sorted_blocks = blocks(words).repartition("block").sortWithinPartitions("block")
    found = sorted_blocks.mapInArrow(run, "word string, n_near long, less long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of the chain of forms that starts at each word of ``forms``, ``(word, form)``."""
    now, left = settle(forms.select("word", F.col("form").alias("root")), "chains"), -1
    while True:
        # every word jumps to where its root has come, so a chain is half as long after each round
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        left = moved.filter("moved").count()
        now = moved.drop("moved")
        if not left:
            return now


def grouped(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words``, ``(word, n)``."""
    near = settle(words.join(near_words(words), "word", "left"), "near-words")
    form_n = -F.col("best.less")
    named = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form_n >= RATIO * F.col("n"), F.struct(F.col("best.near").alias("form"), form_n.alias("form_n"))).alias("held"))
    named = named.select("word", F.col("held.form").alias("form"), "n", "n_near", F.col("held.form_n").alias("form_n"))
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(settle(counted(table(spark, sf_dir, "documents")), "vocabulary"))


#: Near words by their texts with one letter taken out: equal at the same place, or equal to the other word.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY b) AS entries FROM (
        SELECT b, list_reduce(range(8)::BIGINT[], lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM range(256) AS r(b)
    )
),
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
),
found AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
digests AS (
    SELECT run, n, xor(list_reduce(
        list_transform(range(1, octet_length(encode(doc_id || ':' || run)) + 1), lambda i : ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i::INT - 1, 2))::BIGINT),
        lambda c, b : xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
    FROM found, crc_table
),
written AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM digests),
words AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, length(word) AS size, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM less AS a JOIN less AS b USING (size, i, rest) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less AS a JOIN words AS b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less AS a JOIN words AS b ON a.rest = b.word
),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
named AS (
    SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words AS w LEFT JOIN best AS b ON b.word = w.word AND place = 1
),
chain AS (
    SELECT word, form AS stop FROM named WHERE form IS NOT NULL
    UNION ALL SELECT c.word, m.form FROM chain AS c JOIN named AS m ON m.word = c.stop WHERE m.form IS NOT NULL
),
ends AS (SELECT c.word, c.stop FROM chain AS c JOIN named AS m ON m.word = c.stop WHERE m.form IS NULL)
SELECT m.word, form, coalesce(stop, m.word) AS root, n, n_near, form_n FROM named AS m LEFT JOIN ends AS e ON e.word = m.word
"""
