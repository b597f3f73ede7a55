"""Glossaries: reading, cleaning, and matching whole words in chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docspark.functions.text import spaced_controls, strip

MAX_CHARS = 100
#: A glossary up to this size is sent to every task.
MAX_TERMS, MAX_TERM_CHARS = 200_000, 16_000_000
# Entries that try to give instructions.
SUSPICIOUS = (
    r"ignor\w*.{0,30}instruccion",
    r"ignore.{0,30}instructions",
    r"disregard.{0,30}(instructions|rules|prompt)",
    r"system\s*:",
    r"you\s+are\s+now",
    r"act[uú]a\s+como",
)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """``(position, term, translation)`` of a JSON object of strings, repeated terms too; anything else is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"), F.json_object_keys("value").alias("k"))
    told = F.when(F.col("m").isNull() | F.col("k").isNull(), F.raise_error(F.lit("the glossary is no JSON object")).cast("map<string,string>")).otherwise(F.col("m"))
    return raw.select(F.posexplode(F.map_entries(told)).alias("position", "e")).select("position", F.col("e.key").alias("term"), F.col("e.value").alias("translation"))


def suspicious(value: Column) -> Column:
    out = F.lit(False)
    for pattern in SUSPICIOUS:
        out = out | value.rlike(f"(?iud){pattern}")
    return out


def sanitised(raw: DataFrame) -> DataFrame:
    """Every entry with cleaned sides and the ``reason`` of a rejection, null if kept."""
    rows = raw.withColumn("term", strip(spaced_controls("term"))).withColumn("translation", strip(spaced_controls("translation")))
    term, to = F.col("term"), F.col("translation")
    reason = (
        F.when(term.isNull() | to.isNull() | (term == "") | (to == ""), "empty")
        .when((F.length(term) > MAX_CHARS) | (F.length(to) > MAX_CHARS), "long")
        .when(suspicious(term) | suspicious(to), "suspicious")
    )
    return rows.withColumn("reason", reason)


def clean(raw: DataFrame) -> DataFrame:
    """Kept entries, one per term: last translation, first position."""
    kept = sanitised(raw).filter("reason is null")
    return kept.groupBy("term").agg(F.min("position").alias("position"), F.max_by("translation", "position").alias("translation")).select("position", "term", "translation")


def pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?iuU)\b"), F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(r"\b"))


def _fold(x: Column) -> Column:
    return F.lower(F.upper(x))


class Automaton:
    """Finds every term of a glossary in one pass over a text.

    ``\\b`` on both sides of a term means that it starts where a run of word characters, or of
    others, starts and ends where one ends.  So terms and texts are sequences of such runs, told apart
    without case, and terms are found by an Aho-Corasick automaton over runs.
    """

    RUNS, WORD = re.compile(r"\w+|\W+"), re.compile(r"\w").match
    #: Distinct runs whose symbols are remembered.
    REMEMBERED = 500_000

    def __init__(self, terms: list[str]):
        self.alphabet: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.found: list[tuple[int, ...]] = [()]
        self.seen: dict[str, int] = {}
        for n, term in enumerate(terms):
            node = 0
            for run in self.RUNS.findall(term):
                symbol = self.alphabet.setdefault(self.folded(run), len(self.alphabet) + 1)
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    self.found.append(())
                node = self.next[node][symbol]
            if node:
                self.found[node] += (n,)
        self.back = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for symbol, child in self.next[node].items():
                queue.append(child)
                at = self.back[node]
                while at and symbol not in self.next[at]:
                    at = self.back[at]
                self.back[child] = self.next[at].get(symbol, 0)
                self.found[child] += self.found[self.back[child]]

    @staticmethod
    def folded(run: str) -> str:
        """Without case, letter by letter: a letter whose other case is several letters is only itself."""
        if run.isascii():
            return run.lower()
        # the one letter whose lower case is another's with a mark, and counts as that other
        up = (u if len(u := c.upper()) == 1 else c for c in run.replace("İ", "i"))
        return "".join(low if len(low := c.lower()) == 1 else c for c in up)

    def search(self, text: str) -> list[int]:
        """The numbers of the terms that stand in ``text``, in order."""
        node, out, follow, found, seen = 0, set(), self.next, self.found, self.seen
        runs = self.RUNS.findall(text)
        # where a text starts or ends with other than word characters there is no border of a word
        for run in runs[bool(runs) and not self.WORD(runs[0]) : len(runs) - (bool(runs) and not self.WORD(runs[-1]))]:
            symbol = seen.get(run)
            if symbol is None:
                if len(seen) >= self.REMEMBERED:
                    seen.clear()
                symbol = seen[run] = self.alphabet.get(self.folded(run), 0)
            if not symbol:
                node = 0
                continue
            while node and symbol not in follow[node]:
                node = self.back[node]
            node = follow[node].get(symbol, 0)
            if found[node]:
                out.update(found[node])
        return sorted(out)


def _terms_udf(spark: SparkSession, rows: list):
    """A column function from texts to the ``(term, translation)`` pairs found in them, null where none is."""
    shipped = spark.sparkContext.broadcast([(r["term"], r["translation"]) for r in rows])
    kind = pa.list_(pa.struct([("term", pa.string()), ("translation", pa.string())]))

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs = shipped.value
        automaton = Automaton([t for t, _ in pairs])
        told = [{"term": t, "translation": to} for t, to in pairs]
        for texts in batches:
            made = ([told[n] for n in automaton.search(t.as_py() or "")] for t in texts)
            yield pa.array([m or None for m in made], kind)

    return F.arrow_udf(found, "array<struct<term string, translation string>>")


def matched(chunk_rows: DataFrame, glossary: DataFrame, key: list[str], text: str = "chunk_text") -> DataFrame:
    """``chunk_rows`` with ``terms``: the glossary's terms that stand in ``text`` as whole words, in glossary order, or null.

    A glossary within ``MAX_TERMS`` and ``MAX_TERM_CHARS`` is sent to every task as an automaton, and texts
    are searched where they are, without any exchange; beyond, terms are joined by word.
    """
    size = glossary.agg(F.count("*").alias("n"), F.sum(F.length("term") + F.length("translation")).alias("chars")).first()
    if size["n"] > MAX_TERMS or (size["chars"] or 0) > MAX_TERM_CHARS:
        return chunk_rows.join(matches_by_word(chunk_rows, glossary, key, text), key, "left")
    rows = glossary.select("position", "term", "translation").orderBy("position", "term", "translation").collect()
    return chunk_rows.withColumn("terms", _terms_udf(chunk_rows.sparkSession, rows)(F.col(text)))


def matches(chunk_rows: DataFrame, glossary: DataFrame, key: list[str], text: str = "chunk_text") -> DataFrame:
    """``key`` and ``terms`` of the rows in whose text any term stands."""
    return matched(chunk_rows.select(*key, text), glossary, key, text).filter("terms is not null").select(*key, "terms")


def matches_by_word(chunk_rows: DataFrame, glossary: DataFrame, key: list[str], text: str = "chunk_text") -> DataFrame:
    """The same for a glossary of any size: ``key`` and ``terms``, by joins alone.

    A word of a term is a whole word wherever the term stands, and a term without any
    is all that stands between two words there.  So terms are found by equality, of their
    longest word or of all they are, with the distinct words of each text and what stands
    between them; only keys and words take part in that join.  A term of one word is then
    tried against that word; others are tried against the text, which is fetched by its key
    for what is left alone.
    """
    words = F.regexp_extract_all("term", F.lit(r"(?U)\w+"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    rows = glossary.select("position", "term", "translation", pattern(F.col("term")).alias("pattern"), F.when(F.size(words) > 0, longest).otherwise(F.col("term")).alias("word"))
    rows = rows.withColumn("piece", _fold(F.col("word"))).withColumn("alone", (F.col("word") == F.col("term")) & (F.size(words) > 0)).drop("word")
    texts = chunk_rows.select(*key, F.col(text).alias("__text"))
    pieces = F.array_distinct(F.regexp_extract_all("__text", F.lit(r"(?U)\w+|\W+"), F.lit(0)))
    met = texts.select(*key, F.explode(pieces).alias("held")).withColumn("piece", _fold(F.col("held"))).join(rows, "piece")
    columns = [*key, "position", "term", "translation"]
    by_word = met.filter("alone").filter(F.expr("regexp_like(held, pattern)")).select(*columns)
    by_text = met.filter("not alone").select(*columns, "pattern").distinct().join(texts, key).filter(F.expr("regexp_like(__text, pattern)")).select(*columns)
    found = by_word.unionByName(by_text).distinct()
    terms = F.transform(F.array_sort(F.collect_list(F.struct("position", "term", "translation"))), lambda t: F.struct(t["term"].alias("term"), t["translation"].alias("translation")))
    return found.groupBy(*key).agg(terms.alias("terms"))


def with_terms(chunk_rows: DataFrame, glossary: DataFrame, key: list[str]) -> DataFrame:
    """``chunk_rows`` with ``terms``; null where none stands in the text, as with an empty glossary."""
    return matched(chunk_rows, glossary, key)


def size(glossary: DataFrame) -> int:
    """How many terms it has; a glossary of none is as good as no glossary."""
    return glossary.count()
