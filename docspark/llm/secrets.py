"""Operator 5: secret scans, by base patterns and character Markov models.

Base patterns find assigned values, access keys and long hexadecimal strings.
Beside them, every long token is scored under two character models of first
order, one of random strings and one of ordinary identifiers; a token whose mean
log-likelihood ratio per character passes ``THRESHOLD`` is a further span.  Base
spans always stay; tokens that overlap one are not scored again.

The models are counts of adjacent characters.  Labelled random strings are drawn, as
many of each alphabet of ``RANDOM`` (their law is known, so a sample of any size can be
had), and beside them stand the values of base spans of a bounded sample of documents;
tokens of its documents without any base span are the ordinary ones.  At most
``2 * 68 * 68`` counts reach the driver, whatever the corpus.

Everything is a column expression on one scan: no exchange beside the training
counts, no Python on executors.  Long tokens and many matches cost in proportion, but
for the places of matches, which are summed in blocks (power 1.5 of the matches of a text).

Defined results: a null text counts as empty and has no spans; repeated rows
repeat; a null ``doc_id`` is kept; further columns are not read.  Positions are code
points, the end is exclusive.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Maximal runs of 24 and more, the same as all runs with the short ones dropped.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Tokens that the models judge, and those that the models learn from.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
PLAIN = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
SAMPLE_DOCS = 20_000
#: Weight of single characters in what is expected after another.
BACK = 2.0
#: Alphabets of the labelled random strings, and how many of each are drawn and how long.
RANDOM = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567", ALPHABET[:62], ALPHABET[:64])
DRAWN, DRAWN_CHARS = 500, 40
#: Stands for every character of a base span while other tokens are looked for.
_TAKEN = "\ue000"
#: One of so many sampled documents without a span gives its tokens; they are plentiful.
ORDINARY = 20
THRESHOLD = 3.0


_EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _sums(values: Column) -> Column:
    """Running sums of an array of integers, each without its own value; folds append to arrays of few items only."""

    def fold(part: Column, start: Column) -> Column:
        none = F.expr("cast(array() as array<int>)")
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def blocked(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / side).cast("int") - 1), lambda b: F.slice(v, b * side + 1, side))
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
        starts = lambda p: fold(F.transform(p, total), F.lit(0))
        return _let(parts, lambda p: F.flatten(F.transform(F.arrays_zip(p.alias("part"), starts(p).alias("start")), lambda x: fold(x["part"], x["start"]))))

    return _let(values, lambda v: F.when(F.size(v) == 0, F.expr("cast(array() as array<int>)")).otherwise(blocked(v)))


def _positions(text: Column, pattern: str, kind: int, low: int, group: int = 0) -> Column:
    """Spans ``(start, kind, end, value)`` of the matches whose group has at least ``low`` characters.

    The text split at the matches gives the gaps; a running sum of gaps and
    matches gives the starts.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda m: F.length(m)).alias("long"), values.alias("value"))

    def placed(s: Column) -> Column:
        # the last gap has no match behind it
        before = _sums(F.transform(s, lambda x: x["gap"] + F.coalesce(x["long"], F.lit(0))))
        spans = F.transform(F.arrays_zip(s.alias("s"), before.alias("at")), lambda x: F.struct((x["at"] + x["s"]["gap"]).alias("start"), F.lit(kind).alias("kind"), (x["at"] + x["s"]["gap"] + x["s"]["long"]).alias("end"), x["s"]["value"].alias("value")))
        return F.filter(spans, lambda x: F.length(x["value"]) >= low)

    return F.when(text.rlike(pattern), _let(steps, placed)).otherwise(F.expr(_EMPTY))


def base_spans(text: Column) -> Column:
    # a pattern that a key word must start is tried only where one is
    empty = F.expr(_EMPTY)
    assign = F.when(text.rlike(r"(?i:passw|secret|token|api)"), _positions(text, ASSIGN, 0, MIN_ASSIGN, 2)).otherwise(empty)
    access = F.when(F.contains(text, F.lit("AKIA")), _positions(text, ACCESS, 1, MIN_ACCESS)).otherwise(empty)
    return F.concat(assign, access, _positions(text, HEX, 2, 24))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def _transitions(token: Column) -> Column:
    """``SIDE * code(a) + code(b)`` of each adjacent pair of characters."""
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * SIDE + b)
    return F.when(F.length(token) > 1, _let(_codes(token), pairs)).otherwise(F.expr("cast(array() as array<int>)"))


def drawn() -> dict[int, float]:
    """Counts of the transitions of the labelled random strings."""
    out: dict[int, float] = {}
    r = random.Random(5)
    for alphabet in RANDOM:
        for _ in range(DRAWN):
            codes = [ALPHABET.index(c) + 1 for c in r.choices(alphabet, k=DRAWN_CHARS)]
            for a, b in zip(codes, codes[1:]):
                out[a * SIDE + b] = out.get(a * SIDE + b, 0) + 1
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random against ordinary, by index."""
    rows = docs.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1e6 * sample_docs / max(rows, 1))
    text = F.coalesce("text", F.lit(""))
    # repeated ids could all fall into the share; the limit holds whatever they do
    sample = docs.filter(share).select(text.alias("text"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ORDINARY)) == 0).alias("plain")).limit(2 * sample_docs).withColumn("base", base_spans(F.col("text")))
    tokens = sample.select(
        F.size("base").alias("hits"),
        F.explode(F.when(F.size("base") > 0, F.transform("base", lambda b: b["value"])).when(F.col("plain"), F.regexp_extract_all("text", F.lit(PLAIN), F.lit(0)))).alias("token"),
    )
    pairs = tokens.select((F.col("hits") > 0).alias("random"), F.explode(_transitions(F.col("token"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    # the values found weigh as much as one alphabet at most, whatever form most of them have
    base = sum(n for (is_random, _), n in counts.items() if is_random)
    weight = min(1.0, DRAWN * (DRAWN_CHARS - 1) / base) if base else 0.0
    counts = {k: n * weight if k[0] else n for k, n in counts.items()}
    for pair, n in drawn().items():
        counts[True, pair] = counts.get((True, pair), 0) + n
    return ratios(*({k: n for (c, k), n in counts.items() if c is kind} for kind in (True, False)))


def ratios(random_pairs: dict[int, float], ordinary_pairs: dict[int, float]) -> list[float]:
    """Log-likelihood ratios by pair, from the counts of pairs of either kind.

    What follows a character is drawn towards what is frequent anyhow, as if ``BACK`` more had been seen.
    """
    logs = []
    for counts in (random_pairs, ordinary_pairs):
        after, single = [0.0] * SIDE, [0.1] * SIDE
        for pair, n in counts.items():
            after[pair // SIDE] += n
            single[pair % SIDE] += n
        total = sum(single)
        logs.append([math.log((counts.get(a * SIDE + b, 0) + BACK * single[b] / total) / (after[a] + BACK)) for a in range(SIDE) for b in range(SIDE)])
    return [round(p - q, 4) for p, q in zip(*logs)]


def _hidden(text: Column, test: str, pattern: str, low: int, group: int) -> Column:
    """The text, of the same length, with every character of the pattern's spans replaced by ``_TAKEN``."""
    value = lambda m: F.regexp_extract(m, pattern, group)
    mask = lambda m: F.when(F.length(value(m)) >= low, F.repeat(F.lit(_TAKEN), F.length(m))).otherwise(m)

    def joined(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), mask)
        pieces = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), found.alias("m"))
        return F.when(t.rlike(test), F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], F.coalesce(x["m"], F.lit("")))), "")).otherwise(t)

    return _let(text, joined)


def _masked(text: Column) -> Column:
    out = F.translate(text, _TAKEN, " ")
    for of_kind in ((r"(?i:passw|secret|token|api)", ASSIGN, MIN_ASSIGN, 2), ("AKIA", ACCESS, MIN_ACCESS, 0), (HEX, HEX, 24, 0)):
        out = _hidden(out, *of_kind)
    return out


def markov_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Long tokens apart from base spans that the models take for random."""
    weights = F.array(*[F.lit(x) for x in ratios])
    mean = lambda t: F.aggregate(_transitions(t["value"]), F.lit(0.0), lambda s, i: s + F.get(weights, i)) / (F.length(t["value"]) - 1)
    # a token that reaches into a base span holds the character that stands for one
    shown = F.when(F.size(base) > 0, _masked(text)).otherwise(text)
    apart = F.when(text.rlike(TOKEN), _let(shown, lambda t: _positions(t, TOKEN.replace("[", f"[{_TAKEN}"), 3, 16))).otherwise(F.expr(_EMPTY))
    return F.filter(apart, lambda t: ~F.contains(t["value"], F.lit(_TAKEN)) & (mean(t) > THRESHOLD))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: arrays of spans ``(start, kind, end, value)``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("base", base_spans(F.col("text"))).withColumn("added", markov_spans(F.col("text"), F.col("base"), ratios)).drop("text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "added")).alias("spans"),
    )
