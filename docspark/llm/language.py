"""Operator 9: language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed against it into longest phrases that occur in the sample;
the language whose sample needs the fewest wins, phrases being weighed by the logarithm
of the sample's length: a longer sample holds longer phrases for that alone.

The automata are dense transition tables, in which a missing transition names the
state where the next phrase starts.  All texts of a batch take a step at once; the few
that are much longer than the others go on one by one, so every text is parsed whole and
costs in proportion to its length.  The plan is one narrow pass over the texts; the
sample is all that reaches the driver: of the ``LANGUAGES`` most frequent labels
``SAMPLE_DOCS`` documents each, about, of ``SAMPLE_CHARS`` characters at most, and
``ALL_CHARS`` of all together, which bounds the tables (under 300 MB, 60 MB for four
languages).

Defined results: null text or no letter gives ``und`` with score 0; ties go to the
first language in code-point order; without labelled text every text is ``und``;
a null ``doc_id`` counts as the empty string; repeated rows repeat; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bounds of the training sample, for each language.
SAMPLE_DOCS = 150
SAMPLE_CHARS = 30_000
ALL_CHARS = 500_000
DOC_CHARS = 3_000
LANGUAGES = 200
#: Letters with a symbol of their own, the most frequent of the sample; others share these by their code point.
LETTERS = 62
#: Texts that take their steps together at least; fewer go on one by one.
TOGETHER = 24
#: Texts that stand in a worker's memory at once.
TEXTS = 2_048


def fold(number: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(number).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def training_sample(docs: DataFrame) -> dict[str, str]:
    """Text by language: documents outside the held-out fold, those of least hash, cut to the bounds above."""
    known = docs.filter((fold() != 1) & F.col("lang").isNotNull() & (F.length("text") > 0))
    frequent = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in frequent.collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_DOCS / n))])
    at = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) / F.lit(1e6)
    chosen = known.select("lang", F.substring("text", 1, DOC_CHARS).alias("text"), at.alias("at")).filter(F.col("at") < share[F.col("lang")])
    rows = chosen.orderBy("at", "lang", "text").limit(4 * SAMPLE_DOCS * len(counts)).toLocalIterator()
    most = min(SAMPLE_CHARS, ALL_CHARS // len(counts))
    out: dict[str, str] = {}
    for r in rows:
        out[r["lang"]] = (out.get(r["lang"], "") + "\n" + r["text"])[:most]
    return out


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``symbols``; ``~s`` stands for "a phrase begins, go on in state s".

    In the last state no phrase is open: texts begin there, and a symbol that the sample lacks leads there.
    """
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(step) + 1, size), -1, dtype=np.int32)
    for s, moves in enumerate(step):
        for c, t in moves.items():
            table[s, c] = t
    first = np.where(table[0] < 0, len(step), table[0])
    return np.where(table < 0, ~first[None, :], table)


class Parser:
    """Automata of all languages, and the symbols of letters."""

    def __init__(self, sample: dict[str, str]):
        self.languages = sorted(sample)
        shares: dict[str, float] = {}
        for text in sample.values():
            found = pd.Series([c for c in text.lower() if c.isalpha()], dtype=object).value_counts(normalize=True)
            for c, n in found.items():
                shares[c] = shares.get(c, 0.0) + n
        letters = sorted(shares, key=lambda c: (-shares[c], c))[:LETTERS]
        self.symbol = np.array([(2 + c * 2654435761 % 2**32 % max(1, len(letters))) * chr(c).isalpha() for c in range(0x110000)], dtype=np.uint8)
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = 2 + i
        self.size = 2 + len(letters)
        ids = [self.symbols(sample[k]) for k in self.languages]
        self.weight = np.log2(np.array([max(2, len(x)) for x in ids], dtype=float))
        tables = [automaton(x.tolist(), self.size) for x in ids]
        starts = np.cumsum([0, *[len(t) for t in tables]])[:-1].astype(np.int32)
        # one table for all languages: states are shifted, a restart keeps its sign
        self.table = np.concatenate([np.where(t >= 0, t + s, t - s) for t, s in zip(tables, starts)]).ravel().astype(np.int32) if tables else np.zeros(0, np.int32)
        self.starts = starts + np.array([len(t) - 1 for t in tables], dtype=np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text: letters without case, any run of other characters as one 0."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ids = self.symbol[points]
        if len(ids) > 1:
            ids = ids[np.concatenate(([True], (ids[1:] > 0) | (ids[:-1] > 0)))]
        return ids

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and symbols by text (0 where it has no letter)."""
        ids = [self.symbols(t) for t in texts]
        lengths = np.array([len(x) if x.any() else 0 for x in ids], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        order, sizes = order[sizes > 0], sizes[sizes > 0]
        found = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not len(order):
            return found, lengths
        flat = np.concatenate([ids[i] for i in order]).astype(np.int32)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        together = int(sizes[TOGETHER]) if len(sizes) > TOGETHER else 0
        live = np.searchsorted(-sizes, -np.arange(1, together + 1), side="right")
        state = np.repeat(self.starts[:, None], len(order), axis=1)
        ended = np.zeros((len(self.languages), len(order)), dtype=np.int64)
        for k in range(together):
            n = live[k]
            now = self.table.take(state[:, :n] * self.size + flat.take(begin[:n] + k))
            sign = now >> 31
            ended[:, :n] -= sign
            state[:, :n] = now ^ sign
        look, size = memoryview(self.table), self.size
        for j in np.flatnonzero(sizes > together).tolist():
            rest = flat[begin[j] + together : begin[j] + sizes[j]].tolist()
            for m in range(len(self.languages)):
                at, n = int(state[m, j]), 0
                for c in rest:
                    at = look[at * size + c]
                    if at < 0:
                        at, n = ~at, n + 1
                ended[m, j] += n
        found[order] = ended.T
        return found, lengths

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (how much shorter than with the next language, 0 to 1) and bits of phrases a symbol."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        found, lengths = self.phrases(texts)
        found = found * self.weight
        best = found.argmin(axis=1)
        rank = np.sort(found, axis=1)
        score = 1 - rank[:, 0] / np.maximum(rank[:, 1], 1e-9) if len(self.languages) > 1 else np.ones(len(texts))
        none = lengths == 0
        names = ["und" if z else self.languages[b] for z, b in zip(none, best)]
        return names, np.where(none, 0.0, score).tolist(), np.where(none, 1.0, rank[:, 0] / np.maximum(lengths, 1)).tolist()


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: dict[str, str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``phrase_rate`` of each row; learns from ``docs`` unless given a sample."""
    sample = training_sample(docs) if sample is None else sample
    parser = docs.sparkSession.sparkContext.broadcast(Parser(sample))
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_rate", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                names, score, rate = parser.value.predict([t or "" for t in batch.column("text").to_pylist()])
                kept = [batch.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*keep, "lang_pred", "score", "phrase_rate"])

    # a text that is kept goes to the worker once
    return docs.select(*[F.col(f"`{k}`") for k in dict.fromkeys((*keep, "text"))]).mapInArrow(run, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs).select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
