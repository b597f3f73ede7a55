"""Operator 10: quality rules, with a linear-chain CRF over lines.

The base rules count words, symbols, repeated lines and repeated windows of words.
Then every line with a word is a position of a sequence: a conditional random
field, fitted on a bounded sample of labelled documents, marks it content or
boilerplate by Viterbi decoding, and the share of words in content lines decides
whether the document stays.

The plan is one narrow pass over the texts.  What reaches the driver is the
sample alone: line features of ``SAMPLE_DOCS`` labelled documents at most, of up to
``SAMPLE_LINES`` lines each.  Labelled lines are made of them: runs of lines of documents
of quality 0 are set into documents of quality 1 at known borders, so the field learns
when a document passes from content to boilerplate and back.

Defined results: a null text has no words and fails the base rules; repeated rows
repeat; labels of null, or of documents that are missing, teach nothing; without
labels every line counts as content; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docspark.llm.common import text_bytes

SAMPLE_DOCS = 1500
SAMPLE_LINES = 40
MIN_WORDS = 20
WINDOW = 8
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
_NOT_WORD_POINTS = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))
#: Classes of bytes whose shares describe a line.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", SYMBOLS, b"!?", b".,;:"]
_TABLE = np.full(256, len(_CLASSES), dtype=np.uint8)
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c)] = _i
FEATURES = 12


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array(list(map(names.__getitem__, words)), dtype=np.int64)
    # windows are named exactly: names of the two halves, paired, three times over
    size = 1
    while size < window:
        pair = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        found, ids = np.unique(pair, return_inverse=True)
        if len(found) == len(ids):  # no longer window can repeat
            return 0
        size *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x FEATURES) and words of the lines, each of which has a word."""
    counts = np.zeros((len(lines), len(_CLASSES)), dtype=np.float64)
    total = np.array([len(x) for x in lines], dtype=np.float64)
    kinds = _TABLE[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    starts = np.concatenate(([0], np.cumsum(total)[:-1])).astype(np.int64)
    for k in range(len(_CLASSES)):
        counts[:, k] = np.add.reduceat((kinds == k).astype(np.int32), starts)
    split = [x.split() for x in lines]
    words = np.array([len(w) for w in split], dtype=np.float64)
    distinct = np.array([len(set(w)) for w in split], dtype=np.float64)
    seen: set[bytes] = set()
    again = np.array([x in seen or bool(seen.add(x)) for x in lines], dtype=np.float64)
    upper, lower, digit, symbol, loud, stop = counts.T
    f = np.zeros((len(lines), FEATURES))
    f[:, 0] = 1
    f[:, 1] = words < 5
    f[:, 2] = words >= 20
    f[:, 3] = symbol / total > 0.02
    f[:, 4] = symbol / total > 0.08
    f[:, 5] = upper > lower
    f[:, 6] = digit / total > 0.1
    f[:, 7] = loud / words > 0.3
    f[:, 8] = (words >= 8) & (distinct / words < 0.4)
    f[:, 9] = again
    f[:, 10] = [x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines]
    f[:, 11] = stop / words > 0.6
    return f, words


def spliced(docs: list[tuple[int, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences ``(labels, features)`` of lines: each document as it is, and each of quality 1 with a run of lines of one of quality 0 set in."""
    r = np.random.default_rng(11)
    good, bad = ([f for q, f in docs if q == k] for k in (1, 0))
    out = [(np.full(len(f), q, dtype=np.int64), f) for q, f in docs]
    for f in good if bad else []:
        other = bad[int(r.integers(len(bad)))]
        n = int(r.integers(1, len(other) + 1))
        first, at = int(r.integers(len(other) - n + 1)), int(r.integers(len(f) + 1))
        labels = np.ones(len(f) + n, dtype=np.int64)
        labels[at : at + n] = 0
        out.append((labels, np.concatenate([f[:at], other[first : first + n], f[at:]])))
    return out


def _ahead_and_back(e: np.ndarray, moves: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums of padded sequences (all three length x 2 x n, ``here`` length x n), and the log sum over all paths of each."""
    ahead, back = np.zeros_like(e), np.zeros_like(e)
    ahead[0] = e[0]
    for t in range(1, len(e)):
        for q in (0, 1):
            met = e[t, q] + np.logaddexp(ahead[t - 1, 0] + moves[0, q], ahead[t - 1, 1] + moves[1, q])
            ahead[t, q] = np.where(here[t], met, ahead[t - 1, q])
    for t in range(len(e) - 2, -1, -1):
        to = e[t + 1] + back[t + 1]
        for p in (0, 1):
            back[t, p] = np.where(here[t + 1], np.logaddexp(moves[p, 0] + to[0], moves[p, 1] + to[1]), back[t + 1, p])
    return ahead, back, np.logaddexp(ahead[-1, 0], ahead[-1, 1])


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and presence of the lines, sequences filled up to one length."""
    n, longest = len(sequences), max(len(f) for _, f in sequences)
    x, y, here = np.zeros((n, longest, FEATURES)), np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
    for i, (labels, f) in enumerate(sequences):
        x[i, : len(f)], y[i, : len(f)], here[i, : len(f)] = f, labels, True
    return x, y, here


def expected(weights: np.ndarray, moves: np.ndarray, x: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Under the model: sums of features by state (2 x FEATURES), of moves (2 x 2), and the log sum of each sequence."""
    e, on = np.ascontiguousarray((x @ weights.T).transpose(1, 2, 0)), np.ascontiguousarray(here.T)
    ahead, back, whole = _ahead_and_back(e, moves, on)
    share = np.exp(np.minimum(ahead + back - whole, 0)) * on[:, None]
    got_m = np.zeros_like(moves)
    for p in (0, 1):
        for q in (0, 1):
            got_m[p, q] = (np.exp(np.minimum(ahead[:-1, p] + moves[p, q] + e[1:, q] + back[1:, q] - whole, 0)) * on[1:]).sum()
    return np.tensordot(share, x, ([0, 2], [1, 0])), got_m, whole


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2 x FEATURES) and transitions (2 x 2) of greatest likelihood, by gradient steps over all sequences ``(labels, features)``."""
    weights, moves = np.zeros((2, FEATURES)), np.zeros((2, 2))
    if not sequences:
        weights[1, 0] = 1.0
        return weights, moves
    # sequences of similar length are padded together
    by_length: dict[int, list] = {}
    for labels, f in sequences:
        by_length.setdefault(len(f).bit_length(), []).append((labels, f))
    groups = [padded(by_length[k]) for k in sorted(by_length)]
    lines = sum(here.sum() for _, _, here in groups)
    gw, gm = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    want_f, want_m = np.zeros_like(weights), np.zeros_like(moves)
    for x, y, here in groups:
        for q in (0, 1):
            want_f[q] += x[here & (y == q)].sum(0)
            for p in (0, 1):
                want_m[p, q] += (here[:, 1:] & (y[:, :-1] == p) & (y[:, 1:] == q)).sum()
    for _ in range(rounds):
        got = [expected(weights, moves, x, here) for x, _, here in groups]
        dw = (want_f - sum(f for f, _, _ in got)) / lines - 1e-3 * weights
        dm = (want_m - sum(m for _, m, _ in got)) / lines - 1e-3 * moves
        gw += dw**2
        gm += dm**2
        weights += 0.3 * dw / np.sqrt(gw)
        moves += 0.3 * dm / np.sqrt(gm)
    return weights, moves


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest states: 1 content, 0 boilerplate; ties go to content."""
    e = scores.tolist()
    (aa, ab), (ba, bb) = moves.tolist()
    a, b = e[0]
    from_a, from_b = [], []
    for ea, eb in e[1:]:
        to_a, to_b = (ba + b >= aa + a), (bb + b >= ab + a)
        from_a.append(to_a)
        from_b.append(to_b)
        a, b = (ba + b if to_a else aa + a) + ea, (bb + b if to_b else ab + a) + eb
    state = b >= a
    out = [state]
    for fa, fb in zip(reversed(from_a), reversed(from_b)):
        state = fb if state else fa
        out.append(state)
    return np.array(out[::-1], dtype=bool)


def measured(text: bytes, model: tuple[np.ndarray, np.ndarray]) -> tuple:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    n_repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > 30 * len(words)
    share = 0.0
    if lines:
        f, n = line_features(lines)
        share = float(n[viterbi(f @ model[0].T, model[1])].sum() / n.sum())
    return (
        len(words), len(text.translate(None, _NOT_WORD_POINTS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n_repeat,
        failed, share, not failed and share >= CONTENT_SHARE,
    )


def training_lines(docs: DataFrame, labels: DataFrame) -> list[tuple[int, np.ndarray]]:
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for quality, text in zip(batch["quality"], batch["text"]):
                lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")][:SAMPLE_LINES]
                if lines:
                    rows.append((quality, line_features(lines)[0].astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["quality", "f"])

    # at most SAMPLE_DOCS ids and labels: small whatever the tables hold
    texts = docs.select("doc_id", text_bytes("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    rows = texts.mapInPandas(run, "quality int, f binary").orderBy(F.xxhash64("f"), "f", "quality").limit(SAMPLE_DOCS).collect()
    return [(r["quality"], np.frombuffer(bytes(r["f"]), dtype=np.uint8).reshape(-1, FEATURES).astype(float)) for r in rows]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``content_share`` and ``kept`` of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(spliced(training_lines(docs, labels))))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = [measured(t.as_py(), model.value) for t in batch.column("text")]
            columns = [pa.array([r[i] for r in rows], to_arrow_type(k)) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    return docs.select("doc_id", text_bytes("text").alias("text")).mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
