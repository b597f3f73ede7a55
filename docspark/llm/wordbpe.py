"""Operator 11: BPE with word ends, texts cut at forced boundaries.

A byte pair that stands inside no token of the vocabulary can never be merged, so
every such pair in a word is a certain cut: the fragments on both sides are
encoded alone, and their ids are concatenated.  The last byte of a word counts as
a symbol of its own, as it carries the mark of the word's end.

A text is cut in four steps: at the strings of the added tokens, at white space, into
the words of the file's pattern, and at forced boundaries.  None of the cuts needs
more than one row, so the plan is a scan and one narrow map, without any exchange;
a worker remembers fragments and the pieces between white space, which repeat.

Defined results: a null or empty text, and one of white space only, has no tokens;
repeated rows and null ``doc_id`` values give a row each; extra columns are ignored
unless named in ``keep``; a text without white space is one piece, encoded in
O(n log n); an empty table gives no rows.  Letters, numbers and lower case are those of
Python's Unicode tables (15.1): a character assigned since then is neither letter nor number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Characters of pieces, and their packed ids in bytes, that a worker remembers.
CACHE_SIZE = 64_000_000
#: What the file has to say of a text before its words are cut; anything else is refused.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: The end of a word, as a byte that UTF-8 never has.
END = b"\xff"
#: Fragments up to so many bytes are merged by scanning, and remembered.
SHORT = 64


def _class(held: Callable[[str], bool]) -> str:
    """The inside of a character class: the ranges of the characters for which ``held``."""
    flags = [False, *map(held, map(chr, range(sys.maxunicode + 1))), False]
    edges = [c - 1 for c in range(1, len(flags)) if flags[c] != flags[c - 1]]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


def white_space(c: str) -> bool:
    """Unicode's white space, which Python's is but for four separators."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def word_pattern(pattern: str) -> str:
    """The file's pattern with its classes spelled out for ``re``, by the Unicode tables of this Python."""
    for name, held in ((r"\p{L}", lambda c: unicodedata.category(c)[0] == "L"), (r"\p{N}", lambda c: unicodedata.category(c)[0] == "N"), (r"\s", white_space)):
        pattern = pattern.replace(name, _class(held))
    return pattern


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def read_tokenizer(path: str) -> dict:
    """Vocabulary, merges, added tokens and word pattern of a tokenizer file of this kind."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held["pre_tokenizer"]["pretokenizers"]
    if [n["type"] for n in held["normalizer"]["normalizers"]] != NORMALIZERS or [p["type"] for p in before] != ["Split", "ByteLevel"] or held["decoder"] is not None:
        raise ValueError(f"{path}: not a tokenizer of words in lower case")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    added = {t["content"]: t["id"] for t in held["added_tokens"]}
    return {"vocabulary": model["vocab"], "merges": merges, "added": added, "end": model["end_of_word_suffix"], "pattern": word_pattern(before[0]["pattern"]["Regex"])}


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int], end: str, pattern: str):
        letters = byte_letters()
        symbol = {c: b for b, c in enumerate(letters)}
        self.first, self.last = [vocabulary[c] for c in letters], [vocabulary[c + end] for c in letters]
        #: by byte and next byte, whether some token holds that pair: inside a word, and at a word's end
        self.inside, self.ending = [bytearray(256) for _ in letters], [bytearray(256) for _ in letters]
        for token in vocabulary:
            at = [symbol[c] for c in token.removesuffix(end)]
            for k in range(1, len(at)):
                (self.ending if k == len(at) - 1 and token.endswith(end) else self.inside)[at[k - 1]][at[k]] = 1
        self.ranks = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocabulary[a + b] for a, b in merges]
        self.words = re.compile(pattern).findall
        self.added = added
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pieces = {i: t.encode() for t, i in (vocabulary | added).items()}
        self.odd_space, self.spaces = re.compile("[\x1c-\x1f]").search, re.compile(f"[^{_class(white_space)}]+").findall
        self.fragments: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a word between forced boundaries; the last one carries ``END``."""
        inside, n = self.inside, len(word) - 1
        stops = [0, *[k for k in range(1, n) if not inside[word[k - 1]][word[k]]]]
        if n and not self.ending[word[n - 1]][word[n]]:
            stops.append(n)
        word += END
        return [word[a:b] for a, b in zip(stops, [*stops[1:], len(word)])]

    def merge(self, fragment: bytes) -> bytes:
        """Packed ids of one fragment: the adjacent pair of lowest rank, leftmost first, merges until none can."""
        if fragment.endswith(END):
            ids = [*[self.first[b] for b in fragment[:-2]], self.last[fragment[-2]]]
        else:
            ids = [self.first[b] for b in fragment]
        if len(ids) > SHORT:
            ids = self._merge_long(ids)
        else:
            get, none = self.ranks.get, len(self.made)
            ranks = [get(p, none) for p in zip(ids, ids[1:])]
            while ranks and (rank := min(ranks)) < none:
                k = ranks.index(rank)
                ids[k : k + 2] = [self.made[rank]]
                del ranks[k]
                if k:
                    ranks[k - 1] = get((ids[k - 1], ids[k]), none)
                if k < len(ranks):
                    ranks[k] = get((ids[k], ids[k + 1]), none)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs, so that fragments of many thousand bytes stay at O(n log n)."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, k, pair = heapq.heappop(heap)
            right = after[k]
            if right >= n or ids[k] != pair[0] or ids[right] != pair[1]:
                continue
            ids[k], ids[right] = self.made[rank], -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
            for a, b in ((before[k], k), (k, right)):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], a, p))
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> bytes:
        """Packed ids of what stands between white space."""
        # letter by letter, so that no letter's lower case depends on the next
        low = piece.lower() if piece.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
        out = []
        for word in [low] if low.isascii() and low.isalpha() else self.words(low):
            for fragment in self.cuts(word.encode()):
                ids = self.fragments.get(fragment)
                if ids is None:
                    ids = self.merge(fragment)
                    if len(fragment) <= SHORT:
                        self.fragments[fragment] = ids
                        self.held += 5 * len(fragment)
                out.append(ids)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without added tokens."""
        pieces = self.spaces(text) if self.odd_space(text) else text.split()
        try:
            return b"".join([self.known[p] for p in pieces])
        except KeyError:
            if self.held > CACHE_SIZE:
                self.known, self.fragments, self.held = {}, {}, 0
            for p in set(pieces).difference(self.known):
                self.known[p] = self.piece(p)
                self.held += 5 * len(p)
            return b"".join([self.known[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """Ids packed as little-endian unsigned 32-bit integers; the strings of added tokens are those tokens."""
        if not text:
            return b""
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        return b"".join([self.added[t].to_bytes(4, "little") if t in self.added else self.plain(t) for t in self.marks.split(text)])

    def decode(self, packed: bytes) -> bytes:
        """The tokens as they stand in the vocabulary, separated by spaces: what a file without a decoder asks for."""
        return b" ".join(map(self.pieces.__getitem__, memoryview(packed).cast("I")))


#: The coder of this worker, with the key of its tokenizer: what it remembers serves the tasks that follow.
_CODER: dict[str, Coder] = {}


def _coder(key: str, tokenizer: dict) -> Coder:
    if key not in _CODER:
        _CODER.clear()
        _CODER[key] = Coder(**tokenizer)
    return _CODER[key]


def _coded(docs: DataFrame, path: str, keep: tuple[str, ...], made: list[T.StructField], of: Callable[[Coder, bytes], tuple]) -> DataFrame:
    """``keep`` and what ``of`` makes of the ids of each row.

    The tokenizer is a fixed file, read once on the driver and sent as a broadcast
    variable of known size; it does not grow with the corpus.
    """
    tokenizer = read_tokenizer(path)
    key = hashlib.sha256(json.dumps(tokenizer).encode()).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)
    schema = T.StructType([docs.schema[k] for k in keep] + made)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder, kinds = _coder(key, shipped.value), [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in made]
        for batch in batches:
            rows = [of(coder, coder.encode(t.as_py())) for t in batch.column(len(keep))]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], *columns], names=schema.names)

    # kept columns stay in their Arrow arrays, so no id passes through a float beside a null
    return docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("__text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (packed token ids) and ``decoded`` (UTF-8) of each row of ``docs``."""
    made = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return _coded(docs, path, keep, made, lambda coder, ids: (ids, coder.decode(ids)))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, taken where the ids are made, so that these do not travel."""
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _coded(docs, path, ("doc_id",), made, lambda coder, ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))


def op11_wordbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
