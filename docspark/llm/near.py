"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash (operator 4, on five-word shingles) brings together the texts whose fingerprints hang
together by ``simhash.BITS`` bits or fewer; each is verified on its exact sets against the least of them.
Pairs at the bound differ in 10 of 64 bits, so most are out of its reach: MinHash bands bring
together what is still apart, and every candidate is verified alike.  A pair at the bound shares none of ``BANDS`` bands of ``ROWS`` hashes with a chance of
``(1 - 0.8 ** 5) ** 30``, under 1 in 100,000, more similar ones less.

At scale
  * Equal texts are one node; the nodes of a band that SimHash has left apart first meet its least one.  After these links are
    closed to components, the nodes outside the largest component of a band meet a few heads of it,
    then more, and at last all nodes of other components; so a family of copies is not paired
    in full and no link between groups is lost.
  * Texts whose sets differ too much in size or in their parity bits to be similar, or agree in too few
    of their least hashes, are told apart before their sets travel; a text's shingles are hashed once, not for each pair.

Defined results: of each component the row with the least ``doc_id`` stays, null ones
last, of equal ids one text; texts without words are alike; words are lower case in ASCII.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docspark.llm import simhash
from docspark.llm.common import settle, small_batches, text_bytes
from docspark.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
#: Bits of each least hash that are kept, and longs that a bit of all of them takes.
PLANES, PLANE_LONGS = 4, -(-BANDS * ROWS // 64)
#: Least hashes that must agree in these bits before texts are compared: of a pair at the bound 122 of 150 do, and fewer than
#: this with a chance under 1 in 50,000.
AGREEING = 101
#: Longs of the parity bits of a set: shingles are dealt to them, and a bit tells whether it got an odd number.
PARITY_LONGS = 16
#: Columns of a text's sketch: bits of least hashes, then parity bits.
SKETCH = [*[f"m{k}" for k in range(PLANES * PLANE_LONGS)], *[f"q{k}" for k in range(PARITY_LONGS)]]
#: Heads of a band in each round, before all that is still apart is compared.
HEADS = (16,)
#: Nodes outside its largest component that a band compares in one task, of as many nodes in all.
SHARE_NODES = 20_000
#: Rows that a task sends to Python at a time: texts and sets of shingles are large.
BATCH_ROWS = 1000


def grams(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's shingles; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    parts = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) > SHINGLE else [b" ".join(words)]
    return np.unique(np.array([xxh64_intdigest(g) for g in parts], dtype=np.uint64))


def bands(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of a text's bands, and ``PLANES`` bits of each of its least hashes, a plane of bits after another."""
    r = np.random.default_rng(1)
    factors, offsets = (r.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    least = np.array([(own * (f | np.uint64(1)) + o).min() for f, o in zip(factors, offsets)], dtype=np.uint64).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    bits = np.zeros((PLANES, 64 * PLANE_LONGS), dtype=np.uint8)
    bits[:, : BANDS * ROWS] = least.ravel() >> np.arange(PLANES, dtype=np.uint64)[:, None] & np.uint64(1)
    return out.view(np.int64), np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def parities(own: np.ndarray) -> np.ndarray:
    """Parity bits of a set of hashes; those in which two sets differ are no more than the shingles that only one of them has."""
    counts = np.bincount((own >> np.uint64(20) & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _agreeing(x: str, y: str) -> Column:
    """How many of the least hashes of two texts agree in their bits."""
    differ = lambda k: functools.reduce(Column.bitwiseOR, [F.col(f"{x}m{k + p * PLANE_LONGS}").bitwiseXOR(F.col(f"{y}m{k + p * PLANE_LONGS}")) for p in range(PLANES)])
    return F.lit(BANDS * ROWS) - sum((F.bit_count(differ(k)) for k in range(PLANE_LONGS)), F.lit(0))


def _alike(x: str, y: str) -> Column:
    """Whether sets of two sizes can be similar enough at all."""
    return F.least(x, y) >= F.greatest(x, y) * SIMILARITY


def _may_be_similar(x: str, y: str) -> Column:
    """Whether two texts are not told apart by their sketches: by size and parity bits never wrongly, by least hashes hardly ever.

    ``x`` and ``y`` are what stands before the names of their columns.
    """
    # at the bound the sets differ in a fifth of their union, which is a ninth of both sizes together
    odd = sum((F.bit_count(F.col(f"{x}q{k}").bitwiseXOR(F.col(f"{y}q{k}"))) for k in range(PARITY_LONGS)), F.lit(0))
    few = odd * (1 + SIMILARITY) <= (F.col(f"{x}size") + F.col(f"{y}size")) * (1 - SIMILARITY) + 1e-6
    return _alike(f"{x}size", f"{y}size") & (_agreeing(x, y) >= AGREEING) & few


def _sketches(texts: DataFrame) -> DataFrame:
    """``(node, size, bands, planes, parities)`` of each text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, keys, planes, odd = [], [], [], []
            for t in batch.column("text"):
                own = grams(t.as_py())
                sizes.append(len(own))
                odd.append(parities(own))
                for held, new in zip((keys, planes), bands(own)):
                    held.append(new)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int32()), pa.array(keys, lists), pa.array(planes, lists), pa.array(odd, lists)], names=["node", "size", "bands", "planes", "parities"])

    return texts.mapInArrow(run, "node long, size int, bands array<long>, planes array<long>, parities array<long>")


def _shingled(texts: DataFrame) -> DataFrame:
    """``(node, grams)``: the sorted hashes of each text's shingles in bytes, made once, however many texts it is compared with."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [grams(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node long, grams binary")


def _verified(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` that are similar enough."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda node, name: shingled.select(F.col("node").alias(node), F.col("grams").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _mixed(met: DataFrame, links: DataFrame, sketched: DataFrame) -> DataFrame:
    """The nodes of the bands whose nodes are not one component yet, with their ``root``, the root that is ``largest`` in the band and ``n`` nodes of it."""
    roots = settle(components(links), "roots")
    named = met.select("band", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    held = F.concat("planes", "parities")
    sketch = sketched.select("node", "bands", *[held[k].alias(c) for k, c in enumerate(SKETCH)])
    return settle(named.join(sizes.filter("roots > 1").drop("roots"), "band").join(sketch, "node"), "open_bands")


def _with_heads(named: DataFrame, heads: int) -> DataFrame:
    """Pairs ``(a, b)`` to compare: the nodes outside the largest component of their band with ``heads`` nodes of the band at most."""
    dealt = F.pmod(F.xxhash64("node", F.lit(heads)), F.lit(heads))
    # the order of heads is the same in all bands, so a pair of them is mostly one pair
    chosen = named.groupBy("band", dealt.alias("share")).agg(F.min(F.struct(F.xxhash64("node").alias("order"), "node", "size", "root", *SKETCH)).alias("head")).drop("share")
    met = named.filter("root <> largest").join(chosen, "band").filter((F.col("root") != F.col("head.root")) & _may_be_similar("", "head."))
    return met.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def _with_all(named: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different components, each in the least band that both have.

    Of two components of a band one at least is not its largest; so the nodes outside the largest meet all
    others, and a large band is cut into shares of them, each of which meets the whole band in a task of its own.
    """
    shares = F.ceil(F.col("n") / SHARE_NODES).cast("int")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "root", "bands", *SKETCH)]
    outside = named.filter("root <> largest").select("band", F.pmod(F.xxhash64("node"), shares).cast("int").alias("share"), *side("x"))
    every = named.select("band", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "largest", *side("y"))
    once = (F.col("y_root") == F.col("largest")) | (F.col("x_node") < F.col("y_node"))
    least = F.array_min(F.array_intersect("x_bands", "y_bands")) == F.col("band")
    met = outside.join(every, ["band", "share"]).filter((F.col("x_root") != F.col("y_root")) & once & _may_be_similar("x_", "y_") & least)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def by_simhash(docs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of texts to compare: each with the least one that its fingerprint hangs together with."""
    named = simhash.near_duplicates(docs.select(text_node().alias("doc_id"), "text"), SHINGLE)
    return named.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    named = rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left")
    return named.withColumn(root, F.coalesce(root, node))


def links(docs: DataFrame) -> DataFrame:
    """Verified pairs ``(a, b)`` of texts, of which all components of similar texts follow."""
    texts = docs.select(text_node().alias("node"), text_bytes("text").alias("text"))
    first = settle(by_simhash(docs), "simhash_pairs")
    sketched = settle(_sketches(texts), "sketches").dropDuplicates(["node"])
    band = settle(sketched.select("node", "size", F.explode("bands").alias("band")), "bands")
    often = band.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("head")).filter("n > 1")
    met = settle(band.join(often.select("band", "head"), "band"), "met")
    named = met.select("node").unionByName(first.select(F.col("a").alias("node"))).unionByName(first.select(F.col("b").alias("node"))).distinct()
    single = texts.join(named, "node").groupBy("node").agg(F.min("text").alias("text"))
    single = settle(_shingled(single), "near_shingles")
    found = settle(_verified(first, single), "links")
    roots = settle(components(found), "roots")
    tried = met.filter(_alike("size", "head.size")).select(F.col("head.node").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    apart = _rooted(_rooted(tried, roots, "a", "root_a"), roots, "b", "root_b").filter("root_a <> root_b").select("a", "b")
    tried = settle(apart.join(first, ["a", "b"], "left_anti"), "tried")
    found = found.unionByName(settle(_verified(tried, single), "links"))
    tried = tried.unionByName(first)
    for heads in (*HEADS, None):
        # bands whose nodes are one component have nothing left to try
        named = _mixed(met, found, sketched)
        if named.isEmpty():
            break
        pairs = settle((_with_heads(named, heads) if heads else _with_all(named)).join(tried, ["a", "b"], "left_anti"), "tried")
        found = found.unionByName(settle(_verified(pairs, single), "more_links"))
        tried = tried.unionByName(pairs)
    return found


def kept(docs: DataFrame) -> DataFrame:
    """``(doc_id, node)`` of the row that stays of each group; ``node`` is ``text_node`` of its text."""
    rows = docs.select("doc_id", text_node().alias("node"))
    with small_batches(docs.sparkSession, BATCH_ROWS):
        roots = settle(components(links(docs)), "roots")
    grouped = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node")).alias("least"))
    return least.select("least.doc_id", "least.node")


def text_node():
    return F.xxhash64(text_bytes("text"), F.octet_length(text_bytes("text")))
