"""Operators 11 to 13 against the public library, plain versions and brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from docspark.llm import resample, variants, wordbpe

SCHEMA = "doc_id long, text string, bucket long, word string, n int, at int"
AWKWARD = [
    None, "", " \n\t ", "One word", "don't WE'LL it's", "<|endoftext|>a<|startoftext|> b <|endoftext", "ΑΣ ΣΑΣ'S İI ǅ Ⅷ ²", "é ́x Å", "x\x1cy\x1d z\u0085q　w​v",
    "日本語テスト 👍🏽 l'été 12345 !!!???", "ab" * 3000 + "!?" * 900, "q" * 20_000, "One word",
]


def _docs(spark, texts):
    return spark.createDataFrame([(k if k % 4 else None, t, 7, "x", 1, 2) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    held = tokenizers.Tokenizer.from_file(path)
    held.no_truncation()
    held.no_padding()
    return path, held


def test_wordbpe(spark, none, tokenizer):
    path, lib = tokenizer
    want = []
    for k, t in enumerate(AWKWARD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want.append((k if k % 4 else None, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in wordbpe.encode_digests(_docs(spark, AWKWARD), path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    full = wordbpe.encode(_docs(spark, ["Hello, world"]), path, keep=("at", "doc_id")).first()
    assert bytes(full.ids) == struct.pack("<3I", *lib.encode("Hello, world", add_special_tokens=False).ids) and bytes(full.decoded) == b"hello</w> ,</w> world</w>" and full["at"] == 2
    assert wordbpe.encode_digests(none, path).count() == 0


def test_wordbpe_of_random_texts(tokenizer, monkeypatch):
    path, lib = tokenizer
    coder = wordbpe.Coder(**wordbpe.read_tokenizer(path))
    monkeypatch.setattr(wordbpe, "CACHE_SIZE", 500)  # what is remembered is forgotten over and over
    r = random.Random(3)
    for alphabet in ("abcdefgh'slé èß\n", "thinger 's've", "ΑΣσς ÅΏ̧１２ⅣẞΣ\t<|>日👍\x1c", "aAbB1!?-'"):
        for _ in range(700):
            text = "".join(r.choices(alphabet, k=r.randint(0, 40)))
            assert list(memoryview(coder.encode(text)).cast("I")) == lib.encode(text, add_special_tokens=False).ids
    # both ways of merging, and fragments that forced boundaries part
    for _ in range(300):
        word = "".join(r.choices("aeinrst", k=r.randint(1, 12))).encode() + b"\xff"
        ids = [*[coder.first[b] for b in word[:-2]], coder.last[word[-2]]]
        assert list(memoryview(coder.merge(word)).cast("I")) == coder._merge_long(ids)
    cut = coder.cuts("qzxjqzxj".encode())
    assert len(cut) > 1 and b"".join(cut) == b"qzxjqzxj\xff"


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _grouped(counts):
    """``{word: (form, root, n, n_near, form_n)}`` by comparing every word with every other."""
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and _near(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (form, n, len(near), counts.get(form))
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w] = (out[w][0], end, *out[w][1:])
    return out


def test_variants_by_brute_force(spark):
    r = random.Random(4)
    words = {}
    for length in (6, 7, 8, 9, 10):
        for _ in range(220):
            # few letters and long runs: errors at the borders of zones, and many near words
            words["".join(r.choices("aé", weights=[3, 1], k=length)) if r.random() < 0.5 else "".join(r.choices("abcÿ", k=length))] = r.choice([5, 5, 6, 30, 31, 200, 5000])
    long = "".join(r.choices("abc", k=3000))
    words |= {long: 900, long[:1500] + long[1501:]: 40, long[:-1]: 8, "z" + long: 7, long[:7] + "zz" + long[7:]: 6, "aaaaaa": 5}
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == _grouped(words)
    assert max(x[2] for x in got.values()) > 6 and sum(x[0] is not None and x[1] != x[0] for x in got.values()) > 20


def test_variants_of_texts(spark, none):
    texts = ["Longest words: LONGEST wordsworth,lôngest", None, "", "longes longest " * 40, "Éclair éclair ×÷abcdef", "longest " * 300, "a" * 2000, "longes " * 9, "longest " * 300]
    docs = _docs(spark, texts * 6)
    counts = Counter()
    for k, t in enumerate(texts * 6):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k if k % 4 else ''}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in variants.grouped(variants.counted(docs)).collect()}
    assert got == _grouped(counts) and len(counts) > 3
    assert variants.grouped(variants.counted(none)).count() == 0


WORDS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _features(text, order):
    words = re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[k : k + n]) for n in range(1, order + 1) for k in range(len(words) - n + 1)], len(words)


@pytest.mark.parametrize("order", [1, 3])
def test_resample(spark, none, order):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé日X7", k=r.choice([1, 2, 3, 5, 70 if r.random() < 0.1 else 4])))
    texts = [None, "", "!?", "One-word's", *[r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.choice([3, 19, 20, 21, 60]))) for _ in range(90)], "y" * 9000 + " " + "z" * 70, "same text " * 15, "same text " * 15]
    goal = [*[" ".join(word() for _ in range(30)) for _ in range(6)], None, ""]
    s, t = Counter(), Counter()
    for side, held in ((s, texts), (t, goal)):
        for x in held:
            side.update(zlib.crc32(f.encode()) % 50 for f in _features(x, order)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    rows = []
    for k, x in enumerate(texts):
        key = k if k % 4 else None
        found, n_words = _features(x, order)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % 50] for f in found)
        rows.append([key, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    drawn = len(able) * 30 // 100
    want = [(*x, able.index(x) + 1 if x in able[:drawn] else None) for x in rows]
    docs = _docs(spark, texts)
    got = [tuple(x) for x in resample.resampled(docs, spark.createDataFrame([(x,) for x in goal], "text string"), order=order, buckets=50, percent=30).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and drawn > 10
    assert resample.resampled(none, docs).count() == 0
    assert resample.resampled(docs, none).count() == len(texts)


def test_shifted_crc():
    """The CRC of every stretch of a text comes from the CRCs of two prefixes, however long the stretch."""
    import numpy as np

    raw = random.Random(6).randbytes(3000)
    prefix = np.array([zlib.crc32(raw[:k]) for k in range(len(raw) + 1)], dtype=np.uint32)
    starts, stops = np.array([0, 5, 0, 17, 1, 700, 2999]), np.array([0, 6, 63, 81, 2000, 764, 3000])
    got = prefix[stops] ^ resample.Shifts()(prefix[starts], stops - starts)
    assert got.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, stops)]
