"""Many terms at once: the automaton, the joins and a plain search find the same."""

import random
import re

import pytest

from docspark.operators import glossary

TERMS = "position int, term string, translation string"


def test_automaton_against_a_plain_search():
    r = random.Random(1)
    letters = ["a", "b", "A", "é", "É", "ß", "ſ", "S", "µ", "Ω", "_", "1", " ", "  ", ".", "+", "-", "'", "\n", "日", "ı", "İ", "K"]
    for _ in range(300):
        terms = list({"".join(r.choices(letters, k=r.choice([1, 1, 2, 3, 5]))) for _ in range(r.randint(1, 30))})
        automaton = glossary.Automaton(terms)
        automaton.REMEMBERED = 3
        for _ in range(10):
            text = "".join(r.choices(letters, k=r.randint(0, 30)))
            want = [n for n, t in enumerate(terms) if re.search(rf"\b{re.escape(t)}\b", text, re.I)]
            assert automaton.search(text) == want, (terms, text)


@pytest.mark.parametrize("n", [10, 1000, 10_000])
def test_automaton_equals_the_joins(spark, monkeypatch, n):
    r = random.Random(n)
    words = ["".join(r.choices("etaoinshrd", k=r.choice([1, 2, 2, 3, 4]))) for _ in range(3000)]
    gap = lambda: r.choice([" ", " ", " ", ", ", "-", "'", ". ", "+"])
    texts = ["".join(w + gap() for w in r.choices(words, k=120)) for _ in range(150)] + ["", None]
    terms = set()
    while len(terms) < n:
        source = r.choice(texts[:-2])
        runs = re.findall(r"\w+|\W+", source)
        at = r.randrange(len(runs))
        term = "".join(runs[at : at + r.choice([1, 1, 1, 2, 3, 5])]).strip()
        terms.add(r.choice([term, term.upper(), term.title(), f"{term}x"]) or "x")
    rows = spark.createDataFrame([(k, t, t[::-1]) for k, t in enumerate(sorted(terms))], TERMS)
    chunks = spark.createDataFrame(list(enumerate(texts)), "k int, chunk_text string")
    plain = lambda found: {x.k: [(t.term, t.translation) for t in x.terms] for x in found.collect()}
    one = plain(glossary.matches(chunks, rows, ["k"]))
    assert one == plain(glossary.matches_by_word(chunks, rows, ["k"])) and sum(map(len, one.values())) > 100
    monkeypatch.setattr(glossary, "MAX_TERMS", 5)
    told = {x.k: x.terms and [(t.term, t.translation) for t in x.terms] for x in glossary.with_terms(chunks, rows, ["k"]).collect()}
    assert told == {k: one.get(k) for k in range(len(texts))}


def test_empty_glossary_and_texts(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "k int, chunk_text string")
    none = spark.createDataFrame([], TERMS)
    assert {x.k: x.terms for x in glossary.with_terms(chunks, none, ["k"]).collect()} == {1: None, 2: None, 3: None}
    assert glossary.matches(chunks.limit(0), spark.createDataFrame([(0, "a", "x")], TERMS), ["k"]).count() == 0
