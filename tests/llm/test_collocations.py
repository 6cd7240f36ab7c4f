"""Phrases against plain counting: collisions of short fingerprints, a filter that lets much through, each defined case."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tenderglow.llm import collocations
from tests.llm.brute import LOW


def wanted(rows, least, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for m in range(1, 6):
                count.update(("und" if lang is None else lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    kept = {k: a for k, a in count.items() if a >= least}
    out = {}
    for (lang, w), a in kept.items():
        inside = lambda v: any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if len(w) < 2 or any(x == lang and len(v) > len(w) and b >= a and inside(v) for (x, v), b in kept.items()):
            continue
        score, k = min((1000 * a * total[lang] // (kept[lang, w[:k]] * kept[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((" ".join(w), a, kept[lang, w[:k]], kept[lang, w[k:]], total[lang], score))
    for found in out.values():
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
    return [(lang, i + 1, *r) for lang in sorted(out) for i, r in enumerate(out[lang][:top])]


TEXTS = [
    ("en", "The big  dog\tsaw the big dog. The big dog, and a cat"), ("en", "a a a a a a a a!b b"), ("en", None), ("en", ""),
    (None, "el perro grande el perro grande"), ("und", "el perro\ngrande"), ("de", "É é É é\x0bÉ é É é " * 3), ("en", "the big " * 40),
    ("en", "big\x1cdog big\x1cdog the"), ("de", "x" * 70_000 + " y"), ("de", " .,;: \t "), ("", "the big dog the big"),
]


@pytest.mark.parametrize("bits, filter_bits", [(64, 1 << 20), (5, 1 << 20), (9, 64), (64, 64)])
def test_phrases(spark, bits, filter_bits):
    rows = TEXTS * 2 + TEXTS[:3]
    docs = spark.createDataFrame([(i, t, lang, 5, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, at string").repartition(3)
    found = [tuple(r) for r in collocations.collocations(docs, least=3, bits=bits, filter_bits=filter_bits).collect()]
    assert sorted(found) == sorted(wanted(rows, 3))


def test_top_and_empty(spark):
    docs = spark.createDataFrame([("en", "a b c a b c a b"), ("en", "c d c d")], "lang string, text string")
    found = [tuple(r) for r in collocations.collocations(docs, least=2, top=1).collect()]
    assert found == wanted([("en", "a b c a b c a b"), ("en", "c d c d")], 2, top=1)
    assert collocations.collocations(docs.where("false")).collect() == []
    assert collocations.collocations(docs).collect() == []  # nothing stands a hundred times


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 7), ("en", 2, "a b", big - 9)], "lang string, size int, phrase string, n long")
    totals = spark.createDataFrame([("en", 9 * 10 ** 15)], "lang string, n long")
    row = collocations.score_phrases(phrases, totals).collect()[0]
    assert (row.l, row.r, row.score) == (big, big - 7, 1000 * (big - 9) * 9 * 10 ** 15 // (big * (big - 7)))


def test_ranges(spark):
    """Many ranges of fingerprints; a text that stands in two languages has phrases in each."""
    rows = TEXTS * 2 + TEXTS[:3] + [("fr", t) for lang, t in TEXTS if lang == "en"] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for bits in (64, 6):
        found = [tuple(r) for r in collocations.collocations(docs, least=3, bits=bits, range_words=9).collect()]
        assert sorted(found) == sorted(wanted(rows, 3))


def test_counts_move_packed(monkeypatch):
    """Of a run that stands once a task hands on about 7 bytes (a row of two longs had 16), in parts of bounded size."""
    draw = np.random.default_rng(1)
    texts = [" ".join(map(str, draw.integers(0, 1 << 30, 2000))) for _ in range(60)] + ["a b " * 50] * 2
    batches = [pa.RecordBatch.from_pydict({"text": texts[i:i + 10], "code": pa.array([5] * len(texts[i:i + 10]), pa.int64())}) for i in range(0, len(texts), 10)]
    for held in (1 << 19, 50_000):
        monkeypatch.setattr(collocations, "HELD", held)
        dealt = list(collocations._count(2, None, 64, 3)(iter(batches)))
        count, moved = Counter(), 0
        for batch in dealt:
            moved += batch.nbytes
            for part, rows, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "packed")), strict=True):
                prints, counts = collocations._unpack(rows, packed, 2)
                assert (prints >> np.uint64(61) == part).all() and (np.diff(prints) > 0).all()
                count.update(dict(zip(prints.tolist(), counts.tolist(), strict=True)))
        assert len(dealt) == (1 if held > 200_000 else 3)
        assert len(count) == 60 * 1999 + 2 and sorted(count.values())[-2:] == [98, 100]
        assert moved < 7.5 * len(count)
