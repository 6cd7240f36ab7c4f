"""Links of vectors against all cosines, with tiles of a few rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tenderglow.llm import embedding_pairs


def wanted(rows, least):
    """Rows are (vec_id, vector, label); links of ids, all pairs in double precision."""
    ok = []
    for i, v, label in rows:
        good = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if good and (i, v, label) not in ok:
            ok.append((i, v, label))
    links, near = [0] * len(ok), {}
    for p, (i, v, a) in enumerate(ok):
        for q, (j, w, b) in enumerate(ok):
            if p != q and a == b and len(v) == len(w) and embedding_pairs.cosine(np.array([v]), np.array([w]))[0] >= least:
                links[p] += 1
                near.setdefault(i, set()).add(j)
    low = {i: i for i, _, _ in ok}
    for _ in ok:
        low = {i: min([low[i], *(low[j] for j in near.get(i, ()))]) for i in low}
    return [(i, links[ok.index((i, v, a))] if (i, v, a) in ok else 0, low.get(i, i)) for i, v, a in rows]


def made(dims=24, seed=5):
    draw = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 1, 1, 2):
        centre = draw.normal(size=dims)
        for spread in (0.02, 0.15, 0.22, 0.5):
            rows += [[float(x) for x in centre + draw.normal(size=dims) * spread] for _ in range(12)]
        rows += [rows[-1], [2 * x for x in rows[-1]], [-x for x in rows[-2]]]
    labelled = [(i * 7 % 991, [float(np.float32(x)) for x in v], (0, 1, 1, 1, 2)[i // 51]) for i, v in enumerate(rows)]
    return [*labelled, (2000, None, 1), (2001, [], 1), (2002, [0.0] * dims, 1), (2003, [None] * dims, 1), (2004, [math.nan] * dims, 1),
            (2005, [math.inf] + [1.0] * (dims - 1), 1), (2006, labelled[0][1], None), (None, labelled[0][1], 0), labelled[60], labelled[60],
            (2007, labelled[60][1], 1), (2008, labelled[60][1][:5], 1), (2009, labelled[60][1][:5], 1), (2010, [1e300] * dims, 2), (2011, [1e-300] * dims, 2),
            (2012, [1.0], 2), (2013, [0.5], 2), (2014, [-0.0, 1.0], 2), (2015, [0.0, 1.0], 2)]


@pytest.mark.parametrize("rows, most, rotation", [(20, 8 << 20, 64 << 20), (4096, 8 << 20, 0), (64, 8 << 20, 64 << 20)])
def test_links(spark, monkeypatch, rows, most, rotation):
    monkeypatch.setattr(embedding_pairs, "LEAST_ROWS", 8)
    monkeypatch.setattr(embedding_pairs, "ROTATION_BYTES", rotation)
    monkeypatch.setattr(embedding_pairs, "STRIP", 16)
    given = made()
    vectors = spark.createDataFrame([(*r, "x", 3) for r in given], "vec_id long, embedding array<double>, label int, key string, node long").repartition(3)
    for least in (0.98, 0.9):
        found = embedding_pairs.find_links(vectors, least, most, rows).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted(given, least)))
        assert len({r.component_id for r in found}) < len(found)


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_pairs.digest(embedding_pairs.find_links(empty)).collect() == []


def test_bound_gives_up_most_pairs_early():
    draw = np.random.default_rng(3)
    axes = np.linalg.qr(draw.normal(size=(64, 64)))[0]
    given = (draw.normal(size=(400, 64)) * np.geomspace(8, 0.1, 64)) @ axes
    moments = embedding_pairs.unit(given).T @ embedding_pairs.unit(given)
    turned = embedding_pairs.unit(given) @ np.linalg.eigh(moments)[1][:, ::-1]
    rest = np.sqrt((turned[:, 8:] ** 2).sum(axis=1))
    reach = turned[:, :8] @ turned[:, :8].T + np.outer(rest, rest) >= 0.98
    assert np.count_nonzero(reach) < 0.1 * reach.size
