"""Operators that learn: exact where a small model can be followed by hand, else by held-out accuracy."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tenderglow.llm import byte_bpe, lm_score, near_dup, quality_pu, quality_rules, tokens, toxicity
from tests.llm import brute
from tests.llm.conftest import prose

GIVEN = Path("/root/testdata/sf0.01")


def ppm(train: list[str], text: str) -> float:
    """PPM, method C, full exclusion, one byte after the other."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in train:
        data = b"\0" * lm_score.ORDER + t.lower().encode() + b"\0"
        for i in range(lm_score.ORDER, len(data)):
            for n in range(lm_score.ORDER + 1):
                at = counts.setdefault(data[i - n:i], {})
                at[data[i]] = at.get(data[i], 0) + 1
    total = 0.0
    data = b"\0" * lm_score.ORDER + text.lower().encode() + b"\0"
    for i in range(lm_score.ORDER, len(data)):
        chance, out = 1.0, set()
        for n in range(lm_score.ORDER, -1, -1):
            seen = {s: c for s, c in counts.get(data[i - n:i], {}).items() if s not in out}
            if not seen:
                continue
            size = sum(seen.values()) + len(seen)
            if data[i] in seen:
                chance *= seen[data[i]] / size
                break
            chance *= len(seen) / size
            out |= set(seen)
        else:
            chance /= 256 - len(out)
        total += math.log10(chance)
    return total


def test_ppm_against_a_byte_by_byte_model(spark):
    texts = [(i, prose(i, 12) + " été") for i in range(12)] + [(50, ""), (51, None), (52, "Zebra quiz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    train = [t or "" for i, t in texts if brute.fold(i, 5) != 1]
    got = {r.doc_id: r.score for r in lm_score.score_texts(docs).collect()}
    for i, t in texts:
        assert got[i] == pytest.approx(ppm(train, t or ""), rel=1e-5)


@pytest.mark.parametrize("head", [0, 500, lm_score.GRAMS])
def test_ppm_keeps_more_contexts_than_are_sent(spark, head):
    """40,000 contexts were kept once, whatever the input; a text of random letters has more."""
    draw = random.Random(5)
    texts = [(i, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(6000))) for i in range(8)]
    texts += [(20 + i, t[3000:3400] + "é") for i, t in texts] + [(51, None), (52, "Zebra quiz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    train = [t or "" for i, t in texts if brute.fold(i, 5) != 1]
    assert len({t[p:p + 5] for t in train for p in range(len(t) - 4)}) > 30_000 and len(train) < len(texts)
    got = {r.doc_id: r.score for r in lm_score.score_texts(docs, grams=head).collect()}
    for i, t in texts:
        assert got[i] == pytest.approx(ppm(train, t or ""), rel=1e-5)


def test_pruned_trie_still_gives_chances_of_all_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 103, 4000)
    rows = {}
    for i in range(5, len(data)):
        for n in range(3):
            key = n, int(sum(int(data[i - k]) << 8 * (k - 1) for k in range(1, n + 1))), int(data[i])
            rows[key] = rows.get(key, 0) + 1
    size, context, symbol = (np.array(x) for x in zip(*rows, strict=True))
    trie = lm_score.Trie(size, context, symbol, np.array(list(rows.values())))
    assert np.allclose((10.0 ** trie.log.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_pairs_at_the_limit_meet_at_the_last_level():
    """Nodes of any size go to DEPTH; 14 trees of 12 levels missed more than one pair of a hundred."""
    rng = np.random.default_rng(2)
    pairs, part = 4000, 0.25
    one, other = (rng.integers(0, 1 << 32, (pairs, near_dup.SKETCH), dtype=np.uint32) for _ in range(2))
    other = np.where(rng.random(one.shape) < 0.8, one, other)
    apart = np.ones(pairs, bool)
    for seed in tokens.mix(np.arange(1, near_dup.trees_for(0.99999, 0.8) + 1, dtype=np.uint64)):
        found = []
        for sketches in (one, other):
            row, node = np.arange(pairs), np.full(pairs, seed)
            for level in range(near_dup.DEPTH):
                keep, node = near_dup._branch(node, sketches[row], level, part)
                row = row[keep]
            found.append(set(zip(row.tolist(), node.tolist(), strict=True)))
        apart[[i for i, _ in found[0] & found[1]]] = False
    assert apart.sum() <= 1


def test_upper_bound_is_exact():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01, rel=1e-6)
    p = quality_rules.upper_bound(3, 50, 0.01)
    assert sum(math.comb(50, k) * p ** k * (1 - p) ** (50 - k) for k in range(4)) == pytest.approx(0.01, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.1) == 1.0 and quality_rules.upper_bound(0, 0, 0.1) == 1.0


def test_cutoffs_keep_their_promise(spark):
    good = [(i, prose(i, 60 + i % 50)) for i in range(2000)]
    bad = [(5000 + i, "\n".join([prose(i, 20)] * 2) + " ###" * 60 + " " + prose(i + 9, 60)) for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    ruled = quality_rules.apply_rules(docs, labels)
    kept = {r.doc_id: r.kept for r in ruled.collect()}
    assert sum(not kept[i] for i, _ in good) <= 0.06 * len(good)
    assert not any(kept[i] for i, _ in bad)
    none = quality_rules.apply_rules(docs, labels.limit(0))
    assert none.where("NOT kept AND NOT base_failed").isEmpty()


@pytest.mark.skipif(not GIVEN.exists(), reason="given tables not present")
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_pu.score_quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in scored)
    assert right >= 0.95 * len(scored)
    assert all(0 <= r.score <= 1 for r in scored)


def test_quality_edges(spark, docs, empty, labels):
    assert quality_pu.score_quality(empty, labels).collect() == []
    none = labels.limit(0)
    assert quality_pu.score_quality(docs, none).where("predicted = 0").isEmpty()
    left = quality_pu.drop_rejected(docs, none)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert quality_pu.score_quality(docs, labels).count() == docs.count()


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_of_a_made_mixture(prior):
    """Positives around 2, negatives around -2: the tails tell the share of positives among all."""
    draw = np.random.default_rng(3)
    texts = np.where(draw.random(100_000) < prior, draw.normal(2, 1, 100_000), draw.normal(-2, 1, 100_000))
    counts = np.bincount(quality_pu._bin(texts), minlength=quality_pu.BINS)
    assert quality_pu.estimate_prior(draw.normal(2, 1, 3000), counts) == pytest.approx(prior, abs=0.03)
    assert quality_pu.estimate_prior(np.zeros(0), counts) == 0.5


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_slopes_of_the_non_negative_risk(shift):
    """Slopes against differences, above zero and where the negatives' estimate falls below it (there: a step back)."""
    draw = np.random.default_rng(4)
    p, u = draw.normal(0.5 - shift, 1, (40, 3)), draw.normal(0, 1, (90, 3))
    model = quality_pu.PuNetwork(np.zeros(3), np.ones(3))
    model.parts[2] = model.parts[2] + 2
    if shift:
        model.parts[0] = np.abs(model.parts[0])

    def parts() -> tuple[float, float]:
        fp, fu = model.value(p), model.value(u)
        return 0.6 * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - 0.6 * np.logaddexp(0, fp).mean()

    good, bad, slopes = model.risk(model._scaled(p), model.as_negative(model._scaled(u)), len(u), 0.6)
    assert (good, bad) == pytest.approx(parts()) and (bad < 0) == (shift < 0)
    for part, slope in zip(model.parts, slopes, strict=True):
        for at in np.ndindex(part.shape):
            was, ends = part[at], []
            for step in (1e-5, -1e-5):
                part[at] = was + step
                ends.append(sum(parts()) if bad >= 0 else -parts()[1])
            part[at] = was
            assert slope[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_risk_is_added_up_over_all_rows(spark):
    """Sums by tasks equal those over one array; moments too."""
    draw = np.random.default_rng(5)
    x = draw.normal(1, 2, (500, quality_pu._MEASURES)).astype(np.float32)
    rows = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "doc_id long, text_hash long, x array<float>").repartition(5)
    mean, scale = quality_pu._moments(rows)
    assert mean == pytest.approx(x.mean(axis=0), abs=1e-4) and scale == pytest.approx(x.std(axis=0) + 1e-3, abs=1e-4)
    model = quality_pu.PuNetwork(mean, scale)
    loss, slopes = quality_pu.unlabelled_loss(rows, model)
    wanted = model.as_negative(model._scaled(x.astype(np.float64)))
    assert loss == pytest.approx(wanted[0])
    for a, b in zip(slopes, wanted[1], strict=True):
        assert a == pytest.approx(b)
    counts, sums = quality_pu.binned(rows, model)
    assert counts.sum() == 500 and sums.sum() == pytest.approx(model.value(x.astype(np.float64)).sum())


def test_measures_of_empty_and_odd_texts():
    rows = quality_pu.measures(pa.array(["", None, " ", "a", "é" * 5000, "x " * 9000, "A B\nA B\n"]))
    assert rows.shape == (7, quality_pu._MEASURES) and np.isfinite(rows).all()


@pytest.fixture(scope="module")
def toxic_model():
    draw = random.Random(3)
    bad = ["idiot", "scumbag", "moron"]
    sample = []
    for i in range(600):
        words = prose(i, 60).split()
        if i % 3 == 0:
            words.insert(draw.randrange(60), draw.choice(bad))
        sample.append((" ".join(words), int(i % 3 == 0)))
    return toxicity.train(sample)


def test_toxic_words_and_their_misspellings(toxic_model):
    bias = float(toxic_model.bias[1] - toxic_model.bias[0])
    slope, offset = toxic_model.curve

    def score(texts):
        odds = toxicity.text_odds(toxic_model.table(), bias, pa.array(texts))
        return slope * odds + offset > 0

    frame = prose(999, 40) + " {} " + prose(998, 2000)
    assert score([frame.format(w) for w in ("idiot", "IDIOT!", "\"moron\",", "scumbags", "idiiot", "scumbg", "morron")]).all()
    clean = score([prose(10_000 + i, 300) for i in range(200)] + ["", None, "...", "a"])
    assert clean.mean() <= 0.02 and not clean[-4:].any()
    # Words that no training text has: other languages and alphabets, single letters, few letters.
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert not score(["yes", "the cat", "hello world", "привет мир как дела", "日本語 テスト", "zażółć gęślą jaźń", "straßenbahn übermäßig", *letters]).any()
    assert score([a + b for a in letters for b in letters]).mean() < 0.15  # some begin or end like a toxic word


def test_toxicity_edges(spark, docs, empty, labels):
    assert toxicity.score_toxicity(empty, labels).collect() == []
    none = toxicity.score_toxicity(docs, labels.limit(0))
    assert none.where("score > 0").isEmpty() and none.count() == docs.count()


def test_hashes_do_not_depend_on_the_batch():
    texts = ["One two\tthree", "", "two", "é two  " * 3, "z" * (3 << 20) + " two"]
    whole = [g.hashes[g.of(i)] for g in tokens.groups(pa.array(texts), True) for i in range(g.last - g.first)]
    alone = [next(tokens.groups(pa.array([t]), True)).hashes for t in texts]
    assert all((a == b).all() for a, b in zip(whole, alone, strict=True))
    assert len({int(whole[i][j]) for i, j in ((0, 1), (2, 0), (3, 1), (4, 1))}) == 1


def test_encoder_steps_back():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260}
    encoder = byte_bpe.ByteEncoder(ranks, r"\S+|\s+")
    import tiktoken
    known = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("abcd ") for _ in range(draw.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == known.encode_ordinary(text)


@pytest.mark.skipif(not GIVEN.exists(), reason="given tables not present")
def test_pipeline_stage_by_stage(spark):
    """Columns stay until the last stage, each stage only drops or changes what it is there for, run() chains them."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, corpus_pipeline.cut_lineage(stage(spark, seen, sf_dir))
        if name in ("pii", "byte_bpe"):
            assert seen.count() == before.count()
        else:
            assert seen.exceptAll(before).isEmpty()
        assert seen.columns[:len(columns)] == columns
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for (i, _), (_, c) in zip(rows, brute.components(rows, 5), strict=True) if i == c}
            assert {r.doc_id for r in seen.collect()} == want
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for (i, _), w in zip(rows, brute.overlaps(rows, items), strict=True) if not w[4]}
            assert {r.doc_id for r in seen.collect()} == want
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()} == {
        (r.doc_id, r.n_tokens) for r in seen.select("doc_id", "n_tokens").collect()}
