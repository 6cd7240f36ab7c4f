"""A quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning needs no negatives: unlabelled text is a mixture in which a share, the class prior, is
positive. The risk on negatives is the unlabelled risk less the positives' part in it; that estimate cannot truly be below
zero, so the non-negative risk stops there, which keeps a flexible model from fitting it further down. A small network
over measures of the text is trained on this risk; labelled negatives are not used anywhere.

* The prior comes from tails: whatever ranks the texts, the share of all texts above a cut is at least the prior times
  the share of positives above it. A first network ranks them, and the cut with the least upper bound gives the prior.
  Positives it was fitted on do not take part in that.
* Trusted positives are a bounded sample of labelled rows. Unlabelled text is all of it: means and deviations, the tails,
  each step of the descent on the risk and the curve are aggregates over every row. Only the start of the descent comes
  from a bounded sample.
* The curve from value to score minimises the positive-unlabelled risk too, which is convex in its two parameters.

Defined cases: a null or empty text is measured like any other; a null ``doc_id`` is scored but never learned from;
repeated rows are scored each; contradicting labels of an id count as the better one; without positives every score is 1
(with one alone the prior is taken as one half), so nothing is thrown away; an empty table gives an empty table; columns other than the text are no input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import tokens
from tenderglow.llm.common import by_row, in_fold, text_session, texts
from tenderglow.llm.quality_rules import _per_document, _table, repeated_words
from tenderglow.session import cut_lineage

#: Bounds of the samples: trusted positives, and unlabelled rows that the descent starts from.
LABELLED, START = 4_000, 8_000
#: Steps of the descent over all rows.
STEPS = 20
HIDDEN = 16
#: Values are counted in this many bins of one width; the outermost hold what lies beyond.
BINS, BIN = 2_000, 0.02
ACCEPT = 0.7

_CLASSES = [_table(x) for x in (
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!", b"#*$%&<>", b"|", b".", b",", b"\n", b"@/:=_+",
    b"\"'()[]{}-;?\\~^`", bytes(range(192, 256)))]
_MEASURES = len(_CLASSES) + 15


def measures(column: pa.Array) -> np.ndarray:
    """A row of measures per text: shares of kinds of characters, words and lines, repetition, and lengths."""
    out = []
    for group in tokens.groups(column, lower=False, most=1 << 20):
        places, bounds, docs = group.offsets, group.bounds, group.last - group.first
        size = np.maximum(np.diff(places), 1)
        words = np.diff(bounds)
        some = np.maximum(words, 1)
        length = (group.end - group.start).astype(np.float64)
        doc = group.doc
        values = [_per_document(t[group.data], places) / size for t in _CLASSES]
        mean = np.bincount(doc, weights=length, minlength=docs) / some
        square = np.bincount(doc, weights=length ** 2, minlength=docs) / some
        first, last = group.data[group.start], group.data[np.maximum(group.end - 1, 0)]
        capital = _CLASSES[0][first]
        shout = capital & _CLASSES[0][group.data[np.minimum(group.start + 1, len(group.data) - 1)]] & (length > 2) if len(first) else capital
        same = np.zeros(len(doc), bool)
        if len(doc) > 1:
            same[1:] = (group.hashes[1:] == group.hashes[:-1]) & (doc[1:] == doc[:-1])
        per = lambda marks: np.bincount(doc, weights=marks, minlength=docs) / some
        # Distinct words of each document, by the first of each run after sorting within documents.
        order = np.lexsort((group.hashes, doc))
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (group.hashes[order][1:] != group.hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order], weights=fresh, minlength=docs)
        runs = np.diff(np.append(np.flatnonzero(fresh), len(doc)))
        top = np.zeros(docs)
        np.maximum.at(top, doc[order][fresh], runs)
        lines, dup = [], []
        for a, b in zip(places[:-1], places[1:], strict=True):
            found = [x for x in group.data[a:b].tobytes().split(b"\n") if x.strip()]
            lines.append(len(found))
            dup.append(len(found) - len(set(found)))
        lines, dup = np.array(lines), np.array(dup)
        values += [np.log1p(words), mean, np.sqrt(np.maximum(square - mean ** 2, 0)), per(capital), per(shout), per(same),
                   per(length == 1), per(~np.isin(last, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,", np.uint8))
                                         & (last < 128)),
                   distinct / some, np.log1p(distinct) / np.log1p(some), top / some, repeated_words(group) / some,
                   dup / np.maximum(lines, 1), np.log1p(lines), np.log1p(size / np.maximum(lines, 1))]
        out.append(np.stack(values, axis=1))
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, _MEASURES), np.float32)


class PuNetwork:
    """One hidden layer; ``fit`` minimises the non-negative positive-unlabelled risk of the logistic loss."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        width = len(mean)
        self.mean, self.scale = mean, scale
        self.parts = [rng.normal(0, 0.3, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.curve = (1.0, 0.0)

    def value(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x))[1]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.parts[0] + self.parts[1])
        return hidden, hidden @ self.parts[2] + self.parts[3][0]

    def _slopes(self, x: np.ndarray, hidden: np.ndarray, by_value: np.ndarray) -> list[np.ndarray]:
        inner = by_value[:, None] * self.parts[2] * (1 - hidden ** 2)
        return [x.T @ inner, inner.sum(axis=0), hidden.T @ by_value, by_value.sum(keepdims=True)]

    def as_negative(self, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Sum of the losses of scaled rows taken as negatives, and its slopes."""
        hidden, value = self._forward(x)
        return float(np.logaddexp(0, value).sum()), self._slopes(x, hidden, _logistic(value))

    def risk(self, positive: np.ndarray, unlabelled: tuple[float, list[np.ndarray]], count: int, prior: float
             ) -> tuple[float, float, list[np.ndarray]]:
        """Risk of the positives, risk of the negatives (below zero: an estimate gone wrong), slopes of the step to take.

        ``unlabelled`` is ``as_negative`` of the ``count`` unlabelled rows, wherever it was added up.
        """
        hidden, value = self._forward(positive)
        part = prior / len(positive)
        loss, slopes = unlabelled
        negative = loss / count - part * np.logaddexp(0, value).sum()
        down = [a / count - b for a, b in zip(slopes, self._slopes(positive, hidden, part * _logistic(value)), strict=True)]
        if negative >= 0:
            kept = [a + b for a, b in zip(self._slopes(positive, hidden, -part * _logistic(-value)), down, strict=True)]
        else:  # step back from it
            kept = [-a for a in down]
        return float(part * np.logaddexp(0, -value).sum()), float(negative), kept

    def descend(self, slopes: list[np.ndarray], step: int, rate: float, decay: float = 1e-3) -> None:
        """One step with running moments; ``step`` 1 starts them anew."""
        if step == 1:
            self._moments = [np.zeros_like(a) for a in self.parts], [np.zeros_like(a) for a in self.parts]
        first, second = self._moments
        for i, slope in enumerate(slopes):
            slope = slope + decay * self.parts[i]
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope ** 2
            self.parts[i] = self.parts[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 250, rate: float = 0.03) -> None:
        """Descent over rows at hand."""
        p, u = self._scaled(positive), self._scaled(unlabelled)
        for step in range(1, steps + 1):
            self.descend(self.risk(p, self.as_negative(u), len(u), prior)[2], step, rate)

    def calibrate(self, positive: np.ndarray, counts: np.ndarray, sums: np.ndarray, prior: float) -> None:
        """A rising logistic curve from value to score: of least positive-unlabelled risk, by damped Newton steps.

        ``counts`` and ``sums`` are those of the unlabelled values per bin.
        """
        some = counts > 0
        share, value = counts[some] / counts.sum(), sums[some] / counts[some]
        middle = float(share @ value)
        scale = max(float(np.sqrt(share @ (value - middle) ** 2)), 1e-6)
        z = np.stack([value / scale, np.ones(len(value))])
        wanted = prior * np.array([self.value(positive).mean() / scale, 1.0])
        beta = np.array([1.0, 0.0])
        for _ in range(100):
            q = _logistic(beta @ z)
            slope = z @ (q * share) - wanted + 1e-3 * (beta - [1.0, 0.0])
            bend = (z * (q * (1 - q) * share)) @ z.T + 2e-3 * np.eye(2)
            move = np.linalg.solve(bend, slope)
            beta -= move * min(1.0, 2.0 / max(float(np.abs(move).max()), 1e-12))
        self.curve = (max(float(beta[0]), 0.0) / scale, float(beta[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.curve[0] * self.value(x) + self.curve[1])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bin(value: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(value / BIN) + BINS // 2, 0, BINS - 1).astype(np.int64)


def estimate_prior(positive: np.ndarray, counts: np.ndarray, least: float = 0.05, most: float = 0.98) -> float:
    """The class prior from values of positives and the binned values of all texts.

    Above any cut the share of all texts is at least the prior times that of the positives. The cut whose quotient is
    smallest, with three standard errors added above and taken off below, gives the prior by its plain quotient.
    """
    own = np.bincount(_bin(positive), minlength=BINS)
    n, m = own.sum(), counts.sum()
    if n < 2 or not m:
        return 0.5
    p, u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (own, counts))
    error = lambda share, size: 3 * np.sqrt(share * (1 - share) / size)
    low = p - error(p, n)
    bound = np.where(low > 0, (u + error(u, m)) / np.maximum(low, 1e-12), np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(u[at] / p[at], least, most))


def measured(docs: DataFrame) -> DataFrame:
    """One stored row of measures per document row, with ``text_hash`` to find it again."""
    text_session(docs.sparkSession, "2m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = measures(batch.column("text"))
            offsets = pa.array(np.arange(0, rows.size + 1, _MEASURES, dtype=np.int32))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "x": pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))})

    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return cut_lineage(source.mapInArrow(run, "doc_id long, text_hash long, x array<float>"))


def _trusted(rows: DataFrame, labels: DataFrame, folds: int, fold: int, most: int) -> np.ndarray:
    """Measures of at most ``most`` labelled positives outside the held-out fold, in the order of a hash."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    known = known.where(~in_fold(F.col("doc_id"), folds, fold) & (F.col("y") == 1)).select("doc_id")
    return _matrix(rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(most))


def fit(rows: DataFrame, labels: DataFrame, folds: int, fold: int, labelled: int, start: int, steps: int) -> PuNetwork | None:
    """A network fitted on at most ``labelled`` positives and all of ``rows``; ``start`` rows lead to its first parameters."""
    good = _trusted(rows, labels, folds, fold, labelled)
    if not len(good):
        return None
    mean, scale = _moments(rows)
    pool = _matrix(rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_hash").limit(start))
    ranker = PuNetwork(mean, scale)
    ranker.fit(good[::2], pool, 0.5)
    counts, _ = binned(rows, ranker)
    prior = estimate_prior(ranker.value(good[1::2]), counts)
    network = PuNetwork(mean, scale)
    network.fit(good, pool, prior)
    positive, total = network._scaled(good), int(counts.sum())
    for step in range(1, steps + 1):
        network.descend(network.risk(positive, unlabelled_loss(rows, network), total, prior)[2], step, 0.01)
    network.calibrate(good, *binned(rows, network), prior)
    return network


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each measure over all rows."""
    each = [F.get("x", F.lit(i)).cast("double") for i in range(_MEASURES)]
    found = rows.agg(*(F.avg(x) for x in each), *(F.stddev_pop(x) for x in each)).first()
    values = np.array(found, np.float64)
    return values[:_MEASURES], values[_MEASURES:] + 1e-3


def _sums(rows: DataFrame, network: PuNetwork, of: Callable[[PuNetwork, np.ndarray, dict[int, np.ndarray]], None]) -> list:
    """Adds up numbers by place over all rows: each task brings one number per place, Spark adds them."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, _MEASURES).astype(np.float64)
                of(shared.value, x, totals)
        for part, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(at), part)), "at": pa.array(at), "value": pa.array(sums[at])})

    found = rows.select("x").mapInArrow(run, "part long, at long, value double")
    out = found.groupBy("part", "at").agg(F.sum("value").alias("value")).collect()
    shared.unpersist()
    return out


def _add(totals: dict[int, np.ndarray], part: int, values: np.ndarray) -> None:
    totals[part] = totals[part] + values if part in totals else values.astype(np.float64)


def binned(rows: DataFrame, network: PuNetwork) -> tuple[np.ndarray, np.ndarray]:
    """How many of all rows have their value in each bin, and the sums of those values."""

    def of(model: PuNetwork, x: np.ndarray, totals: dict[int, np.ndarray]) -> None:
        value = model.value(x)
        at = _bin(value)
        _add(totals, 0, np.bincount(at, minlength=BINS))
        _add(totals, 1, np.bincount(at, weights=value, minlength=BINS))

    out = np.zeros((2, BINS))
    for row in _sums(rows, network, of):
        out[row.part, row.at] = row.value
    return out[0], out[1]


def unlabelled_loss(rows: DataFrame, network: PuNetwork) -> tuple[float, list[np.ndarray]]:
    """``as_negative`` of all rows."""

    def of(model: PuNetwork, x: np.ndarray, totals: dict[int, np.ndarray]) -> None:
        loss, slopes = model.as_negative(model._scaled(x))
        _add(totals, 0, np.array([loss]))
        for i, slope in enumerate(slopes, 1):
            _add(totals, i, slope.ravel())

    sums = [np.zeros(1), *(np.zeros(a.size) for a in network.parts)]
    for row in _sums(rows, network, of):
        sums[row.part][row.at] = row.value
    return float(sums[0][0]), [s.reshape(a.shape) for s, a in zip(sums[1:], network.parts, strict=True)]


def _matrix(rows: DataFrame) -> np.ndarray:
    found = rows.select("x").toPandas()["x"].tolist()
    return np.array(found, np.float64).reshape(-1, _MEASURES)


def _scores(rows: DataFrame, network: PuNetwork | None, keep: list[str]) -> DataFrame:
    if network is None:
        return rows.select(*keep, F.lit(1.0).alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(network)
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, _MEASURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(x))], [*keep, "score"])

    return rows.select(*keep, "x").mapInArrow(run, f"{kinds}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, labelled: int = LABELLED,
                  start: int = START, steps: int = STEPS) -> DataFrame:
    """Per document row: ``doc_id, text_hash, held_out, score, predicted``. Every whole text is measured and scored.

    Only the positives and the start of the descent are bounded samples; labels of the held-out fold are not used.
    """
    rows = measured(docs)
    network = fit(rows, labels, folds, fold, labelled, start, steps)
    out = _scores(rows, network, ["doc_id", "text_hash"])
    return out.select("doc_id", "text_hash", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                      (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The documents, all columns, without those that the classifier rejects."""
    scored = score_quality(docs, labels, **options).where("predicted = 0")
    return by_row(docs, cut_lineage(scored.select("doc_id", "text_hash").distinct()), "left_anti")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", "predicted")
