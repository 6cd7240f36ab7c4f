"""Toxicity from subwords.

A word is the bag of its character n-grams; their embeddings are averaged and go into a linear softmax. Embeddings and
softmax are trained jointly in numpy, so a misspelling never seen shares most of its n-gram vectors with the word it
comes from. A text is as toxic as its most toxic word; a logistic curve over that value, fitted on the training labels,
gives the score.

Labels speak of texts, not of words. Words with an n-gram that stands in toxic texts only, and in too many for chance, inherit
their label; all others count as clean; each round adds clean words that the model so far rates too high. Words of both kinds are also shown
with random edits.

Defined cases: a null or empty text has the lowest score; a null ``doc_id`` is scored but never learned from; repeated rows
are scored each; contradicting labels of an id count as toxic; without labels of both kinds every score is 0; an empty
table gives an empty table; columns other than the text are no input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import tokens
from tenderglow.llm.common import in_fold, text_session, texts
from tenderglow.session import cut_lineage

BUCKETS, SIZES, WIDTH = 1 << 20, (3, 4, 5), 8
#: Bounds of the training sample: texts of each label, and the longest text in it, in code points.
SAMPLE, LONGEST = 2_000, 50_000
SPARE = 10  # one in so many words and edits is kept out of the fit, to see how unknown words are rated
MIDDLE = 0.75  # where the middle of the curve lies between clean texts and edited toxic words, both with words that the fit has not seen
LOWEST = -12.0  # value of a text without words

_EDGE = np.ones(256, bool)  # bytes stripped from both ends of a word: ASCII that is neither letter nor digit
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without punctuation at the ends; a word of nothing else becomes empty."""
    start, end = start.copy(), end.copy()
    todo = np.arange(len(start))
    while len(todo):
        todo = todo[start[todo] < end[todo]]
        todo = todo[_EDGE[data[start[todo]]]]
        start[todo] += 1
    todo = np.arange(len(start))
    while len(todo):
        todo = todo[start[todo] < end[todo]]
        todo = todo[_EDGE[data[end[todo] - 1]]]
        end[todo] -= 1
    return start, end


def ngrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of all n-grams of the words, their ends marked, and of the whole words; A-Z are lowered."""
    size = np.maximum(end - start, 0)
    first = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.zeros(first[-1], np.uint64)
    word = np.repeat(np.arange(len(size)), size + 2)
    inner = np.repeat(first[:-1] + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    source = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    flat[inner] = tokens.LOWER[data[source]]
    flat[first[:-1]], flat[first[1:] - 1] = 1, 2
    words, hashes = [], []
    value = np.zeros(len(flat), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(flat) < n:
            break
        value = value[:len(flat) - n + 1] << np.uint64(8) | flat[n - 1:]
        if n in SIZES:
            whole = word[:len(value)] == word[n - 1:]
            words.append(word[:len(value)][whole])
            hashes.append(tokens.mix(value[whole] + np.uint64(n << 56)))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = tokens.mix(flat + tokens.mix(np.arange(len(flat), dtype=np.uint64) - first[word].astype(np.uint64)))
    words.append(np.arange(len(size)))
    hashes.append(tokens.mix(np.add.reduceat(letter, first[:-1])))
    return np.concatenate(words), np.concatenate(hashes)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _as_arrays(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), end - size, end


class SubwordModel:
    """Embeddings of n-gram buckets, averaged per word, into a linear softmax over (clean, toxic)."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.weights = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
        self.bias = np.array([2, -2], np.float32)  # a word of unknown n-grams is taken for clean
        self.squares = np.full(BUCKETS, 1e-6, np.float32)
        self.known = np.zeros(BUCKETS, bool)
        self.curve = (0.0, LOWEST)

    def fit(self, word: np.ndarray, bucket: np.ndarray, count: int, target: np.ndarray, weight: np.ndarray,
            epochs: int, rate: float = 0.3, decay: float = 1e-6) -> None:
        """Gradient steps on the weighted cross-entropy of all words; each vector has its own step size."""
        size = np.maximum(np.bincount(word, minlength=count), 1).astype(np.float32)
        order = np.argsort(bucket, kind="stable")
        w_sorted, b_sorted = word[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], b_sorted[1:] != b_sorted[:-1]]))
        used = b_sorted[cuts]
        self.known[used] = True
        order = np.argsort(word, kind="stable")
        by_word, bw = bucket[order], word[order]
        heads = np.flatnonzero(np.concatenate([[True], bw[1:] != bw[:-1]]))
        present = bw[heads]
        share = (weight / weight.sum()).astype(np.float32)
        top = np.float32(1e-6)
        for _ in range(epochs):
            mean = np.zeros((count, WIDTH), np.float32)
            mean[present] = np.add.reduceat(self.vectors[by_word], heads, axis=0)
            mean /= size[:, None]
            logit = mean @ self.weights + self.bias
            logit -= logit.max(axis=1, keepdims=True)
            chance = np.exp(logit)
            chance /= chance.sum(axis=1, keepdims=True)
            slope = chance.copy()
            slope[:, 1] -= target
            slope[:, 0] -= 1 - target
            slope *= share[:, None]
            back = (slope @ self.weights.T) / size[:, None]
            turn = np.add.reduceat(back[w_sorted], cuts, axis=0)
            self.squares[used] += (turn ** 2).mean(axis=1) * 1e4
            down = mean.T @ slope + decay * self.weights
            top += np.float32((down ** 2).mean())
            self.vectors[used] -= rate * turn * 100 / np.sqrt(self.squares[used])[:, None] + decay * self.vectors[used]
            self.weights -= rate * down / np.sqrt(top)
            self.bias -= rate * slope.sum(axis=0)

    def table(self) -> np.ndarray:
        """What one n-gram adds to the log odds of its word, before averaging; nothing if no fit has seen it."""
        return np.where(self.known, self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), 0).astype(np.float32)


def word_odds(table: np.ndarray, bias: float, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    word, hashes = ngrams(data, start, end)
    size = np.bincount(word, minlength=len(start))
    odds = np.bincount(word, weights=table[bucket_of(hashes)], minlength=len(start)) / np.maximum(size, 1) + bias
    return np.where(end > start, odds, LOWEST)


def text_odds(table: np.ndarray, bias: float, column: pa.Array) -> np.ndarray:
    """The greatest word value of every text."""
    out = []
    for group in tokens.groups(column, lower=True):
        value = np.full(group.last - group.first, LOWEST)
        if len(group.hashes):
            _, one, which = np.unique(group.hashes, return_index=True, return_inverse=True)
            start, end = stripped(group.data, group.start[one], group.end[one])
            odds = word_odds(table, bias, group.data, start, end)
            np.maximum.at(value, group.doc, odds[which])
        out.append(value)
    return np.concatenate(out) if out else np.zeros(0)


def _edited(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one or two random edits: a letter dropped, doubled, swapped with the next or replaced."""
    out = bytearray(word)
    for _ in range(rng.integers(1, 3)):
        if len(out) < 4:
            break
        i = int(rng.integers(0, len(out)))
        kind = int(rng.integers(0, 4))
        if kind == 0:
            del out[i]
        elif kind == 1:
            out.insert(i, out[i])
        elif kind == 2 and i + 1 < len(out):
            out[i], out[i + 1] = out[i + 1], out[i]
        else:
            out[i] = b"abcdefghijklmnopqrstuvwxyz0123456789*@$!"[int(rng.integers(0, 40))]
    return bytes(out)


def _copies(bags: list[np.ndarray], rare: np.ndarray, hashes: int = 4) -> np.ndarray:
    """A group number per text; texts that share a least hash of their rare words are copies of each other."""
    group = np.arange(len(bags))
    for seed in range(1, hashes + 1):
        first: dict[int, int] = {}
        for i, bag in enumerate(bags):
            own = bag[rare[bag]]
            if len(own):
                low = int(tokens.mix(own.astype(np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed << 40)).min())
                other = first.setdefault(low, i)
                group[group == group[i]] = group[other]
    return group


def _marks(bags: list[np.ndarray], labels: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Words with an n-gram that stands in toxic texts only, and in too many for chance; copies of a text vote once."""
    word, hashes = ngrams(*_as_arrays(words))
    grams, gram = np.unique(hashes, return_inverse=True)
    order = np.argsort(word, kind="stable")
    gram, cuts = gram[order], np.searchsorted(word[order], np.arange(len(words) + 1))
    seen_word = np.bincount(np.concatenate([*bags, np.zeros(0, np.int64)]), minlength=len(words))
    toxic = np.flatnonzero(labels == 1)
    group = np.zeros(len(bags), np.int64)
    group[toxic] = _copies([bags[i] for i in toxic], seen_word <= max(3, 0.01 * len(bags)))
    clean, votes = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for i in np.flatnonzero(labels == 0):
        clean[np.unique(np.concatenate([*(gram[cuts[w]:cuts[w + 1]] for w in bags[i]), np.zeros(0, np.int64)]))] += 1
    for g in np.unique(group[toxic]):
        own = np.unique(np.concatenate([*(bags[i] for i in toxic[group[toxic] == g]), np.zeros(0, np.int64)]))
        votes[np.unique(np.concatenate([*(gram[cuts[w]:cuts[w + 1]] for w in own), np.zeros(0, np.int64)]))] += 1
    share = len(toxic) / len(bags)
    least = math.log(100 * max(len(grams), 1)) / -math.log(min(max(share, 1e-3), 0.9))
    marked = (votes >= least) & (clean * 50 <= votes)
    words_clean = np.bincount(np.concatenate([*(bags[i] for i in np.flatnonzero(labels == 0)), np.zeros(0, np.int64)]), minlength=len(words))
    has = np.bincount(np.repeat(np.arange(len(words)), np.diff(cuts)), weights=marked[gram], minlength=len(words)) > 0
    return np.flatnonzero(has & (words_clean == 0))


def train(sample: list[tuple[str, int]], rounds: int = 4, start: int = 25_000, epochs: int = 50, seed: int = 1) -> SubwordModel | None:
    """A model from (text, label) rows, None without both labels.

    It starts from ``start`` words; each round adds the words of the sample that the model so far wrongly rates highest.
    """
    labels = np.array([y for _, y in sample], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    edge, lower = bytes(np.flatnonzero(_EDGE).astype(np.uint8)), tokens.LOWER.tobytes()
    vocabulary: dict[bytes, int] = {}
    bags = []
    for text, _ in sample:
        found = {w.strip(edge) for w in text.encode().translate(lower).split()} - {b""}
        bags.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in sorted(found)], np.int64))
    words = list(vocabulary)
    toxic, clean = np.zeros(len(words)), np.zeros(len(words))
    for bag, label in zip(bags, labels, strict=True):
        (toxic if label else clean)[bag] += 1
    marks = _marks(bags, labels, words).tolist()
    if not marks:  # too few texts: each word inherits the label of its text
        marks = np.flatnonzero((toxic > 0) & (clean == 0))[:1000].tolist()
    other = np.ones(len(words), bool)
    other[marks] = False
    spare = rng.integers(0, SPARE, len(words)) == 0
    usual = np.flatnonzero(other & ~spare)
    chosen = set(rng.choice(usual, min(len(usual), start), replace=False).tolist()) if len(usual) else set()
    edits = sorted({_edited(words[w], rng) for w in marks for _ in range(max(3, 4000 // len(marks)))} - set(vocabulary))
    unseen = edits[::SPARE]
    edits = [e for i, e in enumerate(edits) if i % SPARE]
    wrong = sorted({_edited(words[w], rng) for w in sorted(chosen)[:start // 3]} - set(vocabulary) - set(edits))
    model, arrays = SubwordModel(seed), _as_arrays(words)
    for _ in range(rounds):
        negatives = sorted(chosen)
        listed = [words[w] for w in marks] + edits + [words[w] for w in negatives] + wrong
        bad = len(marks) + len(edits)
        target = np.zeros(len(listed))
        target[:bad] = 1
        weight = np.ones(len(listed))
        weight[:len(marks)] = 0.25 * len(negatives) / max(len(marks), 1)
        weight[len(marks):bad] = 0.25 * len(negatives) / max(len(edits), 1)
        weight[bad:bad + len(negatives)] = 1 + np.log1p(clean[negatives])
        word, hashes = ngrams(*_as_arrays(listed))
        model.fit(word, bucket_of(hashes), len(listed), target, weight, epochs=epochs)
        odds = word_odds(model.table(), float(model.bias[1] - model.bias[0]), *arrays)
        highest = usual[np.argsort(-odds[usual])[:4000]]
        chosen |= set(highest[odds[highest] > -2].tolist())
    values = np.array([odds[bag].max() if len(bag) else LOWEST for bag in bags])
    # Misspelled words count as toxic texts of their own for the slope. The middle of the curve lies between the clean texts, a tenth
    # of whose words the fit has not seen, and misspellings that it has not seen either; a word of unknown n-grams is clean.
    bias = float(model.bias[1] - model.bias[0])
    seen = word_odds(model.table(), bias, *_as_arrays(unseen)) if unseen else values[labels == 1]
    slope, _ = _logistic(np.concatenate([values, seen]), np.concatenate([labels, np.ones(len(seen), np.int64)]))
    low = max(float(np.quantile(values[labels == 0], 0.997)), bias)
    middle = low + max(MIDDLE * (float(np.quantile(seen, 0.1)) - low), 0.5)
    model.curve = (slope, -slope * middle)
    return model


def _logistic(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by damped Newton steps; classes weigh alike."""
    scale = max(float(value.std()), 1e-6)
    middle = float(value.mean())
    x = np.stack([(value - middle) / scale, np.ones(len(value))])
    w = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        slope = x @ (w * (p - label)) + 1e-4 * beta
        bend = (x * (w * p * (1 - p))) @ x.T + 1e-4 * np.eye(2)
        beta -= np.linalg.solve(bend, slope)
    a = max(float(beta[0]) / scale, 0.0)
    return a, float(beta[1]) - a * middle


def training_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, each: int, longest: int) -> DataFrame:
    """At most ``each`` labelled texts per label, outside the held-out fold, in the order of a hash of the id.

    Ids and lengths settle which; then at most twice ``each`` ids are sent to where the texts are. A repeated id counts
    with one of its texts.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).alias("label"))
    known = known.where(~in_fold(F.col("doc_id"), folds, fold))
    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    fitting = source.where((F.length("text") <= longest) & F.col("doc_id").isNotNull())
    narrow = fitting.groupBy("doc_id").agg(F.min("text_hash").alias("text_hash")).join(known, "doc_id")
    parts = [narrow.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    chosen = cut_lineage(parts[0].unionByName(parts[1]))
    return source.join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["doc_id"])


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE,
                   longest: int = LONGEST) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``.

    The model is fitted on at most ``sample`` texts per label of at most ``longest`` code points, and on labels outside the
    held-out fold; every whole text is scored.
    """
    spark = text_session(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", folds, fold, sample, longest).select("text", "label").collect()
    model = train(sorted((r.text, int(r.label)) for r in rows))
    source = texts(docs).withColumn("held_out", in_fold(F.col("doc_id"), folds, fold))
    kind = "doc_id long, held_out boolean, score double"
    if model is None:
        scored = source.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        shared = spark.sparkContext.broadcast((model.table(), float(model.bias[1] - model.bias[0]), model.curve))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, bias, (slope, offset) = shared.value
            for batch in batches:
                odds = text_odds(table, bias, batch.column("text"))
                score = 1 / (1 + np.exp(-np.clip(slope * odds + offset, -40, 40)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score)})

        scored = source.mapInArrow(run, kind)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
