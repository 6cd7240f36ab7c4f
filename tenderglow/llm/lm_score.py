"""Language-model scoring by prediction by partial matching (PPM).

Byte contexts are counted over all training texts. The chance of a byte is its share in the longest context known; a
context that lacks it escapes (method C: as often as it has distinct bytes) to the next shorter one, in which the bytes it
had are excluded, down to all bytes alike. The counts are made beforehand; adding the code lengths of all bytes and of an
end mark gives the text's log probability. A-Z are lowered first, as for the words.

Every context of the training texts is kept, in stored tables with one row per gram (a context and its byte), one for each
order. Workers get the log chances of the most frequent whole grams; all others, seen or not, are scored once each by joins
from order to order and then joined to the texts, so what is sent to the workers changes no score. A unigram word score
with smoothing is computed beside it in the same way: counts of the most frequent words are sent, all others are joined.

Defined cases: a null or empty text scores its end mark alone; a null ``doc_id`` is in the training part; repeated rows
are counted and scored each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import tokens
from tenderglow.llm.common import in_fold, maybe_broadcast, text_session, texts
from tenderglow.session import cut_lineage

#: Longest context in bytes.
ORDER = 5
#: Grams whose log chances, and words whose counts, are sent to the workers at most.
GRAMS, FREQUENT = 1_000_000, 65_536
_END = np.int64(-0x1234567890ABCDEF)  # the end token among the word hashes
_WORD, _GRAM = 0, 1


def _padded(group: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, A-Z lowered, with zeros around each document; places of all bytes to predict (the end mark included); first of each document."""
    count = group.last - group.first
    size = np.diff(group.offsets)
    data = np.zeros(len(group.data) + count * (ORDER + 1), np.uint8)
    gap = np.repeat(np.arange(count) * (ORDER + 1) + ORDER, size)
    data[np.arange(len(group.data)) + gap] = tokens.LOWER[group.data]
    first = group.offsets[:-1] + np.arange(count) * (ORDER + 1) + ORDER
    place = np.repeat(first, size + 1) + np.arange(len(group.data) + count) - np.repeat(group.offsets[:-1] + np.arange(count), size + 1)
    return data, place, group.offsets[:-1] + np.arange(count)


def _grams(group: tokens.Words) -> np.ndarray:
    """Of each byte to predict: the ORDER bytes before it and itself, the latest lowest."""
    data, place, _ = _padded(group)
    gram = np.zeros(len(place), np.int64)
    for back in range(ORDER, -1, -1):
        gram = gram << 8 | data[place - back]
    return gram


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in tokens.groups(batch.column("text"), lower=True):
            words, times = np.unique(group.hashes.view(np.int64), return_counts=True)
            words, times = np.append(words, _END), np.append(times, group.last - group.first)
            grams, often = np.unique(_grams(group), return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.repeat(np.array([_WORD, _GRAM], np.int8), [len(words), len(grams)])),
                "key": pa.array(np.concatenate([words, grams])), "times": pa.array(np.concatenate([times, often]).astype(np.int64))})


def count(train: DataFrame) -> DataFrame:
    """Stored counts of words and of byte grams over all training texts; summed on the map side first."""
    parts = train.select("text").mapInArrow(_counted, "kind tinyint, key long, times long")
    return cut_lineage(parts.groupBy("kind", "key").agg(F.sum("times").alias("times")))


def _cut(size: int, column: str = "key"):
    """The lowest ``size`` bytes."""
    return F.col(column).bitwiseAND((1 << 8 * size) - 1)


def orders(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored tables for each order from 0: ``key, times`` of all grams and what their contexts hold.

    ``context, total, kinds`` are occurrences and distinct bytes; ``left, left_kinds`` those of the next shorter context
    without the bytes that this one has. Every byte of a context also follows the shorter one, so none is lost in the joins.
    """
    tables = [grams]
    for n in range(ORDER, 0, -1):
        tables.insert(0, cut_lineage(tables[0].select(_cut(n).alias("key"), "times").groupBy("key").agg(F.sum("times").alias("times"))))
    contexts = []
    for n, table in enumerate(tables):
        rows = table.select(F.shiftright("key", 8).alias("context"), "times", _cut(n).alias("lower"))
        sums = [F.sum("times").alias("total"), F.count("*").alias("kinds")]
        if n == 0:
            found = rows.groupBy("context").agg(*sums).select("*", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("left_kinds"))
        else:
            below, above = tables[n - 1].toDF("lower", "below"), contexts[n - 1].select(
                F.col("context").alias("shorter"), F.col("total").alias("all"), F.col("kinds").alias("all_kinds"))
            if n <= 2:  # at most 65,536 grams
                below, above = F.broadcast(below), F.broadcast(above)
            found = rows.join(below, "lower").groupBy("context").agg(*sums, F.sum("below").alias("taken"))
            found = found.withColumn("shorter", _cut(n - 1, "context")).join(above, "shorter").select(
                "context", "total", "kinds", (F.col("all") - F.col("taken")).alias("left"), (F.col("all_kinds") - F.col("kinds")).alias("left_kinds"))
        contexts.append(cut_lineage(found))
    return tables, contexts


def gram_logs(wanted: DataFrame, tables: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """``key, log``: log10 chances of distinct grams, seen or not, worked out from order to order."""
    needed = [wanted]
    for n in range(ORDER, 0, -1):
        needed.insert(0, cut_lineage(needed[0].select(_cut(n).alias("key")).distinct()))
    seen, known = F.col("times").isNotNull(), F.col("total").isNotNull()
    size = F.log10(F.col("total") + F.col("kinds"))
    below = None
    for n in range(ORDER + 1):
        held = contexts[n].withColumnRenamed("context", "longer")
        rows = needed[n].join(F.broadcast(tables[n]) if n <= 1 else tables[n], "key", "left").withColumn("longer", F.shiftright("key", 8))
        rows = rows.join(F.broadcast(held) if n <= 2 else held, "longer", "left")
        if below is None:
            # ``rest`` is the log chance of a byte that the context lacks, once it has escaped.
            rows = rows.withColumn("rest", -F.log10(F.greatest(256 - F.coalesce("kinds", F.lit(0)), F.lit(1)))).withColumn(
                "shorter_log", F.lit(-math.log10(256)))
        else:
            lower = below.select(F.col("key").alias("lower"), F.col("times").alias("below"), F.col("log").alias("shorter_log"),
                                 F.col("rest").alias("shorter_rest"))
            rows = rows.withColumn("lower", _cut(n)).join(F.broadcast(lower) if n <= 2 else lower, "lower")
            left = F.log10(F.col("left") + F.col("left_kinds"))
            escape = F.when(F.col("left_kinds") > 0, F.log10("left_kinds") - left).otherwise(0.0)
            rows = rows.withColumn("rest", F.when(F.col("below").isNotNull(), F.log10("below") - left).otherwise(escape + F.col("shorter_rest")))
        log = F.when(seen, F.log10("times") - size).when(known, F.log10("kinds") - size + F.col("rest")).otherwise(F.col("shorter_log"))
        below = rows.select("key", "times", "rest", log.alias("log"))
        if n in (2, ORDER):
            below = cut_lineage(below)
    return below.select("key", "log")


def frequent_grams(grams: DataFrame, contexts: DataFrame, most: int = GRAMS) -> DataFrame:
    """``key, log`` of the most frequent whole grams, at most ``most``; chosen by a histogram, so nothing is sorted."""
    level = F.floor(F.log2("times") * 16).cast("int")
    rows, cut = 0, 1 << 20
    for r in grams.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 1,024 levels
        rows += r["count"]
        if rows > most:
            break
        cut = r.level
    often = grams.where(level >= cut).withColumn("context", F.shiftright("key", 8))
    return often.join(contexts, "context").select("key", (F.log10("times") - F.log10(F.col("total") + F.col("kinds"))).cast("float").alias("log"))


class Trie:
    """The same chances in memory, of all 256 bytes after every context, for small models; tests follow the tables by it."""

    def __init__(self, size: np.ndarray, context: np.ndarray, symbol: np.ndarray, times: np.ndarray) -> None:
        names = context | size << 40
        known = np.unique(names)  # by size, then context
        row = np.searchsorted(known, names)
        n = max(len(known), 1)
        counts = np.zeros((n, 256), np.float32)
        counts[row, symbol] = times
        sizes, contexts = known >> 40, known & ((1 << 40) - 1)
        self.child = np.full((n, 256), -1, np.int32)
        self.log = np.zeros((n, 256), np.float32)
        rest = np.zeros((n, 256), np.float32)  # chances of a context's unseen bytes once it has escaped
        parent = np.zeros(n, np.int64)
        for i in range(1, ORDER + 1):
            own = np.flatnonzero(sizes == i)
            shorter = contexts[own] & ((1 << 8 * (i - 1)) - 1)
            parent[own] = np.searchsorted(known, shorter | (i - 1) << 40)
            self.child[parent[own], contexts[own] >> 8 * (i - 1)] = own
        for i in range(ORDER + 1):
            own = np.flatnonzero(sizes == i) if len(known) else np.array([0])
            for own in np.array_split(own, len(own) // 2048 + 1):
                if not len(own):
                    continue
                seen = counts[own] > 0
                if i == 0:
                    rest[own] = 1 / np.maximum(256 - seen.sum(axis=1, keepdims=True), 1)
                else:
                    above = counts[parent[own]]
                    left = np.where(seen, 0, above)  # what the shorter context has besides
                    total, kinds = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
                    escape = np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 1)
                    rest[own] = np.where(left > 0, left / np.maximum(total + kinds, 1), escape * rest[parent[own]])
                total, kinds = counts[own].sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
                escape = np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 1)
                chance = np.where(seen, counts[own] / np.maximum(total + kinds, 1), escape * rest[own])
                self.log[own] = np.log10(np.maximum(chance, 1e-30))

    def log10(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each byte at ``place``, given the bytes before it."""
        state = np.zeros(len(place), np.int32)
        active = np.arange(len(place))
        for back in range(1, ORDER + 1):
            longer = self.child[state[active], data[place[active] - back]]
            found = longer >= 0
            active = active[found]
            state[active] = longer[found]
        return self.log[state, data[place]]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(values.astype(np.int64)))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grams, gram_logs = model["grams"], model["gram_logs"]
        keys, logs, end_log = model["keys"], model["logs"], model["end_log"]
        for batch in batches:
            parts = {"n_tokens": [], "head_known": [], "head_score": [], "gram_score": []}
            tails, gram_tails, gram_times = [], [], []
            for group in tokens.groups(batch.column("text"), lower=True, most=1 << 20):
                docs = group.last - group.first
                words, doc = group.hashes.view(np.int64), group.doc
                at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
                hit = keys[at] == words if len(keys) else np.zeros(len(words), bool)
                parts["n_tokens"].append(np.diff(group.bounds) + 1)
                parts["head_known"].append(np.bincount(doc[hit], minlength=docs) + int(model["end_known"]))
                parts["head_score"].append(np.bincount(doc[hit], weights=logs[at[hit]], minlength=docs) + end_log)
                rest = words[~hit]
                tails += np.split(rest, np.searchsorted(doc[~hit], np.arange(1, docs)))
                own, which = np.unique(_grams(group), return_inverse=True)
                at = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
                hit = grams[at] == own if len(grams) else np.zeros(len(own), bool)
                log = np.where(hit, gram_logs[at], 0) if len(grams) else np.zeros(len(own))
                size = np.diff(group.offsets) + 1
                parts["gram_score"].append(np.add.reduceat(log[which], np.cumsum(size) - size))
                left = np.flatnonzero(~hit[which])
                pair, often = np.unique(np.repeat(np.arange(docs), size)[left] * len(own) + which[left], return_counts=True)
                cuts = np.searchsorted(pair, np.arange(1, docs) * len(own))
                gram_tails += np.split(own[pair % len(own)], cuts)
                gram_times += np.split(often, cuts)
            flat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": pa.array(flat["n_tokens"].astype(np.int64)), "head_known": pa.array(flat["head_known"].astype(np.int64)),
                "head_score": pa.array(flat["head_score"].astype(np.float64)), "gram_score": pa.array(flat["gram_score"].astype(np.float64)),
                "tail": _lists(tails), "gram_tail": _lists(gram_tails), "gram_times": _lists(gram_times)})

    return run


def score_texts(docs: DataFrame, folds: int = 5, fold: int = 1, grams: int = GRAMS, frequent: int = FREQUENT) -> DataFrame:
    """Per document: tokens, unigram ``base_score`` and PPM ``score`` (log10 chances), learned from all other folds.

    The driver holds the ``frequent`` counts and the log chances of at most ``grams`` grams, nothing else; both only say what
    is joined, not what is known.
    """
    spark = text_session(docs.sparkSession)
    source = texts(docs).withColumn("held_out", in_fold(F.col("doc_id"), folds, fold))
    counts = count(source.where(~F.col("held_out")))
    words = counts.where(F.col("kind") == _WORD).select("key", "times")
    total = words.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                      F.coalesce(F.sum(F.when(F.col("key") == int(_END), F.col("times"))), F.lit(0)).alias("ends")).first()
    scale = total.n + 0.5 * (total.v + 1)
    head = words.where(F.col("key") != int(_END)).orderBy(F.desc("times"), "key").limit(frequent).toPandas().sort_values("key")
    tables, contexts = orders(counts.where(F.col("kind") == _GRAM).select("key", "times"))
    often = frequent_grams(tables[ORDER], contexts[ORDER], grams).toArrow()
    keys = often["key"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast({
        "keys": head["key"].to_numpy(np.int64), "logs": np.log10((head["times"].to_numpy(np.float64) + 0.5) / scale),
        "end_known": total.ends > 0, "end_log": float(np.log10((total.ends + 0.5) / scale)),
        "grams": keys[order], "gram_logs": often["log"].to_numpy()[order]})
    del often, keys, order
    scored = source.mapInArrow(_scored(shared), "doc_id long, held_out boolean, n_tokens long, head_known long, "
                               "head_score double, gram_score double, tail array<long>, gram_tail array<long>, gram_times array<long>")
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode("tail").alias("key")).join(words, "key", "left")
    tail = tail.groupBy("row").agg(
        F.count("times").alias("tail_known"),
        F.sum(F.log10((F.coalesce("times", F.lit(0)) + 0.5) / F.lit(scale))).alias("tail_score"))
    pairs = scored.select("row", F.explode(F.arrays_zip("gram_tail", "gram_times")).alias("gram")).select(
        "row", F.col("gram.gram_tail").alias("key"), F.col("gram.gram_times").alias("times"))
    logs = gram_logs(cut_lineage(pairs.select("key").distinct()), tables, contexts)
    left = pairs.join(maybe_broadcast(logs, 16, 4 << 20), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("gram_rest"))
    return scored.join(tail, "row", "left").join(left, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        (F.col("gram_score") + F.coalesce("gram_rest", F.lit(0.0))).alias("score"))
