"""Removal of repeated passages by De Bruijn compaction.

A window of k words is an edge of the De Bruijn graph of (k-1)-word nodes. An edge that starts in two documents is
repeated; its source is the least of them. Repeated edges that follow each other without branching, in a document and
with one source, compact into a path: a long repeated span with its place in the copy. A join on the ends of the paths
looks up the places in the source and confirms that the source holds the same path in one run.

Only repeated edges are worth moving. So each window is first represented by its minimizer, the least hash among its
short grams, as in the partitioning of assembly graphs: windows with equal words have equal minimizers, and a window
whose minimizer stands in one document only is not repeated. Documents with the same words are compared once.

Defined cases: a null text has no words; a text shorter than a window loses none; repeats inside one document are left
alone; rows with a null ``doc_id`` have no order, so they lose nothing and are no source; rows of one id do not remove each
other's words; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderglow.llm import tokens
from tenderglow.llm.common import text_session, texts
from tenderglow.session import cut_lineage

WINDOW, GRAM = 13, 5
#: Place of a word: the text's number among those of its id, and the word's number.
_PART = 1 << 40


def minimizers(group: tokens.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the group's words) of all windows that lie in one document, and the least gram hash of each."""
    starts = _windows(group, window)
    grams = tokens.ngram_hashes(group.hashes, gram)
    width = window - gram + 1
    least, have = grams, 1
    while have < width:  # minima over twice as many, then over the rest
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    return starts, least[starts]


def _windows(group: tokens.Words, window: int) -> np.ndarray:
    last = np.repeat(group.bounds[1:], np.diff(group.bounds))
    place = np.arange(len(group.hashes))
    return place[place + window <= last]


def _kept_hash(group: tokens.Words, i: int, keep: np.ndarray | None = None) -> str:
    """Hash of the words of a document that stay, joined by single spaces."""
    part = group.data[group.offsets[i]:group.offsets[i + 1]].tobytes()
    words = part.split()
    if keep is not None:
        words = [w for w, k in zip(words, keep, strict=True) if k]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, prints = [], [], []
            for group in tokens.groups(batch.column("text"), lower=False):
                starts, least = minimizers(group, window, gram)
                doc = group.doc[starts]
                cut = np.searchsorted(doc, np.arange(group.last - group.first + 1))
                for i in range(group.last - group.first):
                    counts.append(int(group.bounds[i + 1] - group.bounds[i]))
                    hashes.append(_kept_hash(group, i))
                    prints.append(np.unique(least[cut[i]:cut[i + 1]]).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "n_words": pa.array(counts, pa.int64()), "words_sha256": pa.array(hashes, pa.string()),
                "prints": pa.array(prints, pa.list_(pa.int64()))})

    return run


def _edges(window: int, gram: int):
    """Edges of one document whose minimizer is repeated: two hashes, place, and hashes of the words before and after."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            prints, parts, ids = batch.column("prints"), batch.column("part").to_numpy(), batch.column("doc_id")
            for group in tokens.groups(batch.column("text"), lower=False):
                starts, least = minimizers(group, window, gram)
                doc = group.doc
                cut = np.searchsorted(doc[starts], np.arange(group.last - group.first + 1))
                chosen = np.zeros(len(starts), bool)
                for i in range(group.last - group.first):
                    wanted = prints[row + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    chosen[cut[i]:cut[i + 1]] = np.isin(least[cut[i]:cut[i + 1]], wanted)
                at = starts[chosen]
                own = doc[at]
                first, last = group.bounds[own], group.bounds[own + 1]
                edge, check = tokens.ngram_hashes(group.hashes, window), tokens.ngram_hashes(group.hashes, window, seed=7)
                half = (group.hashes >> np.uint64(49)).astype(np.int32) + 1  # 15 bits, never 0
                before = np.where(at > first, half[np.maximum(at - 1, 0)], 0)
                after = np.where(at + window < last, half[np.minimum(at + window, len(half) - 1)], 0) if len(half) else at
                yield pa.RecordBatch.from_pydict({
                    "edge": pa.array(edge[at].view(np.int64)),
                    "check": pa.array((check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    "doc_id": ids.take(pa.array(own + row)),
                    "pos": pa.array(parts[own + row] * _PART + at - first),
                    "around": pa.array((before << 16 | after).astype(np.int32))})
                row += group.last - group.first

    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compacts rows sorted by document and place: a path goes on while places follow each other, the source stays, and
    the edge neither branches after nor the next one before."""
    held = None
    names = ("doc_id", "pos", "owner", "branches", "edge", "check")
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(n).to_numpy() for n in names]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        breaks = _breaks(held)
        if len(breaks) > 1:  # the last path may go on in the next batch
            yield _path_rows(held, breaks)
            held = [x[breaks[-1]:] for x in held]
    if held is not None:
        yield _path_rows(held, np.append(_breaks(held), len(held[0])))


def _breaks(rows: list[np.ndarray]) -> np.ndarray:
    doc, pos, owner, branches = rows[:4]
    same = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (owner[1:] == owner[:-1])
    same &= (branches[:-1] & 1 == 0) & (branches[1:] & 2 == 0)
    return np.concatenate([[0], np.flatnonzero(~same) + 1])


def _path_rows(rows: list[np.ndarray], breaks: np.ndarray) -> pa.RecordBatch:
    doc, pos, owner, _, edge, check = rows
    head, tail = breaks[:-1], breaks[1:] - 1
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(doc[head]), "pos": pa.array(pos[head]), "edges": pa.array(breaks[1:] - breaks[:-1]),
        "owner": pa.array(owner[head]), "edge": pa.array(edge[head]), "check": pa.array(check[head]),
        "last_edge": pa.array(edge[tail]), "last_check": pa.array(check[tail])})


_PATHS = "doc_id long, pos long, edges long, owner long, edge long, check int, last_edge long, last_check int"


def scan(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One stored row per document row: its words counted and hashed, and the minimizers of its windows."""
    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return cut_lineage(source.mapInArrow(
        _scan(window, gram), "doc_id long, text_hash long, n_words long, words_sha256 string, prints array<long>"))


def repeated_edges(docs: DataFrame, scanned: DataFrame, window: int, gram: int) -> DataFrame:
    """All occurrences of edges that start in two documents: ``edge, check, doc_id, pos, owner, branches``."""
    long = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # Equal word sequences: the least id stands for all.
    first = cut_lineage(long.groupBy("words_sha256").agg(F.min("doc_id").alias("doc_id")))
    rep = long.join(first, ["words_sha256", "doc_id"]).select("doc_id", "text_hash", "words_sha256", "prints")
    numbered = Window.partitionBy("doc_id").orderBy("words_sha256", "text_hash")
    rep = rep.withColumn("part", F.row_number().over(numbered).cast("long") - 1)
    grams = rep.select("doc_id", "part", "text_hash", F.explode("prints").alias("print"))
    common = cut_lineage(grams.groupBy("print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                         .where("low < high").select("print"))
    wanted = grams.join(common, "print").groupBy("doc_id", "part", "text_hash").agg(F.collect_list("print").alias("prints"))
    wanted = cut_lineage(wanted)
    moved = texts(docs).where(F.col("doc_id").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    moved = moved.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "part", "text", "prints")
    edges = cut_lineage(moved.mapInArrow(_edges(window, gram), "edge long, check int, doc_id long, pos long, around int"))
    before, after = F.shiftrightunsigned("around", 16), F.col("around").bitwiseAND(0xFFFF)
    # A branch: two different words after (or before) the same edge; 0 is the end of a text and counts as a word.
    sums = edges.groupBy("edge", "check").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("high"), F.min(before).alias("b0"), F.max(before).alias("b1"),
        F.min(after).alias("a0"), F.max(after).alias("a1")).where("owner < high")
    branches = F.when(F.col("a0") < F.col("a1"), 1).otherwise(0) + F.when(F.col("b0") < F.col("b1"), 2).otherwise(0)
    sums = cut_lineage(sums.select("edge", "check", "owner", branches.alias("branches")))
    return edges.join(sums, ["edge", "check"]).select("edge", "check", "doc_id", "pos", "owner", "branches")


def find_paths(docs: DataFrame, scanned: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Repeated spans: ``doc_id, pos, edges`` in the copy, ``owner`` and ``source_pos`` in the source.

    ``confirmed`` tells whether the source holds the whole path in one run; a path whose edges the source has in other
    places is repeated all the same, edge by edge.
    """
    found = cut_lineage(repeated_edges(docs, scanned, window, gram))
    copies = found.where("doc_id > owner").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    paths = cut_lineage(copies.select("doc_id", "pos", "owner", "branches", "edge", "check").mapInArrow(_paths, _PATHS))
    source = found.where("doc_id = owner").groupBy("owner", "edge", "check").agg(F.min("pos").alias("at"))
    head = paths.join(source, ["owner", "edge", "check"], "left").withColumnRenamed("at", "source_pos")
    tail = source.select("owner", F.col("edge").alias("last_edge"), F.col("check").alias("last_check"), F.col("at").alias("source_end"))
    both = head.join(tail, ["owner", "last_edge", "last_check"], "left")
    run = F.col("source_end") - F.col("source_pos") == F.col("edges") - 1
    return both.select("doc_id", "pos", "edges", "owner", "source_pos", F.coalesce(run, F.lit(False)).alias("confirmed"))


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, counts, hashes = 0, [], []
            for group in tokens.groups(batch.column("text"), lower=False):
                for i in range(group.last - group.first):
                    size = int(group.bounds[i + 1] - group.bounds[i])
                    marks = np.zeros(size + 1, np.int64)
                    spans = batch.column("spans")[row].values
                    begin = spans.field("pos").to_numpy() % _PART
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + spans.field("edges").to_numpy() + window - 1, -1)
                    gone = np.cumsum(marks)[:size] > 0
                    counts.append(int(gone.sum()))
                    hashes.append(_kept_hash(group, i, ~gone))
                    row += 1
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "n_removed": pa.array(counts, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_removed`` and the hash of the words that stay."""
    text_session(docs.sparkSession)
    scanned = scan(docs, window, gram)
    paths = cut_lineage(find_paths(docs, scanned, window, gram))
    named = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = named.groupBy("words_sha256").agg(F.min("doc_id").alias("first_id"))
    by_text = paths.groupBy("doc_id", F.floor(F.col("pos") / _PART).alias("part")).agg(
        F.collect_list(F.struct("pos", "edges")).alias("spans"))
    # The numbering of the texts of one id, as in repeated_edges.
    rep = named.join(first, "words_sha256").where("doc_id = first_id").select("doc_id", "text_hash", "words_sha256")
    numbered = Window.partitionBy("doc_id").orderBy("words_sha256", "text_hash")
    rep = rep.withColumn("part", F.row_number().over(numbered).cast("long") - 1)
    spans = rep.join(by_text, ["doc_id", "part"]).select("doc_id", "text_hash", "spans")
    moved = texts(docs).where(F.col("doc_id").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    moved = moved.join(cut_lineage(spans).dropDuplicates(["doc_id", "text_hash"]), ["doc_id", "text_hash"])
    partly = moved.mapInArrow(_removed(window), "doc_id long, text_hash long, n_removed long, kept_sha256 string")
    partly = cut_lineage(partly.dropDuplicates(["doc_id", "text_hash"]))
    rows = scanned.select("doc_id", "text_hash", "n_words", "words_sha256").join(first, "words_sha256", "left")
    rows = rows.join(partly, ["doc_id", "text_hash"], "left")
    copied = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    return rows.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"))
