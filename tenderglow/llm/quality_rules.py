"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a text whose measure exceeds a cutoff. For every stratum and rule the labelled good texts that a cutoff
would reject are counted; an exact binomial (Clopper-Pearson) bound limits the true share of good texts rejected, at a
level divided by the number of all (stratum, rule, cutoff) tests. The strictest cutoff whose bound keeps the promise is
taken; where none does, for want of labels, the rule is off. Strata are classes of length in words.

Defined cases: a null text has no words and fails the base; a null ``doc_id`` and repeated rows are kept; labels that
contradict each other count as good; an empty table gives an empty table, and without labels only the base rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import tokens
from tenderglow.llm.common import text_session, texts
from tenderglow.session import cut_lineage

# Symbols counted by the base.
SYMBOLS = b"#*$%&|<>"
#: Lower bounds of the strata, in words.
STRATA = (0, 150, 600)


@dataclass(frozen=True)
class Promise:
    """At most ``share`` of the good texts of a stratum are rejected by all rules together, with probability 1 - ``miss``."""

    share: float = 0.06
    miss: float = 0.05


#: Rules: a measure (numerator, denominator) and the cutoffs tried, from strict to lax.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)),
    "repeats": ("n_repeat_words", "n_words", (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)),
    "capitals": ("n_capitals", "word_chars", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)),
    "shouts": ("n_shouts", "n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)),
    "long_words": ("word_chars", "n_words", (7.5, 8.0, 8.5, 9.0, 10.0, 11.0, 12.0, 15.0, 20.0)),
}

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL, _IS_CAPITAL, _IS_SHOUT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"!")


def _per_document(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[places[1:]] - sums[places[:-1]]


def repeated_words(group: tokens.Words, size: int = 3) -> np.ndarray:
    """Words of each document that lie in a window of ``size`` words found twice or more in it."""
    last = np.repeat(group.bounds[1:], np.diff(group.bounds))
    start = np.arange(len(last))[np.arange(len(last)) + size <= last]
    marks = np.zeros(len(last), bool)
    if len(start):
        grams = tokens.mix(tokens.ngram_hashes(group.hashes, size)[start] ^ tokens.mix(group.doc[start].astype(np.uint64)))
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(size):
            marks[start[twice] + i] = True
    return _per_document(marks, group.bounds)


def _lines(part: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier line."""
    lines = [x for x in part.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[list[np.ndarray]] = [[] for _ in _COUNTS]
        for group in tokens.groups(batch.column("text"), lower=False):
            data, places = group.data, group.offsets
            lead = (data & 0xC0) != 0x80
            ink = ~tokens._SPACE[data]
            lines = np.array([_lines(data[a:b].tobytes()) for a, b in zip(places[:-1], places[1:], strict=True)], np.int64)
            for out, values in zip(parts, (
                    np.diff(group.bounds), _per_document(lead & ink, places), _per_document(_IS_SYMBOL[data], places),
                    lines[:, 1], repeated_words(group), lines[:, 0], _per_document(_IS_CAPITAL[data], places),
                    _per_document(_IS_SHOUT[data], places)), strict=True):
                out.append(values)
        arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in parts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *_COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """One stored row of counts per document row."""
    text_session(docs.sparkSession)
    return cut_lineage(texts(docs).mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)))


def upper_bound(rejected: int, good: int, level: float) -> float:
    """The exact one-sided upper bound of a binomial share."""
    if good == 0 or rejected >= good:
        return 1.0

    def at_most(p: float) -> float:
        # The chance of exactly ``rejected`` is the largest, as p is not below the share; smaller counts add ever less.
        k = rejected
        log = math.lgamma(good + 1) - math.lgamma(k + 1) - math.lgamma(good - k + 1) + k * math.log(p) + (good - k) * math.log1p(-p)
        term = total = math.exp(log)
        while k and term > total * 1e-17:
            term *= k / (good - k + 1) * (1 - p) / p
            total, k = total + term, k - 1
        return total

    low, high = rejected / good, 1.0 - 1e-12
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(max(mid, 1e-300)) > level else (low, mid)
    return high


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def stratum() -> Column:
    out = F.lit(0)
    for i, low in enumerate(STRATA):
        out = F.when(F.col("n_words") >= low, i).otherwise(out)
    return out


def _measure(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def choose_cutoffs(counts: DataFrame, labels: DataFrame, promise: Promise = Promise()) -> dict[tuple[int, str], float]:
    """The cutoff of each stratum and rule that has one. One row of counts per stratum reaches the driver."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = counts.where(~base_failed()).join(good, "doc_id", "left_semi")
    sums = [F.sum((_measure(r) > c).cast("long")).alias(f"{r}_{i}") for r, (_, _, cuts) in RULES.items() for i, c in enumerate(cuts)]
    rows = held.groupBy(stratum().alias("stratum")).agg(F.count("*").alias("good"), *sums).collect()
    tests = len(STRATA) * sum(len(cuts) for _, _, cuts in RULES.values())
    chosen = {}
    for row in rows:
        for rule, (_, _, cuts) in RULES.items():
            for i, cutoff in enumerate(cuts):
                if upper_bound(row[f"{rule}_{i}"], row["good"], promise.miss / tests) <= promise.share / len(RULES):
                    chosen[row["stratum"], rule] = cutoff
                    break
    return chosen


def apply_rules(docs: DataFrame, labels: DataFrame, promise: Promise = Promise()) -> DataFrame:
    """Per document: its counts, ``base_failed``, ``kept``, and ``rejected_by``, the rules that reject it."""
    counts = measure(docs)
    chosen = choose_cutoffs(counts, labels, promise)
    hits = [F.when((stratum() == s) & (_measure(r) > c), F.lit(r)) for (s, r), c in sorted(chosen.items())]
    by = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    out = counts.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def digest(ruled: DataFrame) -> DataFrame:
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
