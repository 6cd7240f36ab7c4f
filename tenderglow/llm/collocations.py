"""Phrase collocations by Rabin-Karp fingerprints.

Texts are cut into pieces at punctuation and line ends, and pieces into words. Prefix polynomials over word hashes give the
fingerprint of every run of words by two subtractions. A pass per phrase length counts fingerprints: equal ones of a task are
added up in numpy, then by ranges of fingerprints, which Spark deals out. Most runs are different ones, so what moves are sorted
fingerprints as packed differences, a row per task and range. A phrase is frequent only if both its parts that are one word
shorter are, so a pass counts only runs whose parts passed; which passed is told by a bit table of fixed size, a filter that lets
some rare runs through and no frequent one be lost. A last pass gives each frequent fingerprint a pointer (the least hash of a
text that has it, so that few texts serve all) and the least and greatest value of a second, unrelated hash. Where that shows
that different phrases share a fingerprint, their occurrences are counted again by their text. Only frequent phrases ever become
text, found by their fingerprint in the texts pointed at; a bit table keeps the other texts from moving.

Defined cases: a null text has no words; a null language is ``und``, and so counts with rows that say ``und``; repeated rows
count as often as they stand; equal scores are ordered by count, then by the phrase's bytes; an empty table gives no rows; no
other column matters. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderglow.llm import tokens
from tenderglow.llm.common import lower_az, text_session
from tenderglow.session import cut_lineage

#: Most bits of the table that tells which shorter phrases are frequent: 16 MB in each worker, whatever the input.
FILTER_BITS = 1 << 27
#: Bits of that table for each frequent phrase while it is smaller.
BITS_EACH = 32
#: Fingerprints that a task holds before it hands them on, and words of the whole table for each range of fingerprints.
HELD = 1 << 19
RANGE_WORDS = 1 << 21

_BLANK, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_ODD = 0xC2B2AE3D27D4EB4F
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Factors of the second hash by a byte's place in its word; longer words use them again.
_PLACES = tokens.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
_BYTES = tokens.mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 50))
#: What the second hash adds to a word by its place in the phrase.
_TURNS = np.arange(64, dtype=np.uint64) * _STEP
_PIECE = 1 << 20

_WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
_PACKED = "part int, rows int, packed binary"


class Prefix:
    """Prefix polynomial of 64-bit values, so the polynomial of any run takes one subtraction and one product."""

    def __init__(self, values: np.ndarray):
        up, self.down = np.full(len(values) + 1, _ODD, np.uint64), np.full(len(values) + 1, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = self.down[0] = 1
        np.cumprod(self.down, out=self.down)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * np.cumprod(up)[:-1], out=self.sums[1:])

    def runs(self, first: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[first + size] - self.sums[first]) * self.down[first]


class Phrases:
    """Words of some consecutive texts: where they stand, how many follow in their piece, and their two hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, bits: int = 64, checked: bool = True):
        low = tokens.LOWER[data]
        cut = _CUT[low]
        ink = ~(_BLANK[low] | cut)
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        padded = np.concatenate([[False], ink, [False]])
        self.start = np.flatnonzero(ink & (~padded[:-2] | edge[:-1]))
        self.end = np.flatnonzero(ink & (~padded[2:] | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.offsets, self.bits = offsets, bits
        self.langs = langs[self.doc]
        count = len(self.start)
        cuts = np.zeros(len(low) + 1, np.int64)
        np.cumsum(cut, out=cuts[1:])
        last = np.ones(count, bool)  # the last word of a piece
        last[:-1] = (cuts[self.start[1:]] != cuts[self.end[:-1]]) | (self.doc[1:] != self.doc[:-1])
        ends = np.flatnonzero(last)
        self.room = ends[np.searchsorted(ends, np.arange(count))] - np.arange(count) + 1 if count else np.zeros(0, np.int64)
        self.second = np.zeros(count, np.uint64)
        words = np.zeros(count, np.uint64)
        at = 0
        while at < count:  # whole words, about a megabyte at a time
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + _PIECE, "right")))
            base = self.start[at]
            part, first, after = low[base:self.end[to - 1]], self.start[at:to] - base, self.end[at:to] - base
            words[at:to] = tokens._hash_piece(part, first, after)
            if not checked:
                at = to
                continue
            place = np.arange(len(part), dtype=np.int64)
            place -= np.repeat(first, np.diff(np.append(first, len(part))))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * _PLACES[place & 0xFFFF], out=sums[1:])
            self.second[at:to] = tokens.mix(sums[after] - sums[first] + (after - first).astype(np.uint64))
            at = to
        self.prefix = Prefix(words)

    def prints(self, first: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the runs of ``size`` words at the given words; the language is part of them."""
        found = tokens.mix(tokens.mix(self.prefix.runs(first, size) ^ self.langs[first]) + np.uint64(size))
        return found >> np.uint64(64 - self.bits)

    def checks(self, first: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(first), np.uint64)
        for i in range(size):
            out += tokens.mix(self.second[first + i] + _TURNS[i])
        return tokens.mix(out ^ self.langs[first]).view(np.int64)

    def passing(self, size: int, known: np.ndarray | None) -> np.ndarray:
        """First words of the runs of ``size`` words in one piece whose parts, one word shorter, are in the filter."""
        first = np.flatnonzero(self.room >= size)
        if known is None:
            return first
        parts = np.flatnonzero(self.room >= size - 1)
        passed = np.zeros(len(self.room) + 1, bool)
        passed[parts] = inside(known, self.prints(parts, size - 1))
        return first[passed[first] & passed[first + 1]]


def inside(known: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether both bits of each fingerprint are set in the filter."""
    mask = np.uint64(len(known) * 64 - 1)
    hit = np.ones(len(prints), bool)
    for slot in _slots(prints, mask):
        hit &= (known[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _slots(prints: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    twice = tokens.mix(prints + _STEP)
    return twice & mask, (twice >> np.uint64(32)) & mask


def build_filter(prints: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the fingerprints (``print``). Tasks find the bits and Spark ors them; at most ``bits`` / 64 rows arrive here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(_slots(batch.column("print").to_numpy().view(np.uint64), np.uint64(bits - 1))))
            bit = np.uint64(1) << (slots & np.uint64(63))
            yield pa.RecordBatch.from_pydict({"word": pa.array((slots >> np.uint64(6)).astype(np.int32)), "bit": pa.array(bit.view(np.int64))})

    set_bits = prints.select("print").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    known = np.zeros(bits // 64, np.uint64)
    known[set_bits.column("word").to_numpy()] = set_bits.column("bit").to_numpy().view(np.uint64)
    return known


def _texts(column: pa.Array, codes: np.ndarray, bits: int, checked: bool = True, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, Phrases]]:
    """First and last row, bytes and phrases of groups of texts of about ``most`` bytes."""
    data, offsets = tokens.buffers(column)
    codes = codes.view(np.uint64)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        part = data[offsets[row]:offsets[last]]
        yield row, last, part, Phrases(part, offsets[row:last + 1] - offsets[row], codes[row:last], bits, checked)
        row = last


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


def _merged(held: list[tuple[np.ndarray, ...]], how: tuple) -> tuple[np.ndarray, ...]:
    """Distinct fingerprints in order, each with its other columns put together by the functions ``how``."""
    prints, *others = (np.concatenate(column) for column in zip(*held, strict=True))
    order, begin = _groups(prints)
    if not len(order):
        return prints, *others
    return prints[order[begin]], *(f.reduceat(x[order], begin) for f, x in zip(how, others, strict=True))


def _pack(prints: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted fingerprints as differences, and their other columns; bytes of equal weight stand together, so that zeros vanish."""
    columns = [np.diff(prints, prepend=np.uint64(0)), *others]
    return pa.compress(b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns), codec="zstd", asbytes=True)


def _unpack(rows: int, packed: bytes, width: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(pa.decompress(packed, decompressed_size=rows * width * 8, codec="zstd"), np.uint8).reshape(width, 8, rows)
    steps, *others = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in data)
    return np.cumsum(steps, dtype=np.uint64), *others


def _dealt(columns: tuple[np.ndarray, ...], bits: int, ranges: int) -> pa.RecordBatch:
    """A packed row for each of the 2**``ranges`` ranges of fingerprints that has any."""
    parts = columns[0] >> np.uint64(bits - ranges) if ranges else np.zeros(len(columns[0]), np.uint64)
    begin = np.flatnonzero(np.diff(parts, prepend=~parts[:1]))
    bounds = [*begin.tolist(), len(parts)]
    packed = [_pack(*(x[a:b] for x in columns)) for a, b in zip(bounds, bounds[1:], strict=False)]
    return pa.RecordBatch.from_pydict({
        "part": pa.array(parts[begin].astype(np.int32)), "rows": pa.array(np.diff(bounds).astype(np.int32)), "packed": pa.array(packed, pa.binary())})


def _handed_on(found: Iterator[tuple[np.ndarray, ...]], how: tuple, bits: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """What a task finds, put together as far as ``HELD`` fingerprints allow, and packed."""
    held, count = [], 0
    for columns in found:
        held.append(columns)
        count += len(columns[0])
        if count >= HELD:
            held = [_merged(held, how)]
            count = len(held[0][0])
            if count >= HELD // 2:
                yield _dealt(held[0], bits, ranges)
                held, count = [], 0
    if count:
        yield _dealt(_merged(held, how), bits, ranges)


_SUM, _RANGE = (np.add,), (np.minimum, np.maximum, np.minimum)


def _together(packed: DataFrame, how: tuple, least: int, names: list[str], ranges: int) -> DataFrame:
    """The packed fingerprints of all tasks put together range by range: ``print`` and ``names``, of which the first is at least ``least``."""
    def put(rows: list) -> pa.RecordBatch:
        columns = _merged([_unpack(n, x, len(how) + 1) for n, x in rows], how)
        keep = columns[1] >= np.uint64(least)
        return pa.RecordBatch.from_pydict({name: pa.array(x[keep].view(np.int64)) for name, x in zip(["print", *names], columns, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # a task has one range or a few, of bounded size, so that Spark need not sort
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "packed")), strict=True):
                held.setdefault(part, []).append(row)
        while held:
            yield put(held.popitem()[1])

    schema = ", ".join(f"{name} long" for name in ["print", *names])
    return packed.repartition(1 << ranges, "part").mapInArrow(run, schema)


def _count(size: int, known, bits: int, ranges: int):
    """Fingerprints of a task with their counts, packed."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        table = None if known is None else known.value
        for batch in batches:
            for _, _, _, phrases in _texts(batch.column("text"), batch.column("code").to_numpy(), bits, checked=False):
                prints, counts = np.unique(phrases.prints(phrases.passing(size, table), size), return_counts=True)
                yield prints, counts.astype(np.uint64)

    return lambda batches: _handed_on(found(batches), _SUM, bits, ranges)


def _point(longest: int, known, bits: int, ranges: int):
    """Fingerprints of the filter that a task has, with the range of the second hash and the least hash of a text, packed."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ats = batch.column("at").to_numpy().view(np.uint64)
            for row, _, _, phrases in _texts(batch.column("text"), batch.column("code").to_numpy(), bits):
                for size in range(1, longest + 1):
                    first = np.flatnonzero(phrases.room >= size)
                    prints = phrases.prints(first, size)
                    keep = inside(known.value, prints)
                    first, prints = first[keep], prints[keep]
                    if not len(first):
                        break
                    checks = phrases.checks(first, size).view(np.uint64)
                    yield _merged([(prints, checks, checks, ats[row + phrases.doc[first]])], _RANGE)

    return lambda batches: _handed_on(found(batches), _RANGE, bits, ranges)


def _pointed(known):
    """The texts whose hash is in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(inside(known.value, batch.column("at").to_numpy().view(np.uint64))))

    return run


def _spell(data: bytes) -> str:
    """The words of a run of bytes, joined by one space."""
    return b" ".join(x for x in data.replace(b"\t", b" ").split(b" ") if x).decode()


def _recount(size: int, known, bits: int):
    """Occurrences whose fingerprint is in the filter, by their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part, phrases in _texts(batch.column("text"), batch.column("code").to_numpy(), bits):
                first = np.flatnonzero(phrases.room >= size)
                prints = phrases.prints(first, size)
                keep = inside(known.value, prints)
                first, prints = first[keep], prints[keep]
                if not len(first):
                    continue
                order, begin = _groups(prints, phrases.checks(first, size))
                lead, low = first[order[begin]], tokens.LOWER[part].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "code": pa.array(phrases.langs[lead].view(np.int64)),
                    "print": pa.array(prints[order[begin]].view(np.int64)),
                    "phrase": pa.array([_spell(low[a:b]) for a, b in zip(phrases.start[lead], phrases.end[lead + size - 1], strict=True)], pa.string()),
                    "n": pa.array(np.diff(np.append(begin, len(order)))),
                })

    return run


def _read(bits: int):
    """Phrases of the texts that are pointed at: each must have the fingerprint that points there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pointers = batch.column("pointers")
            for row, last, part, phrases in _texts(batch.column("text"), batch.column("code").to_numpy(), bits):
                wanted: dict[int, list] = {}
                for doc, of_text in enumerate(pointers.slice(row, last - row).to_pylist()):
                    for p in of_text:
                        wanted.setdefault(p["size"], []).append((doc, p["print"], p["n"]))
                low = tokens.LOWER[part].tobytes()
                for size, asked in wanted.items():
                    docs, prints, counts = (np.array(x, np.int64) for x in zip(*asked, strict=True))
                    first = np.flatnonzero(phrases.room >= size)
                    seen = phrases.prints(first, size).view(np.int64)
                    keep = np.isin(seen, prints)
                    first, seen = first[keep], seen[keep]
                    places = dict(zip(zip(phrases.doc[first].tolist(), seen.tolist(), strict=True), first.tolist(), strict=True))
                    lead = np.array([places.get(x, -1) for x in zip(docs.tolist(), prints.tolist(), strict=True)])
                    if (lead < 0).any():
                        raise RuntimeError("a pointer leads to a text without its phrase")
                    words = [_spell(low[a:b]) for a, b in zip(phrases.start[lead], phrases.end[lead + size - 1], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "code": pa.array(phrases.langs[lead].view(np.int64)), "size": pa.array(np.full(len(lead), size, np.int32)),
                        "phrase": pa.array(words, pa.string()), "n": pa.array(counts)})

    return run


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, bits: int = 64, filter_bits: int = FILTER_BITS,
                     range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that stand at least ``least`` times (``lang, size, phrase, n``), and ``lang, n`` of all words."""
    spark = text_session(docs.sparkSession)
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    source = source.select("lang", "text", F.xxhash64("lang").alias("code"), F.xxhash64("text", "lang").alias("at"))
    totals = cut_lineage(source.groupBy("lang", "code").agg(F.sum(F.regexp_count("text", F.lit(_WORD)).cast("long")).alias("n")))
    source = source.drop("lang")
    words = totals.agg(F.sum("n")).first()[0] or 0
    ranges = min(bits, (words // range_words).bit_length())
    levels, known = [], None
    for size in range(1, longest + 1):
        found = source.select("text", "code").mapInArrow(_count(size, known, bits, ranges), _PACKED)
        levels.append(cut_lineage(_together(found, _SUM, least, ["n"], ranges).withColumn("size", F.lit(size))))
        if known is not None:
            known.unpersist()
        rows = levels[-1].count()
        if not rows:
            break
        known = spark.sparkContext.broadcast(build_filter(levels[-1], _table_bits(rows, filter_bits)))
    kept = cut_lineage(reduce(DataFrame.unionByName, levels))
    known = spark.sparkContext.broadcast(build_filter(kept, _table_bits(kept.count(), filter_bits)))
    found = _together(source.mapInArrow(_point(longest, known, bits, ranges), _PACKED), _RANGE, 0, ["low", "high", "at"], ranges)
    pointed = cut_lineage(kept.join(found, "print"))
    # One fingerprint may even be that of phrases of two lengths; then the place that it points to has one of them only.
    sizes = pointed.groupBy("print").agg(F.count("*").alias("sizes"))
    pointed = cut_lineage(pointed.join(sizes, "print").withColumn("alone", (F.col("low") == F.col("high")) & (F.col("sizes") == 1)))
    several = cut_lineage(pointed.where("NOT alone").select("print", "size"))
    pointed, again = pointed.where("alone"), []
    if not several.isEmpty():
        shared = spark.sparkContext.broadcast(build_filter(several, _table_bits(several.count(), filter_bits)))
        for size in range(1, longest + 1):
            counted = source.mapInArrow(_recount(size, shared, bits), "code long, print long, phrase string, n long")
            counted = counted.join(several.where(F.col("size") == size), "print", "left_semi").groupBy("code", "phrase").agg(F.sum("n").alias("n"))
            again.append(cut_lineage(counted.where(F.col("n") >= least).select("code", F.lit(size).alias("size"), "phrase", "n")))
    pointers = cut_lineage(pointed.groupBy("at").agg(F.collect_list(F.struct("size", "print", "n")).alias("pointers")))
    # A text's copies in a language are one text here, and only texts that hold a pointer (and few others) move.
    ats = pointers.select(F.col("at").alias("print"))
    known = spark.sparkContext.broadcast(build_filter(ats, _table_bits(pointers.count(), filter_bits)))
    chosen = source.mapInArrow(_pointed(known), source.schema).groupBy("at").agg(F.first("text").alias("text"), F.first("code").alias("code"))
    phrases = chosen.join(pointers, "at").select("text", "code", "pointers").mapInArrow(_read(bits), "code long, size int, phrase string, n long")
    phrases = reduce(DataFrame.unionByName, again, phrases)
    return cut_lineage(phrases.join(totals.select("lang", "code"), "code").select("lang", "size", "phrase", "n")), totals.select("lang", "n")


def _table_bits(rows: int, most: int) -> int:
    return min(most, max(1 << 16, 1 << (rows * BITS_EACH).bit_length()))


def _wide(name: str):
    return F.col(name).cast("decimal(19,0)")


def score_phrases(phrases: DataFrame, totals: DataFrame, longest: int = 5) -> DataFrame:
    """Candidates that no equally frequent longer one covers: ``lang, phrase, a, l, r, n, score`` of their lowest-scoring cut.

    A longer candidate that covers one has the same count, and so have all phrases between the two; one word more is enough to look at.
    """
    longer = phrases.where("size >= 3").select("lang", "n", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    open_ones = phrases.where("size >= 2").join(longer, ["lang", "phrase", "n"], "left_anti")
    cuts = open_ones.withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - size)")})
    parts = phrases.where(F.col("size") < longest)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang").withColumn("thousand", F.col("n") * 1000)
    # Products of two longs fit 38 digits; ``div`` drops the fraction.
    cuts = cuts.select("lang", "phrase", "a", "l", "r", "n", "k", F.call_function(
        "div", _wide("a") * _wide("thousand"), _wide("l") * _wide("r")).alias("score"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, bits: int = 64, filter_bits: int = FILTER_BITS,
                 range_words: int = RANGE_WORDS) -> DataFrame:
    """The first ``top`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``."""
    from pyspark.sql import Window

    phrases, totals = frequent_phrases(docs, longest, least, bits, filter_bits, range_words)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = score_phrases(phrases, totals, longest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
