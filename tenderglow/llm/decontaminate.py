"""Benchmark decontamination by winnowing.

The fingerprint of a window of words is the smallest hash among its k-grams. Windows with equal words have equal
fingerprints, so joining fingerprints finds every shared window; a run of windows with the same fingerprint is joined
once. Each joint fingerprint is then extended to its whole windows, which are compared word by word. Benchmark items shorter than a window are one window, found by their first word.

Defined cases: a null or wordless text has no words and no hits; wordless items are left out; an item with a null id
counts for hits but has no name; a repeated item id is named once; repeated document rows each give a row; a null
``doc_id`` is kept; without items nothing is contaminated; other columns are ignored by ``find_overlaps`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow.llm.common import BROADCAST_BYTES, by_row, fits, lower_az, texts
from tenderglow.session import cut_lineage

WINDOW, GRAM = 13, 5
#: Words of a chunk.
STEP = 128
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(text), F.lit(WORD), F.lit(0))


def fingerprints(tokens: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Per window, in order: the smallest hash of the grams in it. Empty for fewer words than a window."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - gram + 1), lambda i: F.xxhash64(F.slice(tokens, i, gram)))
    per = window - gram + 1
    least = F.transform(F.array(grams), lambda g: F.transform(
        F.sequence(F.lit(1), F.size(tokens) - window + 1), lambda i: F.array_min(F.slice(g, i, per))))[0]
    return F.when(F.size(tokens) >= window, least).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: their words joined by spaces, their length, and the sorted ids of the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.coalesce("text", F.lit(""))).alias("w"))
    items = items.where(F.size("w") > 0)
    each = items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    each = each.select("item", F.slice("w", F.col("i"), window).alias("w"))
    return each.groupBy(F.array_join("w", " ").alias("words"), F.size("w").alias("len")).agg(
        F.sort_array(F.collect_set("item")).alias("items"))


def _chunks(docs: DataFrame, window: int, step: int) -> DataFrame:
    """Texts as chunks of ``step`` words and the ``window`` - 1 that follow them; a wordless text has one empty chunk.

    Whatever is exploded later carries a chunk along and not the text, so the work is linear in a text's length.
    """
    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(step))
    parts = F.transform(starts, lambda i: F.struct(i.alias("base"), F.slice("w", i + 1, step + window - 1).alias("w")))
    # Outer, as the plain form adds a filter that splits every text a second time.
    chunks = keyed.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.explode_outer(parts).alias("c"))
    return chunks.select("doc_id", "key", "n_words", "c.base", "c.w")


def _same_row(a: DataFrame, b: DataFrame, how: str, *also: Column) -> DataFrame:
    """Joins on (doc_id, key), where ids may be null."""
    b = b.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    return a.join(b, [a["doc_id"].eqNullSafe(b["_id"]), a["key"] == b["_key"], *also], how).drop("_id", "_key")


def known_marks(windows: DataFrame, window: int, gram: int) -> DataFrame:
    """What can start a window of an item: a fingerprint, or for short windows the hash of the first word; with lengths."""
    first = F.xxhash64(F.substring_index("words", " ", 1))
    least = F.get(fingerprints(F.split("words", " "), window, gram), F.lit(0))
    marks = windows.select(
        F.when(F.col("len") < window, first).otherwise(least).alias("print"), (F.col("len") < window).alias("short"), "len")
    return marks.groupBy("print", "short").agg(F.sort_array(F.collect_set("len")).alias("lens"))


def _marks(tokens: Column, base: Column, window: int, gram: int, step: int, short: bool) -> Column:
    """Marks of a chunk with the first and last place they stand for.

    Winnowing keeps a fingerprint once for each run of windows that share it. With ``short`` every word is a mark too.
    The first chunk of a text starts with a mark that equals nothing and stands for the document itself.
    """

    def mark(value: Column, first: Column, last: Column, word: bool) -> Column:
        return F.struct(value.alias("mark"), first.cast("int").alias("first"), last.cast("int").alias("last"), F.lit(word).alias("word"))

    def runs(m: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: ~F.get(m, i - 1).eqNullSafe(F.get(m, i - 2)))
        return F.transform(F.array(places), lambda at: F.transform(at, lambda i, j: mark(
            F.get(m, i - 1), i, F.coalesce(F.get(at, j + 1) - 1, F.size(m)), False)))[0]

    nothing = F.array(mark(F.lit(None).cast("long"), F.lit(0), F.lit(0), False))
    least = F.transform(F.array(fingerprints(tokens, window, gram)), lambda m: F.when(F.size(m) > 0, runs(m)))[0]
    parts = [F.when(base == 0, nothing), least]
    if short:
        parts.append(F.transform(F.slice(tokens, 1, step), lambda w, j: mark(F.xxhash64(w), j + 1, j + 1, True)))
    return F.flatten(F.array_compact(F.array(*parts)))


def candidates(docs: DataFrame, windows: DataFrame, window: int, gram: int, most: int, step: int = STEP) -> DataFrame:
    """Per document a row with ``pos`` 0, and a row for each place that an item's window may be at: place, length, words."""
    known = cut_lineage(known_marks(windows, window, gram))
    chunks = _chunks(docs, window, step)
    short = not known.where("short").isEmpty()
    marks = _marks(F.col("w"), F.col("base"), window, gram, step, short)
    same = (F.col("mark") == F.col("print")) & (F.col("word") == F.col("short"))
    place = F.struct("first", "last", "lens")
    if fits(known, 16 + 4 * window, most):
        rows = chunks.select("doc_id", "key", "n_words", "base", "w", F.explode_outer(marks).alias("m"))
        rows = rows.select("doc_id", "key", "n_words", "base", "w", "m.*")
        met = rows.join(F.broadcast(known), same, "left").where((F.col("first") == 0) | F.col("lens").isNotNull())
        met = met.select("doc_id", "key", "n_words", "base", "w", place.alias("place"))
    else:
        # Too many for a broadcast: narrow rows meet in a shuffle, then the chunks with hits move once.
        narrow = chunks.select("doc_id", "key", "base", F.explode_outer(marks).alias("m")).select("doc_id", "key", "base", "m.*")
        places = narrow.where("first > 0").join(known, same).groupBy("doc_id", "key", "base").agg(F.collect_set(place).alias("places"))
        places = places.withColumnRenamed("base", "_base")
        hit = _same_row(chunks, places, "inner", F.col("base") == F.col("_base"))
        itself = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(None).cast("array<int>").alias("lens"))
        met = hit.select("doc_id", "key", "n_words", "base", "w", F.explode("places").alias("place")).unionByName(
            chunks.where("base = 0").select("doc_id", "key", "n_words", "base", "w", itself.alias("place")))
    starts = F.flatten(F.transform(F.sequence("place.first", "place.last"), lambda p: F.transform(
        F.coalesce("place.lens", F.array(F.lit(0))), lambda n: F.struct(p.alias("at"), n.alias("len")))))
    found = met.select("doc_id", "key", "n_words", "base", "w", F.explode(starts).alias("s"))
    shown = F.when(F.col("s.at") > 0, F.array_join(F.slice("w", F.greatest("s.at", F.lit(1)), F.col("s.len")), " ")).otherwise("")
    pos = F.when(F.col("s.at") > 0, F.col("base") + F.col("s.at")).otherwise(0)
    return found.select("doc_id", "key", "n_words", pos.alias("pos"), "s.len", shown.alias("words"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  most: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: ``n_words``, ``n_hit`` (words inside a shared window) and ``items`` (sorted ids as strings).

    ``most`` bounds the bytes of a broadcast fingerprint table; beyond it the join is shuffled, with equal results.
    """
    windows = cut_lineage(item_windows(benchmark, window))
    rows = cut_lineage(candidates(docs, windows, window, gram, most))
    exact = rows.where(F.col("pos") > 0).join(windows, ["words", "len"])
    spans = F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))))
    hits = exact.groupBy("doc_id", "key").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    union = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"),
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["pos"], acc["end"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
    hits = hits.select("doc_id", "key", union.alias("n_hit"), F.sort_array("items").alias("items"))
    all_rows = rows.where(F.col("pos") == 0).select("doc_id", "key", "n_words")
    return _same_row(all_rows, hits, "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The documents, all columns, without contaminated ones."""
    found = find_overlaps(docs, benchmark, **options).where(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = cut_lineage(found.select("doc_id", F.col("key").alias("text_hash")).distinct())
    return by_row(docs, bad, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
