"""Near duplicates by a chosen-path set similarity join.

Each document is the set of its word shingles, and a fixed number of minwise tokens stands for the set. A tree starts
with all documents in one node; a node that is too large picks one or two positions of the minwise list and its
documents branch by the token there, so a similar pair stays together in some child with high probability. Small nodes
compare their documents exhaustively. Independent trees repeat this until the target recall is reached. Links are
confirmed on the full shingle sets.

Sets that are equal are one class before any of this, so exact copies cost nothing. Two passes keep dense groups of
near copies linear: the first links each document to a leader of its node; in the second, nodes whose documents are all
connected are closed, the others are compared, in blocks if they are large, and only documents not yet connected. This loses
no component.

Defined cases: without words the set is empty and linked with nothing; with fewer words than a shingle the whole sequence
is one shingle; repeated ``doc_id`` rows each give a row, judged by its own text; a row without ``doc_id`` has no name to be
linked by, so its ``component_id`` is null, but ``drop_duplicates`` drops it if a row with an id has the same set, and keeps one
row of equal texts without an id; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import components, tokens
from tenderglow.llm.common import by_row, fits, text_session, texts
from tenderglow.session import cut_lineage

#: Minwise tokens per set.
SKETCH = 128
#: Largest node whose documents are compared exhaustively.
NODE = 1000
#: Levels of every tree; a node that is still too large then is compared in blocks, so recall does not depend on the input's size.
DEPTH = 3
#: Shingles of all sets that one node brings into a task; beyond it the node is dealt into tiles.
SET_TOKENS = 1 << 19
#: Bytes of texts that are shingled at a time.
GROUP_BYTES = 1 << 20
#: Bytes of each matrix that a node's comparison holds.
MATRIX_BYTES = 8 << 20


def least_similar(similarity: float) -> float:
    """Share of equal minwise tokens below which two sketches are not looked at further."""
    return similarity - 5.5 * math.sqrt(similarity * (1 - similarity) / SKETCH)


def missed(trees: int, similarity: float, depth: int = DEPTH) -> float:
    """Chance that a pair of exactly the given similarity meets in none of the trees, or looks too unlike where it does.

    All trees draw from one sketch, so they are independent only once its number of equal tokens is given.
    """
    part = (1 / similarity - 1) * (1 - 1 / SKETCH)  # how often a node picks a second, other position
    total = 0.0
    for equal in range(SKETCH + 1):
        share, apart = equal / SKETCH, 0.0
        for _ in range(depth):
            lost = 1 - share + share * apart
            apart = (1 - part) * lost + part * lost * lost
        chance = math.comb(SKETCH, equal) * similarity ** equal * (1 - similarity) ** (SKETCH - equal)
        total += chance * (1.0 if share < least_similar(similarity) else apart ** trees)
    return total


def trees_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """Trees for which a pair of exactly the given similarity is found with the wanted probability at the given depth."""
    for trees in range(1, 1000):
        if missed(trees, similarity, depth) <= 1 - recall:
            return trees
    raise ValueError("a sketch of this size cannot reach the wanted recall")


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one document, sorted."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < size:
        return tokens.ngram_hashes(hashes, len(hashes), seed=len(hashes))
    return np.unique(tokens.ngram_hashes(hashes, size))


_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """For each of the permutations the least 32-bit value over the set."""
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096]
        values = ((part[:, None] * _FACTORS + _SHIFTS) >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, values.min(axis=0), out=out)
    return out


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            ids = batch.column("doc_id")
            counts, keys, mins = [], [], []
            for group in tokens.groups(batch.column("text"), lower=True, most=GROUP_BYTES):
                for i in range(group.last - group.first):
                    found = shingle_set(group.hashes[group.of(i)], size)
                    counts.append(len(found))
                    keys.append(blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None)
                    mins.append(minwise(found).tobytes() if len(found) else None)
            columns = {"doc_id": ids, "text_hash": batch.column("text_hash"),
                       "n_shingles": pa.array(counts, pa.int64()), "key": pa.array(keys, pa.string())}
            columns["sketch"] = pa.array(mins, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _positions(node: np.ndarray, level: int, part: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document of a node the positions that its node picks: rows and positions, the second choice only for some."""
    draw = tokens.mix(node + np.uint64(level * 2 + 1))
    first = (draw % np.uint64(SKETCH)).astype(np.int64)
    second = ((draw >> np.uint64(8)) % np.uint64(SKETCH)).astype(np.int64)
    more = ((draw >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float64) / (1 << 24) < part
    rows = np.arange(len(node))
    more &= second != first
    return [(rows, first), (rows[more], second[more])]


def _branch(node: np.ndarray, sketches: np.ndarray, level: int, part: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of the documents' nodes: document rows and the child's name, a hash of its whole path."""
    rows, names = [], []
    for row, position in _positions(node, level, part):
        value = sketches[row, position].astype(np.uint64)
        rows.append(row)
        names.append(tokens.mix(tokens.mix(node[row] * np.uint64(0xD6E8FEB86659FD93) + position.astype(np.uint64)) ^ value))
    return np.concatenate(rows), np.concatenate(names)


def _roots(trees: int, levels: int, part: float):
    """Each document with its nodes at the first ``levels`` levels of every tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = tokens.mix(np.arange(1, trees + 1, dtype=np.uint64))
        for batch in batches:
            ids, sketches = batch.column("doc_id").to_numpy(), _stacked(batch.column("sketch"))
            row, node = np.repeat(np.arange(len(ids)), trees), np.tile(seeds, len(ids))
            for level in range(levels):
                keep, node = _branch(node, sketches[row], level, part)
                row = row[keep]
            yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "doc_id": pa.array(ids[row])})

    return run


def _deeper(level: int, part: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, node = batch.column("doc_id").to_numpy(), batch.column("node").to_numpy().view(np.uint64)
            row, child = _branch(node, _stacked(batch.column("sketch")), level, part)
            yield pa.RecordBatch.from_pydict({"node": pa.array(child.view(np.int64)), "doc_id": pa.array(ids[row])})

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """Nodes of at least two documents, with their size."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "node")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes whose documents are not all connected: ``node, doc_id, label, size`` and ``work``, the pairs not yet connected.

    ``rows`` has ``node, doc_id``. Dense groups of near copies are one component by now, so their nodes are closed here.
    """
    named = labels.select("doc_id", F.col("component_id").alias("label"))
    rows = rows.join(named, "doc_id", "left").select("node", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    rows = cut_lineage(rows)
    parts = rows.groupBy("node", "label").agg(F.count("*").cast("double").alias("n"))
    sizes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("inner"), F.count("*").alias("parts"))
    sizes = sizes.where("parts > 1").select("node", "size", ((F.col("size") * F.col("size") - F.col("inner")) / 2).alias("work"))
    return rows.join(sizes, "node")


def leaves(roots: DataFrame, sketched: DataFrame, labels: DataFrame, part: float, level: int, node: int = NODE,
           depth: int = DEPTH) -> DataFrame:
    """``node, doc_id, label`` of all nodes that are small, or have little left to compare, in all trees.

    Other nodes branch on. A node that is still too large at the last level is dealt into blocks: every pair of blocks is a
    leaf, so no pair of documents is lost and none meets in a task with more than two blocks.
    """
    done, rows = [], roots
    while True:
        sized = cut_lineage(_open(rows, labels))
        small = (F.col("size") <= node) | ((F.col("work") <= node * node / 2) & (F.col("size") <= 8 * node))
        done.append(sized.where(small).select("node", "doc_id", "label"))
        large = sized.where(~small)
        if large.isEmpty():
            break
        if level >= depth:
            done.append(_tiles(large, node))
            break
        rows = large.select("node", "doc_id").join(sketched, "doc_id").select("node", "doc_id", "sketch").mapInArrow(
            _deeper(level, part), "node long, doc_id long").distinct()
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _blocks(node: int):
    return F.ceil(F.col("size") / node).cast("int"), lambda blocks: F.pmod(F.xxhash64("node", "doc_id"), blocks).cast("int")


def _tiles(large: DataFrame, node: int) -> DataFrame:
    """Documents of large nodes, once per tile: blocks by hash, a tile for each two blocks."""
    blocks, own = _blocks(max(node // 2, 1))  # ``size`` may count documents or shingles
    dealt = large.select("node", "doc_id", "label", blocks.alias("blocks"), own(blocks).alias("own"))
    each = dealt.select("node", "doc_id", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tile = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return each.select(tile.alias("node"), "doc_id", "label")


def _by_node(columns: tuple[str, ...], work, schema: tuple[str, ...]):
    """Runs ``work`` on the rows of every node; rows come sorted by node, a node may go on in the next batch.

    ``work`` takes one list or array per column and returns rows of ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(rows[0])) + 1
            found = []
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows[0])]]), strict=True):
                if hi - lo > 1:
                    found += work(*(x[lo:hi] for x in rows))
            out = np.array(found, np.int64).reshape(-1, len(schema))
            return pa.RecordBatch.from_pydict({n: pa.array(out[:, i].copy()) for i, n in enumerate(schema)})

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [_column(batch.column(c)) for c in columns]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield flush([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield flush(held)

    return run


def _column(column: pa.Array) -> np.ndarray:
    """Numbers as they are, sketches as a table of their low bytes, sets as byte strings."""
    if pa.types.is_binary(column.type):
        # The low byte of each token is enough to estimate a similarity.
        return _stacked(column).astype(np.uint8)
    if pa.types.is_list(column.type):
        out = np.empty(len(column), object)
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        out[:] = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out
    return column.to_numpy()


def _leaders(least: float):
    """Pass 1: documents of a node join the first leader that looks similar, or become leaders."""
    def work(node: np.ndarray, ids: np.ndarray, short: np.ndarray) -> list[tuple[int, int]]:
        out, left = [], np.argsort(ids, kind="stable")
        while len(left) > 1:
            near = (short[left[1:]] == short[left[0]]).mean(axis=1) >= least
            out += [(ids[left[0]], ids[j]) for j in left[1:][near]]
            left = left[1:][~near]
        return out

    return work


def _hopeful(least: float):
    """Pass 2: the documents of a node that look similar to one they are not connected with."""
    def work(node: np.ndarray, label: np.ndarray, ids: np.ndarray, short: np.ndarray) -> list[tuple[int, int, int]]:
        near = np.zeros(len(ids), bool)
        names, which, often = np.unique(label, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(which != often.argmax()):  # the largest component compares with the others only
            hit = (label != label[i]) & ((short == short[i]).mean(axis=1) >= least)
            near |= hit
            near[i] |= hit.any()
        return [(node[0], label[i], ids[i]) for i in np.flatnonzero(near)]

    return work


def _linked(percent: int):
    """Pass 2: links between components, confirmed on the full sets; one for each two components is enough."""
    def work(node: np.ndarray, label: np.ndarray, ids: np.ndarray, sets: np.ndarray) -> list[tuple[int, int]]:
        _, which, often = np.unique(label, return_inverse=True, return_counts=True)
        rows = np.flatnonzero(which != often.argmax())
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, token, uses = np.unique(np.concatenate(list(sets)), return_inverse=True, return_counts=True)
        common = uses > 1
        row, token = row[common[token]], (np.cumsum(common) - 1)[token[common[token]]]
        order = np.argsort(token, kind="stable")
        row, token, found = row[order], token[order], {}
        wide = max(16, MATRIX_BYTES // (4 * len(sets)))  # columns of one part, rows of one slice
        for lo in range(0, len(rows), wide):
            own = rows[lo:lo + wide]
            both = np.zeros((len(own), len(sets)), np.float32)
            for at in range(0, int(common.sum()), wide):
                first, last = np.searchsorted(token, [at, at + wide])
                part = np.zeros((len(sets), wide), np.float32)
                part[row[first:last], token[first:last] - at] = 1
                both += part[own] @ part.T
            # Counts are whole numbers far below 2**24, so these products are exact in double precision.
            union = size[own][:, None] + size[None, :] - both.astype(np.float64)
            hit = (100 * both.astype(np.float64) >= percent * union) & (label[own][:, None] != label[None, :])
            for i, j in zip(*np.nonzero(hit), strict=True):
                a, b = sorted(((label[own[i]], ids[own[i]]), (label[j], ids[j])))
                found.setdefault((a[0], b[0]), (a[1], b[1]))
        return list(found.values())

    return work


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


def star_pairs(roots: DataFrame, sketched: DataFrame, least: float, node: int = NODE) -> DataFrame:
    """Pairs of a document and a leader of its node; a large node is dealt into blocks, other trees deal it otherwise."""
    blocks, own = _blocks(node)
    dealt = roots.select(F.xxhash64("node", own(blocks)).alias("node"), "doc_id")
    rows = dealt.join(sketched.select("doc_id", "sketch"), "doc_id").select("node", "doc_id", "sketch")
    pairs = _sorted(rows).mapInArrow(_by_node(("node", "doc_id", "sketch"), _leaders(least), ("a", "b")), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_links(nodes: DataFrame, sketched: DataFrame, reps: DataFrame, size: int, percent: int, least: float) -> DataFrame:
    """Confirmed links between documents of ``nodes`` (node, doc_id, label) with different labels, ``a, b``.

    Only documents that look similar to an unconnected one bring their sets, and they bring them to the node, not to every
    pair. A node whose sets are too large for a task is dealt into tiles.
    """
    rows = nodes.join(sketched.select("doc_id", "sketch"), "doc_id").select("node", "label", "doc_id", "sketch")
    names = ("node", "label", "doc_id")
    hope = _sorted(rows).mapInArrow(_by_node((*names, "sketch"), _hopeful(least), names), "node long, label long, doc_id long")
    hope = cut_lineage(hope.distinct())
    members = cut_lineage(hope.select("doc_id").distinct())
    sets = cut_lineage(set_table(reps, members, size))
    weights = hope.join(sets.select("doc_id", F.size("shingles").alias("n")), "doc_id").groupBy("node").agg(F.sum("n").alias("size"))
    sized = hope.join(cut_lineage(weights), "node")
    light = sized.where(F.col("size") <= SET_TOKENS).select("node", "doc_id", "label")
    dealt = light.unionByName(_tiles(sized.where(F.col("size") > SET_TOKENS), SET_TOKENS))
    rows = dealt.join(sets, "doc_id").select("node", "label", "doc_id", "shingles")
    return _sorted(rows).mapInArrow(_by_node((*names, "shingles"), _linked(percent), ("a", "b")), "a long, b long").distinct()


def set_table(reps: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``doc_id, shingles`` of the wanted documents."""
    wanted = F.broadcast(members) if fits(members, 16) else members
    return reps.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, shingles array<long>")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(g.hashes[g.of(i)], size).view(np.int64)
                     for g in tokens.groups(batch.column("text"), lower=True, most=GROUP_BYTES) for i in range(g.last - g.first)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "shingles": pa.array(found, pa.list_(pa.int64()))})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(_column(batch.column("x")), _column(batch.column("y")), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity. ``reps`` has ``doc_id, text`` of every class once."""
    members = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut_lineage(set_table(reps, members, size))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def find_components(docs: DataFrame, size: int = 2, percent: int = 80, recall: float = 0.99999) -> DataFrame:
    """Per document row: ``doc_id``, ``text_hash``, ``n_shingles``, ``key`` of its set, ``component_id``, the least id reachable,
    and ``class_id``, which also rows without an id have if their set does.

    ``recall`` is the wanted probability that a pair of exactly the limit similarity is found, see ``missed``.
    """
    similarity = percent / 100
    spark = text_session(docs.sparkSession, "2m")
    source = texts(docs)
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    rows = cut_lineage(hashed.mapInArrow(_sketches(size), "doc_id long, text_hash long, n_shingles long, key string, sketch binary"))
    # A set's class is named by its least id; an id with several texts may name several sets.
    named = rows.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    classes = cut_lineage(named.groupBy("key").agg(F.min("doc_id").alias("rep")))
    sketched = cut_lineage(named.join(classes.withColumnRenamed("rep", "doc_id"), ["key", "doc_id"]).select("doc_id", "sketch"))
    part, level = 1 / similarity - 1, DEPTH
    least = least_similar(similarity)
    roots = sketched.mapInArrow(_roots(trees_for(recall, similarity), level, part), "node long, doc_id long")
    roots = cut_lineage(_shared(roots))
    reps = source.where(F.col("doc_id").isNotNull())
    links = cut_lineage(confirmed(cut_lineage(star_pairs(roots, sketched, least)), reps, size, percent))
    labels = components.connect(spark, links)
    nodes = leaves(roots.select("node", "doc_id"), sketched, labels, part, level)
    more = cut_lineage(open_links(nodes, sketched, reps, size, percent, least))
    if not more.isEmpty():
        labels = components.extend(spark, labels, more)
    named_class = classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "key", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "key").join(named_class, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "key", F.col("component_id").alias("class_id"), own.alias("component_id"))


def drop_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, recall: float = 0.99999) -> DataFrame:
    """One document of each component, all columns kept; of repeated rows one stays."""
    found = cut_lineage(find_components(docs, size, percent, recall))
    group = F.coalesce("component_id", "class_id", "doc_id").cast("string")
    group = F.coalesce(group, F.concat(F.lit("text "), F.col("text_hash").cast("string")))
    # Rows without an id come last.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    chosen = found.groupBy(group.alias("group")).agg(F.min(order).alias("row"), F.count("*").alias("rows"))
    stay = by_row(docs, cut_lineage(chosen.select("row.doc_id", "row.text_hash")), "left_semi")
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    return stay if again.isEmpty() else stay.dropDuplicates(["doc_id", "text"])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
