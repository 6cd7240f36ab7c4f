"""Near-duplicate embeddings by PCA-ordered tiled comparison.

One pass sums the second moments of all unit vectors; its eigenvectors, most weight first, turn every vector so that the
leading dimensions carry most of a product. Vectors of one label are dealt into blocks of bounded size, and each two blocks are a
tile. In a tile products are summed over a few dimensions at a time. After each step the rest of a product is at most the
product of the two suffix norms; a pair that cannot reach the threshold any more is given up, and a tile ends when no pair is
left. Pairs within rounding of the threshold are computed again from the vectors as given.

A tile returns no pairs: it counts the links of each vector and gives edges that join what is linked, at most one per vector.
Copies of a vector are one row with a weight before all this. Work within a label still grows with the square of its different
vectors, as the exact comparison must; tiles keep memory bounded and spread it, and the first dimensions end most of it.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite component links with nothing, nor does one without
label; vectors are compared at equal lengths only; a row without ``vec_id`` is not compared, and its ``component_id`` is null;
repeated rows count once as others' links and each return a row; rows that share an id but not a vector are links of their own and
one node of the components; an empty table gives no rows; no other column matters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import components
from tenderglow.llm.common import text_session
from tenderglow.session import cut_lineage

#: Bytes of one block of vectors in double precision, and its most and least rows.
BLOCK_BYTES, MOST_ROWS, LEAST_ROWS = 8 << 20, 4096, 64
#: Rows of a block that are compared with the other block at a time.
STRIP = 256
#: Bytes of all rotations; lengths beyond it are compared without one, which prunes less and finds the same.
ROTATION_BYTES = 64 << 20
#: Products this near to the threshold are computed again from the given components.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for components of any size."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` and ``b``, one by one."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of a task's unit vectors, a row of the matrix per row."""
    sums: dict[int, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        parts = [(n, i, row) for n, m in sums.items() for i, row in enumerate(m)]
        return pa.RecordBatch.from_pydict({
            "dims": pa.array([p[0] for p in parts], pa.int32()), "i": pa.array([p[1] for p in parts], pa.int32()),
            "row": pa.array([p[2] for p in parts], pa.list_(pa.float64()))})

    held = 0
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for n in np.unique(dims):
            v = unit(_matrix(batch.column("vector").filter(pa.array(dims == n))))
            held += 0 if n in sums else n * n * 8
            sums[int(n)] = sums.get(int(n), 0) + v.T @ v
            if held > ROTATION_BYTES:
                yield rows()
                sums, held = {}, 0
    if sums:
        yield rows()


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent lengths, as far as they fit into ``ROTATION_BYTES``, the eigenvectors of all vectors' second moments."""
    lengths = vectors.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1000).collect()
    room, chosen = ROTATION_BYTES, []
    for r in lengths:
        if r.dims * r.dims * 8 <= room:
            chosen.append(r.dims)
            room -= r.dims * r.dims * 8
    sums = vectors.where(F.col("dims").isin(chosen)).select("dims", "vector").mapInArrow(_moments, "dims int, i int, row array<double>")
    cells = sums.select("dims", "i", F.posexplode("row").alias("j", "x")).groupBy("dims", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    dims, i, j, x = (cells.column(c).to_numpy() for c in ("dims", "i", "j", "x"))
    out = {}
    for n in chosen:
        own = dims == n
        matrix = np.zeros((n, n))
        matrix[i[own], j[own]] = x[own]
        _, axes = np.linalg.eigh((matrix + matrix.T) / 2)
        out[n] = np.ascontiguousarray(axes[:, ::-1])  # most weight first
    return out


def steps(dims: int) -> list[int]:
    """Where the sums stop to look at the bound: a few leading dimensions, then twice as many each time."""
    out, at = [], min(8, dims)
    while at < dims:
        out.append(at)
        at *= 2
    return [*out, dims]


def _linked(x: np.ndarray, y: np.ndarray, rest_x: np.ndarray, rest_y: np.ndarray, cuts: list[int], least: float):
    """Row and column numbers of pairs that may reach ``least``, and their products: dense while many pairs are left, then pair by pair."""
    done, last = cuts[0], cuts[-1]
    sums = x[:, :done] @ y[:, :done].T
    for k, at in enumerate(cuts):
        if at > done:
            sums += x[:, done:at] @ y[:, done:at].T
            done = at
        alive = sums >= least - SLACK - (np.outer(rest_x[k], rest_y[k]) if at < last else 0.0)
        left = np.count_nonzero(alive)
        if not left or at == last or left * 20 < alive.size:
            break
    row, col = np.nonzero(alive)
    product = sums[row, col]
    for k, at in enumerate(cuts):
        if at <= done or not len(row):
            continue
        for lo in range(0, len(row), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            product[part] += (x[row[part], done:at] * y[col[part], done:at]).sum(axis=1)
        done = at
        keep = product >= least - SLACK - (rest_x[k][row] * rest_y[k][col] if at < last else 0.0)
        row, col, product = row[keep], col[keep], product[keep]
    return row, col, product


def compare(given: np.ndarray, second: np.ndarray, weight: np.ndarray, same: bool, turn: np.ndarray | None, least: float):
    """Links between two blocks (or within one): weights of linked vectors for every row, and edges that connect what is linked."""
    split = int(np.searchsorted(second, 1))
    turned = unit(given)
    if turn is not None:
        turned = turned @ turn
    cuts = steps(given.shape[1])
    squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
    rest = [np.sqrt(squares[:, at]) if at < given.shape[1] else np.zeros(len(given)) for at in cuts]
    links, label = np.zeros(len(given), np.int64), np.arange(len(given))
    rows = len(given) if same else split
    for at in range(0, rows, STRIP):
        to, first = min(at + STRIP, rows), at if same else split  # within one block a pair is looked at once
        row, col, product = _linked(turned[at:to], turned[first:], [r[at:to] for r in rest], [r[first:] for r in rest], cuts, least)
        row, col = row + at, col + first
        if same:
            row, col, product = (z[row < col] for z in (row, col, product))
        close = np.flatnonzero(np.abs(product - least) <= 2 * SLACK)
        for part in np.array_split(close, max(1, len(close) >> 14)):
            product[part] = cosine(given[row[part]], given[col[part]])
        row, col = row[product >= least], col[product >= least]
        links += np.bincount(row, weight[col], len(links)).astype(np.int64)
        links += np.bincount(col, weight[row], len(links)).astype(np.int64)
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        for b, e in zip(begin, np.append(begin, len(row))[1:], strict=True):
            met = np.unique(label[np.append(col[b:e], row[b])])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return links, label


def _tiles(turns, least: float):
    """Links and edges of every tile; rows come sorted by tile and block, and a tile may go on in the next batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            ids = table.column("node").to_numpy()
            links, label = compare(
                _matrix(table.column("vector")), table.column("second").to_numpy(), table.column("weight").to_numpy(),
                bool(table.column("same")[0].as_py()), turns.value.get(table.column("dims")[0].as_py()), least)
            keep = np.flatnonzero(links)
            return pa.RecordBatch.from_pydict({
                "key": table.column("key").combine_chunks().take(pa.array(keep)), "links": pa.array(links[keep]),
                "a": pa.array(ids[label[keep]]), "b": pa.array(ids[keep])})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            tiles = batch.column("tile").dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1), len(tiles)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and held[0].column("tile")[0] != batch.column("tile")[lo]:
                    yield flush(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush(held)

    return run


def comparable(vector: Column, label: Column, vec_id: Column) -> Column:
    """Whether a row has an id, a label, and a vector with a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def find_links(vectors: DataFrame, threshold: float = 0.98, block_bytes: int = BLOCK_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id`` for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = text_session(vectors.sparkSession)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    given = given.select("vec_id", "vector", "label", comparable(F.col("vector"), F.col("label"), F.col("vec_id")).alias("usable"))
    # 0.0 and -0.0 are one number, so copies differ in no bit that matters; 128 bits of hash name a vector.
    even = F.transform("vector", lambda x: x + F.lit(0.0))
    name = F.struct(F.xxhash64(F.lit(1), "label", even), F.xxhash64("label", F.lit(2), even, F.size("vector")))
    given = given.withColumn("key", F.when(F.col("usable"), F.to_json(name)))
    rows = cut_lineage(given.select("vec_id", "key"))
    # Copies and repeated rows: one row per vector, its weight the number of its ids.
    ids = rows.where(F.col("key").isNotNull()).distinct()
    weights = ids.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    single = given.where("usable").groupBy("key").agg(F.first("vector").alias("vector"), F.first("label").alias("label"))
    single = cut_lineage(single.join(weights, "key").withColumn("dims", F.size("vector")))
    turns = rotations(single)
    shared = spark.sparkContext.broadcast(turns)
    pairs = cut_lineage(tiles(single, turns, block_bytes, most_rows).repartition("tile").sortWithinPartitions("tile", "second").mapInArrow(
        _tiles(shared, threshold), "key string, links long, a long, b long"))
    links = pairs.groupBy("key").agg(F.sum("links").alias("links"))
    # Ids of one vector are linked with each other, and so is each with all links of the vector.
    copies = ids.join(weights.where("weight > 1"), "key").where("vec_id <> node").select(F.col("node").alias("a"), F.col("vec_id").alias("b"))
    edges = pairs.select("a", "b").unionByName(copies).where("a <> b")
    labels = components.connect(spark, edges).withColumnRenamed("doc_id", "vec_id")
    counted = weights.join(links, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(counted, "key", "left").join(labels, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def tiles(single: DataFrame, turns: dict[int, np.ndarray], block_bytes: int, most_rows: int) -> DataFrame:
    """Every vector once per tile of its label: ``tile, second, same, key, node, weight, dims, vector``.

    A label's rows are counted and a hash deals them into as many blocks as they need, so blocks are about equal and no label
    comes into one task.
    """
    fit = F.least(F.lit(most_rows), F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(block_bytes) / (F.col("dims") * 8))))
    sizes = single.groupBy("label", "dims").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / fit).cast("int"))
    dealt = single.join(sizes.drop("size"), ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return each.select(
        F.to_json(F.struct("label", "dims", low.alias("low"), high.alias("high"))).alias("tile"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("second"),
        (F.col("own") == F.col("other")).alias("same"), "key", "node", "weight", "dims", "vector")


def digest(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
