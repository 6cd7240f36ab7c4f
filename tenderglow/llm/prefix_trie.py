"""Prefix trie of conversations, its subtree totals by time-forward processing.

Each conversation is first rebuilt: it starts with the first turns of a shared base conversation and goes on with its own. A
turn is named by 128 bits of hash, and so is a sequence of turns, by combining what each turn gives at its place; equal
sequences are one node, found by an aggregate that combines map-side.

Subtree totals travel upwards. Spark sorts the nodes of a shard externally, deepest first; a task reads them in that order, takes
the messages that children have left for a node out of a priority queue, and leaves one for the node's parent. The queue holds a
bounded number of messages and spills sorted runs. A shard is a subtree small enough for one task, or a band of
levels of the few nodes above those. Totals that leave a shard are added up by Spark for the parent in another: first from the
subtrees, then across the roots of the bands, which form a small tree of their own.

Which subtree is small is known before it is counted: a node has at most as many nodes below it as its members have turns
left. The limit of a shard grows with the square root of the turns, so both the shards and the part above them do.

Defined cases: rows without ``conv_id`` belong to no conversation; turns are ordered by ``turn``, null first, equal ones by the
hash of role and text; a null role or text is empty; a repeated row is one more turn; an empty table has no nodes, not even a root;
no other column matters. Texts and conversations of any length are taken whole.
"""

from __future__ import annotations

import heapq
import math
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderglow.llm.common import text_session
from tenderglow.session import cut_lineage

#: Turns of a conversation whose running hashes are made in one group of a window.
CHUNK = 4096
#: Messages that a priority queue holds in memory.
QUEUE = 200_000
#: Least limit of a shard's nodes.
LEAST_SHARD = 256

_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ("depth", "p1", "p2")


class SpillingQueue:
    """Priority queue of (rank, key, values) that keeps a bounded number in memory and the rest in sorted runs.

    Runs are unnamed files in Spark's own local folders, where its sorts spill too; they vanish with the task.
    """

    _FORM = struct.Struct("<q16sqqq")

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs = max(2, most), [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        """The later half goes to a run, the earlier half stays."""
        ordered = sorted(self.heap)
        self.heap = ordered[:len(ordered) // 2]  # a sorted list is a heap
        self._write(ordered[len(ordered) // 2:])
        if len(self.runs) > 64:
            runs, self.runs = self.runs, []
            self._write(heapq.merge(*map(self._read, runs)))

    def _write(self, messages) -> None:
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for m in messages:
            file.write(self._FORM.pack(*m))
        file.seek(0)
        self.runs.append([self._next(file), file])

    def _read(self, run) -> Iterator[tuple]:
        while run[0] is not None:
            yield run[0]
            run[0] = self._next(run[1])
        run[1].close()

    def _next(self, file) -> tuple | None:
        data = file.read(self._FORM.size)
        return self._FORM.unpack(data) if data else None

    def peek(self) -> tuple | None:
        heads = [r[0] for r in self.runs]
        if self.heap:
            heads.append(self.heap[0])
        return min(heads) if heads else None

    def pop(self) -> tuple:
        least = self.peek()
        if self.heap and self.heap[0] == least:
            return heapq.heappop(self.heap)
        run = next(r for r in self.runs if r[0] == least)
        run[0] = self._next(run[1])
        if run[0] is None:
            run[1].close()
            self.runs.remove(run)
        return least


def _forward(most: int):
    """Totals of each node's subtree within its shard: rows come sorted by shard, then deepest first, then by key.

    ``children``, ``leaves`` and ``saved`` are what other shards have sent to the node; the same columns return with all that
    the node's shard adds. ``top`` says that the node's parent is in another shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(most), None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("shard", "depth", "p1", "p2", "q1", "q2", "top", "gain", "children", "leaves", "saved")}
            out = {n: [] for n in ("children", "leaves", "saved")}
            for own, depth, p1, p2, q1, q2, top, gain, children, leaves, saved in zip(*columns.values(), strict=True):
                if own != shard:
                    if queue.peek() is not None:
                        raise RuntimeError("a message found no node")
                    shard = own
                place = (-depth, _bytes(p1, p2))
                while (head := queue.peek()) is not None and head[:2] <= place:
                    if head[:2] < place:
                        raise RuntimeError("a message found no node")
                    _, _, more, ends, sums = queue.pop()
                    children, leaves, saved = children + more, leaves + ends, saved + sums
                saved += gain
                for name, value in zip(out, (children, leaves, saved), strict=True):
                    out[name].append(value)
                if not top:
                    queue.push((1 - depth, _bytes(q1, q2), 1, leaves, saved))
            kept = {n: batch.column(n) for n in batch.schema.names if n not in out}
            yield pa.RecordBatch.from_pydict(kept | {n: pa.array(v, pa.int64()) for n, v in out.items()})
        if queue.peek() is not None:
            raise RuntimeError("a message found no node")

    return run


def _bytes(high: int, low: int) -> bytes:
    """Sixteen bytes that sort like the two signed numbers."""
    return ((high + (1 << 63)) << 64 | (low + (1 << 63))).to_bytes(16, "big")


def settle(nodes: DataFrame, most: int = QUEUE) -> DataFrame:
    """``nodes`` with the totals of their subtrees, each shard for itself; a stored table."""
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "p1", "p2")
    names = [n for n in nodes.columns if n not in ("children", "leaves", "saved")]
    schema = ", ".join(f"{n} {nodes.schema[n].dataType.simpleString()}" for n in names) + ", children long, leaves long, saved long"
    return cut_lineage(ordered.mapInArrow(_forward(most), schema))


def _mixed(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, h1, h2, words``: the turns of each conversation, counted from 1 in their order.

    Rows are sorted over all tasks by range and counted within each range, so a conversation may be longer than a task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The text is read once and left behind; what moves is narrow.
    narrow = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _mixed(role, text).alias("h1"), _mixed(F.lit(7), text, role).alias("h2"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.select("conv_id", "h1", "h2", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return placed.join(counts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "h1", "h2", "words")


def rebuilt(turns: DataFrame, every: int = 20, most_shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """All conversations ``conv_id, turns`` and their rebuilt turns ``conv_id, pos, h1, h2, words``.

    Of conversation c the first crc32(c) % ``most_shared`` turns come from conversation c - c % ``every``, as far as it has them.
    """
    own = cut_lineage(numbered(turns))
    sizes = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    sizes = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % most_shared).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    sizes = cut_lineage(sizes)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    sizes = sizes.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut_lineage(sizes.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")))
    # Only the first few turns of a base are joined, to at most ``every`` conversations each.
    head = own.where(F.col("pos") < most_shared).withColumnRenamed("conv_id", "base")
    lent = convs.where("shared > 0").join(head, "base").where("pos <= shared").select("conv_id", "pos", "h1", "h2", "words")
    rest = own.join(convs.select("conv_id", "h", "shared"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "h1", "h2", "words")
    return convs.select("conv_id", "turns"), rest.unionByName(lent)


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, q1, q2, words, turns``: the node of every prefix of every conversation and its parent's key.

    A prefix is named by the exclusive or of what each turn gives at its place. Sums run within chunks of a conversation, and then over
    the chunks, so a conversation of any length is many groups.
    """
    marked = turns.withColumns({"m1": _mixed("pos", "h1", "h2"), "m2": _mixed("h2", "h1", F.lit(1), "pos"),
                                "chunk": F.floor((F.col("pos") - 1) / CHUNK).cast("long")})
    inside = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"r1": F.bit_xor("m1").over(inside), "r2": F.bit_xor("m2").over(inside)})
    marked = cut_lineage(marked.drop("h1", "h2"))
    last = marked.groupBy("conv_id", "chunk").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    last = last.withColumn("chunk", F.col("chunk") + 1)
    above = Window.partitionBy("conv_id").orderBy("chunk")
    last = last.select("conv_id", "chunk", F.bit_xor("m1").over(above).alias("s1"), F.bit_xor("m2").over(above).alias("s2"))
    # The first chunk of a conversation has nothing before it.
    later = marked.where("chunk > 0").join(last, ["conv_id", "chunk"])
    both = later.unionByName(marked.where("chunk = 0").withColumns({"s1": F.lit(0).cast("long"), "s2": F.lit(0).cast("long")}))
    both = both.withColumns({"p1": F.col("r1").bitwiseXOR(F.col("s1")), "p2": F.col("r2").bitwiseXOR(F.col("s2"))})
    both = both.join(convs, "conv_id").select(
        "conv_id", F.col("pos").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("m1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("m2")).alias("q2"), "words", "turns")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), zero.alias("words"), "turns")
    return cut_lineage(both.unionByName(roots))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its ids, as they come sorted; only the hash's state is held."""
    from hashlib import sha256

    held, state = None, None
    for batch in batches:
        out = []
        for *node, conv in zip(*(batch.column(n).to_pylist() for n in (*_KEY, "conv_id")), strict=True):
            if node == held:
                state.update(f",{conv}".encode())
                continue
            if held is not None:
                out.append((*held, state.hexdigest()))
            held, state = node, sha256(str(conv).encode())
        yield _ended(out)
    if held is not None:
        yield _ended([(*held, state.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*_KEY, "ends_sha256"])


def _send(sent: DataFrame, to: DataFrame) -> DataFrame:
    """``to`` with what the nodes of ``sent`` give to their parents; added up before it is joined."""
    given = sent.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    out = to.join(given, list(_KEY), "left")
    return out.withColumns({n: F.col(n) + F.coalesce(x, F.lit(0)) for n, x in (("children", "c"), ("leaves", "l"), ("saved", "s"))}).drop("c", "l", "s")


def subtree_totals(nodes: DataFrame, prefixes: DataFrame, limit: int, most: int = QUEUE) -> DataFrame:
    """``nodes`` with ``children, leaves, saved`` of their subtrees; ``limit`` bounds a shard's nodes and a band's levels."""
    zero = F.lit(0).cast("long")
    # All members of a childless node end in it.
    blank = nodes.withColumns({"children": zero, "leaves": F.when(F.col("weight") == F.col("n_convs"), 1).otherwise(0).cast("long"), "saved": zero})
    heavy = cut_lineage(blank.where(F.col("weight") > limit))
    # Below the last heavy node of a conversation's path begins its small subtree: that node names the shard.
    on_path = prefixes.join(heavy.select(*_KEY), list(_KEY)).groupBy("conv_id").agg(F.max("depth").alias("cut"))
    tops = prefixes.join(on_path, "conv_id", "left").where(F.col("depth") == F.coalesce(F.col("cut") + 1, F.lit(0)))
    tops = tops.select("conv_id", F.col("depth").alias("cut"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
    small = blank.where(F.col("weight") <= limit).join(tops, "conv_id")
    small = small.withColumns({"shard": F.concat_ws(":", "cut", "t1", "t2"), "top": F.col("depth") == F.col("cut")}).drop("cut", "t1", "t2")
    done = settle(small, most)
    if heavy.isEmpty():
        return done.drop("shard", "top")
    fed = cut_lineage(_send(done.where("top"), heavy))
    # Bands of the heavy nodes: the shard of a node is its ancestor where the band begins, on the path of its first member.
    begin = (F.floor(F.col("depth") / limit) * limit).cast("long")
    starts = prefixes.where(F.col("depth") % limit == 0).select("conv_id", F.col("depth").alias("begin"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
    banded = fed.withColumn("begin", begin).join(starts, ["conv_id", "begin"])
    banded = cut_lineage(banded.withColumns({"shard": F.concat_ws(":", "begin", "t1", "t2"), "top": F.col("depth") == F.col("begin")}))
    above = settle(banded, most)
    if not above.where("top AND depth > 0").isEmpty():
        # Across shard roots: each band root is a node of a small tree, whose parent is the root of the band that its parent is in.
        tops = above.where("top")
        home = above.select(*_KEY, F.col("t1").alias("u1"), F.col("t2").alias("u2"))
        parents = home.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "u1", "u2")
        rooted = tops.join(parents, ["depth", "q1", "q2"], "left")
        tree = rooted.select(
            (F.col("depth") / limit).cast("long").alias("depth"), "p1", "p2", F.coalesce("u1", F.lit(0)).alias("q1"), F.coalesce("u2", F.lit(0)).alias("q2"),
            (F.col("depth") == 0).alias("top"), F.lit("roots").alias("shard"), F.col("saved").alias("gain"), F.lit(0).cast("long").alias("children"),
            F.col("leaves"), F.lit(0).cast("long").alias("saved"))
        final = settle(tree, most).select((F.col("depth") * limit).alias("depth"), "p1", "p2", "leaves", "saved")
        sent = tops.where("depth > 0").drop("leaves", "saved").join(final, list(_KEY))
        above = settle(_send(sent, banded), most)
    names = done.drop("shard", "top").columns
    return done.select(names).unionByName(above.select(names))


def conversation_trie(turns: DataFrame, every: int = 20, most_shared: int = 4, shard: int | None = None, most: int = QUEUE) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``shard`` bounds the nodes of a shard; if it is not given, four times the square root of all rebuilt turns.
    """
    text_session(turns.sparkSession)
    convs, own = rebuilt(turns, every, most_shared)
    prefixes = paths(convs, own)
    weight = F.col("turns") - F.col("depth") + 1
    nodes = cut_lineage(prefixes.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.max("words").alias("words"), F.sum(weight).alias("weight")))
    nodes = nodes.withColumn("gain", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    limit = shard or max(LEAST_SHARD, 4 * math.isqrt(prefixes.count()))
    totals = cut_lineage(subtree_totals(nodes, prefixes, limit, most))
    ends = prefixes.where(F.col("depth") == F.col("turns")).select(*_KEY, "conv_id")
    ends = ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").mapInArrow(_hash_ends, "depth long, p1 long, p2 long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = totals.join(parents, ["depth", "q1", "q2"], "left").join(ends, list(_KEY), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
