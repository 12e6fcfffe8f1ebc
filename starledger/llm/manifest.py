"""Merkle manifest of a dataset by time-forward processing.

Rows are leaves, ascending by id within their group; every eight neighbours become a parent until one
is left, the group's subroot, and the subroots in the order of their groups likewise give the root.

A node's label is its time: the last leaf under it, then its level.  In the order of labels every
child comes before its parent, so one sweep over the leaves suffices: a node that is ready sends its
digest to its parent through a priority queue ordered by label, and a parent is ready when the sweep
has passed its label.  The queue is external.  Inside a block of ``8 ** step`` neighbouring leaves it
is a heap of at most seven messages a level; messages between blocks go through a sorted shuffle,
which deals them to the blocks of the next round.  A round divides the nodes by ``8 ** step``, so their
number is the logarithm of the rows, and no task holds more than a block.

Proofs come from the reversed sweep: in descending order of labels a node hands each child the
siblings of that child and its own proof; blocks of one round hand the proofs of their leaves to
the tops of the blocks below, down to the rows.

Defined results: a null field counts as ``-`` in its leaf; null ids come first, null groups too; rows
with the same group and id are ordered by their leaf's digest, and equal ones are leaves each; other columns
are ignored unless carried, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import partitions, place, positional
from starledger.operators.ids import with_dense_id
from starledger.session import cut_lineage

BITS = 3            # a parent has up to 2 ** BITS children
STEP = 4            # levels a round climbs
PROOF = "array<struct<left: string, right: string>>"
ROWS_OUT = 1024     # proofs handed on at a time


def digest(*columns: Column | str) -> Column:
    """Leaf digest of a row: each value's UTF-8 byte count, a colon and the value; a null is ``-``."""
    parts = []
    for column in columns:
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level.left, node, level.right), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one text."""
    return F.concat_ws("", F.transform(proof, lambda level: F.concat(level.left, level.right)))


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves: the least d with 8 ** d >= n."""
    return F.when(n > 1, (F.length(F.bin(n - 1)) + F.lit(BITS - 1)).cast("int") / BITS).otherwise(0).cast("int")


def _parent(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Sweep:
    """The forward sweep over one block: leaves go in by ``feed``, ``close`` gives the top's digest.

    ``nodes`` holds (label, digests of the children) in the order of labels.
    """

    def __init__(self, levels: int):
        self.levels, self.queue, self.nodes, self.at, self.top = levels, [], [], 0, None

    def _send(self, level: int, index: int, value: str) -> None:
        """A message to the parent, under its label, behind those of the children before."""
        if level == self.levels:
            self.top = value
            return
        up = index >> BITS
        last = ((up + 1) << BITS * (level + 1)) - 1
        heappush(self.queue, (last, level + 1, index, value))

    def _settle(self, time: float) -> None:
        while self.queue and self.queue[0][0] <= time:
            last, level, index, value = heappop(self.queue)
            children = [value]
            while self.queue and self.queue[0][:2] == (last, level):
                children.append(heappop(self.queue)[3])
            self.nodes.append(((last, level), children))
            self._send(level, index >> BITS, _parent("".join(children)))

    def feed(self, value: str) -> None:
        self._send(0, self.at, value)
        self._settle(self.at)
        self.at += 1

    def close(self) -> str:
        self._settle(float("inf"))
        return self.top


def reversed_sweep(sweep: Sweep, proof: list[tuple[str, str]]):
    """Proofs of a block's leaves in descending order, from the proof of its top."""
    if not sweep.levels:
        yield proof
        return
    queue = [((-sweep.nodes[-1][0][0], -sweep.levels), proof)]
    for (last, level), children in reversed(sweep.nodes):
        label, mine = heappop(queue)
        assert label == (-last, -level)
        first = (last >> BITS * level) << BITS           # of the children, on their level
        for c in range(len(children) - 1, -1, -1):
            own = [("".join(children[:c]), "".join(children[c + 1:])), *mine]
            if level == 1:
                yield own
            else:
                end = ((first + c + 1) << BITS * (level - 1)) - 1
                heappush(queue, ((-end, 1 - level), own))


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    order = ["tree", "block", *more, "pos"]
    return (nodes.repartition(partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions(*order))


def _levels(tall: int, height: int, step: int) -> int:
    """Levels that a block climbs in the round that begins at ``height``."""
    return min(step, max(0, tall - height))


def _climb(nodes: DataFrame, rounds: int, step: int) -> list[DataFrame]:
    """The nodes at the bottom of each round, and the tops: (tree, pos, tall, digest)."""
    found = [nodes]
    for r in range(rounds):
        def tops(batches, height=r * step):
            key, tall, sweep = None, 0, None
            for batch in batches:
                done = []
                columns = [batch.column(c).to_pylist() for c in ("tree", "block", "tall", "digest")]
                for tree, block, high, value in zip(*columns):
                    if (tree, block) != key:
                        if sweep:
                            done.append((*key, tall, sweep.close()))
                        key, tall, sweep = (tree, block), high, Sweep(_levels(high, height, step))
                    sweep.feed(value)
                yield _tops(done)
            if sweep:
                yield _tops([(*key, tall, sweep.close())])

        here = found[-1].select("tree", "pos", "tall", "digest",
                                F.shiftright("pos", BITS * step).alias("block"))
        found.append(cut_lineage(_blocks(here).mapInArrow(tops, "tree bigint, pos bigint, tall int, digest string"),
                                 "merkle-tops"))
    return found


def _tops(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["tree", "pos", "tall", "digest"])


def _descend(found: list[DataFrame], tops: DataFrame, step: int) -> DataFrame:
    """The bottom nodes with ``proof``, ``subroot`` and ``root``; ``tops`` has these of every tree's top."""
    for r in range(len(found) - 2, -1, -1):
        nodes = found[r]
        carried = [f for f in nodes.schema.fields]

        def handed(batches, height=r * step, names=tuple(f.name for f in carried)):
            sweep, rows, top = None, [], None

            def proofs():
                sweep.close()
                kept = pa.Table.from_batches(rows).combine_chunks()
                down, at = [], kept.num_rows
                for proof in reversed_sweep(sweep, top[0]):
                    down.append(proof)
                    if len(down) == ROWS_OUT:
                        at -= len(down)
                        yield _handed(kept.slice(at, len(down)), down[::-1], top)
                        down = []
                if down:
                    yield _handed(kept.slice(0, at), down[::-1], top)

            for batch in batches:
                start, is_node = 0, batch.column("is_node").to_pylist()
                talls, values = batch.column("tall").to_pylist(), batch.column("digest").to_pylist()
                slim = batch.select(names)
                for i, node in enumerate(is_node):
                    if node:
                        if sweep is None:
                            sweep = Sweep(_levels(talls[i], height, step))
                        sweep.feed(values[i])
                        continue
                    if i > start:
                        rows.append(slim.slice(start, i - start))
                    if sweep:
                        yield from proofs()
                    sweep, rows, start = None, [], i + 1
                    proof = batch.column("proof")[i].as_py()
                    top = ([(p["left"], p["right"]) for p in proof], batch.column("subroot")[i].as_py(),
                           batch.column("root")[i].as_py())
                if batch.num_rows > start:
                    rows.append(slim.slice(start))
            if sweep:
                yield from proofs()

        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in carried),
                            f"proof {PROOF}, subroot string, root string"])
        above = tops.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root",
                            F.lit(False).alias("is_node"))
        here = nodes.select("*", F.shiftright("pos", BITS * step).alias("block"), F.lit(True).alias("is_node"))
        tops = _blocks(above.unionByName(here, allowMissingColumns=True), "is_node").mapInArrow(handed, schema)
        if r:
            tops = cut_lineage(tops, "merkle-proofs")
    return tops


def _handed(rows: pa.Table, proofs: list, top: tuple) -> pa.RecordBatch:
    ends = [0]
    for proof in proofs:
        ends.append(ends[-1] + len(proof))
    sides = [pa.array([level[side] for proof in proofs for level in proof], pa.string()) for side in (0, 1)]
    column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))
    n = rows.num_rows
    arrays = [*(rows.column(c).combine_chunks() for c in rows.schema.names), column,
              pa.array([top[1]] * n, pa.string()), pa.array([top[2]] * n, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [*rows.schema.names, "proof", "subroot", "root"])


def build(docs: DataFrame, fields: list[str], group: str = "lang", ident: str = "doc_id",
          carry: list[str] = (), step: int = STEP) -> DataFrame:
    """(id, group, leaf, subroot, root, proof, carried columns): the manifest, a row per leaf.

    ``proof`` lists, from the leaf's level to the root's, the siblings to the left and to the right as
    texts of digests; ``fold`` leads from a leaf along it to the root.
    """
    flat = positional(docs)
    extra = [f"x{i}" for i in range(len(carry))]
    leaves = flat.select(F.col(place(docs, group)).alias("grouped"),
                         F.col(place(docs, ident)).cast("bigint").alias("id"),
                         digest(*[F.col(place(docs, f)) for f in fields]).alias("digest"),
                         *[F.col(place(docs, c)).alias(x) for c, x in zip(carry, extra)])
    # Written first: sampling the range sort's split points would hash every text once more.
    leaves = cut_lineage(leaves, "merkle-leaves")
    numbered = with_dense_id(leaves, "at", ["grouped", "id", "digest"], start=0)
    sizes = numbered.groupBy("grouped").agg(F.min("at").alias("from_at"), F.count(F.lit(1)).alias("n"))
    trees = cut_lineage(with_dense_id(sizes, "tree", ["grouped"], start=0)
                        .select("tree", "grouped", "from_at", depth(F.col("n")).alias("tall")), "merkle-trees")
    tallest, n_trees = trees.agg(F.max("tall"), F.count(F.lit(1))).first()
    nodes = numbered.alias("l").join(trees.alias("t"), F.col("l.grouped").eqNullSafe(F.col("t.grouped"))).select(
        "tree", (F.col("at") - F.col("from_at")).alias("pos"), "tall", "digest", "l.grouped", "id", *extra)
    lower = _climb(nodes, max(1, -(-(tallest or 0) // step)), step)

    # The subroots are the leaves of one more tree.
    over = lower[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"),
                            depth(F.lit(n_trees)).alias("tall"), "digest")
    upper = _climb(over, max(1, -(-(max(1, n_trees) - 1).bit_length() // (BITS * step))), step)
    root = upper[-1].select(F.col("tree"), "pos", F.expr(f"cast(array() AS {PROOF})").alias("proof"),
                            F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = _descend(upper, root, step).select(F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "proof",
                                        F.col("digest").alias("subroot"), "root")
    rows = _descend(lower, cut_lineage(tops, "merkle-subroots"), step)
    return rows.select(F.col("id").alias(ident), F.col("grouped").alias(group), F.col("digest").alias("leaf"),
                       "subroot", "root", "proof", *[F.col(x).alias(c) for c, x in zip(carry, extra)])
