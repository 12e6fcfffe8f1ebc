"""Near-duplicate documents by an LSH forest.

Every distinct shingle set gets ``TREES`` labels of ``DEPTH`` MinHash values.  In each tree the
labels are sorted; sets that share their first ``MIN_DEPTH`` values form a region, and neighbours
with the longest common prefix are candidates, confirmed on the full sets.  Depth adapts to the
region: a region of up to ``BLOCK`` rows in one sorted range is compared whole, a denser one in
overlapping blocks along its sorted order, whose rows share longer prefixes.  Where that leaves a
denser or cut region in several components, its rows meet in an exact prefix-filter join.

The rounds keep large groups of near copies linear: first direct neighbours in two trees, then
direct neighbours in all trees, then blocks, then the exact join, and each round only asks about rows
that earlier links have not connected.  Copies (equal sets) are one node throughout.  Joins with texts and sets are
sort-merge joins at every size: the tables grow with the corpus.

Defined results: null or blank text has an empty set and no link; rows that share an id are one
document; documents without an id take part and a group of such documents only has no component
id; ids lie below 2^62; further columns are ignored; an empty table gives an empty one.  A pair at the
threshold itself shares a region in some tree with probability 1 - (1 - 0.8^5)^32 > 0.99999, and a
pair that shares a region is compared or already connected, however dense the region is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm import shingles
from starledger.llm.common import partitions, pick, place, positional, slices
from starledger.llm.components import components
from starledger.session import cut_lineage

TREES = 32
DEPTH = 8
MIN_DEPTH = 5
BLOCK = 128                             # rows of a region whose sets are compared in one block
BLOCK_SHINGLES = 4_000_000              # shingles of a block at most, unless two rows have more
SLAB = 8_192                            # shingles per slice of the comparison
LABEL = 2 * DEPTH                       # bytes
REGION = 1 + 2 * MIN_DEPTH              # bytes of tree and shared prefix in a key
NO_ID = 1 << 62                         # nodes of documents without an id lie above it
SKETCH = 1 << 20                        # counters of the shingles' frequencies in the exact join
HOT = 2_048                             # rows of a shingle from which the exact join salts it

FIRST_TREES = 2                         # trees whose direct neighbours are confirmed first
SLICE = 1 << 20
_RNG = np.random.default_rng(7)
_A = (_RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)[:, None]


def minhash(values: np.ndarray, work: np.ndarray) -> np.ndarray:
    """The smallest of each hash function over a set; ``work`` is scratch of TREES*DEPTH rows."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), work.shape[1]):
        part = low[at:at + work.shape[1]]
        out = work[:, :len(part)]
        np.multiply(_A, part[None, :], out=out)
        np.add(out, _B, out=out)
        np.minimum(best, out.min(axis=1), out=best)
    return best


def labels(values: np.ndarray, work: np.ndarray) -> bytes:
    """All tree labels of a set: 16 bits per MinHash value, big-endian so that bytes sort like values."""
    best = minhash(values, work)
    return ((best * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2").tobytes()


def signatures(docs: DataFrame, n_words: int) -> DataFrame:
    """(id, n, key, sig): size, 16-byte identity and tree labels of each document's set."""
    def sign(batches):
        work = np.empty((TREES * DEPTH, 512), np.uint32)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = shingles.sets(batch.column("text"), n_words)
                key = [np.array([x.sum(), shingles.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum()],
                                np.uint64).tobytes() if len(x) else None for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(x) for x in found], pa.int64()),
                     pa.array(key, pa.binary()),
                     pa.array([labels(x, work) if len(x) else None for x in found], pa.binary())],
                    ["id", "n", "key", "sig"])

    return docs.mapInArrow(sign, "id bigint, n bigint, key binary, sig binary")


def _ordered(rows: DataFrame) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartitionByRange(n, "label", "node").sortWithinPartitions("label", "node")


def _crowded(forest: DataFrame) -> DataFrame:
    """The rows that share their region with another row, and the ends of each sorted range."""
    def shared(batches):
        tail = None
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 15):
                batch = pa.Table.from_batches([whole.slice(at, 1 << 15)])
                table = batch if tail is None else pa.concat_tables([tail.select(batch.column_names), batch])
                n = table.num_rows
                region = np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint8).reshape(
                    n, 1 + LABEL)[:, :REGION]
                same = (region[1:] == region[:-1]).all(axis=1)
                keep = np.zeros(n, bool)
                keep[1:] |= same
                keep[:-1] |= same
                keep[0] |= True if tail is None else tail.column("held")[0].as_py()
                yield from table.slice(0, n - 1).filter(pa.array(keep[:-1])).to_batches()
                tail = table.slice(n - 1).append_column("held", pa.array([bool(keep[-1])]))
        if tail is not None:
            yield from tail.drop_columns(["held"]).to_batches()

    return _ordered(forest.select("label", "node", "n")).mapInArrow(shared, "label binary, node bigint, n bigint")


def _neighbours(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of direct neighbours in a region whose roots differ; rows are (label, node, n, root).

    Each range of the sorted order is read as a stream; the two outermost rows of every range are
    compared once more across the ranges.
    """
    names = ["label", "node", "n", "root"]
    schema = "a bigint, b bigint, label binary, node bigint, n bigint, root bigint"

    def pairs(table: pa.Table):
        label = np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint8).reshape(-1, 1 + LABEL)
        node, size, root = (table.column(c).to_numpy() for c in names[1:])
        fits = (label[1:, :REGION] == label[:-1, :REGION]).all(axis=1)
        fits &= (root[1:] != root[:-1]) & (node[1:] != node[:-1])
        fits &= np.minimum(size[1:], size[:-1]) >= threshold * np.maximum(size[1:], size[:-1])
        return np.minimum(node[1:], node[:-1])[fits], np.maximum(node[1:], node[:-1])[fits]

    def rows_of(a, b, ends: pa.Table | None = None):
        k = ends.num_rows if ends is not None else 0
        arrays = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(k, pa.int64())]) for x in (a, b)]
        for c, t in zip(names, [pa.binary(), pa.int64(), pa.int64(), pa.int64()]):
            end = ends.column(c).combine_chunks().cast(t) if k else pa.nulls(0, t)
            arrays.append(pa.concat_arrays([pa.nulls(len(a), t), end]))
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", *names])

    def stream(batches, edges: bool):
        tail = None
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 15):
                batch = pa.Table.from_batches([whole.slice(at, 1 << 15)]).select(names)
                table = batch if tail is None else pa.concat_tables([tail, batch])
                yield rows_of(*pairs(table), batch.slice(0, 1) if edges and tail is None else None)
                tail = table.slice(table.num_rows - 1)
        if tail is not None and edges:
            yield rows_of([], [], tail)

    found = cut_lineage(_ordered(rows).mapInArrow(lambda it: stream(it, True), schema), "neighbours")
    # Two rows per range: bounded by the number of partitions.
    across = (found.filter("a is null").select(*names).distinct()
              .repartition(1).sortWithinPartitions("label", "node")
              .mapInArrow(lambda it: stream(it, False), schema))
    return (found.filter("a is not null").select("a", "b")
            .unionByName(across.filter("a is not null").select("a", "b")).distinct())


def _cut(rows: DataFrame) -> DataFrame:
    """(pid, edge, region, nodes, roots): the blocks (edge 0) and the first (1) and last (2) rows of each range.

    Blocks are runs of at most ``BLOCK`` rows of a region, each overlapping the next by half.  A region that
    fits is one block; a denser one is cut along its sorted order, where rows of a block share the longest
    prefixes.  Blocks whose rows one component already holds, and regions of two rows, which were
    compared as neighbours, are left out.
    """
    def cut(batches):
        pid = TaskContext.get().partitionId()
        region, block, fresh, weight, out = None, [], 0, 0, []
        head, n_regions = [], 0          # first rows of the range's first region

        def closed():
            wanted = fresh and len(block) > 2 and len({r for _, r, _ in block}) > 1
            return [(0, None, block)] if wanted else []

        def batch_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([pid] * len(found), pa.int32()), pa.array([x[0] for x in found], pa.int32()),
                 pa.array([x[1] for x in found], pa.binary()),
                 *(pa.array([[row[i] for row in x[2]] for x in found], pa.list_(pa.int64())) for i in (0, 1))],
                ["pid", "edge", "region", "nodes", "roots"])

        for batch in batches:
            for label, node, n, root in zip(*(batch.column(c).to_pylist() for c in ("label", "node", "n", "root"))):
                if label[:REGION] != region:
                    out += closed()
                    region, block, fresh, weight, n_regions = label[:REGION], [], 0, 0, n_regions + 1
                elif len(block) >= BLOCK or weight + n > BLOCK_SHINGLES:
                    out += closed()
                    block = block[-max(len(block) // 2, 1):]
                    weight, fresh = sum(k for _, _, k in block), 0
                block = block + [(node, root, n)]
                weight += n
                fresh += 1
                if n_regions == 1 and len(head) < BLOCK // 2:
                    head.append((node, root, n))
                    first = region
            if len(out) >= 512:
                yield batch_of(out)
                out = []
        out += closed()
        if n_regions:
            out += [(1, first, head), (2, region, block[-(BLOCK // 2):])]
        if out:
            yield batch_of(out)

    return cut_lineage(_ordered(rows).mapInArrow(
        cut, "pid int, edge int, region binary, nodes array<bigint>, roots array<bigint>"), "block-rows")


def _across(found: DataFrame) -> DataFrame:
    """The blocks of :func:`_cut` and those across neighbouring ranges.

    A region that goes on in the next sorted range gets one more block there, from the last rows of one
    range and the first of the next.
    """
    ends = found.filter("edge = 2").select((F.col("pid") + 1).alias("pid"), "region",
                                           F.col("nodes").alias("nodes_a"), F.col("roots").alias("roots_a"))
    across = (found.filter("edge = 1").join(ends, ["pid", "region"])
              .select(F.concat("nodes_a", "nodes").alias("nodes"), F.concat("roots_a", "roots").alias("roots"))
              .filter(F.size(F.array_distinct("roots")) > 1))
    return found.filter("edge = 0").select("nodes", "roots").unionByName(across).dropDuplicates(["nodes"])


def _open(unsettled: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) of the rows in regions of several components that no single block held whole.

    ``unsettled`` with the roots after the blocks; ``found`` from :func:`_cut` tells which regions lie
    in more than one sorted range.
    """
    rows = unsettled.select("node", "n", "root", F.substring("label", 1, REGION).alias("region"))
    dense = (rows.groupBy("region").agg(F.count("*").alias("k"), F.sum("n").alias("weight"))
             .filter((F.col("k") > BLOCK) | (F.col("weight") > BLOCK_SHINGLES)).select("region"))
    # Dealt anew, here and in ``_unsettled``: a join with an aggregate's own output keeps its partitioning, and
    # a region with many rows could not be split.
    halved = (found.filter("edge > 0").groupBy("region").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
              .filter("lo <> hi").select("region"))
    wanted = dense.unionByName(halved).distinct().hint("rebalance")
    return (rows.join(wanted, "region", "left_semi")
            .select("node", "root").distinct())


def _exact_pairs(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots that may overlap by ``percent``: none that does is left out.

    Shingles are ordered by rarity.  The first shingle that two such sets have in common stands early
    enough in both that what follows can still make up the overlap; so the early shingles are joined,
    those of the smaller set (it may start no later than for an equal partner) with those of the larger,
    and the places bound the overlap.  ``SKETCH`` counters order the shingles: any order is right, the
    rare ones first is quick.  Frequent shingles are salted.
    """
    sets = cut_lineage(members.join(rows.hint("merge"), "node").select("node", "root", "grams"), "open-sets")

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            held = [np.frombuffer(grams.as_buffer(), np.uint64) for grams in batch.column("grams")]
            counters = np.concatenate([np.empty(0, np.uint64), *held]) % np.uint64(SKETCH)
            total += np.bincount(counters.astype(np.int64), minlength=SKETCH)
        kinds = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(total[kinds])], ["counter", "k"])

    # At most ``SKETCH`` rows of two numbers.
    counted = (sets.select("grams").mapInArrow(count, "counter bigint, k bigint")
               .groupBy("counter").agg(F.sum("k").alias("k")).toArrow())
    often = np.zeros(SKETCH, np.int64)
    often[counted.column("counter").to_numpy()] = counted.column("k").to_numpy()
    salts = 1 + np.maximum(often - 2 * often.sum() // SKETCH, 0) // HOT

    def early(batches):
        for batch in batches:
            found, sizes, lengths = [], [], []
            for held in batch.column("grams"):
                grams = np.frombuffer(held.as_buffer(), np.uint64)
                n = len(grams)
                counter = (grams % np.uint64(SKETCH)).astype(np.int64)
                first = np.argsort(often[counter], kind="stable")[:n + 1 + -percent * n // 100]
                at = np.arange(len(first))
                found.append((grams[first].view(np.int64), salts[counter[first]], at,
                              at < n + 1 + -2 * percent * n // (100 + percent)))
                sizes.append(len(first))
                lengths.append(n)
            whole = [np.concatenate(part) for part in zip(*found)] if found else [[]] * 4
            beside = (np.repeat(x, sizes) for x in (lengths, batch.column("node").to_numpy(),
                                                    batch.column("root").to_numpy()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip((*whole, *beside), kinds)],
                ["gram", "salts", "at", "small", "n", "node", "root"])

    found = cut_lineage(sets.mapInArrow(
        early, "gram bigint, salts bigint, at bigint, small boolean, n bigint, node bigint, root bigint"), "early")
    less = found.filter("small").select(
        "gram", F.expr("pmod(xxhash64(node), salts)").alias("salt"),
        *(F.col(c).alias(f"{c}_a") for c in ("at", "n", "node", "root")))
    more = found.select("gram", F.expr("explode(sequence(0L, salts - 1))").alias("salt"),
                        *(F.col(c).alias(f"{c}_b") for c in ("at", "n", "node", "root")))
    return (less.hint("merge").join(more, ["gram", "salt"])
            .filter("root_a <> root_b AND (n_a < n_b OR n_a = n_b AND node_a < node_b)")
            .filter(F.least(F.expr("n_a - at_a"), F.expr("n_b - at_b")) * (100 + percent)
                    >= (F.col("n_a") + F.col("n_b")) * percent)
            .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())


def _members(docs: DataFrame, nodes: DataFrame, n_words: int) -> DataFrame:
    """(node, grams): full sorted sets of the documents that are somebody's neighbour."""
    def full(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = shingles.sets(batch.column("text"), n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["node", "grams"])

    wanted = docs.join(nodes.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi")
    return wanted.mapInArrow(full, "node bigint, grams binary")


def _confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets overlap by ``percent`` of their union."""
    def overlap(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    half = members.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    other = members.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(half.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "grams_a", "grams_b").mapInArrow(
        overlap, "a bigint, b bigint")


def _linked_blocks(blocks: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links that connect different roots within each block, from the full sets of its rows."""
    def confirm(group: pa.Table) -> pa.Table:
        node, root = group.column("node").to_pylist(), group.column("root").to_pylist()
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in group.column("grams")]
        both = overlaps(grams)
        size = np.array([len(g) for g in grams])
        close = np.argwhere(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
        links = []
        for i, j in close.tolist():
            if root[i] != root[j]:
                links.append((node[i], node[j]))
                root = [root[i] if r == root[j] else r for r in root]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()),
                         "b": pa.array([y for _, y in links], pa.int64())})

    rows = (blocks.select(F.xxhash64("nodes").alias("block"), F.explode(F.arrays_zip("nodes", "roots")).alias("row"))
            .select("block", F.col("row.nodes").alias("node"), F.col("row.roots").alias("root")))
    return (rows.join(members.hint("merge"), "node").select("block", "node", "root", "grams")
            .groupBy("block").applyInArrow(confirm, "a bigint, b bigint"))


def overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over slices of the shingles."""
    k = len(grams)
    row = np.repeat(np.arange(k), [len(g) for g in grams])
    kinds, column, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = often[column] > 1                     # a shingle of one row meets nobody
    number = np.cumsum(often > 1) - 1
    row, column = row[shared], number[column[shared]]
    both = np.zeros((k, k), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        lo, hi = np.searchsorted(column, [at, at + SLAB])
        held = np.zeros((k, SLAB), np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        both += np.rint(held @ held.T).astype(np.int64)
    return both


def _own_id(ident: Column, text: Column) -> Column:
    """The id, or for a document without one a number above all ids, the same for equal texts."""
    unnamed = F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(NO_ID)) + F.lit(NO_ID)
    return F.coalesce(ident.cast("bigint"), unnamed)


def classes(docs: DataFrame, text: str = "text", ident: str = "doc_id", n_words: int = 5,
            percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    found = _components(docs, text, ident, n_words, percent)
    return found.select(F.when(F.col("id") < NO_ID, F.col("id")).alias(ident), F.col("n").alias("n_shingles"),
                        F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


def unique_rows(docs: DataFrame, text: str = "text", ident: str = "doc_id", n_words: int = 5,
                percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, with all columns.

    Documents without an id stay only where nobody in their group has one, and then one text stays.
    """
    flat = positional(docs)
    own = _own_id(F.col(place(docs, ident)), F.col(place(docs, text)).cast("string"))
    goes = (_components(docs, text, ident, n_words, percent).filter("id <> component")
            .select(F.col("id").alias("k_goes")).distinct())
    return flat.join(goes.hint("merge"), own == F.col("k_goes"), "left_anti").toDF(*docs.columns)


def _components(docs: DataFrame, text: str, ident: str, n_words: int, percent: int) -> DataFrame:
    """(id, n, component) of every document; ids from :func:`_own_id`."""
    slim = pick(docs, id=ident, text=text).select(
        _own_id(F.col("id"), F.col("text").cast("string")).alias("id"), F.col("text").cast("string"))
    signed = cut_lineage(signatures(slim, n_words), "signatures")
    filled = signed.filter("n > 0")
    nodes = cut_lineage(filled.groupBy("key").agg(F.min("id").alias("node")), "nodes")
    # One row per set, its node's (sets that share an id stand side by side in every tree).
    stems = (filled.join(nodes.select(F.col("key").alias("k"), F.col("node").alias("m")),
                         (F.col("key") == F.col("k")) & (F.col("id") == F.col("m")), "left_semi")
             .select(F.col("id").alias("node"), "n", "key", "sig").dropDuplicates(["node", "key"]))
    forest = (stems.select("node", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
              .select("node", "n",
                      F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")),
                               F.expr(f"substring(sig, tree * {LABEL} + 1, {LABEL})")).alias("label")))
    rows = cut_lineage(_crowded(forest), "forest")
    members = cut_lineage(_members(slim, rows, n_words), "sets")
    first = rows.filter(F.col("label") < F.lit(bytearray([FIRST_TREES])))
    pairs = _neighbours(first.withColumn("root", F.col("node")), percent / 100)
    roots = _merged(None, cut_lineage(_confirmed(pairs, members, percent), "confirmed"))
    pairs = _neighbours(_unsettled(rows, roots), percent / 100)
    roots = _merged(roots, cut_lineage(_confirmed(pairs, members, percent), "confirmed"))
    found = _cut(_unsettled(rows, roots))
    blocks = cut_lineage(_across(found), "blocks")
    roots = _merged(roots, cut_lineage(_linked_blocks(blocks, members, percent), "confirmed"))
    open_rows = cut_lineage(_open(_unsettled(rows, roots), found), "open")
    if not open_rows.isEmpty():
        pairs = _exact_pairs(open_rows, members, percent)
        roots = _merged(roots, cut_lineage(_confirmed(pairs, members, percent), "confirmed"))
    return _labelled(signed, nodes, roots)


def _unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the regions that hold more than one component, with their roots."""
    rooted = (rows.join(roots, "node", "left")
              .select("label", "node", "n", F.coalesce("root", "node").alias("root"),
                      F.substring("label", 1, REGION).alias("region")))
    mixed = (rooted.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .filter("lo <> hi").select("region"))
    return rooted.join(mixed.hint("rebalance"), "region", "left_semi").select("label", "node", "n", "root")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after the new links: only the roots that links join are walked again."""
    if roots is None:
        return cut_lineage(components(links), "roots")
    if links.isEmpty():
        return roots
    def rooted(column):
        return roots.select(F.col("node").alias(column), F.col("root").alias(f"root_{column}"))
    lifted = (links.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left")
              .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = components(lifted).select(F.col("node").alias("root"), F.col("root").alias("moved"))
    old = (roots.join(moved, "root", "left")
           .select("node", F.coalesce("moved", "root").alias("root")))
    new = (moved.join(roots.select(F.col("node").alias("root")), "root", "left_anti")
           .select(F.col("root").alias("node"), F.col("moved").alias("root")))
    return cut_lineage(old.unionByName(new), "roots")


def _labelled(signed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    settled = (nodes.join(roots, "node", "left")
               .select("key", F.coalesce("root", "node").alias("component")))
    return (signed.select("id", "n", "key").join(settled, "key", "left")
            .select("id", "n", F.coalesce("component", "id").alias("component")))
