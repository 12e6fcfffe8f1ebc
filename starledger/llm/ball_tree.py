"""Exact top-k by inner product: a ball tree per shard, branch and bound, a shared k-th score.

Vectors are integers.  Equal vectors are put together first, with their ``keep`` smallest ids (no other id can
be among the best), so a vector that a third of the rows share is one point.  A bounded sample cuts
the space into at most ``REGIONS`` regions; a region's points are dealt to shards of about ``SHARD``
points, and every shard becomes one stored row with its ball tree: nodes with centre, radius and range of points.

The best score that a node can hold for a query q is q.centre + |q| radius.  Regions have such a bound
too, and every query visits them in its order in a few rounds: the best region first, then the next
ones, each round four times as far.  A round starts with the k-th score that the query has from all
shards so far, skips the regions whose bound is below it, and hands it to the shards that remain; within a
shard the children of a node come in the order of their bounds, for all queries of a batch at once, and the
k-th score rises as leaves are read.  A bound is widened by its rounding error, so results are exact.

A shard that many queries visit is copied for every ``VISITS`` of them: no task holds more than a tree
and a batch of queries.  The driver holds the sample, the cuts and a row per region.

Defined results: rows whose vector is null or holds a null or non-finite component take no part; a
shorter vector counts as filled up with zeros; of equal scores the smaller id wins, a null id counts as the
largest long and comes back as null; repeated rows are candidates each, and a query passes over one row only,
its own; components and scores beyond a long's range saturate; further columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starledger.llm.common import partitions, pick, sample_by_hash
from starledger.operators.ids import with_dense_id
from starledger.session import cut_lineage

SAMPLE = 16_384      # points that the cuts between regions are learned from, at most
REGIONS = 256        # at most: a row each on the driver and in every task
SHARD = 8_192        # points of a shard
LEAF = 64            # points of a leaf
VISITS = 16_384      # queries that one copy of a shard answers

LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min    # score of an empty place
EXACT = 2.0 ** 53


def quantised(rows: DataFrame, ident: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, vector): floor(scale * x) of every component; rows that take no part are left out."""
    slim = pick(rows, id=ident, vector=vector)
    whole = F.expr("transform(vector, x -> cast(x AS double))")
    sound = F.col("vector").isNotNull() & F.forall(
        F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (slim.select(F.col("id").cast("bigint"), whole.alias("vector")).filter(sound)
            .select("id", F.transform("vector", lambda x: F.floor(x * F.lit(scale))).alias("vector")))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _lengths(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points.astype(float) ** 2).sum(axis=1))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows with all rows, saturated at a long's range."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), np.int64)
    if _lengths(left).max() * _lengths(right).max() < EXACT:     # so is every partial sum
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    return np.clip(left.astype(object) @ right.T.astype(object), LEAST, MOST).astype(np.int64)


# ---------------------------------------------------------------- cuts and trees

def _direction(points: np.ndarray) -> np.ndarray:
    """From one of two points far apart to the other."""
    one = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    return points[((points - one) ** 2).sum(axis=1).argmax()] - one


class Cuts:
    """Halfspaces learned from a sample, each region a leaf of their tree."""

    def __init__(self, sample: np.ndarray, regions: int):
        points = sample.astype(float)
        self.nodes: list = [None]       # (direction, threshold, left, right), or the region's number
        queue = [(-len(points), 0, np.arange(len(points)))]
        self.regions = 1
        leaves = {0: queue[0][2]}
        while queue and self.regions < regions:
            _, node, rows = heappop(queue)
            own = points[rows]
            direction = _direction(own) if len(rows) > 1 else None
            if direction is None or not direction.any():
                continue
            along = own @ direction
            threshold = float(np.median(along))
            low = along <= threshold
            if low.all():
                low = along < threshold
                threshold = float(along[low].max()) if low.any() else threshold
            if not low.any():
                continue
            self.nodes[node] = (direction, threshold, len(self.nodes), len(self.nodes) + 1)
            del leaves[node]
            for part in (rows[low], rows[~low]):
                leaves[len(self.nodes)] = part
                heappush(queue, (-len(part), len(self.nodes), part))
                self.nodes.append(None)
            self.regions += 1
        self.centres = np.zeros((self.regions, points.shape[1]))
        for number, (node, rows) in enumerate(sorted(leaves.items())):
            self.nodes[node] = number
            if len(rows):
                self.centres[number] = points[rows].mean(axis=0)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), np.int32)
        open_ = [(0, np.arange(len(points)))]
        points = points.astype(float)
        while open_:
            node, rows = open_.pop()
            if isinstance(self.nodes[node], int):
                found[rows] = self.nodes[node]
            elif len(rows):
                direction, threshold, left, right = self.nodes[node]
                low = points[rows] @ direction <= threshold
                open_ += [(left, rows[low]), (right, rows[~low])]
        return found


class Tree:
    """The points of a shard in the order of its ball tree."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, owner: np.ndarray):
        """``ids`` belong to the points ``owner``, which ascend."""
        order = np.arange(len(points))
        exact = points.astype(float)
        self.start, self.stop, self.left, self.right, centres, radii = [], [], [], [], [], []
        open_ = [(0, len(points), -1, 0)]
        while open_:
            a, b, parent, side = open_.pop()
            node = len(self.start)
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            own = exact[order[a:b]]
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            self.start.append(a)
            self.stop.append(b)
            self.left.append(-1)
            self.right.append(-1)
            if b - a > LEAF:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ _direction(own), middle)]
                open_ += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.points = points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        counts = np.bincount(owner, minlength=len(points))
        begin = np.concatenate([[0], np.cumsum(counts)])
        self.ids = np.concatenate([ids[begin[i]:begin[i + 1]] for i in order])
        self.first = np.concatenate([[0], np.cumsum(counts[order])])

    def search(self, queries: np.ndarray, floor: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``keep`` best of each query, as far as they reach its ``floor``."""
        n = len(queries)
        self.scores, self.found = np.full((n, keep), NONE), np.zeros((n, keep), np.int64)
        self.queries, self.real, self.norm = queries, queries.astype(float), _lengths(queries)
        self.floor = floor.copy()
        reach = np.sqrt((self.centres ** 2).sum(axis=1)) + self.radii
        open_ = [(0, np.arange(n))]
        while open_:
            node, rows = open_.pop()
            # What the bound's own rounding may hide is added to it.
            slack = self.norm[rows] * reach[node] * 1e-9
            rows = rows[self._bound(node, rows) + slack >= self.floor[rows]]
            if not len(rows):
                continue
            if self.left[node] < 0:
                self._read(node, rows)
                continue
            a, b = self.left[node], self.right[node]
            first = self._bound(a, rows) >= self._bound(b, rows)
            # The last one put on the stack is read first: each query's better child before the other.
            open_ += [(a, rows[~first]), (b, rows[~first]), (b, rows[first]), (a, rows[first])]
        return self.scores, self.found

    def _bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        return self.real[rows] @ self.centres[node] + self.norm[rows] * self.radii[node]

    def _read(self, node: int, rows: np.ndarray) -> None:
        a, b = self.start[node], self.stop[node]
        scores = products(self.queries[rows], self.points[a:b])
        row, point = np.nonzero(scores >= self.floor[rows][:, None])
        if not len(row):
            return
        keep = self.scores.shape[1]
        each = self.first[a + point + 1] - self.first[a + point]
        which = np.repeat(np.arange(len(row)), each)
        ids = self.ids[np.repeat(self.first[a + point], each) + np.arange(len(which))
                       - np.repeat(np.cumsum(each) - each, each)]
        touched = np.unique(row)
        owners = np.concatenate([row[which], np.repeat(touched, keep)])
        marks = np.concatenate([scores[row, point][which], self.scores[rows[touched]].ravel()])
        ids = np.concatenate([ids, self.found[rows[touched]].ravel()])
        order = np.lexsort((ids, -marks, owners))     # -NONE overflows to NONE: made the last below
        order = order[np.argsort(owners[order] * 2 + (marks[order] == NONE), kind="stable")]
        owners = owners[order]
        begin = np.searchsorted(owners, touched)
        best = order[begin[:, None] + np.arange(keep)]
        self.scores[rows[touched]], self.found[rows[touched]] = marks[best], ids[best]
        self.floor[rows[touched]] = np.maximum(self.floor[rows[touched]], marks[best[:, -1]])

    def packed(self) -> dict:
        low, high = int(self.points.min(initial=0)), int(self.points.max(initial=0))
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        links = np.array([self.start, self.stop, self.left, self.right], "<i4")
        return {"kind": kind, "width": self.points.shape[1], "points": self.points.astype(kind).tobytes(),
                "links": links.tobytes(), "centres": self.centres.tobytes(), "radii": self.radii.tobytes(),
                "ids": self.ids.tobytes(), "first": self.first.astype("<i4").tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> Tree:
        tree, width = cls.__new__(cls), row["width"]
        tree.start, tree.stop, tree.left, tree.right = np.frombuffer(row["links"], "<i4").reshape(4, -1).tolist()
        tree.points = np.frombuffer(row["points"], row["kind"]).astype(np.int64).reshape(tree.stop[0], width)
        tree.centres = np.frombuffer(row["centres"]).reshape(-1, width)
        tree.radii = np.frombuffer(row["radii"])
        tree.ids, tree.first = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["first"], "<i4").astype(np.int64)
        return tree


PACKED = "kind string, width int, points binary, links binary, centres binary, radii binary, ids binary, first binary"


# ---------------------------------------------------------------- the operator

def _points(rows: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): distinct vectors with their ``keep`` smallest ids."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    known = rows.select("vector", F.coalesce("id", F.lit(int(MOST))).alias("id"))
    return (known.withColumn("rank", rank).filter(F.col("rank") <= keep)
            .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def _placed(points: DataFrame, cuts: Cuts, width: int) -> DataFrame:
    """Points with their region and their distance from its centre."""
    def place(batches):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), width)
            region = cuts.of(matrix)
            away = np.sqrt(((matrix - cuts.centres[region]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(away)],
                                             [*batch.schema.names, "region", "away"])

    return points.mapInArrow(place, "vector array<bigint>, ids array<bigint>, region int, away double")


def _forest(placed: DataFrame, parts: np.ndarray, width: int) -> DataFrame:
    """One row per shard: (region, part) and its packed tree."""
    def grow(batches):
        key, held = None, []

        def done():
            whole = pa.concat_arrays([v for v, _ in held]), pa.concat_arrays([i for _, i in held])
            sizes = np.diff(whole[1].offsets.to_numpy())
            tree = Tree(_matrix(whole[0], width), whole[1].flatten().to_numpy(),
                        np.repeat(np.arange(len(sizes)), sizes))
            return pa.RecordBatch.from_pylist([{"region": key[0], "part": key[1], **tree.packed()}], schema)

        for batch in batches:
            region, part = (batch.column(c).to_numpy() for c in ("region", "part"))
            edges = np.flatnonzero((np.diff(region) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                here = (int(region[a]), int(part[a]))
                if here != key and held:
                    yield done()
                    held = []
                key = here
                held.append((batch.column("vector").slice(a, b - a), batch.column("ids").slice(a, b - a)))
        if held:
            yield done()

    binary = [(c, pa.binary()) for c in ("points", "links", "centres", "radii", "ids", "first")]
    schema = pa.schema([("region", pa.int32()), ("part", pa.int32()), ("kind", pa.string()), ("width", pa.int32()),
                        *binary])
    dealt = placed.select("vector", "ids", "region", F.pmod(F.xxhash64("vector"), _of(parts)).cast("int").alias("part"))
    return (dealt.repartition(partitions(placed.sparkSession), "region", "part")
            .sortWithinPartitions("region", "part")
            .mapInArrow(grow, f"region int, part int, {PACKED}"))


def _of(values: np.ndarray):
    """The value of a row's region."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("region") + 1)


def _visits(queries: DataFrame, cuts: Cuts, radii: np.ndarray, parts: np.ndarray, width: int,
            begin: int, end: int) -> DataFrame:
    """(region, part, q, floor, vector): the shards of each query's regions ``begin`` to ``end`` by bound."""
    reach = np.sqrt((cuts.centres ** 2).sum(axis=1)) + radii

    def choose(batches):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), width)
            norm = _lengths(matrix)
            bound = matrix @ cuts.centres.T + norm[:, None] * radii + norm[:, None] * reach * 1e-9
            bound[:, parts == 0] = -np.inf
            floor = batch.column("floor").to_numpy()
            order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
            rows = np.repeat(np.arange(len(matrix)), order.shape[1])
            region = order.ravel()
            stay = (bound[rows, region] >= floor[rows]) & (parts[region] > 0)
            rows, region = rows[stay], region[stay]
            times = parts[region]
            part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            rows, region = np.repeat(rows, times), np.repeat(region, times)
            for a in range(0, len(rows), 4096):
                at = pa.array(rows[a:a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region[a:a + 4096], pa.int32()), pa.array(part[a:a + 4096], pa.int32()),
                     *(batch.column(c).take(at) for c in ("q", "floor", "vector"))],
                    ["region", "part", "q", "floor", "vector"])

    return queries.select("q", "floor", "vector").mapInArrow(
        choose, "region int, part int, q bigint, floor bigint, vector array<bigint>")


def _answers(forest: DataFrame, visits: DataFrame, keep: int, width: int) -> DataFrame:
    """(q, score, id): what the visited shards hold for their queries."""
    load = visits.groupBy("region", "part").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies"))
    load = cut_lineage(load, "visits")
    trees = forest.join(load, ["region", "part"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    callers = visits.join(load, ["region", "part"]).withColumn(
        "copy", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int")).drop("copies")
    key = ["region", "part", "copy"]

    def ask(batches):
        tree = None
        for batch in batches:
            trees_at = np.flatnonzero(np.asarray(batch.column("q").is_null())).tolist()
            for a, b in zip([-1, *trees_at], [*trees_at, batch.num_rows]):
                if a >= 0:
                    tree = Tree.unpacked(batch.slice(a, 1).to_pylist()[0])
                if b <= a + 1:
                    continue
                own = batch.slice(a + 1, b - a - 1)
                scores, ids = tree.search(_matrix(own.column("vector"), width), own.column("floor").to_numpy(), keep)
                full = scores != NONE
                q = np.repeat(own.column("q").to_numpy(), full.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores[full]), pa.array(ids[full])],
                                                 ["q", "score", "id"])

    both = trees.unionByName(callers, allowMissingColumns=True)
    return (both.repartition(partitions(forest.sparkSession), *key)
            .sortWithinPartitions(*key, F.col("q").asc_nulls_first())
            .mapInArrow(ask, "q bigint, score bigint, id bigint"))


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _self_scored(queries: DataFrame, width: int) -> DataFrame:
    def score(batches):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), width)
            own = [products(row[None], row[None])[0, 0] for row in matrix]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "own"])

    return queries.mapInArrow(score, "id bigint, vector array<bigint>, own bigint")


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the ``k`` best of ``rows``, its own row left out.

    Both have columns ``id`` and ``vector`` of integers, and every query is one of the rows.
    """
    keep = k + 1            # a query's own row may be among the best
    points = cut_lineage(_points(rows, keep), "points")
    width, n = points.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    width = max(width or 0, 1)
    sample = [r.vector for r in sample_by_hash(points.select("vector"), "vector", SAMPLE).collect()]
    cuts = Cuts(np.array([[*v, *[0] * (width - len(v))] for v in sample], np.int64).reshape(len(sample), width),
                min(REGIONS, -(-n // SHARD))) if n else Cuts(np.zeros((1, width)), 1)
    placed = cut_lineage(_placed(points, cuts, width), "points-by-region")
    sizes, radii = np.zeros(cuts.regions, np.int64), np.zeros(cuts.regions)
    for region, count, away in placed.groupBy("region").agg(F.count(F.lit(1)), F.max("away")).collect():
        sizes[region], radii[region] = count, away       # a row per region at most
    parts = -(-sizes // SHARD)
    forest = cut_lineage(_forest(placed, np.maximum(parts, 1), width), "ball-trees")

    numbered = cut_lineage(with_dense_id(_self_scored(queries.select("id", "vector"), width), "q", ["id", "vector"]),
                           "queries")
    found, begin, end = None, 0, 1
    while begin < cuts.regions:
        floors = numbered.withColumn("floor", F.lit(int(NONE)))
        if found is not None:
            known = (_best(found, keep).groupBy("q")
                     .agg(F.when(F.count(F.lit(1)) == keep, F.min("score")).alias("floor")))
            floors = numbered.join(known, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(int(NONE))))
        visits = _visits(floors, cuts, radii, parts, width, begin, end)
        fresh = _answers(forest, visits, keep, width)
        found = cut_lineage(_best(fresh if found is None else found.unionByName(fresh), keep).drop("rank"), "best")
        begin, end = end, min(end * 4, cuts.regions)
    entries = found.groupBy("q").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("down"), "id"))).alias("best"))
    own = F.array_position("best", F.struct((-F.col("own")).alias("down"), F.col("asker").alias("id")))
    told = (numbered.withColumnRenamed("id", "asker").join(entries, "q")
            .select("asker", "best", own.alias("at"))
            .select("asker", F.slice(F.filter("best", lambda x, i: i != F.col("at") - 1), 1, k).alias("best")))
    return told.select(F.col("asker").alias("query_id"), F.posexplode("best").alias("rank", "entry")).select(
        "query_id", (F.col("rank") + 1).alias("rank"),
        F.when(F.col("entry.id") != int(MOST), F.col("entry.id")).alias("vec_id"),
        (-F.col("entry.down")).alias("score"))
