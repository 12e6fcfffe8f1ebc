"""Close approaches of directions to sightlines that each look one way, tile by tile.

A tile is a grid cell of the sky, a share of its sightlines and a share of the satellites in reach of the cell.
A sightline has one tile per share of satellites, a satellite's steps within reach of a cell meet in one of that
cell's tiles: the closest step of a pair is known there, and no pair is shuffled.  Pairs are found in slabs and
handed on as they are found, so neither a tile's pairs nor its satellites are ever held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.operators.cells import home_cell, reached_cells
from starledger.session import cut_lineage, many_tasks

LINES_PER_TILE = 1 << 17         # sightlines that one task holds at a time
STEPS_PER_SHARE = 1 << 18        # satellite steps, of the whole sky, in one share
SLAB = 1 << 16                   # separations worked out at once
PAIRS_PER_BATCH = 1 << 17

_TILE = ["_cell", "_share", "_part"]
_VECTOR = ["_x", "_y", "_z"]


def approaches_by_tile(track: DataFrame, seen: DataFrame, sep_deg: float, keep: list[str],
                       closest: bool, request: str = "request_id", tally: bool = False) -> DataFrame:
    """(request, satellite_id, step, sep_deg, kept columns): steps of ``seen`` nearer than ``sep_deg`` to a sightline.

    ``track`` (request, g_x, g_y, g_z) has a row per sightline, ``seen`` (satellite_id, step, u_x, u_y, u_z, kept
    columns) a row per satellite and step.  With ``closest`` each pair of a sightline and a satellite has its closest
    step only, the earlier one on a tie.  Missing ids are ids like others.  With ``tally`` the pairs are counted where
    they are found: (request, kept columns, hits), several rows per group, to be summed up.
    """
    spark = track.sparkSession
    lines = cut_lineage(track.select(F.col(request).alias("_request"), *[
        F.col(f"g_{a}").alias(f"_{a}") for a in "xyz"]).dropna(subset=_VECTOR), "sightlines")
    steps = cut_lineage(seen.select("satellite_id", "step", *keep, *[
        F.col(f"u_{a}").alias(f"_{a}") for a in "xyz"]).dropna(subset=_VECTOR), "directions")
    shares = -(-max(steps.count(), 1) // STEPS_PER_SHARE)
    parts = -(-max(lines.count(), 1) // LINES_PER_TILE)
    vector = [F.col(c) for c in _VECTOR]
    share = F.pmod(F.xxhash64("satellite_id"), F.lit(shares)).cast("int")
    part = F.pmod(F.xxhash64("_request", *_VECTOR), F.lit(parts)).cast("int")
    homes = lines.withColumns({"_cell": home_cell(*vector, sep_deg), "_part": part})
    moving = steps.withColumn("_share", share).withColumn("_cell", F.explode(reached_cells(*vector, sep_deg)))
    moving = moving.join(homes.select("_cell", "_part").distinct(), "_cell")
    homes = homes.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    of_lines, of_steps = ["_request"], ["satellite_id", "step", *keep]
    types = {**{c: homes.schema[c].dataType for c in of_lines}, **{c: steps.schema[c].dataType for c in of_steps}}

    def row(have: list[str], tag: int) -> list:
        return [*_TILE, F.lit(tag).alias("_tag"), *_VECTOR, *[
            F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in types.items()]]

    rows = homes.select(*row(of_lines, 0)).unionByName(moving.select(*row(of_steps, 1)))
    # A number of its own: the work of a task does not follow from the bytes it reads.
    dealt = rows.repartition(many_tasks(spark), *_TILE).sortWithinPartitions(*_TILE, "_tag", "satellite_id", "step")
    kept = [T.StructField(c, types[c]) for c in keep]
    found = [*kept, T.StructField("hits", T.LongType())] if tally else [
        *[T.StructField(c, types[c]) for c in ("satellite_id", "step")], T.StructField("sep_deg", T.DoubleType()), *kept]
    schema = T.StructType([T.StructField(request, types["_request"]), *found])
    return dealt.mapInArrow(_Pairs(sep_deg, keep, closest, request, tally), schema)


class _Pairs:
    """The pairs of the tiles in one partition: a tile's sightlines come first, then its satellites in order."""

    def __init__(self, sep_deg: float, keep: list[str], closest: bool, request: str, tally: bool = False):
        self.sep_deg, self.keep, self.closest, self.request, self.tally = sep_deg, keep, closest, request, tally

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, lines, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in [*_TILE, "_tag"]])
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *starts], [*starts, batch.num_rows]):
                rows = pa.Table.from_batches([batch.slice(start, end - start)])
                if tile != tuple(keys[start, :3]):
                    yield from self._found(lines, held)
                    tile, lines, held = tuple(keys[start, :3]), [], None
                if keys[start, 3] == 0:
                    lines.append(rows.select(["_request", *_VECTOR]))
                elif lines:
                    held = rows if held is None else pa.concat_tables([held, rows])
                    # The last satellite may have more steps in the next batch.
                    whole = _ids(held)[-1] if self.closest else held.num_rows
                    if whole:
                        yield from self._found(lines, held.slice(0, whole))
                        held = held.slice(whole)
        yield from self._found(lines, held)

    def _found(self, lines: list[pa.Table], steps: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Pairs of a tile's sightlines with some of its satellites, each with all its steps."""
        if not lines or steps is None or not steps.num_rows:
            return
        lines[:] = [pa.concat_tables(lines).combine_chunks()]
        steps = steps.combine_chunks()
        g, u = (np.stack([t.column(c).to_numpy() for c in _VECTOR]) for t in (lines[0], steps))
        starts = _ids(steps)
        satellite = np.repeat(np.arange(len(starts)), np.diff([*starts, steps.num_rows]))
        near = math.cos(math.radians(self.sep_deg)) - 1e-9 if self.sep_deg < 180 else -2.0
        tall = max(SLAB // steps.num_rows, 1)
        code, shown = _groups(steps, self.keep) if self.tally else (None, None)
        waiting, size = [], 0
        for top in range(0, g.shape[1], tall):
            for left in self._slabs(satellite):
                x, y, z = (g[i, top:top + tall, None] for i in range(3))
                dot = u[0, left] * x
                dot += u[1, left] * y
                dot += u[2, left] * z
                place = np.flatnonzero(dot >= near)           # the cosine decides almost all pairs
                line, step = np.divmod(place, dot.shape[1])
                sep = np.degrees(np.arccos(np.clip(dot.ravel()[place], -1.0, 1.0)))
                inside = sep < self.sep_deg
                line, step, sep = line[inside] + top, step[inside] + left.start, sep[inside]
                if self.closest and len(sep):
                    first = _closest(line, satellite[step], sep)
                    line, step, sep = line[first], step[first], sep[first]
                if self.tally:
                    n = np.bincount((line - top) * len(shown) + code[step])
                    group = np.flatnonzero(n)
                    line, step, sep = group // len(shown) + top, shown[group % len(shown)], n[group]
                waiting.append((line, step, sep))
                size += len(sep)
                if size >= PAIRS_PER_BATCH:
                    yield self._batch(lines[0], steps, waiting)
                    waiting, size = [], 0
        if size:
            yield self._batch(lines[0], steps, waiting)

    def _slabs(self, satellite: np.ndarray) -> Iterator[slice]:
        """Stretches of about a slab's steps that cut no satellite."""
        start = 0
        while start < len(satellite):
            end = start + SLAB
            if end < len(satellite) and self.closest:
                end = int(np.searchsorted(satellite, satellite[end], "left"))
                if end <= start:
                    end = int(np.searchsorted(satellite, satellite[start], "right"))
            yield slice(start, min(end, len(satellite)))
            start = end

    def _batch(self, lines: pa.Table, steps: pa.Table, found: list[tuple]) -> pa.RecordBatch:
        line, step, sep = (np.concatenate(part) for part in zip(*found))
        names = self.keep if self.tally else ["satellite_id", "step", *self.keep]
        columns = {self.request: lines.column("_request").combine_chunks().take(pa.array(line)),
                   "hits" if self.tally else "sep_deg": pa.array(sep),
                   **{c: steps.column(c).combine_chunks().take(pa.array(step)) for c in names}}
        order = [self.request, *names, "hits"] if self.tally else [self.request, *names[:2], "sep_deg", *self.keep]
        return pa.RecordBatch.from_pydict({c: columns[c] for c in order})


def _codes(steps: pa.Table, column: str) -> np.ndarray:
    """Equal values, missing ones too, as equal whole numbers."""
    codes = steps.column(column).combine_chunks().dictionary_encode(null_encoding="encode")
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(steps: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each step, one step of each group) by equal values of the columns."""
    group = np.zeros(steps.num_rows, np.int64)
    for column in columns:
        codes = _codes(steps, column)
        group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)[1]
    shown, group = np.unique(group, return_index=True, return_inverse=True)[1:]
    return group, shown


def _ids(steps: pa.Table) -> np.ndarray:
    """Where each satellite's steps begin, in rows that are sorted by satellite."""
    codes = _codes(steps, "satellite_id")
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _closest(line: np.ndarray, satellite: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """Of each run of one line and one satellite, in order of steps, the place of the first smallest separation."""
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (satellite[1:] != satellite[:-1])])
    run = np.cumsum(new) - 1
    least = np.flatnonzero(sep == np.minimum.reduceat(sep, np.flatnonzero(new))[run])
    return least[np.concatenate([[True], run[least[1:]] != run[least[:-1]]])]
