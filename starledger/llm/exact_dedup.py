"""Exact dedup by content sort.

Sampled splitters deal the normalised texts to ranges, Spark's external sort puts equal texts next
to each other, and every text is compared in full with its neighbour.  The splitters and the sort
take a text's leading bytes, then its SHA-256, then the id: Spark's sample of whole texts would
grow with their length on the driver, and the id lets one group of copies cover many ranges.  What
a range cannot know, whether its outermost groups go on in the next one, is settled through a table
of two rows per range.

Defined results: a null text counts as empty; of equal texts one row stays, that with the largest
id (``keep="largest"``) or the smallest; a null id loses to any other; of rows with the same id and
text one stays; other columns, whatever their names, are carried or ignored and never compared; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.llm.common import partitions, place, positional, slices, text_bytes
from starledger.session import cut_lineage

LEAD = 64            # leading bytes that splitters and sort compare before the digest
SLICE = 8 << 20      # text bytes a task handles at a time

RUN_FIELDS = [("pid", "int"), ("edge", "int"), ("keep_id", "bigint"), ("group_size", "bigint"),
              ("is_last", "boolean"), ("is_edge_row", "boolean"), ("edge_text", "binary")]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the leading bytes and the SHA-256 of the normalised text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("k_lead", T.BinaryType()),
                           T.StructField("k_sha", T.BinaryType())])

    def keys(batches):
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                norm = [b.lower() for b in text_bytes(batch.column(text))]  # bytes: A-Z only
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([b[:LEAD] for b in norm], pa.binary()),
                     pa.array([hashlib.sha256(b).digest() for b in norm], pa.binary())],
                    [*batch.schema.names, "k_lead", "k_sha"])

    return docs.mapInArrow(keys, schema)


def _runs(ordered: DataFrame, ident: str, text: str, carried: list[str]) -> DataFrame:
    """Runs of equal neighbours in each sorted range.

    ``carried`` empty: one row per document.  Else the last row of each run with those columns.
    Two more rows per range (one if it holds a single run) describe its outermost runs.
    """
    only_last = bool(carried)
    kept_cols = carried or [ident, "k_sha"]
    kinds = {f.name: f for f in ordered.schema.fields}
    schema = T.StructType([kinds[c] for c in kept_cols]
                          + T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in RUN_FIELDS)).fields)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def walk(batches):
        pid = TaskContext.get().partitionId()
        arrow = None
        pending: list[tuple[pa.RecordBatch, int, int]] = []   # (batch, first row, rows) of the open run
        current, size, best, n_runs = None, 0, None, 0
        ready: list[pa.RecordBatch] = []

        def emit(rows: pa.Table | pa.RecordBatch, n, edge, keep, size, last_flags):
            cols = [rows.column(c) for c in kept_cols]
            cols += [pa.array([pid] * n, pa.int32()), pa.array([edge] * n, pa.int32()),
                     pa.array([keep] * n, pa.int64()), pa.array([size] * n, pa.int64()),
                     pa.array(last_flags, pa.bool_()), pa.array([False] * n, pa.bool_()),
                     pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [*kept_cols, *[n for n, _ in RUN_FIELDS]])

        def close(edge):
            parts = pending[-1:] if only_last else pending
            out = []
            for i, (batch, start, n) in enumerate(parts):
                is_final = i == len(parts) - 1
                if only_last:
                    start, n = start + n - 1, 1
                flags = [False] * (n - 1) + [is_final]
                out.append(emit(batch.slice(start, n), n, edge, best, size, flags))
            return out

        def edge_row(edge):
            cols = [pa.nulls(1, arrow.field(c).type) for c in kept_cols]
            cols += [pa.array([pid], pa.int32()), pa.array([edge], pa.int32()),
                     pa.array([best], pa.int64()), pa.array([size], pa.int64()),
                     pa.array([False]), pa.array([True]), pa.array([current], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [*kept_cols, *[n for n, _ in RUN_FIELDS]])

        def flushed():
            if ready:
                whole = pa.Table.from_batches(ready).combine_chunks()
                ready.clear()
                yield from whole.to_batches()

        for whole in batches:
            arrow = whole.schema
            for batch in slices(whole, text, SLICE):
                norm = [b.lower() for b in text_bytes(batch.column(text))]
                ids = batch.column(ident).to_pylist()
                # An open run may last for many batches: it holds copies of ids and digests, or the
                # last row's batch, never the texts it has passed.
                slim = batch.select(kept_cols) if only_last else pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(c).to_pylist(), arrow.field(c).type) for c in kept_cols], kept_cols)
                start = 0
                for i, here in enumerate(norm):
                    if here == current:
                        size += 1
                        best = ids[i]       # ids come in order: the last one stays
                        continue
                    if current is not None:
                        if i > start:
                            pending = pending[:0 if only_last else None] + [(slim, start, i - start)]
                        edge = 0 if n_runs == 1 else None
                        ready.extend(close(edge))
                        if edge == 0:
                            ready.append(edge_row(0))
                    pending, start = [], i
                    current, size, best = here, 1, ids[i]
                    n_runs += 1
                if len(norm) > start:
                    pending = pending[:0 if only_last else None] + [(slim, start, len(norm) - start)]
                yield from flushed()
        if current is not None:
            edge = 0 if n_runs == 1 else 1
            ready.extend(close(edge))
            ready.append(edge_row(edge))
        yield from flushed()

    return ordered.mapInArrow(walk, schema)


def _chains(runs: DataFrame) -> DataFrame:
    """For each outermost run: the kept id and size of the whole group, and whether it goes on.

    At most two rows per range; the ordered windows hold no texts.
    """
    edges = runs.filter("is_edge_row").select("pid", "edge", "keep_id", "group_size", "edge_text")
    order = Window.orderBy("pid", "edge")
    steps = edges.select("pid", "edge", F.lag("pid").over(order).alias("prev_pid"),
                         F.lag("edge").over(order).alias("prev_edge"))
    mine = edges.select("pid", "edge", "keep_id", "group_size", F.col("edge_text").alias("mine"))
    before = edges.select(F.col("pid").alias("prev_pid"), F.col("edge").alias("prev_edge"),
                          F.col("edge_text").alias("before"))
    linked = (steps.join(mine, ["pid", "edge"]).join(before, ["prev_pid", "prev_edge"], "left")
              .select("pid", "edge", "keep_id", "group_size",
                      F.coalesce((F.col("edge") == 0) & (F.col("mine") == F.col("before")),
                                 F.lit(False)).alias("continues")))
    chained = linked.select(
        "*", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(order).alias("chain"),
        F.coalesce(F.lead("continues").over(order), F.lit(False)).alias("goes_on"))
    # The last range of a chain holds the id that stays.
    totals = chained.groupBy("chain").agg(F.sum("group_size").alias("e_size"),
                                          F.max_by("keep_id", F.struct("pid", "edge")).alias("e_keep"))
    return (chained.join(totals, "chain")
            .select("pid", F.col("edge").alias("e_edge"), "e_size", "e_keep", "goes_on"))


def _sorted(docs: DataFrame, text: str, ident: str, keep: str, n: int | None) -> DataFrame:
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    by_id = F.col(ident).asc_nulls_first() if keep == "largest" else F.col(ident).desc_nulls_first()
    order = [F.col("k_lead"), F.col("k_sha"), by_id]
    return (_keyed(docs, text).repartitionByRange(n or partitions(docs.sparkSession), *order)
            .sortWithinPartitions(*order))


def _settled(runs: DataFrame) -> DataFrame:
    """Rows of ``runs`` with the outermost runs' groups completed."""
    # Two rows per range at most: bounded by the number of partitions, whatever the data.
    chains = F.broadcast(_chains(runs))
    joined = runs.filter("not is_edge_row").join(
        chains.withColumnRenamed("pid", "e_pid"),
        (F.col("pid") == F.col("e_pid")) & (F.col("edge") == F.col("e_edge")), "left")
    on_edge = F.col("edge").isNotNull()
    return joined.select(
        *[c for c in runs.columns if c not in dict(RUN_FIELDS)],
        F.when(on_edge, F.col("e_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(on_edge, F.col("e_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("is_last") & ~(on_edge & F.coalesce("goes_on", F.lit(False)))).alias("kept"))


def groups(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "smallest",
           n_partitions: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (hex, normalised text)."""
    slim = positional(docs).select(F.col(place(docs, ident)).cast("bigint").alias("id"),
                                   F.col(place(docs, text)).cast("string").alias("text"))
    runs = cut_lineage(_runs(_sorted(slim, "text", "id", keep, n_partitions), "id", "text", []),
                       "content-runs")
    return _settled(runs).select(
        F.col("id").alias(ident), "keep_id", "group_size", "kept",
        F.lower(F.hex("k_sha")).alias("text_sha256"))


def unique_rows(docs: DataFrame, text: str = "text", ident: str = "doc_id",
                keep: str = "smallest", n_partitions: int | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    flat = positional(docs)
    runs = cut_lineage(_runs(_sorted(flat, place(docs, text), place(docs, ident), keep, n_partitions),
                             place(docs, ident), place(docs, text), flat.columns), "content-rows")
    return _settled(runs).filter("kept").select(*flat.columns).toDF(*docs.columns)
