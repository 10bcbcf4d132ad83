"""Distributed sequential numbering inside scopes (used by M1, M2, M6, M11, M14).

``row_number().over(Window.partitionBy(scope).orderBy(...))`` puts a whole scope in
one task; for a global scope (bags, products, sets) that is the whole input. Here:

1. range-partition the rows by (scope, order) and sort each partition - a hot scope is split over
   many partitions because the range key includes the order columns. This is the only shuffle;
2. number the rows of each scope within the partition, in one Arrow pass over the sorted rows that
   carries the running total from batch to batch;
3. ``pin`` that (a table in ``spark.checkpoint.dir``) so retried tasks see the same rows per partition;
4. read the first and the last row of each partition (two rows a partition, however many rows or
   scopes there are): they tell how far a scope had come where the next partition goes on with it;
5. add that offset, broadcast as at most one row a partition, to the rows of each partition's first scope.

``weight`` numbers ranges: a row with weight k takes k consecutive values (M2).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from batchtrace.session import pin

_ADDED = "_pid int, _local bigint, _head boolean, _edge int"
_FIRST, _LAST = 1, 2


def _numbering(scope: list[str]):
    def run(batches):
        """Adds the partition, the position of a row in its scope there, whether that scope is the
        partition's first, and whether the row is the partition's first or last."""
        pid = TaskContext.get().partitionId()
        last, total, head, held = None, 0, True, None

        def out(batch, local, heads, edge):
            added = [pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(local), pa.array(heads), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_pid", "_local", "_head", "_edge"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = batch.column("_w").to_numpy(zero_copy_only=False)
            new = np.zeros(n, bool)
            for c in scope:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            key = tuple(batch.column(c)[0].as_py() for c in scope)
            new[0] = held is None or key != last
            before = np.cumsum(w) - w
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            local = before - np.where(start >= 0, before[np.maximum(start, 0)], -total)
            heads = np.zeros(n, bool)
            if head:
                changes = np.flatnonzero(new) if held is not None else np.flatnonzero(new)[1:]
                heads[:changes[0] if len(changes) else n] = True
                head = not len(changes)
            edge = np.zeros(n, np.int32)
            if held is None:
                edge[0] = _FIRST
            else:
                yield out(*held)
            last = tuple(batch.column(c)[n - 1].as_py() for c in scope)
            total = int(local[-1] + w[-1])
            held = (batch, local, heads, edge)
        if held is not None:
            held[3][-1] |= _LAST
            yield out(*held)
    return run


def sequence_within(df: DataFrame, scope: list[str], order: list[str], weight: str | None = None,
                     out: str = "_seq0", num_partitions: int | None = None) -> DataFrame:
    """Add ``out``: 0-based position of each row inside its scope in ``order`` (ties must
    be broken by ``order``; pass a unique request id last). With ``weight``, ``out`` is the
    first of the row's ``weight`` consecutive positions."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_w", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    ranged = keyed.repartitionByRange(n, *scope, *order).sortWithinPartitions(*scope, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields), _ADDED])
    pinned = pin(ranged.mapInArrow(_numbering(scope), schema))

    # two rows a partition
    edges = pinned.where("_edge > 0").select("_pid", "_edge", "_local", "_w", *scope).collect()
    offsets, came = [], {}
    for r in sorted(edges, key=lambda r: (r["_pid"], r["_edge"] == _LAST)):
        at = tuple(r[c] for c in scope)
        if r["_edge"] & _FIRST:
            offset, head = came.get(at, 0), at
            if offset:
                offsets.append((r["_pid"], offset))
        if r["_edge"] & _LAST:
            came = {at: r["_local"] + r["_w"] + (offset if at == head else 0)}
    res = pinned.withColumn(out, F.col("_local"))
    if offsets:
        more = F.broadcast(spark.createDataFrame(offsets, "_pid int, _off bigint"))  # at most a row a partition
        res = pinned.join(more, "_pid", "left").withColumn(
            out, F.col("_local") + F.when(F.col("_head"), F.coalesce("_off", F.lit(0))).otherwise(0)).drop("_off")
    return res.drop("_pid", "_local", "_head", "_edge", "_w")


def scope_key(cols: list[str]) -> F.Column:
    """Counter scope text: '' for a global scope, else the parts joined by spaces."""
    return F.concat_ws(" ", *cols) if cols else F.lit("")
