"""Places, running totals and next rows within groups of any size: one path, no window.

The rows are dealt to tasks by ranges of (group, order), so a group of a third of all rows is spread like
any other. Each task walks its range once in batches; one row of totals per task then carries what a
group had before the range, and a second walk adds it."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..session import stored

FIRST, LAST = 1, 2           # marks of the rows at the edges of a range


def _changes(batch: pa.RecordBatch, group: Sequence[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """(whether each row begins a group, the group of the final row)."""
    new = np.zeros(batch.num_rows, bool)
    for c in group:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = last is None or tuple(batch.column(c)[0].as_py() for c in group) != last
    return new, tuple(batch.column(c)[-1].as_py() for c in group)


def _walk(batches: Iterator[pa.RecordBatch], group, sums, lead, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, last, place, is_open = TaskContext.get().partitionId(), None, -1, True
    totals, held = np.zeros(len(sums), "int64"), None

    def give(columns, edge, following=None):
        columns["_edge"] = pa.array(edge, pa.int32())
        if lead:
            after = columns.pop("_after")
            columns["_next"] = pa.concat_arrays([after, pa.array([following], after.type)])
        return pa.record_batch([columns[f.name] for f in schema], schema)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        new, now = _changes(batch, group, last)
        if held is not None:
            yield give(*held, batch.column(lead)[0].as_py() if lead and not new[0] else None)
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        inside = begin >= 0
        opened = np.zeros(n, bool)
        if last is None:
            opened = np.cumsum(new) == 1
        elif is_open:
            opened = ~inside
        columns = {c: batch.column(c) for c in batch.schema.names}
        at = np.arange(n) - np.where(inside, begin, -place - 1)
        columns |= {"_part": pa.array(np.full(n, part, "int32")), "_open": pa.array(opened), "_at": pa.array(at)}
        for j, c in enumerate(sums):
            v = batch.column(c).to_numpy(zero_copy_only=False).astype("int64")
            upto = np.cumsum(v)
            upto = upto - np.where(inside, upto[begin] - v[begin], -totals[j])
            columns[f"{c}_upto"] = pa.array(upto)
            totals[j] = upto[-1]
        if lead:
            columns["_after"] = pc.if_else(pa.array(new[1:]), pa.scalar(None, batch.column(lead).type), batch.column(lead).slice(1))
        edge = np.zeros(n, "int32")
        edge[0] = FIRST * (last is None)
        is_open, last, place, held = bool(opened[-1]), now, int(at[-1]), (columns, edge)
    if held is not None:
        held[1][-1] += LAST
        yield give(*held)


def _carried(edges: list, group, sums, lead) -> tuple[dict, dict]:
    """({range: (rows, totals) its first group has before it}, {range: lead value after its last row})."""
    carry, following, run, before = {}, {}, None, None
    name = lambda r: tuple(r[c] for c in group)
    for r in sorted(edges, key=lambda r: (r["_part"], -(r["_edge"] & FIRST))):
        if r["_edge"] & FIRST:
            if run is not None and run[0] == name(r):
                carry[r["_part"]] = run[1:]
                if lead:
                    following[before] = r[lead]
        if r["_edge"] & LAST:
            own = (r["_at"] + 1, np.array([r[f"{c}_upto"] for c in sums], "int64"))
            if r["_open"] and r["_part"] in carry:
                own = (own[0] + carry[r["_part"]][0], own[1] + carry[r["_part"]][1])
            run, before = (name(r), *own), r["_part"]
    return carry, following


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), lead: str | None = None,
            partitions: int | None = None) -> DataFrame:
    """`rows` with `_at` (place in its group from 0, in order of `order`, nulls first), `<c>_upto` for the
    long columns in `sums` (total up to and with the row; sums wrap at 64 bits) and, for the column
    `lead`, `_next`: its value in the group's next row, null at the last.

    `group` may be empty. Rows equal in group and order stay in one range: add a column to `order` that
    tells them apart if there may be many. `partitions` ranges, else spark.sql.shuffle.partitions."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    extra = [StructField("_part", IntegerType()), StructField("_open", BooleanType()), StructField("_edge", IntegerType()),
             StructField("_at", LongType()), *[StructField(f"{c}_upto", LongType()) for c in sums]]
    if lead:
        extra.append(StructField("_next", rows.schema[lead].dataType))
    schema = StructType([*rows.schema.fields, *extra])

    def walk(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        yield from _walk(batches, group, sums, lead, to_arrow_schema(schema))

    local = stored(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(walk, schema), "ranges")
    seen = ["_part", "_edge", "_open", "_at", *group, *[f"{c}_upto" for c in sums], *([lead] if lead else [])]
    # two rows a range at most
    carry, following = _carried(local.where("_edge > 0").select(*dict.fromkeys(seen)).collect(), group, sums, lead)
    kept = StructType([f for f in schema if f.name not in ("_part", "_open", "_edge")])

    def add(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            part, is_open = columns["_part"].to_numpy(), columns["_open"].to_numpy(zero_copy_only=False)
            final = columns["_edge"].to_numpy() >= LAST
            for p in np.unique(part).tolist():
                if p in carry:
                    here = is_open & (part == p)
                    for c, x in (("_at", carry[p][0]), *zip([f"{c}_upto" for c in sums], carry[p][1])):
                        columns[c] = pa.array(columns[c].to_numpy() + np.where(here, x, 0))
                if p in following:
                    here = pa.array(final & (part == p))
                    columns["_next"] = pc.if_else(here, pa.scalar(following[p], columns["_next"].type), columns["_next"])
            yield pa.record_batch([columns[f.name] for f in kept], [f.name for f in kept])

    return local.mapInArrow(add, kept)
