"""Running values along an order, without a task per group.

A plain window puts all rows of a group into one task. Here rows are dealt by range of (group, order) and sorted, once,
so a group with a third of all rows spreads over many tasks. Each part is streamed through one pass that
computes its own running values in numpy; only the first group of a part can go on from the part before, so one
row a part (its first and last group and its last value) tells what to add to the rows of that group. Those rows,
as many as there are parts, are accumulated on the driver and broadcast. The parts are written to the shared scratch
folder, since both passes must see the same ones; nothing is shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.scratch import materialize

#: What a part's pass adds to its rows: the part, the place in it, whether the row belongs to the part's first group.
ADDED = T.StructType([T.StructField("__part", T.LongType()), T.StructField("__at", T.LongType()), T.StructField("__first", T.BooleanType())])
Step = Callable[[pa.Array, np.ndarray, pa.Scalar | None], pa.Array]


def _changes(columns: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    """True where a group begins: the group columns differ from the row before (from ``before`` in the first row)."""
    starts = np.zeros(len(columns[0]), dtype=bool)
    for k, column in enumerate(columns):
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
        starts[0] |= before is None or not column[0].equals(before[k])
    return starts


def _pass(by: list[str], value: str, step: Step):
    """Replace ``value`` by its running value within groups, and add the ``ADDED`` columns; state is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, first, group, last = TaskContext.get().partitionId(), 0, True, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(c) for c in by]
            starts = _changes(keys, group)
            if place == 0:
                in_first = np.cumsum(starts) == 1
            else:
                in_first = np.full(n, first) & (np.cumsum(starts) == 0)
            values = step(batch.column(value), starts, last)
            group, last, first = [k[n - 1] for k in keys], values[n - 1], bool(in_first[-1])
            columns = [values if name == value else column for name, column in zip(batch.schema.names, batch.columns, strict=True)]
            added = [pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(place, place + n), pa.int64()), pa.array(in_first, pa.bool_())]
            place += n
            yield pa.RecordBatch.from_arrays([*columns, *added], names=[*batch.schema.names, *ADDED.names])

    return run


def _sums(values: pa.Array, starts: np.ndarray, last: pa.Scalar | None) -> pa.Array:
    raw = values.to_numpy(zero_copy_only=False)
    total = np.cumsum(raw) + (0 if last is None or starts[0] else last.as_py())
    begins = np.nonzero(starts)[0]
    if len(begins):
        total -= np.repeat(np.concatenate([[0], total[begins] - raw[begins]]), np.diff(np.concatenate([[0], begins, [len(raw)]])))
    return pa.array(total, values.type)


def _carried(values: pa.Array, starts: np.ndarray, last: pa.Scalar | None) -> pa.Array:
    known = pc.is_valid(values).to_numpy(zero_copy_only=False) | starts
    source = np.maximum.accumulate(np.where(known, np.arange(1, len(values) + 1), 0))  # 0: from the batch before
    head = pa.array([None if last is None else last.as_py()], values.type)
    return pa.concat_arrays([head, values]).take(pa.array(source))


def _running(df: DataFrame, by: list[str], order: list[str], value: str, step: Step, name: str) -> tuple[DataFrame, list[tuple[int, object]]]:
    """The rows with the running ``value`` of their part, and what the first group of each part starts from."""
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    schema = T.StructType([*dealt.schema.fields, *ADDED.fields])
    stored, _ = materialize(dealt.mapInArrow(_pass(by, value, step), schema), name)
    group = F.struct(*by)
    ends = stored.groupBy("__part").agg(F.min_by(group, "__at").alias("begin"), F.max_by(group, "__at").alias("end"), F.max_by(F.struct(value), "__at").alias("last"))
    carries, before, held = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # one row a part
        goes_on = before is not None and r["begin"] == before
        carry = held if goes_on else None
        if carry is not None:
            carries.append((r["__part"], carry))
        value_now = r["last"][0]
        if r["begin"] != r["end"] or carry is None:
            held = value_now
        elif step is _sums:
            held = carry + value_now
        else:
            held = carry if value_now is None else value_now
        before = r["end"]
    return stored, carries


def _with_carry(stored: DataFrame, carries: list[tuple[int, object]], value: str) -> DataFrame:
    schema = T.StructType([T.StructField("__part", T.LongType()), T.StructField("__carry", stored.schema[value].dataType)])
    table = stored.sparkSession.createDataFrame(carries, schema)
    return stored.join(F.broadcast(table), "__part", "left").withColumn("__carry", F.when(F.col("__first"), F.col("__carry")))


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of the column ``value`` (an integer) over the rows of its group up to and including each row, in ``order``."""
    stored, carries = _running(df.withColumn(name, F.col(value).cast("long")), by, order, name, _sums, "running-sum")
    return _with_carry(stored, carries, name).withColumn(name, F.col(name) + F.coalesce("__carry", F.lit(0))).drop("__carry", *ADDED.names)


def carry_last(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with NULLs of ``value`` replaced by the last value before them in their group, in ``order``."""
    stored, carries = _running(df, by, order, value, _carried, "carry-last")
    return _with_carry(stored, carries, value).withColumn(value, F.coalesce(value, "__carry")).drop("__carry", *ADDED.names)
