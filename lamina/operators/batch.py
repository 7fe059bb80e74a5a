"""Write batches: a driver-side builder, and the same rules for bulk DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.keys import entry_size
from lamina.schema import DELETE, PUT, SCHEMA


@dataclass
class Batch:
    """Mutations of one commit, in order. A put is refused once its key has any mutation; deletes always go in."""

    mutations: list[tuple[bytes, int, bytes | None]] = field(default_factory=list)
    _keys: dict[bytes, int] = field(default_factory=dict)

    def put(self, key: bytes, value: bytes) -> bool:
        if key in self._keys:
            return False
        self._append(key, PUT, value)
        return True

    def delete(self, key: bytes) -> None:
        self._append(key, DELETE, None)

    def _append(self, key: bytes, kind: int, value: bytes | None) -> None:
        if not key:
            raise ValueError("empty keys are not data")
        self._keys.setdefault(key, len(self.mutations))
        self.mutations.append((key, kind, value))

    def get(self, key: bytes) -> tuple[bytes | None, bool]:
        """Value of the key's first mutation (None for a delete) and whether there is one."""
        at = self._keys.get(key)
        return (None, False) if at is None else (self.mutations[at][2], True)

    def __contains__(self, key: bytes) -> bool:
        return key in self._keys

    def __len__(self) -> int:
        return len(self.mutations)

    @property
    def is_empty(self) -> bool:
        return not self.mutations

    def stamped(self, ts: int) -> list[tuple]:
        """Rows of the versioned relation at one commit version."""
        if not 0 <= ts < 2**63:
            raise ValueError("version out of range")
        return [(key, ts, kind, value, 0, seq) for seq, (key, kind, value) in enumerate(self.mutations)]

    def size_in_bytes(self) -> int:
        return sum(len(key) + 8 + len(value or b"") for key, _, value in self.mutations)

    def frame(self, spark: SparkSession, ts: int) -> DataFrame:
        return spark.createDataFrame(self.stamped(ts), SCHEMA)


def accepted(mutations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bulk form of the batch rule over ``(key, kind, seq, ...)``: deletes, and puts that come first for their key.

    ``by`` names columns that tell several batches apart.
    """
    first = F.row_number().over(Window.partitionBy(*by, "key").orderBy("seq")) == 1
    return mutations.withColumn("__first", first).where((F.col("kind") == DELETE) | F.col("__first")).drop("__first")


def first_mutation(mutations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What a get on the batch sees: the first mutation of each key."""
    rank = F.row_number().over(Window.partitionBy(*by, "key").orderBy("seq"))
    return mutations.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def containing(keys: DataFrame, mutations: DataFrame) -> DataFrame:
    """The rows of ``keys(key)`` that have a mutation in the batch."""
    return keys.join(mutations.select("key"), "key", "left_semi")


def stamp(mutations: DataFrame, ts: int) -> DataFrame:
    """Mutations at one commit version; deletes lose their value."""
    if not 0 <= ts < 2**63:
        raise ValueError("version out of range")
    known = F.assert_true(F.col("kind").isin(PUT, DELETE), F.lit("unknown kind")).isNull()
    return mutations.where(known).withColumns({"ts": F.lit(ts).cast("long"), "value": F.when(F.col("kind") == DELETE, F.lit(None)).otherwise(F.col("value"))})


def size_in_bytes(entries: DataFrame, *by: str) -> DataFrame:
    """Entries and bytes of batches."""
    return entries.groupBy(*by).agg(F.count("*").alias("entries"), F.sum(entry_size(F.col("key"), F.col("value"))).alias("bytes"))


def fill_levels(entries: DataFrame, budget: int, by: tuple[str, ...] = ("src",)) -> DataFrame:
    """Levels of at most ``budget`` bytes that entries fill in write order (seq, key, ts): ``entry_bytes``, ``held``, ``flush_no``.

    An entry goes into the current level if what is held and the entry's bytes fit the budget, else it opens the
    next one; a version written again counts only the difference of its values. An entry beyond the budget has a level of its own.
    The rule is a fold along each group: a group is one task, streamed, with the keys of one level in memory.
    """
    names = [*by, "key", "ts", "entry_bytes"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, level, held, sizes = None, 0, 0, {}
        for batch in batches:
            helds, levels = [], []
            for *now, key, ts, size in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if now != group:
                    group, level, held, sizes = now, 0, 0, {}
                delta = size - sizes.get((key, ts), 0)
                if sizes and held + delta > budget:
                    level, held, sizes, delta = level + 1, 0, {}, size
                held += delta
                sizes[key, ts] = size
                helds.append(held)
                levels.append(level)
            added = [pa.array(helds, pa.int64()), pa.array(levels, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "held", "flush_no"])

    sized = entries.withColumn("entry_bytes", entry_size(F.col("key"), F.col("value")))
    schema = T.StructType([*sized.schema.fields, T.StructField("held", T.LongType()), T.StructField("flush_no", T.LongType())])
    return sized.repartition(*by).sortWithinPartitions(*by, "seq", "key", "ts").mapInArrow(fold, schema)
