"""The one relation of the engine: versions of keys.

``key`` and ``value`` are BINARY at rest (STRING works in every operator too: both compare bytewise), ``ts``
is a logical version in 0..2^63-1, ``kind`` tells puts from deletes, ``src`` is the priority of the run that a
row comes from (the lower wins a tie) and ``seq`` the position of the mutation in its batch (the later wins).
The total order is (key ASC, ts DESC, src ASC, seq DESC).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 1, 2
MAX_TS = 2**63 - 1

SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("src", T.IntegerType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
COLUMNS = SCHEMA.names


def is_tombstone(empty_is_delete: bool = True) -> Column:
    """Deletes, and with ``empty_is_delete`` also puts of an empty or missing value."""
    gone = F.col("kind") == DELETE
    return gone | (F.coalesce(F.octet_length("value"), F.lit(0)) == 0) if empty_is_delete else gone


def guard(df: DataFrame) -> DataFrame:
    """``df`` with a run-time check of its versions, kinds and keys (no plan change beyond one filter)."""
    legal = F.col("ts").between(0, MAX_TS) & F.col("kind").isin(PUT, DELETE) & (F.octet_length("key") > 0)
    return df.where(F.assert_true(F.coalesce(legal, F.lit(False)), F.lit("version out of range, unknown kind or empty key")).isNull())


def empty(spark) -> DataFrame:
    """The relation without rows."""
    return spark.createDataFrame([], SCHEMA)
