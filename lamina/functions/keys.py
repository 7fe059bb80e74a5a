"""Versioned keys as columns: comparison, ranges, encoding, sizes.

Predicates are written on ``key`` and ``ts`` separately, never on a struct of both, so that they reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A raw key with a version."""

    raw: bytes | str
    ts: int

    def __post_init__(self):
        if not 0 <= self.ts < 2**63:
            raise ValueError("version out of range")


@dataclass(frozen=True)
class KeyRange:
    """Inclusive range of versioned keys in (key ASC, ts ASC) order; None leaves a side open."""

    start: Key | None = None
    end: Key | None = None

    def __post_init__(self):
        if self.start and self.end and (_bytes(self.start.raw), self.start.ts) > (_bytes(self.end.raw), self.end.ts):
            raise ValueError("range starts after its end")

    def contains(self, key: Column | str = "key", ts: Column | str = "ts") -> Column:
        key, ts = _col(key), _col(ts)
        inside = F.lit(True)
        if self.start:
            inside = inside & (key >= self.start.raw) & ((key > self.start.raw) | (ts >= self.start.ts))
        if self.end:
            inside = inside & (key <= self.end.raw) & ((key < self.end.raw) | (ts <= self.end.ts))
        return inside

    def overlaps(self, low: Column | str = "min_key", high: Column | str = "max_key") -> Column:
        """Whether a run with these least and greatest raw keys can hold a row of the range."""
        low, high = _col(low), _col(high)
        touches = F.lit(True)
        if self.start:
            touches = touches & (high >= self.start.raw)
        if self.end:
            touches = touches & (low <= self.end.raw)
        return touches


def _bytes(raw: bytes | str) -> bytes:
    return raw.encode() if isinstance(raw, str) else raw


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_beyond(as_of: int | None = None, upper_key: bytes | str | None = None) -> Column:
    """Rows a snapshot may see: ``ts <= as_of`` for every key, and ``key <= upper_key``."""
    seen = F.lit(True)
    if as_of is not None:
        seen = seen & (F.col("ts") <= as_of)
    if upper_key is not None:
        seen = seen & (F.col("key") <= upper_key)
    return seen


def from_key(key: Key) -> Column:
    """Rows at or after ``key`` in (key ASC, ts DESC) order: what a seek starts at."""
    return (F.col("key") >= key.raw) & ((F.col("key") > key.raw) | (F.col("ts") <= key.ts))


def version_order() -> list[Column]:
    return [F.col("key").asc(), F.col("ts").desc(), F.col("src").asc(), F.col("seq").desc()]


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("src").asc(), F.col("seq").desc()]


def compare(key: Column, ts: Column, other_key: Column, other_ts: Column) -> Column:
    """-1, 0 or 1 in (key ASC, ts DESC) order."""
    by_ts = F.when(ts > other_ts, -1).when(ts < other_ts, 1).otherwise(0)
    return F.when(key < other_key, -1).when(key > other_key, 1).otherwise(by_ts)


def at_most(key: Column, ts: Column, other_key: Column, other_ts: Column) -> Column:
    """(key ASC, ts ASC) less than or equal."""
    return (key < other_key) | ((key == other_key) & (ts <= other_ts))


def empty_first_at_most(a: Column, b: Column) -> Column:
    """Bytewise less than or equal, where an empty string comes before everything."""
    return F.when(F.octet_length(a) == 0, True).when(F.octet_length(b) == 0, False).otherwise(a <= b)


def encode(key: Column, ts: Column) -> Column:
    """``key`` followed by its version as eight big-endian bytes; empty for an empty key."""
    packed = F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(ts), 16, "0")))
    return F.when(F.octet_length(key) == 0, F.unhex(F.lit(""))).otherwise(packed)


def decode_key(encoded: Column) -> Column:
    return F.substring(encoded, F.lit(1), F.octet_length(encoded) - 8)


def decode_ts(encoded: Column) -> Column:
    return F.conv(F.hex(F.substring(encoded, F.octet_length(encoded) - 7, F.lit(8))), 16, 10).cast("long")


def label(key: Column, ts: Column) -> Column:
    return F.concat(key.cast("string"), F.lit("@"), ts.cast("string"))


def encoded_size(key: Column) -> Column:
    size = F.octet_length(key)
    return F.when(size == 0, 0).otherwise(size + 8).cast("long")


def value_size(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def entry_size(key: Column, value: Column) -> Column:
    """Bytes that an entry counts against a memory budget: key, version, value."""
    return (F.octet_length(key) + 8).cast("long") + value_size(value)
