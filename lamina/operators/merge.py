"""Latest-version merge and time-travel snapshots.

All reads reduce to one row per key by a ranked window; Catalyst turns the ``= 1`` filter into a
WindowGroupLimit on both sides of the shuffle, so a key with a third of all versions sends one row per
task, and memory does not grow with the number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.keys import newest_first, not_beyond, version_order
from lamina.operators.along import carry_last
from lamina.schema import is_tombstone


def union_runs(*runs: DataFrame) -> DataFrame:
    """Rows of several runs; ``src`` becomes the position of the run, so that earlier ones win ties."""
    numbered = [run.withColumn("src", F.lit(k)) for k, run in enumerate(runs)]
    merged = numbered[0]
    for run in numbered[1:]:
        merged = merged.unionByName(run)
    return merged


def last_wins(df: DataFrame) -> DataFrame:
    """One row for each (key, ts, src): the last written."""
    rank = F.row_number().over(Window.partitionBy("key", "ts", "src").orderBy(F.col("seq").desc()))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest(df: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included; ties go to the lowest source, then the last seq."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*newest_first()))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def live(merged: DataFrame, empty_is_delete: bool = True) -> DataFrame:
    """Rows of a merge that are not tombstones. Always after the merge: earlier it would revive old versions."""
    return merged.where(~is_tombstone(empty_is_delete))


def snapshot(df: DataFrame, as_of: int | None = None, upper_key: bytes | str | None = None) -> DataFrame:
    """For each key up to ``upper_key`` the newest version at or before ``as_of``, tombstones included."""
    return latest(df.where(not_beyond(as_of, upper_key)))


def compact(df: DataFrame) -> DataFrame:
    """What a full compaction keeps: the newest live version of each key."""
    return live(latest(df))


def history(df: DataFrame) -> DataFrame:
    """Every version with its rank within its key, 1 for the newest."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*newest_first()))
    return df.withColumn("version_rank", rank.cast("long"))


def multi_get(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """For each row of ``probes(probe_id, key, probe_ts)`` the newest version of its key at or before probe_ts.

    An as-of lookup without a range join: probes and versions are sorted together once by key and version, and
    each probe takes the last version before it. Both sides of a hot key spread over many tasks. Probes without
    a version get NULLs.
    """
    entry = F.struct(*[F.col(c) for c in ("ts", "kind", "value", "src", "seq")])
    marked = versions.select("key", F.col("ts").alias("at"), F.lit(0).alias("side"), (-F.col("src")).alias("rank"), "seq", entry.alias("found"), F.lit(None).cast("long").alias("probe_id"))
    nothing = F.lit(None).cast(marked.schema["found"].dataType)
    asked = probes.select("key", F.col("probe_ts").alias("at"), F.lit(1).alias("side"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("seq"), nothing.alias("found"), F.col("probe_id").cast("long"))
    carried = carry_last(marked.unionByName(asked), ["key"], ["at", "side", "rank", "seq"], "found").where("side = 1")
    return carried.select("probe_id", "key", F.col("at").alias("probe_ts"), "found.ts", "found.kind", "found.value")


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(*version_order())
