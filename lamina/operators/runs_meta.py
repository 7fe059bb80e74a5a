"""Metadata of sorted runs: zone maps, pruning, block packing, block index lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.keys import KeyRange, encoded_size, entry_size, value_size
from lamina.operators.along import carry_last, running_sum

BLOCK_BYTES, RECORD_OVERHEAD, TRAILER = 4096, 12, 8


def zone_map(df: DataFrame, run: str = "src") -> DataFrame:
    """Least and greatest key and version, rows and bytes of each run."""
    bounds = [F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")]
    return df.groupBy(F.col(run).alias("run_id")).agg(*bounds, F.count("*").alias("rows"), F.sum(entry_size(F.col("key"), F.col("value"))).alias("bytes"))


def overlapping(zones: DataFrame, wanted: KeyRange) -> DataFrame:
    """Runs that may hold rows of a range."""
    return zones.where(wanted.overlaps())


def overlap_pairs(zones: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each of ``ranges(range_id, lo, hi)`` the runs that may hold its rows; both are small metadata tables."""
    return zones.join(ranges, (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi")))


def block_index(df: DataFrame, every: int, run: str = "src") -> DataFrame:
    """First key of every ``every``-th distinct key of a run, numbered: a sparse index of its blocks."""
    keys = df.select(F.col(run).alias("run_id"), "key").distinct()
    numbered = running_sum(keys.withColumn("one", F.lit(1)), ["run_id"], ["key"], "one", "n").withColumn("n", F.col("n") - 1)
    return numbered.where(F.col("n") % every == 0).select("run_id", (F.col("n") / every).cast("long").alias("block_no"), F.col("key").alias("start_key"))


def locate(probes: DataFrame, index: DataFrame) -> DataFrame:
    """For each of ``probes(run_id, key)`` the last block that starts at or before the key (block 0 if none does)."""
    starts = index.select("run_id", F.col("start_key").alias("key"), F.lit(0).alias("side"), "block_no")
    asked = probes.select("run_id", "key", F.lit(1).alias("side"), F.lit(None).cast("long").alias("block_no"))
    found = carry_last(starts.unionByName(asked), ["run_id"], ["key", "side"], "block_no")
    return found.where("side = 1").select("run_id", "key", F.coalesce("block_no", F.lit(0).cast("long")).alias("block_no"))


def pack_blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES, run: str = "src") -> DataFrame:
    """The block of each record when a run is packed greedily in version order.

    A sequential fold along each run: runs are dealt to tasks, sorted there, and streamed with one running
    total, so memory does not grow with the run. A record larger than a block gets a block of its own.
    """
    cost = (encoded_size(F.col("key")) + value_size(F.col("value")) + RECORD_OVERHEAD).alias("cost")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, used = None, 0, 0
        for batch in batches:
            runs, costs, blocks = batch.column(0).to_pylist(), batch.column(3).to_pylist(), []
            for run_id, size in zip(runs, costs, strict=True):
                if run_id != current:
                    current, block, used = run_id, 0, 0
                elif used and used + size + TRAILER > block_bytes:
                    block, used = block + 1, 0
                used += size
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=["run_id", "key", "ts", "cost", "block_no"])

    rows = df.select(F.col(run).cast("long").alias("run_id"), "key", "ts", "src", "seq", cost)
    sorted_rows = rows.repartition("run_id").sortWithinPartitions("run_id", "key", F.col("ts").desc(), "src", F.col("seq").desc())
    key_type = df.schema["key"].dataType.simpleString()
    return sorted_rows.select("run_id", "key", "ts", "cost").mapInArrow(fold, f"run_id long, key {key_type}, ts long, cost long, block_no long")
