"""Immutable sorted runs: Parquet folders, range-partitioned by key and sorted in version order.

Sorting gives tight row-group and page statistics, and the Bloom filter on ``key`` prunes point lookups; both
are applied by the Parquet reader when the filters of :mod:`lamina.functions.keys` are pushed down. A run's
folder has a name of its own, so what a crash left behind is in nobody's way, and its zone map is observed
while it is written.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.bloom import parquet_options
from lamina.functions.keys import Key, KeyRange, entry_size
from lamina.schema import COLUMNS, SCHEMA, empty
from lamina.sources.files import Store

ROWS_PER_FILE = 4_000_000


@dataclass(frozen=True)
class Run:
    """A run's folder and zone map; keys are hex text, so that the record is plain JSON."""

    run_id: int
    folder: str
    min_key: str
    max_key: str
    min_ts: int
    max_ts: int
    rows: int
    bytes: int

    def may_overlap(self, wanted: KeyRange) -> bool:
        low, high = bytes.fromhex(self.min_key), bytes.fromhex(self.max_key)
        return not ((wanted.start and high < wanted.start.raw) or (wanted.end and low > wanted.end.raw))

    def record(self) -> dict:
        return asdict(self)


class Runs:
    """Runs ``runs/run=<id>-<unique>`` under a table's root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, f"{root.rstrip('/')}/runs")

    def write(self, run_id: int, rows: DataFrame, expected: int, files: int | None = None) -> Run | None:
        """Write a run of about ``expected`` rows (it sizes files and Bloom filters); None for no rows."""
        folder = f"run={run_id:012d}-{uuid.uuid4().hex[:8]}"
        files = files or -(-max(expected, 1) // ROWS_PER_FILE)
        dealt = rows.repartitionByRange(files, "key", "ts")
        written = dealt.sortWithinPartitions("key", F.col("ts").desc(), "src", F.col("seq").desc()).select(*COLUMNS)
        seen = Observation()
        bounds = [F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")]
        zoned = written.observe(seen, *bounds, F.count(F.lit(1)).alias("rows"), F.sum(entry_size(F.col("key"), F.col("value"))).alias("bytes"))
        zoned.write.mode("error").options(**parquet_options("key", min(max(expected, 1), 2 * ROWS_PER_FILE))).parquet(self.store.url(folder))
        zone = seen.get
        if not zone["rows"]:
            self.store.delete(folder)
            return None
        return Run(run_id, folder, bytes(zone["min_key"]).hex(), bytes(zone["max_key"]).hex(), zone["min_ts"], zone["max_ts"], zone["rows"], zone["bytes"])

    def read(self, runs: list[Run]) -> DataFrame:
        """All rows of some runs in one scan, the run being a partition column; a later run has the lower ``src`` and so wins ties."""
        if not runs:
            return empty(self.spark)
        paths = [self.store.url(r.folder) for r in runs]
        stored = T.StructType([*SCHEMA.fields, T.StructField("run", T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", self.store.root).parquet(*paths)
        return rows.withColumn("src", -F.substring("run", 1, 12).cast("int")).select(*COLUMNS)

    def seek(self, run: Run, key: Key) -> DataFrame:
        """Rows at or after a versioned key, in order."""
        from lamina.functions.keys import from_key
        from lamina.operators.merge import ordered

        return ordered(self.read([run]).where(from_key(key)))

    def blocks(self, run: Run) -> int:
        """Number of row groups that hold the run: the units that statistics and Bloom filters can skip."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        total = 0
        for name in self.store.names(run.folder):
            if name.endswith(".parquet"):
                path = jvm.org.apache.hadoop.fs.Path(self.store.url(f"{run.folder}/{name}"))
                reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
                total += reader.getFooter().getBlocks().size()
                reader.close()
        return total

    def size(self, run: Run) -> int:
        return self.store.size(run.folder)

    def delete(self, folder: str) -> None:
        self.store.delete(folder)
