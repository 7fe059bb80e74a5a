"""The write-ahead log as Parquet segments: one folder per segment, whole batches or nothing.

Spark's output commit publishes a batch's files together, so a torn tail cannot be read. Kinds and batch
positions are stored, so replay tells deletes from empty puts and applies mutations in order. A batch that
comes from a stream carries the stream's name and its micro-batch number, by which a retry is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.keys import entry_size
from lamina.operators.merge import last_wins
from lamina.schema import COLUMNS, SCHEMA, empty, guard
from lamina.sources.files import Store

STORED = T.StructType([*SCHEMA.fields, T.StructField("stream", T.StringType()), T.StructField("epoch", T.LongType())])


class Log:
    """Segments ``wal/segment=<id>`` under a table's root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, f"{root.rstrip('/')}/wal")

    def path(self, segment: int) -> str:
        return self.store.url(f"segment={segment:012d}")

    def segments(self) -> list[int]:
        return [int(n.partition("=")[2]) for n in self.store.names("") if n.startswith("segment=")]

    def append(self, segment: int, entries: DataFrame, stream: str | None = None, epoch: int | None = None) -> None:
        """Add one batch of entries to a segment."""
        marked = guard(entries).select(*COLUMNS, F.lit(stream).cast("string").alias("stream"), F.lit(epoch).cast("long").alias("epoch"))
        marked.write.mode("append").parquet(self.path(segment))

    def _stored(self, segments: list[int]) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*[self.path(s) for s in segments])

    def replay(self, segments: list[int] | None = None) -> DataFrame:
        """Rows of the segments; of several writes of one (key, version) the last."""
        chosen = self.segments() if segments is None else segments
        return last_wins(self._stored(chosen).select(*COLUMNS)) if chosen else empty(self.spark)

    def recover(self, segments: list[int] | None = None) -> tuple[DataFrame, int, int]:
        """Replayed rows, the greatest version in them (-1 if none) and their true size in bytes."""
        rows = self.replay(segments)
        top, size = rows.agg(F.max("ts"), F.sum(entry_size(F.col("key"), F.col("value")))).first()
        return rows, -1 if top is None else top, size or 0

    def epochs(self, segments: list[int]) -> dict[str, int]:
        """The last micro-batch of each stream in the segments."""
        if not segments:
            return {}
        return {r["stream"]: r["epoch"] for r in self._stored(segments).where("stream IS NOT NULL").groupBy("stream").agg(F.max("epoch").alias("epoch")).collect()}

    def entries(self, segments: list[int]) -> int:
        """Number of stored entries, from the files' footers."""
        return self._stored(segments).count() if segments else 0

    def stream(self) -> DataFrame:
        """A stream of all entries, present and future."""
        return self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.store.root)

    def delete(self, segment: int) -> None:
        self.store.delete(f"segment={segment:012d}")
