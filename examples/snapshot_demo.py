"""A time-travel snapshot over two in-memory sources, and a reader that refuses work once closed.

Run: python examples/snapshot_demo.py
"""

import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))

from lamina.operators.batch import Batch
from lamina.operators.merge import snapshot, union_runs
from lamina.plans.table import VersionedTable
from lamina.schema import PUT, SCHEMA


def main() -> None:
    spark = SparkSession.builder.master("local[2]").appName("snapshot-demo").getOrCreate()
    first = spark.createDataFrame([(b"apple", 400, PUT, b"apple-400", 0, 0), (b"banana", 250, PUT, b"banana-250", 0, 1)], SCHEMA)
    second = spark.createDataFrame([(b"apple", 300, PUT, b"apple-300", 0, 0), (b"cherry", 300, PUT, b"cherry-300", 0, 1)], SCHEMA)
    snapshot(union_runs(first, second), as_of=325, upper_key=b"cherry").selectExpr("cast(key AS string) AS key", "ts", "cast(value AS string) AS value").orderBy("key").show()

    table = VersionedTable(spark, tempfile.mkdtemp())
    batch = Batch()
    batch.put(b"apple", b"1")
    table.commit(batch)
    with table.reader() as reader:
        rows = reader.rows(reader.snapshot())
        print(next(rows))
    try:
        next(rows)
    except ValueError as error:
        print("after close:", error)
    spark.stop()


if __name__ == "__main__":
    main()
