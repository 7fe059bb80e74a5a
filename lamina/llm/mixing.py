"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in one order: by size, largest first, then doc_id (NULL last), then row
hash. Each has an expected number of copies; the prefix sums of these, shifted by one random offset u in
[0, 1), cross integer boundaries, and every document is emitted once for each boundary that it crosses:
floor(P + u) - floor(P_before + u), so its copies differ from the expectation by less than one.

The expectation is target / source size, but follows what is still to take where single documents weigh much:
each *large* document (more than 1 / ``LARGE`` of its source's size, so at most ``LARGE`` a source, first in the
order) changes the rate of those after it to (target - words taken) / (size left), between 0 and
``max_copies``. So a long document, which would leave its source over or short by its whole length, is made up for by
the documents after it. All documents after the large ones share one rate. There is one offset, and
nothing is chosen by looking at its outcome. In a source without large documents each document's copies average, over
offsets, exactly the plain rate; in one with them, single documents depart from it (the README has figures).

The prefix sums are distributed. Narrow rows are sorted by range over all sources, so a source with a third of
all rows, or of rows of one size, spreads over many tasks; a row's rank is its place in its part plus the rows
of its source in the parts before it, a small table of one row for each part and source. The answer depends on
the order alone, not on the parts. The large documents, at most ``LARGE`` a source, are folded in their order by
source. Tables of one row a source or part are broadcast only up to a counted size; beyond that they are joined by shuffling.

Targets: sources by code point, NULL last, weigh 5, 2, 1, repeating, and share the total size; no target
exceeds ``max_copies`` times its source's size, the excess being reshared by weight. In the order of
size / weight the capped sources are a prefix, which gives the final shares without iteration.

Defined results: NULL and empty texts have size 0 and are sampled at the rate of their source's last documents (the plain
rate if all those have size 0); a source of size 0 has target 0 and takes nothing; repeated rows are ranked
separately; an empty table gives an empty table. Input columns pass through, computed ones replace columns
of the same name. Rows equal in doc_id, source, size and all columns are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.text_columns import column, n_words, row_hash, unwrapped, whole_row
from lamina.scratch import materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
LARGE = 20
BROADCAST_ROWS = 100_000
SEED = "mix-1"
COMPUTED = ("size", "source_size", "target", "copies")
_LAST = 2**63 - 1


def _offset(source: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per source of ``sizes(source, size)``: its number, size, target and offset."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS)) + 1))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("sid"))
    everything = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumns(
        {
            "total": F.sum(big("source_size")).over(everything),
            "before": F.coalesce(F.sum(big("source_size") * MAX_COPIES).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest_w": F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    ranked = ranked.withColumn("capped", F.col("source_size") * MAX_COPIES * F.col("rest_w") <= (F.col("total") - F.col("before")) * F.col("w"))
    ranked = ranked.withColumns(
        {
            "left": F.col("total") - F.sum(F.when(F.col("capped"), big("source_size") * MAX_COPIES).otherwise(F.lit(0))).over(everything),
            "free_w": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything),
        }
    )
    share = (F.col("w") * F.col("left")).cast("double") / F.col("free_w").cast("double")
    target = F.when(F.col("capped"), (F.col("source_size") * MAX_COPIES).cast("double")).otherwise(share)
    return ranked.withColumn("target", target).select("source", F.col("sid").cast("long").alias("sid"), "source_size", "target", _offset(F.col("source"), seed).alias("u"))


def _rate(target: float, taken: int, left: int, otherwise: float) -> float:
    """Copies a document should have so that the documents left take what is left to take."""
    return min(max((target - taken) / left, 0.0), float(MAX_COPIES)) if left > 0 else otherwise


def fold_large(sizes: list[int], source_size: int, target: float, u: float) -> tuple[list[int], float, float]:
    """Copies of a source's large documents in order, their prefix sum, and the rate of the documents after them."""
    plain = min(target / source_size, float(MAX_COPIES)) if source_size else 0.0
    copies, prefix, taken, seen = [], 0.0, 0, 0
    for size in sizes:
        after = prefix + _rate(target, taken, source_size - seen, plain)
        copies.append(floor(after + u) - floor(prefix + u))
        prefix, taken, seen = after, taken + copies[-1] * size, seen + size
    return copies, prefix, _rate(target, taken, source_size - seen, plain)


def _fold_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a source, ``(sid, copies, prefix, rate)``, from rows ``(sid, source_size, target, u, sizes)``."""
    for batch in batches:
        rows = [(sid, *fold_large(sizes, size, target, u)) for sid, size, target, u, sizes in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sid", "large", "prefix", "rate"])


def _small(table: DataFrame) -> DataFrame:
    """``table``, of narrow rows, marked for broadcasting if its counted size allows that."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def count_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: str = SEED) -> DataFrame:
    """One row per input row: the columns ``keep`` (default all; they are shuffled along) with size, source_size, target and copies."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in COMPUTED]
    carried = F.struct(*[column(c) for c in kept], F.lit(0).alias("_")) if kept else F.struct(F.lit(0).alias("_"))
    measured = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(_LAST)).alias("d"), column(source_col).alias("source"), n_words(column(text_col)).alias("size"), row_hash(docs).alias("tie"), carried.alias("row"))
    copies = _copies(measured, seed)
    return copies.select(*unwrapped("row", kept), "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("copies").cast("long").alias("copies"))


def _copies(measured: DataFrame, seed: str) -> DataFrame:
    """``measured(d, source, size, tie, row)`` with source_size, target and copies."""
    sized, _ = materialize(measured, "mix-sizes")
    targets, _ = materialize(source_targets(sized.select("source", "size"), seed), "mix-targets")
    numbered = sized.join(_small(targets.select("source", "sid", "source_size")), sized["source"].eqNullSafe(targets["source"])).select("sid", "d", "size", "tie", "row", (F.col("size") * LARGE > F.col("source_size")).alias("is_large"))
    order = [F.col("sid"), F.col("size").desc(), F.col("d"), F.col("tie")]
    # the place inside a sorted part is the lower 33 bits of the generated id, the part's number the upper ones
    placed, _ = materialize(numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-placed")
    placed = placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    along = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("sid", "part").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    parts, _ = materialize(parts.select("sid", "part", (F.coalesce(F.sum("n").over(along), F.lit(0)) - F.col("begin")).alias("shift")), "mix-parts")
    ranked = placed.join(_small(parts), ["sid", "part"]).withColumn("k", F.col("at") + F.col("shift"))

    large = ranked.where("is_large").groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "size"))), lambda e: e["size"]).alias("sizes"))
    folded = targets.join(large, "sid", "left").select("sid", "source_size", "target", "u", F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes"))
    folded, _ = materialize(folded.mapInArrow(_fold_sources, "sid long, large array<long>, prefix double, rate double"), "mix-large")
    final = ranked.join(_small(targets.drop("source").join(folded, "sid")), "sid")
    rest = (F.col("k") - F.size("large")).cast("double")  # documents after the large ones, before this one
    before, after = (F.floor(F.col("prefix") + n * F.col("rate") + F.col("u")) for n in (rest, rest + 1))
    return final.withColumn("copies", F.when(F.col("is_large"), F.get("large", F.col("k").cast("int"))).otherwise(after - before))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus: each input row as often as its copies say, with the input's columns."""
    spot = [F.coalesce(column(id_col).cast("long"), F.lit(_LAST)).alias("d"), row_hash(docs).alias("tie")]
    measured = docs.select(*spot, column(source_col).alias("source"), n_words(column(text_col)).alias("size"), F.lit(0).alias("row"))
    counted = _copies(measured, seed).groupBy("d", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    counted, _ = materialize(counted.where("copies > 0"), "mix-copies")
    wide = docs.select(whole_row(docs).alias("row"), *spot).join(counted, ["d", "tie"])
    if not counted.where("rows > 1").isEmpty():  # equal rows: one of them carries the copies of all
        wide = wide.dropDuplicates(["d", "tie"])
    return wide.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select(*unwrapped("row", docs.columns))
