"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: 64 majority bits over the XXH64 hashes of a text's 3-word shingles (A-Z lower-cased). Two
fingerprints link if they differ in at most ``radius`` bits; the links are found exactly:

* equal fingerprints are one class from the start, so copies never meet pairwise;
* the 64 bits are cut into radius + ``AGREE`` blocks; linked fingerprints differ in at most radius of them, so
  they agree in some ``AGREE`` blocks. Fingerprints are dealt once for each choice of ``AGREE`` blocks (for the
  defaults ten choices of two out of five, 25 or 26 bits each), and only tiles inside one such group need
  comparing: 10^10 distinct fingerprints make groups of some hundred, and comparisons stay far below all pairs;
* inside a group, fingerprints sorted by population count form tiles; a tile pair whose population
  counts differ by more than the radius is skipped, since bits differ at least by that much; the others
  are compared in full with numpy exclusive-or and bit counts;
* a group larger than ``group_rows`` is cut into tiles by population count and hash, and each tile pair
  within the radius becomes a unit of work of its own, so a hot block value is spread over many tasks.

Each unit of work reports a spanning forest of its links (at most one edge per fingerprint), never all
pairs, and :mod:`lamina.llm.components` joins the forests.

Defined results: NULL, empty and blank texts have fingerprint 0, linked like any other; a text of one or
two words has one shingle. ``component_id`` is the smallest doc_id reachable, NULL only if every doc_id
in the component is. Repeated rows share a fingerprint and so a component. :func:`keep_one` keeps the row of the
smallest doc_id (NULL last), among equal doc_ids that of the least fingerprint, then of the least row hash;
of rows equal in all columns one. Input columns may have any names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.components import connected_components
from lamina.llm.text_columns import column, row_hash, unwrapped, whole_row
from lamina.scratch import materialize

SHINGLE, RADIUS, AGREE, GROUP_ROWS, TILE, SEED = 3, 3, 2, 2048, 256, 42
_LAST = 2**63 - 1


def fingerprint_of(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for texts of any length
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    values = np.fromiter((fingerprint_of(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
    return pa.array(values.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit column."""
    return _fingerprints(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def forest(fps: np.ndarray, other: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links among ``fps``, or between ``fps`` and ``other``; both are uint64 arrays."""
    n = len(fps)
    points = fps if other is None else np.concatenate([fps, other])
    side = np.zeros(len(points), dtype=bool)
    side[n:] = other is not None
    counts = np.bitwise_count(points)
    order = np.lexsort((points, counts))
    points, counts, side = points[order], counts[order], side[order]
    linked_a, linked_b = [], []
    starts = range(0, len(points), tile)
    for a in starts:
        for b in range(a, len(points), tile):
            if int(counts[b]) - int(counts[min(a + tile, len(points)) - 1]) > radius:
                break  # this tile and all later ones hold too many bits
            near = np.bitwise_count(points[a : a + tile, None] ^ points[None, b : b + tile]) <= radius
            if other is not None:
                near &= side[a : a + tile, None] != side[None, b : b + tile]
            i, j = np.nonzero(near)
            keep = i + a < j + b
            if keep.any():
                i, j = i[keep] + a, j[keep] + b
                # a forest of this tile pair is enough: hook every point to the least label it meets
                i, j = _reduce(i, j)
                linked_a.append(i)
                linked_b.append(j)
    if not linked_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return points[np.concatenate(linked_a)], points[np.concatenate(linked_b)]


def _reduce(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links (i, j) as edges from each point to the least point of its component."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    away = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[away], nodes[label[away]]


def _compare_groups(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def edges_of(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        *unit, tile, fp = rows
        lo, hi = unit[2:]
        out_u, out_v = [], []
        change = np.nonzero(np.any([part[1:] != part[:-1] for part in unit], axis=0))[0] + 1
        bounds = np.concatenate([[0], change, [len(fp)]])
        for at in np.nonzero(np.diff(bounds) > 1)[0]:
            a, b = bounds[at], bounds[at + 1]
            mine, first = fp[a:b].view(np.uint64), tile[a:b] == lo[a]
            u, v = forest(mine, None, radius) if lo[a] == hi[a] else forest(mine[first], mine[~first], radius)
            out_u.append(u)
            out_v.append(v)
        if not out_u:
            return None
        u, v = np.concatenate(out_u), np.concatenate(out_v)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(p) for p in zip(rest, now, strict=True)]
            same = np.all([part == part[-1] for part in now[:4]], axis=0) if len(now[0]) else np.zeros(0, bool)
            cut = len(same) - int(same.sum())  # rows are sorted: the last group may go on in the next batch
            rest = [c[cut:] for c in now]
            if cut and (out := edges_of([c[:cut] for c in now])) is not None:
                yield out
        if rest is not None and len(rest[0]) and (out := edges_of(rest)) is not None:
            yield out

    return run


def _masks(radius: int, agree: int) -> list[int]:
    """One mask (signed) for each choice of ``agree`` out of radius + ``agree`` blocks of the 64 bits."""
    n = radius + agree
    cuts = [round(64 * k / n) for k in range(n + 1)]
    blocks = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(n)]
    masks = [sum(choice) for choice in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_forest(fps: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS, agree: int = AGREE) -> DataFrame:
    """Edges ``(u, v)`` that span every link within ``radius`` among the distinct fingerprints ``fps(fp)``."""
    key = ["choice", "value"]
    shares = F.array(*[F.struct(F.lit(k).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value")) for k, mask in enumerate(_masks(radius, agree))])
    members = fps.select("fp", F.explode(shares).alias("s")).select("s.choice", "s.value", "fp")
    # groups of one, the most, need no comparison; the counts of the others are small where few texts are alike
    counts, _ = materialize(members.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "simhash-groups")
    whole = F.lit(-1).cast("long")
    sized = members.join(counts, key)
    units = sized.where(F.col("n") <= group_rows).select(*key, whole.alias("lo"), whole.alias("hi"), whole.alias("tile"), "fp")
    if not counts.where(F.col("n") > group_rows).isEmpty():
        hot = sized.where(F.col("n") > group_rows).drop("n").withColumn("pop", F.bit_count("fp"))
        cells = hot.groupBy(*key, "pop").agg(F.count("*").alias("n")).select(*key, "pop", F.ceil(F.col("n") / group_rows).cast("long").alias("subs"))
        tiles = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pop", "subs"))).alias("subs"))  # at most 65 entries
        tile_of = F.col("pop").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("fp"), F.element_at("subs", F.col("pop")))
        near = F.filter(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda p: F.array_contains(F.map_keys("subs"), p))
        others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("subs", p) - 1), lambda s: p.cast("long") * F.lit(1 << 32) + s)))
        dealt = hot.join(tiles, key).withColumn("tile", tile_of).withColumn("other", F.explode(others))
        units = units.unionAll(dealt.select(*key, F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fp"))
    unit = [*key, "lo", "hi"]
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_compare_groups(radius), "u long, v long")


def classes(docs: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """``(fp, component, component_id)`` for each distinct fingerprint of ``docs(id_col, fp_col)``."""
    distinct, _ = materialize(docs.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("rep")), "simhash-classes")
    links = connected_components(link_forest(distinct.select("fp"), radius, group_rows))
    labelled = distinct.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    return labelled.select("fp", "component").join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``."""
    prints, _ = materialize(docs.select(column(id_col).alias("doc_id"), fingerprint(column(text_col)).alias("fp")), "simhash-prints")
    return prints.join(classes(prints, radius, group_rows), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged; see the module for which."""
    spot = [F.coalesce(column(id_col).cast("long"), F.lit(_LAST)).alias("d"), row_hash(docs).alias("tie")]
    printed, _ = materialize(docs.select(*spot, fingerprint(column(text_col)).alias("fp")), "simhash-prints")
    labelled = printed.join(classes(printed, radius, id_col="d").select("fp", "component", "component_id"), "fp")
    # all rows of the kept id in a component: few, unless ids repeat
    winners = labelled.where(F.col("d") == F.col("component_id")).groupBy("component").agg(F.min(F.struct("d", "fp", "tie")).alias("w")).select("w.d", "w.tie")
    kept = docs.select(whole_row(docs).alias("row"), *spot).join(winners, ["d", "tie"], "left_semi")
    if not printed.groupBy("d", "tie").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["d", "tie"])
    return kept.select(*unwrapped("row", docs.columns))
