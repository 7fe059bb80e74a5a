"""Line dedup: remove later occurrences of repeated three-line windows, with built-in functions only.

A *unit* is a line that holds a word together with the blank lines after it (leading blank lines form a
unit of their own). Every three consecutive units form a window; windows are equal if their units are
equal after trimming white space. Of all occurrences of a window in the corpus the first one, by
(doc_id, position), stays; each later occurrence marks its three units, and the union of the marked
positions is cut from the document. Every unit that goes has an equal one that is earlier in this order,
so no content vanishes from the corpus.

Plan: window hashes are exploded once per document and grouped by hash with map-side sums (a hash that
fills a third of the table costs one row per task); the repeated hashes are joined back to the
occurrences (an ordinary equi-join, which adaptive execution splits where one hash is hot); the marked
positions of each document come back as one sorted array, and the kept stretches between the merged
windows are sliced out in linear time. Text is shuffled once, by document.

Defined results: NULL text stays NULL and empty text stays empty; texts of fewer than three units never
change. NULL doc_ids come after all others, in the order of a 62-bit hash of their text, so that equal texts
without an id count as one document, as do rows with one doc_id (none is later than another). An empty table
gives an empty table. Input columns pass through, whatever their names; the text is replaced, ``n_units`` and
``n_removed`` replace input columns of those names.

Windows are compared by a 64-bit hash of three 64-bit unit hashes: among 10^12 windows about 3*10^4 meet
a false equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.text_columns import column, let, unwrapped, whole_row

WINDOW = 3
#: A newline that begins a line with a word.
UNIT_BREAK = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
TRIMMED = " \t\n\x0b\x0c\r"
#: NULL doc_ids are dealt over this and higher order keys.
_LAST = 2**62


def _units(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, UNIT_BREAK)).otherwise(F.array().cast("array<string>"))


def _occurrences(units: Column) -> Column:
    """Sorted array of (hash, position, first-in-document flag) of a document's windows."""

    def from_hashes(h: Column) -> Column:
        windows = F.transform(F.slice(h, WINDOW, F.size(h)), lambda last, i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), last).alias("h"), i.alias("i")))
        return let(F.sort_array(windows), lambda s: F.transform(s, lambda e, k: F.struct(e["h"].alias("h"), e["i"].alias("i"), F.coalesce(F.get(s, k - 1)["h"] != e["h"], F.lit(True)).alias("first"))))

    return let(F.transform(units, lambda u: F.xxhash64(F.btrim(u, F.lit(TRIMMED)))), from_hashes)


def _without(units: Column, starts: Column) -> Column:
    """The units outside the union of the windows at ``starts`` (sorted, distinct): slices between them."""

    def gap(k: Column) -> Column:
        begin = F.coalesce(F.get(starts, k - 1) + WINDOW, F.lit(0))
        end = F.coalesce(F.get(starts, k), F.size(units))
        return F.slice(units, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), gap))


def _order_key(doc_id: Column, text_hash: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST) + F.shiftrightunsigned(text_hash, 2))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with later repeats of three-line windows cut from the text, plus (with ``counts``) ``n_units``, ``n_removed``."""
    text = column(text_col)
    key = [_order_key(column(id_col), F.xxhash64(text)).alias("d"), F.xxhash64(text).alias("t")]
    occurrences = docs.select(*key, F.explode(_occurrences(_units(text))).alias("o")).select("d", "t", "o.h", "o.i", "o.first")
    repeated = occurrences.groupBy("h").agg(F.min("d").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = occurrences.join(repeated, "h").where((F.col("d") != F.col("owner")) | ~F.col("first"))
    marks = later.groupBy("d", "t").agg(F.sort_array(F.collect_set("i")).alias("starts"))

    keyed = docs.select(*key, whole_row(docs).alias("row"))
    text = F.col("row")[text_col]
    joined = keyed.join(marks, ["d", "t"], "left").withColumn("units", _units(text))
    starts = F.coalesce(F.col("starts"), F.array().cast("array<int>"))
    cut = joined.withColumn("rest", F.when(F.size(starts) == 0, F.col("units")).otherwise(_without(F.col("units"), F.col("starts"))))
    changed = F.when(F.size("rest") < F.size("units"), F.array_join("rest", "\n")).otherwise(text)
    added = {"n_units": F.size("units"), "n_removed": F.size("units") - F.size("rest")} if counts else {}
    kept = [c for c in docs.columns if c not in added]
    fields = [changed.alias(c) if c == text_col else f for c, f in zip(kept, unwrapped("row", kept), strict=True)]
    return cut.select(*fields, *[v.cast("long").alias(c) for c, v in added.items()])
