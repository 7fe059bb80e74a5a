"""Bounded samples of labelled rows, for fitting: the rows with the least hash of their id, with whole texts.

A sample has at most ``max_rows`` rows and, beyond its first row, at most ``max_chars`` characters. Rows with a
NULL id or label are not sampled. Which rows are taken depends on the table alone: the order is (hash of the id, id, hash of
the row), and rows equal in all of these are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lamina.llm.text_columns import column
from lamina.scratch import materialize

MAX_CHARS = 64_000_000


def sampled(labelled: DataFrame, id_col: str, text_col: str, label: Column, max_rows: int, max_chars: int, digest: dict[str, Column], name: str) -> list[Row]:
    """``(id, label, *digest)`` of the sampled rows, in their order; ``digest`` reads the whole text as ``text``.

    The first pass reads ids and labels only; the chosen rows are written to the shared scratch folder, so
    texts of the table are read once.
    """
    keyed = labelled.select(F.xxhash64(column(id_col)).alias("h"), column(id_col).alias("id"), label.alias("label"), column(text_col).alias("text"))
    keyed = keyed.where("id IS NOT NULL AND label IS NOT NULL")
    ids = [r["id"] for r in keyed.select("h", "id").orderBy("h", "id").limit(max_rows).select("id").collect()]  # at most `max_rows`
    if not ids:
        return []
    chosen = keyed.where(F.col("id").isin(sorted(set(ids))))
    stored, _ = materialize(chosen.withColumns({"text": F.coalesce("text", F.lit("")), "tie": F.xxhash64("text", "label")}), name)
    # repeated ids can make more rows than asked for: the limit is on rows
    order = ["h", "id", "tie"]
    sizes = stored.select(*order, F.length("text").alias("n")).orderBy(*order).limit(max_rows).collect()
    total, rows = 0, 0
    for r in sizes:
        total += r["n"]
        if rows and total > max_chars:
            break
        rows += 1
    columns = [c.alias(k) for k, c in digest.items()]
    return stored.select(*order, "label", *columns).orderBy(*order).limit(rows).select("id", "label", *digest).collect()
