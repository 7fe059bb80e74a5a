"""Column expressions over text shared by the native operators.

A *word* is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: inside ``body`` it is a lambda variable, never re-evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of ``text`` in order; no words for NULL or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lines_with_words(text: Column) -> Column:
    """The ``\\n``-split lines that hold at least one word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(NON_SPACE))


def column(name: str) -> Column:
    """The top-level column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that a computed column beside it clashes with none of them."""
    return F.struct(*[column(c) for c in df.columns])


def unwrapped(row: str, names: list[str]) -> list[Column]:
    """The fields of a struct column as columns again."""
    return [F.col(row)[c].alias(c) for c in names]


def row_hash(df: DataFrame) -> Column:
    """64-bit hash over all columns (maps, which have no order, left out): equal for equal rows."""
    plain = [column(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")
