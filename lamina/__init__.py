"""lamina: a multi-version key-value analytics engine expressed as Spark DataFrames.

Versioned rows live in immutable, sorted Parquet runs plus append-only log segments; every read
(point, range, latest, as-of) is a declarative plan over them.
"""
