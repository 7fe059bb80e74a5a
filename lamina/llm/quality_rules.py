"""Quality rules: a threshold table compiled into one Spark projection.

Each :class:`Rule` bounds a ratio of two integer metrics of the text, in per cent. The table compiles
to boolean columns inside a single projection of built-in functions; no user function runs and nothing
is shuffled. All comparisons are on integers, so any SQL engine gives the same verdicts.

Defined results: NULL and blank texts have no words, so every metric is 0 and ``base_failed`` is true.
Rows are judged one by one: repeated rows get equal verdicts, an empty table an empty result. Input
columns pass through, whatever their names; a computed column replaces an input column of the same name.

Windows of three words are compared by a 64-bit hash within one text (about n^2/2^65 chance of a false
repeat in a text of n words).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.text_columns import column, let, lines_with_words, unwrapped, whole_row, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with for is in it on as at by this was are from or an a "
    "le la les de du des et un une que qui en pour dans par sur est au ne pas avec "
    "der die das und zu den von mit ist nicht ein eine sich des im für auf als auch "
    "el los las del y por con una se no su al lo como más para"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a text unless ``low_pct <= 100 * metric / per <= high_pct`` (a side of None is open)."""

    name: str
    metric: str
    per: str
    low_pct: int | None = None
    high_pct: int | None = None

    def failed(self) -> Column:
        value, per = F.col(self.metric) * 100, F.col(self.per)
        fails = F.lit(False)
        if self.low_pct is not None:
            fails = fails | (value < per * self.low_pct)
        if self.high_pct is not None:
            fails = fails | (value > per * self.high_pct)
        return fails

    def failed_sql(self) -> str:
        parts = [f"{self.metric} * 100 < {self.per} * {self.low_pct}"] if self.low_pct is not None else []
        parts += [f"{self.metric} * 100 > {self.per} * {self.high_pct}"] if self.high_pct is not None else []
        return "(" + " OR ".join(parts or ["FALSE"]) + ")"


#: The production table.
RULES = (
    Rule("word_length", "word_chars", "n_words", low_pct=200, high_pct=1500),
    Rule("symbols", "n_symbols", "n_words", high_pct=25),
    Rule("shouting", "n_bangs", "n_words", high_pct=25),
    Rule("stop_words", "n_stop_words", "n_words", low_pct=5),
    Rule("dup_lines", "n_dup_lines", "n_lines", high_pct=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high_pct=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high_pct=30),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50


def _any_case(word_list: list[str]) -> list[str]:
    """Lower, capitalised and upper forms, so that matching needs no case folding of the text."""
    return sorted({form for w in word_list for form in (w, w.capitalize(), w.upper())})


def _repeat_words(windows: Column) -> Column:
    """Words inside a window (array of window hashes) that occurs at least twice: O(n log n), by sorting."""

    def from_sorted(ranked: Column) -> Column:
        def repeated(entry: Column, k: Column) -> Column:
            before, after = F.get(ranked, k - 1), F.get(ranked, k + 1)
            hit = F.coalesce(before["h"] == entry["h"], F.lit(False)) | F.coalesce(after["h"] == entry["h"], F.lit(False))
            return F.when(hit, entry["i"]).otherwise(F.lit(-1))

        starts = F.sort_array(F.filter(F.transform(ranked, repeated), lambda i: i >= 0))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, from_sorted))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all metrics; the text is split into words and into lines once each."""
    stop = _any_case(STOP_WORDS)
    parts = docs.select(whole_row(docs).alias("row"), F.coalesce(column(text_col), F.lit("")).alias("t"))
    parts = parts.withColumns({"w": words(F.col("t")), "l": lines_with_words(F.col("t"))})
    parts = parts.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    parts = parts.withColumn("v", F.transform(F.slice("h", 3, F.size("h")), lambda h, i: F.xxhash64(F.get("h", i), F.get("h", i + 1), h)))
    metrics = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": F.octet_length("t") - F.octet_length(F.regexp_replace("t", SYMBOLS, "")),
        "n_bangs": F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit("!"), F.lit(""))),
        "n_stop_words": F.size(F.filter("w", lambda w: w.isin(stop))),
        "n_lines": F.size("l"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_bullet_lines": F.size(F.filter("l", lambda x: x.startswith("-") | x.startswith("*") | x.startswith("•"))),
        "n_ellipsis_lines": F.size(F.filter("l", lambda x: x.endswith("...") | x.endswith("…"))),
        "n_repeat_words": _repeat_words(F.col("v")),
    }
    kept = [c for c in docs.columns if c not in metrics]
    return parts.select(*unwrapped("row", kept), *[v.cast("long").alias(k) for k, v in metrics.items()])


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the metrics, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``."""
    flat = measure(docs.drop("base_failed", "failed_rules", "kept"), text_col)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    names = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return flat.withColumns({"base_failed": base, "failed_rules": names}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
