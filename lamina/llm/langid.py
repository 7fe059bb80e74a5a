"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of its letter n-grams (one to three letters, A-Z and other
letters lower-cased, everything else a word break), hashed to ``DIMS`` places. Every language has several
centroids, found by spherical k-means; a text gets the language of the centroid with the largest cosine.
It is rejected if that cosine is below the language's threshold for texts that fill as many places: a
cosine with a dense centroid is bounded by the places that a text fills, which grow with its length, while
a text that repeats one word fills as few as a short one. The threshold is ``REJECT_FRACTION`` of a low
quantile (``REJECT_QUANTILE``) of the cosines that the language's training texts and their beginnings
(``HEADS`` characters) reach with centroids fitted without them, by class of filled places. A language with
a single training text rejects nothing.

The model is fitted on a bounded sample: at most ``SAMPLE_PER_LANGUAGE`` labelled documents of a language and
``SAMPLE_TOTAL`` in all, those with the least hash of their id, with whole texts. Languages are counted first, and
each one's rows are thinned by a hash threshold that lets about twice the sample through, so that ranking
them meets a bounded number of rows in a language, however many it has. Prediction reads whole texts of all rows and uses
nothing else.

Defined results: ``und``, score 0 and rejected for NULL texts and texts without a letter; if no labelled
document exists, every text is ``und``. Rows with a NULL id or language are not learned from; of rows with one
id any may be. Rows are judged one by one; an empty table gives an empty table. Input columns pass through,
whatever their names; ``lang_pred``, ``score`` and ``rejected`` replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.samples import MAX_CHARS
from lamina.llm.text_columns import column, unwrapped, whole_row
from lamina.scratch import materialize

DIMS, CENTROIDS, SAMPLE_PER_LANGUAGE, SAMPLE_TOTAL, REJECT_FRACTION, SEED = 2048, 4, 300, 6000, 0.6, 7
BROADCAST_ROWS = 100_000
REJECT_QUANTILE, FOLDS, HEADS = 0.05, 4, (20, 60, 160, 400, 1000, 2500)
#: Classes of filled places, and the square root of the middle of each.
EDGES = np.array([0, 32, 64, 128, 256, 512, 1024, DIMS + 1])
MIDDLES = np.sqrt([16, *np.sqrt(EDGES[1:-1] * EDGES[2:])])
UNKNOWN = "und"
_CHUNK = 1 << 18


def _letter_table() -> np.ndarray:
    """Lower-cased letter, or 32 for anything else, of each code point of the basic plane."""
    out = np.full(65536, 32, dtype=np.uint32)
    for code in range(65536):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


_TABLE: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _TABLE[0][np.minimum(codes, 65535)]
    for at in np.nonzero(codes > 65535)[0]:
        char = chr(codes[at])
        out[at] = ord(char.lower()) if char.isalpha() else 32
    return out


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of letter n-grams with word breaks; None if there is no letter."""
    if not text:
        return None
    counts = np.zeros(DIMS, dtype=np.float32)
    seen, tail = False, np.array([32, 32], dtype=np.uint32)
    for at in range(0, len(text), _CHUNK):
        letters = _letters(text[at : at + _CHUNK])
        seen = seen or bool((letters != 32).any())
        x = np.concatenate([tail, letters])
        x = x[np.concatenate([[True, True], (x[2:] != 32) | (x[1:-1] != 32)])]  # a run of breaks counts once
        a, tail = x * np.uint32(2654435761), x[-2:]
        b = a[1:] ^ (x[:-1] * np.uint32(2246822519))
        c = b[1:] ^ (x[:-2] * np.uint32(3266489917))
        for grams, salt in ((a[2:], 0), (b[1:], 0x9E3779B9), (c, 0x85EBCA6B)):
            mixed = (grams ^ np.uint32(salt)) * np.uint32(0x27D4EB2F)
            counts += np.bincount((mixed >> np.uint32(15)) % DIMS, minlength=DIMS)
    return counts if seen else None


@dataclass
class Model:
    """Centroids (unit rows), their languages, IDF weights and the rejection thresholds of each at ``MIDDLES``."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    thresholds: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        found = [(k, c) for k, t in enumerate(texts) if (c := ngram_counts(t)) is not None]
        if not found or not self.languages:
            return out
        counts = np.stack([c for _, c in found])
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
        filled = np.sqrt((counts > 0).sum(axis=1))
        for row, (k, _) in enumerate(found):
            out[k] = (self.languages[best[row]], float(score[row]), bool(score[row] < np.interp(filled[row], MIDDLES, self.thresholds[best[row]])))
        return out


def _kmeans(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; unit centroids of the non-empty clusters."""
    chosen = [int(rng.integers(len(vectors)))]
    while len(chosen) < min(k, len(vectors)):
        gap = 1.0 - (vectors @ vectors[chosen].T).max(axis=1)
        chosen.append(int(gap.argmax()))
    centers = vectors[chosen]
    for _ in range(rounds):
        near = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[near == c].sum(axis=0) for c in range(len(centers)) if (near == c).any()])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def _thresholds(model: Model, counts: np.ndarray, heads: list[str], reject_fraction: float) -> np.ndarray:
    """The rejection thresholds at ``MIDDLES`` of one language, whose training texts have ``counts`` and begin with ``heads``."""
    cosines, classes = [], []
    vectors, folds = model.vectors(counts), min(FOLDS, len(counts))
    fold = np.arange(len(counts)) % max(folds, 1)
    for held in range(folds if folds > 1 else 0):
        centers = _kmeans(vectors[fold != held], CENTROIDS, np.random.default_rng(SEED))
        begun = [c for k in np.nonzero(fold == held)[0] if heads for n in HEADS if len(heads[k]) >= n and (c := ngram_counts(heads[k][:n])) is not None]
        own = np.concatenate([counts[fold == held], np.stack(begun)]) if begun else counts[fold == held]
        cosines.append((model.vectors(own) @ centers.T).max(axis=1))
        classes.append(np.searchsorted(EDGES, (own > 0).sum(axis=1), side="right") - 1)
    if not cosines:
        return np.zeros(len(MIDDLES))
    cosine, of = np.concatenate(cosines), np.concatenate(classes)
    known = np.unique(of)
    low = [reject_fraction * float(np.quantile(cosine[of == k], REJECT_QUANTILE)) for k in known]
    # classes without a text lie between their neighbours; a few mixed texts must not lower a class below shorter ones
    return np.maximum.accumulate(np.interp(MIDDLES, [0.0, *MIDDLES[known]], [0.0, *low]))


def fit_arrays(counts: np.ndarray, languages: list[str], reject_fraction: float = REJECT_FRACTION, heads: list[str] | None = None) -> Model:
    """``heads``: the beginnings of the texts, for the thresholds of shorter texts."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros((0, len(MIDDLES))))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1.0
    model, labels = Model(names, np.zeros((0, DIMS)), idf, np.zeros((0, len(MIDDLES)))), np.array(languages)
    vectors, rng = model.vectors(counts), np.random.default_rng(SEED)
    centroids, owners, thresholds = [], [], []
    for name in names:
        mine = vectors[labels == name]
        centers = _kmeans(mine, CENTROIDS, rng)
        begun = [heads[k] for k in np.nonzero(labels == name)[0]] if heads else []
        centroids.append(centers)
        owners += [name] * len(centers)
        thresholds += [_thresholds(model, counts[labels == name], begun, reject_fraction)] * len(centers)
    return Model(owners, np.concatenate(centroids).astype(np.float32), idf, np.array(thresholds))


@F.arrow_udf(T.BinaryType())
def _counts(texts: pa.Array) -> pa.Array:
    rows = (ngram_counts(t.as_py()) for t in texts)
    return pa.array([None if c is None else c.tobytes() for c in rows], type=pa.binary())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_TOTAL, reject_fraction: float = REJECT_FRACTION) -> Model:
    """Fit on at most ``per_language`` rows of a language and ``total`` rows of ``labelled`` (NULL labels ignored)."""
    rows = labelled.select(column(id_col).alias("id"), column(lang_col).alias("lang"), column(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("id"))
    counted, _ = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    # broadcast up to a counted size: a join that shuffles would deal all rows of a language to one task
    counted = F.broadcast(counted) if counted.count() <= BROADCAST_ROWS else counted
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))
    thinned = rows.join(counted, "lang").where((F.col("h").cast("double") + F.lit(2.0**63)) <= share * F.lit(2.0**64)).select("id", "lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    ranked = thinned.withColumn("r", rank).where(F.col("r") <= per_language)
    ids = sorted({r[0] for r in ranked.orderBy("r", "lang").limit(total).select("id").collect()})  # at most `total` ids
    digest = [F.length("text").alias("n"), _counts(F.col("text")).alias("c"), F.substring("text", 1, max(HEADS)).alias("head")]
    picked, _ = materialize(rows.where(F.col("id").isin(ids)).select("lang", "h", "id", *digest), "language-sample")
    # repeated ids can make more rows than were ranked: the limits are on rows and characters
    got, chars = [], 0
    for r in picked.where("c IS NOT NULL").orderBy("h", "id", "lang", F.xxhash64("c")).limit(total).collect():
        chars += r["n"]
        if got and chars > MAX_CHARS:
            break
        got.append(r)
    got.sort(key=lambda r: (r["lang"], r["id"]))
    counts = np.stack([np.frombuffer(r["c"], dtype=np.float32) for r in got]) if got else np.zeros((0, DIMS), np.float32)
    return fit_arrays(counts, [r["lang"] for r in got], reject_fraction, [r["head"] for r in got])


def identify(text: Column, model: Model) -> Column:
    """Struct ``(lang_pred, score, rejected)``."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def predict(texts: pa.Array) -> pa.Array:
        parts = [model.predict(texts[at : at + 256].to_pylist()) for at in range(0, len(texts), 256)]
        lang, score, rejected = zip(*[r for p in parts for r in p], strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    return F.arrow_udf(predict, kind)(text)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(whole_row(docs).alias("row"), identify(column(text_col), model).alias("p")).select(*unwrapped("row", kept), "p.lang_pred", "p.score", "p.rejected")


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged."""
    judged = docs.select(whole_row(docs).alias("row"), identify(column(text_col), model).alias("p"))
    return judged.where("NOT p.rejected").select(*unwrapped("row", docs.columns))


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the fold of a document."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
