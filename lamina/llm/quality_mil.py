"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words covering its whole text. Every passage is
encoded: a fixed feature vector (rates of character classes, word shapes, repetition inside the passage
and of earlier passages) passes through a learned layer h = tanh(W x + b). Gated attention gives each
passage the weight softmax(w . (tanh(V h) * sigmoid(U h))) within its document, and the weighted sum of
the encodings is scored by a logistic unit. Only document labels are used; all weights are learned
together by Adam on the log loss.

The model is fitted on a bounded sample (:mod:`lamina.llm.samples`): at most ``SAMPLE`` labelled documents and ``SAMPLE_CHARS``
characters, each document with all its passages. Scoring reads every passage of every row and uses nothing but
the text.

Defined results: NULL, empty and blank texts are one passage without words and get that passage's score;
without labels of both kinds every score is 0.5. Rows are scored one by one; an empty table gives an empty table. Input
columns pass through, whatever their names; ``score`` and ``n_passages`` replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.samples import sampled
from lamina.llm.text_columns import column, unwrapped, whole_row

PASSAGE_WORDS, SAMPLE, SAMPLE_CHARS, HIDDEN, ATTENTION, EPOCHS, SEED = 100, 6000, 64_000_000, 24, 12, 40, 11
PUNCTUATION = ".,;:!?'\"()[]{}<>-_/\\|#*$%&=@+~^`"
_STYLE = 8


def _class_matrix() -> np.ndarray:
    """256 byte values to character classes: lower, upper, digit, space, beyond ASCII, each punctuation sign, other."""
    out = np.zeros((256, 6 + len(PUNCTUATION)), dtype=np.float32)
    for b in range(256):
        char = chr(b)
        if b >= 128:
            out[b, 4] = 1
        elif char.islower():
            out[b, 0] = 1
        elif char.isupper():
            out[b, 1] = 1
        elif char.isdigit():
            out[b, 2] = 1
        elif char.isspace():
            out[b, 3] = 1
        elif char in PUNCTUATION:
            out[b, 6 + PUNCTUATION.index(char)] = 1
        else:
            out[b, 5] = 1
    return out


CLASSES = _class_matrix()
FEATURES = CLASSES.shape[1] + _STYLE


def passages(text: str | None) -> np.ndarray:
    """One feature row per passage of the whole text."""
    words = (text or "").split()
    starts = range(0, max(len(words), 1), PASSAGE_WORDS)
    histograms = np.zeros((len(starts), 256), dtype=np.float32)
    style = np.zeros((len(starts), _STYLE), dtype=np.float32)
    seen: set = set()
    for k, at in enumerate(starts):
        part = words[at : at + PASSAGE_WORDS]
        if not part:
            continue
        raw = " ".join(part).encode("utf-8", "surrogatepass")
        histograms[k] = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        n = len(part)
        trios = [hash(t) for t in zip(part, part[1:], part[2:], strict=False)]
        fresh = set(trios)
        twice = sum(a == b for a, b in zip(part, part[1:], strict=False))
        title = sum(w[0].isupper() for w in part)
        word_end = sum(not w[-1].isalnum() for w in part)
        again = len(fresh & seen)
        seen |= fresh
        style[k] = (np.log1p(n), len(raw) / n / 10, len(set(part)) / n, twice / n, title / n, word_end / n, 1 - len(fresh) / max(len(trios), 1), again / max(len(fresh), 1))
    total = np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    return np.concatenate([np.log1p(100 * (histograms @ CLASSES) / total), style], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights by name, and the mean and scale of the features."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of bags whose rows are stacked in ``x``; every bag has at least one row."""
        if not self.weights:
            return np.full(len(sizes), 0.5)
        return _forward(self.weights, np.clip((x - self.mean) / self.scale, -5, 5), sizes)[0]


def _forward(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray):
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    a = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _sigmoid(z @ p["c"] + p["d"]), h, v, u, a, z, starts, owner


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    s, h, v, u, a, z, starts, owner = _forward(p, x, sizes)
    ds = (s - y) / len(y)
    dz = ds[:, None] * p["c"]
    da = (dz[owner] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[owner])
    dv, du = de[:, None] * p["w"] * u * (1 - v**2), de[:, None] * p["w"] * v * u * (1 - u)
    dh = (a[:, None] * dz[owner] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
    out = {"c": z.T @ ds, "d": ds.sum(), "w": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": x.T @ dh, "b": dh.sum(axis=0)}
    return {k: g + decay * p[k] * (k not in "bd") for k, g in out.items()}


def fit_arrays(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.005, decay: float = 1e-4) -> Model:
    if not bags or len(set(labels.tolist())) < 2:
        return Model({}, np.zeros(FEATURES), np.ones(FEATURES))
    rng = np.random.default_rng(SEED)
    total = sum(map(len, bags))  # sums bag by bag, and bags in single precision: the sample is held once
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / total
    scale = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / total) + 0.05
    bags = [np.clip((b - mean) / scale, -5, 5).astype(np.float32) for b in bags]
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "d": np.array(0.0)}
    m, q, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    rounds = max(epochs, -(-400 * batch // len(bags)))  # small samples get enough steps too
    for epoch in range(rounds):
        order = rng.permutation(len(bags))
        speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / rounds))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, sizes = np.concatenate([bags[k] for k in pick]).astype(np.float64), np.array([len(bags[k]) for k in pick])
            step += 1
            for k, g in _gradients(p, x, sizes, labels[pick], decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                p[k] = p[k] - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
    return Model({k: np.asarray(x, dtype=np.float32) for k, x in p.items()}, mean, scale)


@F.arrow_udf(T.BinaryType())
def _bag(texts: pa.Array) -> pa.Array:
    return pa.array([passages(t.as_py()).astype("<f4").tobytes() for t in texts], type=pa.binary())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``sample`` rows of ``labelled``; rows with a NULL label are ignored."""
    label = F.when(column(label_col).isin(0, 1), column(label_col).cast("double"))
    rows = sampled(labelled, id_col, text_col, label, sample, max_chars, {"bag": _bag(F.col("text"))}, "quality-sample")
    bags = [np.frombuffer(r["bag"], dtype="<f4").reshape(-1, FEATURES) for r in rows]
    return fit_arrays(bags, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``n_passages``."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])

    def run(texts: pa.Array) -> pa.Array:
        scores, sizes = [], []
        for at in range(0, len(texts), 64):
            bags = [passages(t.as_py()) for t in texts[at : at + 64]]
            n = np.array([len(b) for b in bags])
            scores.append(model.score(np.concatenate(bags), n))
            sizes.append(n)
        arrays = [pa.array(np.concatenate(x) if x else [], type=k) for x, k in ((scores, pa.float64()), (sizes, pa.int64()))]
        return pa.StructArray.from_arrays(arrays, names=["score", "n_passages"])

    kept = [c for c in docs.columns if c not in ("score", "n_passages")]
    judged = docs.select(whole_row(docs).alias("row"), F.arrow_udf(run, kind)(column(text_col)).alias("q"))
    return judged.select(*unwrapped("row", kept), "q.score", "q.n_passages")
