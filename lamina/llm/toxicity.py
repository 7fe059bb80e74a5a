"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding composes the text (NFKC, so mathematical, full-width and circled letters become plain ones), lower-cases it, drops
zero-width characters and marks that belong to no letter, and maps look-alike letters of other scripts. In words that
hold a letter, digits and signs that stand for letters are mapped too; numbers stay out. Everything else is a word break.
Every word has two forms: that one, with its accents, and a plain one without them. A lexicon entry is a word
beginning and must start at a word; it is matched against both forms if it has no accent itself, else against the
first, so ``ïdiot`` is found, while a beginning that accents tell apart from others stays apart. Where
several entries match one word the heaviest counts. A match is cancelled if the word before or the word after makes an
exception phrase with it. The summed weight per hundred words passes through a logistic curve to a score from 0 to 1.

The lexicon, its weights, further exception phrases and the curve are learned from labels on a bounded sample:
at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` other labelled documents (:mod:`lamina.llm.samples`).
Candidates are all beginnings of ``MIN_PREFIX`` to ``MAX_PREFIX`` letters that at least ``MIN_SUPPORT`` toxic
sample texts hold and no longer beginning holds as often (so ``trash``, never ``tras``); their weights are log
ratios of how often they occur in toxic and in other texts. Entries are chosen greedily to cover the toxic
documents (a document counts half after each entry that covers it), so that words that merely sit beside
toxic ones stay out; after each choice the words it matches are taken out, so a shorter beginning must win by
other words. Choosing ends when nothing adds ``MIN_GAIN`` documents. Phrases are then looked for around the chosen
entries: word pairs in at least ``MIN_PHRASE`` clean texts and no toxic one. Scoring reads whole texts of all rows and uses nothing else.

Defined results: NULL, empty and blank texts match nothing and get the score of a text without matches; if
there are no toxic labels the lexicon is empty. Rows are scored one by one; an empty table gives an empty
table. Input columns pass through, whatever their names; ``score``, ``matches`` and ``n_words`` replace columns of those names.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Container, Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.samples import MAX_CHARS, sampled
from lamina.llm.text_columns import column, unwrapped, whole_row

SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
MIN_PREFIX, MAX_PREFIX, MIN_SUPPORT, MIN_WEIGHT, MAX_WEIGHT, MIN_GAIN, MIN_PHRASE = 3, 32, 3, 2.5, 8.0, 2.0, 3
#: A clean document counts against an entry in full at this many occurrences per hundred words.
FULL_DENSITY, CLEAN_PENALTY = 0.8, 1.0
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "һ": "h", "ӏ": "l", "ѵ": "v", "ү": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "ɑ": "a", "ı": "i", "ȷ": "j",
    "ꭺ": "a", "ꭰ": "d", "ꭼ": "e", "ꮋ": "h", "ꭻ": "j", "ꮮ": "l", "ꮇ": "m", "ꮲ": "p", "ꭱ": "r", "ꮪ": "s", "ꭲ": "t", "ꮃ": "w",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"}
#: Phrases (first word, second word) that make an entry harmless.
PHRASES = {("clown", "fish"), ("clown", "fishes"), ("clown", "car"), ("class", "clown"), ("trash", "can"), ("trash", "bag"), ("trash", "bin"), ("trash", "collection"), ("pond", "scum"), ("idiot", "proof"), ("dummy", "variable"), ("savage", "garden")}
#: Letters whose Unicode name says which Latin letter they vary (strokes, small capitals, squared and other letters).
_VARIANT = re.compile(r"(?:LATIN (?:SMALL |CAPITAL )?LETTER (?:SMALL CAPITAL )?|REGIONAL INDICATOR SYMBOL LETTER )([A-Z])(?: WITH (?:STROKE|BAR|HOOK|TAIL|RETROFLEX HOOK|MIDDLE TILDE|CURL|LOOP|SWASH TAIL|DIAGONAL STROKE|LEFT HOOK|RIGHT HOOK|LONG LEG|BELT|DESCENDER|PALATAL HOOK|OBLIQUE STROKE|HIGH STROKE|CROSSED-TAIL))?$")
#: A word with a digit or sign next to its letters; signs that merely follow a word are left out.
_MIXED = re.compile(r"[^\s!|]\S*")
_SIGNED = re.compile(f"[{re.escape(''.join(SIGNS))}]")


class _Fold(dict):
    """Code point to folded text, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = folded = self._fold(chr(code))
        return folded

    @staticmethod
    def _fold(char: str) -> str:
        low, kind = char.lower(), unicodedata.category(char)
        if low in LOOK_ALIKES:
            return LOOK_ALIKES[low]
        if kind in ("Mn", "Me", "Cf"):
            return ""
        variant = _VARIANT.search(unicodedata.name(char, "")) if ord(char) >= 128 and (kind == "So" or not unicodedata.decomposition(char)) else None
        if variant:
            return variant[1].lower()
        if kind[0] == "L":
            return "".join(LOOK_ALIKES.get(c, c) for c in low if c.isalpha())
        return char if char in SIGNS or char.isdigit() else " "


class _NoMarks(dict):
    """Code point to itself, or to nothing for a combining mark, filled as characters are met."""

    def __missing__(self, code: int) -> int | None:
        self[code] = kept = None if unicodedata.combining(chr(code)) else code
        return kept


_FOLD, _MARKS = _Fold(), _NoMarks()


def _letters_only(word: str) -> str:
    """The word with digits and signs read as letters; word breaks where that fails, and no word without a letter."""
    core = word.rstrip("!|$€@").lstrip("!|")
    if not any(c.isalpha() for c in core):
        return " "
    return "".join(c if c.isalpha() else SIGNS.get(c, " ") for c in core)


def fold(text: str | None) -> str:
    """Folded words with their accents, each preceded by one space."""
    if not text:
        return ""
    folded = unicodedata.normalize("NFKC", text).translate(_FOLD)
    words = folded.split()
    if _SIGNED.search(folded) or not folded.replace(" ", "").isalpha():
        words = " ".join(w if w.isalpha() else _letters_only(w) for w in words).split()
    return " " + " ".join(words) if words else ""


def plain(folded: str) -> str:
    """The words without accents: the same words at the same places in order."""
    if folded.isascii():
        return folded
    return unicodedata.normalize("NFKD", folded).translate(_MARKS)


@dataclass
class Lexicon:
    """Word beginnings with weights, exception phrases (first word, second word), and the curve."""

    weights: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=lambda: set(PHRASES))
    slope: float = 1.0
    bias: float = -3.0

    def automaton(self, ascii_only: bool):
        name = f"_auto{ascii_only}"
        if name not in self.__dict__:
            auto = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                if entry.isascii() or not ascii_only:
                    auto.add_word(" " + entry, (entry, weight))
            if len(auto):
                auto.make_automaton()
            self.__dict__[name] = auto
        return self.__dict__[name]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_auto")}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _found(self, text: str, ascii_only: bool) -> dict[int, tuple[str, float]]:
        """The heaviest entry by the place of its word's space in ``text``."""
        found: dict[int, tuple[str, float]] = {}
        auto = self.automaton(ascii_only)
        if len(auto) and text:
            for end, (entry, weight) in auto.iter(text):
                at = end - len(entry)
                if at not in found or weight > found[at][1]:
                    found[at] = (entry, weight)
        return found

    def matches(self, folded: str) -> dict[int, tuple[str, float, tuple[str, str, str]]]:
        """By word number: the heaviest entry, its weight, and the words before, at and after it; without cancelled ones."""
        forms = [(folded, False)] + ([] if folded.isascii() else [(plain(folded), True)])
        out: dict = {}
        for text, ascii_only in forms:
            number, last = 0, 0
            for at, (entry, weight) in sorted(self._found(text, ascii_only).items()):
                number, last = number + text.count(" ", last, at), at
                context = _context(text, at)
                if (number not in out or weight > out[number][1]) and not self._excepted(context):
                    out[number] = (entry, weight, context)
        return out

    def _excepted(self, context: tuple[str, str, str]) -> bool:
        before, word, after = context
        return (before, word) in self.exceptions or (word, after) in self.exceptions

    def density(self, folded: str) -> tuple[float, int, int]:
        """Logarithm of the weight per hundred words, matches that count, words."""
        words, found = folded.count(" "), self.matches(folded)
        return math.log1p(100.0 * sum(w for _, w, _ in found.values()) / (words + 20)), len(found), words

    def score(self, text: str | None) -> tuple[float, int, int]:
        x, count, words = self.density(fold(text))
        return 1.0 / (1.0 + math.exp(-(self.slope * x + self.bias))), count, words


def _context(text: str, at: int) -> tuple[str, str, str]:
    """The words before, at and after the space at ``at``."""
    end = text.find(" ", at + 1)
    stop = text.find(" ", end + 1) if end >= 0 else -1
    before = text[text.rfind(" ", 0, at) + 1 : at] if at > 0 else ""
    return before, text[at + 1 : end if end >= 0 else len(text)], "" if end < 0 else text[end + 1 : stop if stop >= 0 else len(text)]


def _beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(MIN_PREFIX, min(len(word), MAX_PREFIX) + 1)]


def _held(words: Iterable[str], kept: Container[str]) -> dict[str, tuple[str, ...]]:
    """The beginnings of each word that are in ``kept``, for the words that have any."""
    held = ((w, tuple(b for b in _beginnings(w) if b in kept)) for w in words)
    return {w: found for w, found in held if found}


def _candidates(toxic: list[Counter], clean: list[Counter]) -> dict[str, float]:
    """Weights of the beginnings that qualify; the texts are given as word counts."""
    holders: Counter = Counter()
    for words in toxic:
        holders.update(words.keys())
    at_most: Counter = Counter()  # no beginning is in more texts than its words together
    for w, n in holders.items():
        for b in _beginnings(w):
            at_most[b] += n
    held = _held(holders, {b for b, n in at_most.items() if n >= MIN_SUPPORT})
    support: Counter = Counter()
    for words in toxic:
        support.update({b for w in words for b in held.get(w, ())})
    kept = {b: n for b, n in support.items() if n >= MIN_SUPPORT}
    longer: dict[str, int] = {}
    for b, n in kept.items():
        longer[b[:-1]] = max(longer.get(b[:-1], 0), n)
    closed = {b for b, n in kept.items() if longer.get(b, 0) < n}
    counts = []
    for group in (toxic, clean):
        total: Counter = Counter()
        for words in group:
            total.update(words)
        found: Counter = Counter()
        for w, bs in _held(total, closed).items():
            for b in bs:
                found[b] += total[w]
        counts.append((found, sum(total.values())))
    (t, all_t), (c, all_c) = counts
    weights = {b: math.log((t[b] + 0.5) / (all_t + 1)) - math.log((c[b] + 0.5) / (all_c + 1)) for b in closed}
    return {b: min(w, MAX_WEIGHT) for b, w in weights.items() if w >= MIN_WEIGHT}


def choose(toxic: list[Counter], clean: list[Counter]) -> dict[str, float]:
    """The chosen entries and their weights; what each adds must outweigh the clean documents it touches."""
    weights = _candidates(toxic, clean)
    held = _held({w for words in (*toxic, *clean) for w in words}, weights)
    where: dict[str, dict[int, set[str]]] = {}  # entry: toxic document: words it matches there
    for k, words in enumerate(toxic):
        for w in words.keys() & held.keys():
            for b in held[w]:
                where.setdefault(b, {}).setdefault(k, set()).add(w)
    against: Counter = Counter()
    for words in clean:
        size, found = sum(words.values()), Counter()
        for w in words.keys() & held.keys():
            for b in held[w]:
                found[b] += words[w]
        for b, n in found.items():
            against[b] += min(1.0, 100.0 * n / (size + 20) / FULL_DENSITY)
    worth, chosen = np.ones(len(toxic)), []

    def gain(entry: str) -> float:
        return round(sum(worth[k] for k in where[entry]) - CLEAN_PENALTY * against[entry], 6)

    # gains only fall, so the best is up to date or is put back with what it is worth now
    heap = [(-gain(b), -weights[b], -len(b), b) for b in where]
    heapq.heapify(heap)
    while heap:
        value, *rest, best = heapq.heappop(heap)
        if best not in where:
            continue
        if gain(best) < -value:
            heapq.heappush(heap, (-gain(best), *rest, best))
            continue
        if -value < MIN_GAIN:
            break
        chosen.append(best)
        worth[list(where[best])] *= 0.5
        for b in [b for b in where if b.startswith(best)]:
            del where[b]
        for b in _beginnings(best)[:-1]:  # what the entry matches is no evidence for a shorter one
            if b in where:
                where[b] = {k: left for k, ws in where[b].items() if (left := {w for w in ws if not w.startswith(best)})}
    return {b: weights[b] for b in chosen}


def _phrases(lexicon: Lexicon, toxic: list[str], clean: list[str]) -> set[tuple[str, str]]:
    """Word pairs around the entries that several clean texts hold and no toxic one."""
    def pairs(folded: str) -> set[tuple[str, str]]:
        around = (context for _, _, context in lexicon.matches(folded).values())
        return {p for before, word, after in around for p in ((before, word), (word, after)) if all(p)}

    counted = Counter(p for t in clean for p in pairs(t))
    harmless = {p for p, n in counted.items() if n >= MIN_PHRASE}
    return harmless - {p for t in toxic for p in pairs(t)} if harmless else harmless


def fit_texts(toxic: list[str], clean: list[str]) -> Lexicon:
    """Learn from folded texts."""
    if not toxic:
        return Lexicon({})
    lexicon = Lexicon(choose([Counter(t.split()) for t in toxic], [Counter(t.split()) for t in clean]))
    lexicon.exceptions |= _phrases(lexicon, toxic, clean)
    points = Counter((lexicon.density(t)[0], label) for label, texts in ((1, toxic), (0, clean)) for t in texts)
    lexicon.slope, lexicon.bias = logistic([(x, y, n) for (x, y), n in points.items()])
    return lexicon


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([fold(t.as_py()) for t in texts], type=pa.string())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, max_chars: int = MAX_CHARS) -> Lexicon:
    """Learn from at most the sample sizes of labelled rows; rows with a NULL label are ignored."""
    texts = []
    for label, size in ((1, sample_toxic), (0, sample_clean)):
        picked = F.when(column(label_col) == label, F.lit(label))
        rows = sampled(labelled, id_col, text_col, picked, size, max_chars // 2, {"folded": _folded(F.col("text"))}, "toxicity-sample")
        texts.append([r["folded"] for r in rows])
        if not texts[0]:
            break
    return fit_texts(texts[0], texts[-1] if len(texts) > 1 else [])


def logistic(points: list[tuple[float, int, int]], ridge: float = 1.0) -> tuple[float, float]:
    """Slope and bias of a one-feature logistic curve over (value, label, count), by Newton steps."""
    x, y, n = (np.array(c, dtype=float) for c in zip(*sorted(points), strict=True))
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (p - y)) + ridge * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``matches`` (that count) and ``n_words`` (after folding)."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("matches", T.LongType()), T.StructField("n_words", T.LongType())])

    def run(texts: pa.Array) -> pa.Array:
        rows = [lexicon.score(t.as_py()) for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["score", "matches", "n_words"])

    kept = [c for c in docs.columns if c not in ("score", "matches", "n_words")]
    judged = docs.select(whole_row(docs).alias("row"), F.arrow_udf(run, kind)(column(text_col)).alias("s"))
    return judged.select(*unwrapped("row", kept), "s.score", "s.matches", "s.n_words")
