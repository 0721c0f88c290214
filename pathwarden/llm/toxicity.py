"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits for letters; anything else but
letters becomes a space) and searched with an Aho-Corasick automaton of stems anchored at
word starts.  A hit inside an exception phrase doesn't count.  The score is a
logistic function of the summed weights, also taken by length.

The lexicon is learned: stems are word prefixes of 3 to 12 folded letters, weighted by
their smoothed log odds between toxic and other labelled documents, of which at most ``SAMPLE_ROWS`` (a bound
on labelled rows only, drawn by the hash of doc_id) are read; half of them choose stems, the
other half fits the three numbers of the logistic function.  Scores then cover every
document.  Label, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathwarden.llm.common import discard, fresh, stored

SAMPLE_ROWS = 24_000
THRESHOLD = 0.7
#: A model has at most so many stems, the surest first.
LEXICON_SIZE = 4096
STEM_LETTERS = (3, 12)
MIN_DOCS = 4
MIN_ODDS = 12.0
# Letters that look like a Latin letter, and digits or signs that stand for one.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
ZERO_WIDTH = "­​‌‍⁠﻿"
#: Harmless phrases that hold a stem; hits inside them don't count.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "trash collection", "stupid simple", "pathetic fallacy", "scum line", "sore loser")

_BYTES = bytearray(b" " * 128)
for _c in range(128):
    if chr(_c).isalpha():
        _BYTES[_c] = ord(chr(_c).lower())
for _k, _v in DIGITS.items():
    _BYTES[ord(_k)] = ord(_v)
_ASCII = bytes(_BYTES) + bytes(range(128, 256))


class _Folds(dict):
    """Translation by code point, filled as code points turn up (there are at most 1.1 million)."""

    def __missing__(self, code: int):
        c = chr(code)
        low = c.lower()
        if c in ZERO_WIDTH:
            out = ""
        elif 0xFF01 <= code <= 0xFF5E:
            out = chr(_ASCII[code - 0xFEE0])
        else:
            out = LOOK_ALIKES.get(low) or (low if low.isalpha() else " ")
        self[code] = out
        return out


_FOLDS = _Folds({i: chr(_ASCII[i]) for i in range(128)})


def fold(text: str | None) -> str:
    """The folded text with a space before it; signs that only trail a word stay folded as letters of it."""
    if not text:
        return " "
    if text.isascii():
        return " " + text.encode().translate(_ASCII).decode()
    return " " + text.translate(_FOLDS)


def stems(folded: str, lo: int = STEM_LETTERS[0], hi: int = STEM_LETTERS[1]) -> set[str]:
    return {w[:k] for w in set(folded.split()) for k in range(lo, min(hi, len(w)) + 1)}


class Lexicon:
    """Weighted stems and exception phrases in one automaton, with the logistic function's numbers."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, coef=(-4.0, 4.0, 0.0)):
        self.weights, self.exceptions, self.coef = dict(weights), tuple(exceptions), tuple(coef)
        self._auto = None

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}

    def automaton(self):
        if self._auto is None:
            a = ahocorasick.Automaton()
            for w, weight in self.weights.items():
                a.add_word(" " + w, (len(w) + 1, weight))
            for phrase in self.exceptions:
                a.add_word(" " + " ".join(fold(phrase).split()), (len(phrase) + 1, None))
            if len(a):
                a.make_automaton()
            self._auto = a
        return self._auto

    def hits(self, folded: str) -> float:
        """The sum over words of the greatest weight among stems at the word, without excepted ones."""
        a = self.automaton()
        if not len(a):
            return 0.0
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, weight) in a.iter(folded):
            start = end - n + 1
            if weight is None:
                free.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if free:
            best = {s: w for s, w in best.items() if not any(x <= s <= y for x, y in free)}
        return sum(best.values())

    def features(self, text: str | None) -> tuple[float, float, float]:
        total = self.hits(fold(text))
        return 1.0, min(total, 30.0), 10 * total / (10 + len(text or "") ** 0.5)

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.coef, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count_stems(only: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[int, Counter] = {0: Counter(), 2: Counter()}
            for text, half in zip(b.column(0), b.column(1)):
                s = stems(fold(text.as_py()))
                counts[half.as_py()].update(s if only is None else s & only)
            names = list(counts[0].keys() | counts[2].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[h][x] for x in names], pa.int64()) for h in (0, 2))], ["stem", "n0", "n2"])

    return run


def _surprise(t: int, o: int, toxic: int, other: int) -> float:
    """The likelihood-ratio statistic of a stem that is in ``t`` toxic and ``o`` other documents."""
    expected = (t + o) * toxic / (toxic + other)
    part = lambda n, e: n * math.log(n / e) if n else 0.0
    return 2 * (part(t, expected) + part(o, t + o - expected))


def choose_stems(counts: list[tuple[str, int, int]], toxic: int, other: int, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Weights (smoothed log odds) of stems that are surely toxic, even as the best of so many; a stem gives way to a shorter one that is as telling."""
    if not toxic or not other or not counts:
        return {}
    least = 2 * math.log(len(counts)) + 8
    odds = {s: ((t + 0.5) / (toxic + 1)) / ((o + 0.5) / (other + 1)) for s, t, o in counts}
    ok = {s: (odds[s], t, o) for s, t, o in counts if t >= MIN_DOCS and odds[s] >= MIN_ODDS and t / (t + o) >= 0.6 and _surprise(t, o, toxic, other) >= least}
    kept: dict[str, tuple[float, int]] = {}
    for s in sorted(ok, key=len):
        parents = [ok[s[:k]] for k in range(STEM_LETTERS[0], len(s)) if s[:k] in kept]
        rate = lambda x: (x[2] + 0.5) / (x[1] + x[2] + 1)
        if not any(rate(p) <= 1.5 * rate(ok[s]) + 0.02 for p in parents):
            kept[s] = (odds[s], ok[s][1])
    # A stem that is telling only through a longer one that is kept too tells nothing of its own.
    for s in sorted(kept, key=len, reverse=True):
        inner = [ok[x] for x in kept if x != s and x.startswith(s)]
        if inner:
            _, t0, o0 = max(inner, key=lambda x: x[1])
            t, o = ok[s][1] - t0, ok[s][2] - o0
            if t < MIN_DOCS or ((t + 0.5) / (toxic + 1)) / ((o + 0.5) / (other + 1)) < MIN_ODDS or _surprise(t, o, toxic, other) < least:
                del kept[s]
    best = sorted(kept, key=lambda s: (-kept[s][1] * math.log(kept[s][0]), s))[:size]
    longer: dict[str, list[str]] = {}
    for s in ok:
        longer.setdefault(s[:-1], []).append(s)

    def grown(s: str) -> str:
        """The longest stem in as good as all toxic documents of ``s``: it spares words that only begin alike."""
        while (more := [x for x in longer.get(s, []) if ok[x][1] >= 0.97 * ok[s][1]]):
            s = max(more, key=lambda x: (ok[x][1], x))
        return s

    return {grown(s): math.log(kept[s][0]) for s in best}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(doc_id="doc_id"):
    """crc32(doc_id as text) mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from rows of ``labels`` (doc_id, toxic) whose remainder is not 1.

    Rows of null label, id or text teach nothing.  With labels of one kind, or none, the lexicon is
    empty and every score is below the threshold.
    """
    use = labels.where((remainder() != 1) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    there = use.count()
    if there > sample_rows:
        use = use.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * sample_rows / there))
    # Labels are narrow: the bounded sample of ids is what is sent to every executor.
    rows, path = stored(docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").where("text is not null").select("text", (F.col("toxic") != 0).cast("int").alias("toxic"), remainder().cast("int").alias("half")), "labelled")
    sizes = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    n = lambda y, *halves: sum(sizes.get((y, h), 0) for h in halves)

    def tally(label: int, only: frozenset | None) -> DataFrame:
        return rows.where(F.col("toxic") == label).select("text", "half").mapInArrow(_count_stems(only), "stem string, n0 long, n2 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n2").alias("n2"))

    lexicon = Lexicon({})
    if n(1, 0, 2) and n(0, 0, 2):
        # What is sought stands in many toxic documents: stems below one in 500 of them, or beyond the 65,536 most frequent, aren't candidates.
        first = tally(1, None).where(F.col("n0") + F.col("n2") >= max(MIN_DOCS, n(1, 0, 2) // 500)).orderBy(F.desc(F.col("n0") + F.col("n2")), "stem").limit(65_536)
        seen = {r["stem"]: (r["n0"], r["n2"]) for r in first.collect()}
        against = {r["stem"]: (r["n0"], r["n2"]) for r in tally(0, frozenset(seen)).collect()}
        pair = lambda s, k: (seen[s][k], against.get(s, (0, 0))[k])
        both = [(s, seen[s][0] + seen[s][1], sum(against.get(s, (0, 0)))) for s in seen]
        lexicon = Lexicon(choose_stems(both, n(1, 0, 2), n(0, 0, 2)))
        halves = {h: Lexicon(choose_stems([(s, *pair(s, k)) for s in seen], n(1, h), n(0, h))) for k, h in ((0, 0), (1, 2))}

        def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([(*halves[2 - h].features(t)[1:], float(y)) for t, y, h in zip(f["text"], f["toxic"], f["half"])], columns=["a", "b", "y"])

        got = rows.mapInPandas(features, "a double, b double, y double").toPandas()
        x = np.column_stack([np.ones(len(got)), got["a"], got["b"]])
        w = _fit(x, got["y"].to_numpy())
        if w[1] < 0 or w[2] < 0:  # weight in hits must not lower a score
            keep = 2 if w[1] < 0 else 1
            v = _fit(x[:, [0, keep]], got["y"].to_numpy())
            w = np.array([v[0], v[1] if keep == 1 else 0.0, v[1] if keep == 2 else 0.0])
        lexicon.coef = tuple(float(v) for v in w)
    discard(docs.sparkSession, path)
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, keep_text: bool = False, out: str = "score") -> DataFrame:
    """The columns of ``docs`` (without the text unless ``keep_text``) and the score of every whole text.

    Null texts score as empty ones.  The score's column is named ``out``, which must be a new name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = 0 if keep_text else 1
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            scores = pa.array([lex.score(t.as_py()) for t in b.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[at:], scores], [*b.schema.names[at:], out])

    slim = docs.select("text", *rest)
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[at:], T.StructField(out, T.DoubleType())]))


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts score as texts without a hit; repeated rows are scored one by one; a null doc_id counts as empty text in
    held_out.  No rows give no rows; without labels of both kinds every score is below the threshold.  Other columns play no part.
    """
    scored = score_texts(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score ``THRESHOLD`` or more; all columns stay, whatever their names.

    Null texts, rows without an id and repeated rows stay like any other; no rows give no rows.
    """
    name = fresh(docs.columns, "_toxicity")
    scored = score_texts(docs, learn(docs, labels), keep_text=True, out=name)
    return scored.where(F.col(name) < THRESHOLD).select(*docs.columns)
