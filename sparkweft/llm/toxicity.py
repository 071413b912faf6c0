"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Text is folded first: compatibility forms and accents go (NFKD), lower case, letters
that look Latin become Latin, digits and signs next to a letter become the letters they
stand for, punctuation becomes a space. The lexicon holds words and beginnings of words
with log-odds weights, learned from a bounded sample of labelled documents. Exception
phrases excuse the matches inside them: a given list, and pairs of words around a match
that the sample has in clean documents only. One automaton finds all of them in one
pass over a text. A document's score is a logistic function of the weights found, as a
sum and by length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, cut, remainder

#: Bound of the labelled sample, for each label; the support a term needs and its least weight.
MAX_PER_LABEL = 6000
MIN_TOXIC = 4
MIN_ODDS = 2.5
PREFIXES = range(3, 9)
#: A longer word, in bytes, is known by its beginnings alone.
LONGEST = 64
#: A pair of words around a match excuses it if so many clean documents hold it and no toxic one.
MIN_CLEAN = 5
#: Phrases that are always exceptions, besides the learned ones.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "sore loser", "scum line", "stupid simple")

# Letters of other scripts that look like Latin ones; NFKD has no form for them.
HOMOGLYPHS = str.maketrans("абвгеёзікмнорстухуѕјԁһӏαβεικνορτυχɑɡıʟոսօցհɩ", "abbreeeikmhopctyxysjdhlabeikvoptuxagilnuoghi") | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None} | str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ß": "ss", "æ": "ae", "œ": "oe"})
_ODD = re.compile("[" + "".join(chr(c) for c in HOMOGLYPHS) + "]")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u20d0-\u20ff]+")
DIGITS = bytes.maketrans(b"01345789@$", b"oieastbgas")
_MIXED = re.compile(rb"(?<=[a-z])[0-9@$]+|[0-9@$]+(?=[a-z])")
_LETTERS = re.compile(rb"[a-z][0-9@$]|[0-9@$][a-z]")
#: Every byte but letters, digits, @, $ and those of longer code points becomes a space.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() or chr(c) in "@$" else 32 for c in range(256))


def fold(text: str) -> str:
    """Folded text between spaces; a character stands for a byte of its UTF-8 form."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low)).lower()
        if _ODD.search(low):
            low = low.translate(HOMOGLYPHS)
    b = low.encode().translate(_PLAIN)
    if _LETTERS.search(b):
        b = _MIXED.sub(lambda m: m[0].translate(DIGITS), b)
    return f" {b.decode('latin-1')} "


def terms(folded: str) -> set[str]:
    """The words (with both spaces) and word beginnings (with the space before) of a folded text."""
    out = set()
    for w in set(folded.split(" ")):
        if w:
            if len(w) <= LONGEST:
                out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in PREFIXES if n < len(w))
    return out


@dataclass
class Lexicon:
    """Weights by term, exception phrases, and the logistic model over a text's features."""

    weights: dict[str, float]
    exceptions: tuple = EXCEPTIONS
    model: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.5, 0.0, 0.0, 0.0]))
    _automaton: object = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "model": self.model, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for p in self.exceptions:
                a.add_word(fold(p), (len(fold(p)), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms found that no exception phrase holds; of the terms that begin at one place
        the heaviest, of equal ones the shortest."""
        best: dict[int, tuple[float, int]] = {}
        excused = []
        a = self.automaton()
        if len(a):
            for end, (n, w) in a.iter(folded):
                start = end - n + 1
                if w is None:
                    excused.append((start, end))
                elif w > best.get(start, (0.0, 0))[0]:
                    best[start] = (w, end)
        out, held, at = [], -1, 0  # the largest end of the excused spans that begin so far
        excused.sort()
        for s, (w, e) in sorted(best.items()):
            while at < len(excused) and excused[at][0] <= s:
                held = max(held, excused[at][1])
                at += 1
            if e > held:
                out.append((s, e, w))
        return out

    def features(self, text: str) -> list[float]:
        """Constant, matched weight (log), weight by length (log), distinct matches, log length."""
        folded = fold(text)
        hits = self.matches(folded)
        words, total = max(1, len(folded.split())), sum(w for _, _, w in hits)
        distinct = len({folded[s : e + 1].strip() for s, e, _ in hits})
        return [1.0, math.log1p(total), math.log1p(10 * total / words), math.log1p(distinct), math.log1p(len(hits)) * math.log1p(words) / 10]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.features(text or ""), self.model)))))))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, text, label): labelled documents that may be learned from, at most ``per_label`` of each label, by hash order.

    Only the ids are sorted; the texts come by a broadcast of these bounded ids. A
    doc_id with several rows counts once, with its smallest text.
    """
    ids = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id") != 0)).select(F.col("doc_id").alias("__id"), F.col(label).alias("label")).distinct()
    chosen = None
    for value in (0, 1):
        some = ids.filter(F.col("label") == value).orderBy(F.xxhash64("__id"), "__id").limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("doc_id", F.col("label").cast("int").alias("label")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def chosen_terms(odds: dict[str, float]) -> dict[str, float]:
    """The terms that say something of their own: a longer one only if it says clearly more than its beginnings that are kept."""
    kept: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):
        if odds[t] > max((kept.get(t[:k], 0.0) for k in range(4, len(t))), default=0.0) + 0.3:
            kept[t] = odds[t]
    return kept


def fit(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL, exceptions: tuple = EXCEPTIONS) -> Lexicon:
    """Learn weights and model from at most ``2 * per_label`` labelled documents (crc32 of the id modulo 5 not 0).

    What is learned is bounded by this sample alone: every term of it that has the
    support and the weight is a candidate.
    """
    sample = cut(sample_labelled(docs, labels, "toxic", per_label).repartition(F.col("doc_id")))

    def both(found: dict[int, Counter], name: str) -> dict:
        some = list(found[0].keys() | found[1].keys())
        return {name: pa.array(some, pa.string()), "pos": pa.array([found[1][t] for t in some], pa.int64()), "neg": pa.array([found[0][t] for t in some], pa.int64())}

    def counted(batch: pa.RecordBatch, of, name: str) -> dict:
        found = {0: Counter(), 1: Counter()}
        for text, y in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist(), strict=True):
            found[y].update(of(fold(text or "")))
        return both(found, name)

    rows = sample.select("text", "label")
    per = arrow_map(rows, lambda b: counted(b, terms, "term"), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.log((F.col("pos") + 0.1) / (n.get(1, 0) + 1)) - F.log((F.col("neg") + 0.5) / (n.get(0, 0) + 1))
    strong = per.filter(F.col("pos") >= MIN_TOXIC).withColumn("weight", F.round(weight, 9)).filter(F.col("weight") >= MIN_ODDS)
    out = Lexicon(chosen_terms({r["term"]: r["weight"] for r in strong.select("term", "weight").collect()}), exceptions)

    def around(folded: str) -> set[str]:  # the pairs of words of which one is a match
        pairs = set()
        for s, _, _ in out.matches(folded):
            end = folded.find(" ", s + 1)
            word, left = folded[s + 1 : end], folded[folded.rfind(" ", 0, s) + 1 : s]
            right = folded[end + 1 : folded.find(" ", end + 1)]
            pairs.update(p for p, known in ((f"{left} {word}", left), (f"{word} {right}", right)) if known)
        return pairs

    if out.weights:
        per = arrow_map(rows, lambda b: counted(b, around, "pair"), "pair string, pos long, neg long").groupBy("pair").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        clean = [r["pair"] for r in per.filter((F.col("pos") == 0) & (F.col("neg") >= MIN_CLEAN)).select("pair").collect()]
        out = Lexicon(out.weights, (*exceptions, *sorted(clean)))

    def measure(batch: pa.RecordBatch) -> dict:
        x = [out.features(t or "") for t in column(batch, "text").to_pylist()]
        return {"x": pa.array(x, pa.list_(pa.float64())), "label": column(batch, "label")}

    rows = arrow_map(rows, measure, "x array<double>, label int").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    if rows and len(n) == 2:
        out.model = logistic(np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]))
    return out


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """Score every document: doc_id, score (0 to 1), predicted (1 if at least ``threshold``), matched (sum of weights).

    Null and empty texts get the score of a text without matches. Repeated rows and
    rows without doc_id are scored like any other. A very long text is scored whole, in
    one pass of the automaton; one unbroken word is known by its beginnings. Of terms
    that begin at one place the heaviest counts, of equally heavy ones the shortest. An
    empty table gives an empty result; without labelled rows the lexicon is empty and
    all scores are low. Other columns are left out, whatever their names.
    """

    def step(batch: pa.RecordBatch) -> dict:
        x = np.array([lexicon.features(t or "") for t in column(batch, "text").to_pylist()])
        score = 1 / (1 + np.exp(-np.clip(x @ lexicon.model, -30, 30)))
        return {
            "doc_id": column(batch, "doc_id"),
            "score": pa.array(score, pa.float64()),
            "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32()),
            "matched": pa.array(np.expm1(x[:, 1]), pa.float64()),
        }

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, score double, predicted int, matched double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents and score all: doc_id, held_out, score, predicted."""
    return toxicity(docs, fit(docs, labels)).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with all their columns; the score runs beside them, no join is needed."""
    lexicon = fit(docs, labels)

    @F.pandas_udf("boolean")
    def clean(text):
        return text.map(lambda t: lexicon.score(t) < threshold).astype(bool)

    return docs.filter(clean(F.col("text")))
