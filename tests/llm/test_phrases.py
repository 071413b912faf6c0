"""Phrase mining against a plain count of every phrase."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkweft.llm import phrases

SCHEMA = "lang string, text string, phrase string, f int, k int"


def brute(rows, top=2000, support=10):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = {}
    known = {p: a for p, a in counts.items() if len(p) > 2 and a >= support}
    for (lang, *w), a in known.items():
        cuts = [(1_000_000 * a * a // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if len(w) == 2 and any(100 * b >= 50 * a for q, b in known.items() if len(q) == 4 and q[0] == lang and w in ([q[1], q[2]], [q[2], q[3]])):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, *w[:k]], counts[lang, *w[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, c in out.items() for i, (s, a, p, left, right) in enumerate(sorted(c)[:top])}


def make(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "à", "état", "ß", "a", "b"] + [f"w{i}" for i in range(25)]
    for i in range(n):
        text = ""
        for _ in range(40):
            text += rng.choice(["New York City", "the of", "a a a", "b a", rng.choice(words[: 1 + int(rng.paretovariate(0.5)) % len(words)]), rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"])
        yield (rng.choice(["en", "en", "en", "de", None, "und"]), text)


def collect(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "BLOCK", 700)  # texts go on over many blocks
    monkeypatch.setattr(phrases, "CHUNK", 50)
    rows = [*make(seed), ("en", None), (None, ""), ("fr", "only one"), ("x", "many many many " * 2000)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    got = phrases.collocations(df)
    assert collect(got) == brute(rows)
    assert collect(phrases.collocations(df, top=3)) == brute(rows, top=3)


@pytest.mark.parametrize("share", [0.0, 0.02, 1.0])
def test_the_sample_changes_nothing(spark, monkeypatch, share):
    rows = list(make(3, 80))
    monkeypatch.setattr(phrases, "SAMPLE", share)
    frequent, _ = phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"))
    counts = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = piece.split()
            counts.update((lang or "und", " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    got = [(r["lang"], r["phrase"], r["f"]) for r in frequent.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(*p, n) for p, n in counts.items() if n >= 10}


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 4_000_000_123, 5_000_000_321
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "too few words")], "lang string, text string")).collect() == []
