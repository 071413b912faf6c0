"""Phrase collocations by Toivonen's method.

A sample of the documents proposes words and word pairs; what is counted exactly in a
pass over all documents is the proposals and their negative border, the phrases that
weren't proposed although all their parts were: all words, the pairs of proposed words,
the triples of proposed pairs. If border phrases turn out frequent, they are added and
an expansion pass counts the border of what is new: the pairs of all frequent words, and
the triples of pairs that are frequent or that this pass is the first to count. Phrases
end at three words, so then it is closed: every frequent phrase has been counted,
whatever the sample held.

What a pass counts is told by two bitmaps of hashes, of words and of pairs, of bounded
size. A hash that is set by chance has more phrases counted, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small
from .common import column, cut, in_order, slices, texts

#: Words of a phrase at most; its occurrences at least; share of a longer phrase that absorbs it (percent); phrases per language.
LONGEST, SUPPORT, ABSORBED, TOP = 3, 10, 50, 2000
#: Share of the documents that proposes, and the occurrences there that make a proposal (a phrase at the support has one there on average).
SAMPLE, PROPOSED = 0.1, 2
#: Words (with ends of pieces) that a task holds at once, bytes of a text that it splits at once, rows that it hands on at once.
BLOCK, CHUNK, HANDED = 1 << 20, 1 << 20, 100_000
#: Bits of a bitmap: so many for each entry, within these bounds (32 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Parts of a word's rows in joins on single words.
SALTS = 32

END = b"."
#: Ends of pieces become END, tabs spaces.
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", END * 10 + b" ")
NO_LANG = "und"


@dataclass
class Filter:
    """Bitmaps of words and of pairs; a phrase passes if all its parts do."""

    words: Broadcast
    pairs: Broadcast


def _bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7)) & 1 == 1


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a << np.uint64(21)) | (a >> np.uint64(43))) ^ b


class Block:
    """Words of texts as numbers from 1, each language's apart; 0 stands between pieces."""

    def __init__(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}
        self.words, self.langs, self.parts, self.held, self.seen = [END], [""], [], 0, 0

    def add(self, lang: str, words: list[bytes]) -> None:
        numbers = self.known.get(lang)
        if numbers is None:
            numbers = self.known[lang] = {END: 0}
        for w in set(words).difference(numbers):
            numbers[w] = len(self.words)
            self.words.append(w)
            self.langs.append(lang)
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.held += len(words)

    def after(self) -> Block:
        """An empty block that begins with the last two words, which were counted."""
        new = Block()
        tail = np.concatenate(self.parts)[-(LONGEST - 1) :]
        for i in tail:
            new.add(self.langs[i] if i else "", [self.words[i]])
        new.seen = len(tail)
        return new


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, END between pieces, some of them at a time; a cut is at a space and changes nothing."""
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= CHUNK else text.find(b" ", start + CHUNK)
        end = len(text) if end < 0 else end
        yield text[start:end].replace(END, b" . ").split()
        start = end


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The texts of (lang, text) in blocks of BLOCK words, ends of pieces included; a text that is longer goes on in the next one."""
    block = Block()
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(column(part, "lang").to_pylist(), texts(part), strict=True):
                lang = NO_LANG if lang is None else lang
                for words in _pieces(text.lower().translate(_SPLIT)):
                    block.add(lang, words)
                    if block.held >= BLOCK:
                        yield block
                        block = block.after()
                block.add(lang, [END])
    if block.held > block.seen:
        yield block


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and which of them stands where."""
    own, inverse = np.unique(keys, return_inverse=True)
    return own, inverse.astype(np.int32)


def _phrases(block: Block, now: Filter | None, before: list[Filter], longest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(numbers of the words..., count) of the block's phrases that pass ``now`` and none of ``before``; words only where there is no before."""
    ids, size = np.concatenate(block.parts), len(block.words)
    hashes = np.zeros(size, np.uint64)
    roots = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in block.known}
    hashes[1:] = [xxhash.xxh64_intdigest(w, roots[lang]) for w, lang in zip(block.words[1:], block.langs[1:], strict=True)]
    if not before:
        n = np.bincount(ids[block.seen :], minlength=size)
        n[0] = 0
        own = np.flatnonzero(n)
        yield own, n[own]

    def both(f: Filter) -> np.ndarray:
        ok = _bits(f.words.value, hashes)
        return ok[ids[:-1]] & ok[ids[1:]]

    two = (ids[:-1] > 0) & (ids[1:] > 0)
    last = np.arange(1, len(ids))
    keys, inverse = _distinct(ids[:-1].astype(np.int64) * size + ids[1:])
    pair = _pair_hash(hashes[keys // size], hashes[keys % size])
    # pairs and triples that the filters so far count. From the second filter on, triples may also hold pairs that this filter is the first to count
    done2, done3 = np.zeros(len(two), bool), np.zeros(max(0, len(two) - 1), bool)
    for i, f in enumerate([*before, now]):
        now2 = np.ones(len(two), bool) if f is None else both(f)
        open2 = np.ones(len(two), bool) if f is None else _bits(f.pairs.value, pair)[inverse]
        if i:
            open2 |= now2 & ~done2
        now3 = open2[:-1] & open2[1:]
        if i == len(before):
            now2, now3 = now2 & ~done2, now3 & ~done3
        else:
            done2, done3 = done2 | now2, done3 | now3
    # a phrase counts where its last word is new in this block
    at = np.flatnonzero(two & (last >= block.seen) & now2)
    n = np.bincount(inverse[at], minlength=len(keys))
    own = np.flatnonzero(n)
    yield keys[own] // size, keys[own] % size, n[own]
    if longest < LONGEST:
        return
    at = np.flatnonzero(two[:-1] & two[1:] & (last[1:] >= block.seen) & now3)
    keys3, n = np.unique(inverse[at].astype(np.int64) * size + ids[at + 2], return_counts=True)
    first = keys[keys3 // size]
    yield first // size, first % size, keys3 % size, n


def counted_phrases(docs: DataFrame, now: Filter | None = None, before: list[Filter] | None = None, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f): exact counts of the phrases that the filter ``now`` (all, if None) is the first to count, after those ``before``; words in the first pass only."""
    before = before or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = pa.array(block.words, pa.binary()).cast(pa.string())
            heads = pc.binary_join_element_wise(pa.array(block.langs, pa.string()), words, "\t")
            for *numbers, n in _phrases(block, now, before, longest):
                for i in range(0, len(n), HANDED):
                    own = [x[i : i + HANDED] for x in numbers]
                    key = pc.binary_join_element_wise(heads.take(pa.array(own[0])), *(words.take(pa.array(x)) for x in own[1:]), " ")
                    yield pa.RecordBatch.from_arrays([key, pa.array(n[i : i + HANDED], pa.int64())], ["key", "c"])

    every = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "key string, c long")
    phrase = F.substring_index("key", "\t", -1)  # no word holds a tab
    return every.groupBy("key").agg(F.sum("c").alias("f")).select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")


def _with_words(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))


def _hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def _rotated(h: Column) -> Column:
    return F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43))


def bitmap(hashes: DataFrame) -> Broadcast:
    """A bitmap of the column ``h``, made in the cluster; its pieces, of a bounded number, go to all executors."""
    bits = LEAST_BITS
    n = hashes.count()
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    pieces = hashes.select(F.shiftright(at, 15).cast("int").alias("piece"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for piece, b in pieces.collect():
        out[piece << 12 : (piece + 1) << 12] = np.frombuffer(b, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def filter_of(phrases: DataFrame) -> Filter:
    """The filter of the phrases (lang, w, k) that are words and of those that are pairs."""
    one = phrases.filter("k = 1").select(_hash(F.col("lang"), F.get("w", 0)).alias("h"))
    two = phrases.filter("k = 2").select(_rotated(_hash(F.col("lang"), F.get("w", 0))).bitwiseXOR(_hash(F.col("lang"), F.get("w", 1))).alias("h"))
    return Filter(bitmap(one), bitmap(two))


def missed(phrases: DataFrame, f: Filter) -> DataFrame:
    """The words and pairs that a filter doesn't hold: the frequent part of its border."""
    words, pairs = f.words, f.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = column(batch, "h").to_numpy(zero_copy_only=False).view(np.uint64)
            one = column(batch, "k").to_numpy(zero_copy_only=False) == 1
            yield batch.filter(pa.array(~np.where(one, _bits(words.value, h), _bits(pairs.value, h))))

    a, b = _hash(F.col("lang"), F.get("w", 0)), _hash(F.col("lang"), F.get("w", 1))
    return phrases.filter("k < 3").select("k", F.when(F.col("k") == 1, a).otherwise(_rotated(a).bitwiseXOR(b)).alias("h")).mapInArrow(run, "k int, h long")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, w, k, f) of all phrases of up to LONGEST words with ``support`` occurrences or more, and (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    chosen = F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 20)) < int(SAMPLE * (1 << 20))
    sample = _with_words(cut(counted_phrases(docs.filter(chosen), longest=2).filter(F.col("f") >= min(PROPOSED, support))))
    now = filter_of(sample)
    counts = cut(counted_phrases(docs, now).filter((F.col("f") >= support) | ~F.contains("phrase", F.lit(" "))))
    total = counts.filter(~F.contains("phrase", F.lit(" "))).groupBy("lang").agg(F.sum("f").alias("n"))
    found = _with_words(counts.filter(F.col("f") >= support))
    if not missed(found, now).isEmpty():  # a part of the border is frequent: count the border of all that is
        more = counted_phrases(docs, filter_of(found), [now]).filter(F.col("f") >= support)
        # now closed: what this pass found frequent are pairs, whose triples it counted with them, and triples, the longest
        found = found.unionByName(_with_words(cut(more)))
    return found, total


def _cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) by exact decimals: the products pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom = F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right)
    return F.call_function("div", top, bottom).cast("long")


def _word_counts(rows: DataFrame, words: DataFrame, word: Column, name: str) -> DataFrame:
    """Adds the count of a word of each phrase; a frequent word's rows are dealt to SALTS parts."""
    side = words.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("lang", F.col("phrase").alias("__word"), "__salt", F.col("f").alias(name))
    return rows.withColumn("__word", word).withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(side, ["lang", "__word", "__salt"]).drop("__word", "__salt")


def scored_phrases(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of two and three words that no longer candidate absorbs.

    Of a triple's two cuts that of the lower score counts, the first one on ties.
    """
    words = frequent.filter("k = 1").select("lang", "phrase", "f")
    pairs = frequent.filter("k = 2").select("lang", "phrase", "w", F.col("f").alias("a"))
    pairs = _word_counts(_word_counts(pairs, words, F.get("w", 0), "l"), words, F.get("w", 1), "r")
    pairs = cut(pairs.select("lang", "phrase", "a", "l", "r", _cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    joined = lambda *at: F.concat_ws(" ", *(F.get("w", i) for i in at))
    triples = frequent.filter("k = 3").select("lang", "phrase", F.col("f").alias("a"), joined(0, 1).alias("__front"), joined(1, 2).alias("__back"))
    front = pairs.select("lang", F.col("phrase").alias("__front"), F.col("l").alias("f1"), F.col("a").alias("f12"))
    back = pairs.select("lang", F.col("phrase").alias("__back"), F.col("r").alias("f3"), F.col("a").alias("f23"))
    triples = cut(triples.join(front, ["lang", "__front"]).join(back, ["lang", "__back"]))
    one, two = _cut_score(F.col("a"), F.col("f1"), F.col("f23")), _cut_score(F.col("a"), F.col("f12"), F.col("f3"))
    second = two < one
    best = triples.select(
        "lang", "phrase", "a", F.when(second, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(second, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least(one, two).alias("score")
    )
    inside = triples.select("lang", F.col("__front").alias("phrase"), "a").unionByName(triples.select("lang", F.col("__back").alias("phrase"), "a"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("__longer"))
    free = pairs.join(longer, ["lang", "phrase"], "left").filter(f"__longer IS NULL OR 100 * __longer < {ABSORBED} * a").drop("__longer")
    return free.unionByName(best)


def collocations(docs: DataFrame, top: int = TOP, support: int = SUPPORT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, then a, then phrase.

    Null texts are empty; a null language is ``und``; repeated rows count each; a very long
    text is counted block by block. Empty tables and languages without a phrase of
    ``support`` occurrences give no rows. Other columns play no part.
    """
    frequent, total = frequent_phrases(docs, support)
    ranked = in_order(scored_phrases(frequent), "lang", F.desc("score"), F.desc("a"), "phrase")
    firsts = ranked.groupBy("lang").agg(F.min("index").alias("__first")).join(total, "lang")
    rows = ranked.join(if_small(cut(firsts)), "lang").withColumn("rank", F.col("index") - F.col("__first") + 1).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in plain SQL (DuckDB), by counting every phrase.
SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(p), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
q AS MATERIALIZED (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS front, array_to_string(w[i+1:], ' ') AS back, k FROM c, (VALUES (1), (2)) AS t(i) WHERE i < k),
s AS (SELECT q.lang, q.phrase, q.k, q.a, q.i, x.f AS l, y.f AS r, (1000000 * CAST(q.a AS HUGEINT) * q.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM q JOIN f x ON x.lang = q.lang AND x.phrase = q.front JOIN f y ON y.lang = q.lang AND y.phrase = q.back),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN o ON b.k = 2 AND o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(n.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE r.rank <= 2000
"""
