"""Spelling variants: exact neighbours at one edit by pairs of trie nodes.

The nodes of a trie over all words, and of one over all reversed words, are numbered.
A word is then a way through both, and what is left of it when position i is skipped is
the pair of integers (node of what stands before i, node of what stands behind it),
whatever the word's length. Two words of one length are near by a replacement if a
pair of theirs with a skipped position is the same; a word is near a longer one by an
insertion if its pair at a gap, where nothing is skipped, is the longer one's with a
skip. The words of one pair are all near each other, so that they are counted, and the
best of them found, without a row for each two of them.

Nodes are numbered in one pass over the sorted words: a word makes new nodes behind
what it shares with the word before it. Ranges of words are numbered apart; what the
first word of a range shares with the last one before it is settled between them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, in_order, slices, texts

#: Least code points and occurrences of a word; how much more frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: One in so many occurrences (by checksum) is read with a letter left out.
NOISE = 31
#: Different words that a task counts before it hands them on.
HELD = 250_000
RUN = re.compile("[a-zÀ-ÿ]+")


def noisy(run: str, start: int) -> str:
    """The run as it is counted; ``start`` is the checksum of what stands before it in the key."""
    h = zlib.crc32(run.encode(), start)
    at = h % len(run)
    return run if h % NOISE else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all whole texts, LEAST_LENGTH code points and LEAST_COUNT occurrences at least.

    Null texts have none; a null doc_id is the empty text in the key; repeated rows
    count each. A task counts what it reads before it hands it on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), texts(part), strict=True):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(RUN.findall(text.lower().decode(errors="replace"))).items():
                        if len(word) >= LEAST_LENGTH and len(word := noisy(word, start)) >= LEAST_LENGTH:
                            counts[word] += n
                    if len(counts) >= HELD:
                        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})
                        counts.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    every = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return every.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    """Code points that two words share in front."""
    return sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(a, b, strict=False)))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted words of one range, numbered from 1; 0 is the root."""
    before, way, made = "", [0], 0
    for batch in batches:
        for part in slices(batch):
            ways = []
            for word in column(part, "word").to_pylist():
                k = _shared(before, word)
                way = way[: k + 1] + list(range(made + 1, made + 1 + len(word) - k))
                made += len(word) - k
                before = word
                ways.append(way)
            yield pa.RecordBatch.from_pydict({"part": column(part, "part"), "id": column(part, "id"), "word": column(part, "word"), "way": pa.array(ways, pa.list_(pa.int64()))})


def trie_ways(words: DataFrame) -> DataFrame:
    """(id, word, way) from (id, word): the trie's nodes from the root to the word, numbered over all words.

    Of each range its first and last word and the last way go to the driver, which
    settles the nodes that ranges share: as many rows as there are ranges.
    """
    ordered = cut(in_order(words.select("id", "word"), "word").select("part", "id", "word").mapInArrow(_numbers, "part int, id long, word string, way array<long>"))
    ends = ordered.groupBy("part").agg(F.min("word").alias("first"), F.max(F.struct("word", "way")).alias("last"))
    before, path, base, fixes = "", [0], 0, []
    for part, first, last in sorted(ends.collect()):
        k = _shared(before, first)
        kept = path[: k + 1]
        fixes.append((part, k, base, kept))
        path = [kept[q] if q <= k else base + q - k for q in last["way"]]
        base += last["way"][-1] - k
        before = last["word"]
    fix = words.sparkSession.createDataFrame(fixes, "part int, k long, base long, kept array<long>")
    own = F.transform("way", lambda q: F.when(q <= F.col("k"), F.get("kept", q)).otherwise(F.col("base") + q - F.col("k")))
    return ordered.join(F.broadcast(fix), "part").select("id", "word", own.alias("way"))


#: What a row of a pair stands for: a gap, a skipped position, a skipped position whose letter differs from the one before.
GAP, SKIP, FIRST = 0, 1, 2


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, kind, id): for each word (id, word) its pairs of nodes at all gaps and with each position skipped.

    Of equal letters in a row only the first skip meets gaps: the others leave the same word.
    """
    front = trie_ways(words).withColumn("c", F.split("word", "")).select("id", "way", F.transform("c", lambda x, i: F.when((i == 0) | (x != F.get("c", i - 1)), FIRST).otherwise(SKIP)).alias("kinds"))
    back = trie_ways(words.select("id", F.reverse("word").alias("word"))).select("id", F.reverse("way").alias("rest"))
    both = cut(front.join(back, "id"))
    gaps = both.select("id", F.explode(F.arrays_zip("way", "rest")).alias("x")).select(F.col("x.way").alias("p"), F.col("x.rest").alias("s"), F.lit(GAP).alias("kind"), "id")
    skipped = F.arrays_zip(F.slice("way", F.lit(1), F.size("kinds")).alias("p"), F.slice("rest", F.lit(2), F.size("kinds")).alias("s"), F.col("kinds").alias("kind"))
    skips = both.select("id", F.explode(skipped).alias("x")).select("x.p", "x.s", "x.kind", "id")
    return gaps.unionByName(skips)


def near_counts(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words (id, word) that have near words; ids number the words by merit, so that the smallest id is the best.

    ``best`` is the near word of smallest id if that is smaller than the word's own, else
    null or some other near word of larger id.
    """
    same = Window.partitionBy("p", "s")
    skip, first = F.col("kind") != GAP, F.col("kind") == FIRST
    rows = node_pairs(words).select(
        "id", "kind", F.count(F.when(skip, 1)).over(same).alias("skips"), F.count(F.when(first, 1)).over(same).alias("firsts"), F.min(F.when(~skip, F.col("id"))).over(same).alias("gap"),
        F.min(F.when(skip, F.col("id"))).over(same).alias("top"), F.min(F.when(first, F.col("id"))).over(same).alias("top_first"),
    )
    shorter = first & F.col("gap").isNotNull()
    n = F.when(skip, F.col("skips") - 1 + shorter.cast("long")).otherwise(F.col("firsts"))
    best = F.when(skip, F.least(F.when(F.col("top") != F.col("id"), F.col("top")), F.when(shorter, F.col("gap")))).otherwise(F.col("top_first"))
    return rows.select("id", n.alias("n"), best.alias("best")).filter("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, to, form): forms followed to the last. A form has FORM_FACTOR times the word's count, so a way is as long as counts have digits; a round doubles its steps."""
    ways = cut(forms.select("id", "to", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("far"))
        new = cut(ways.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.coalesce("far", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = new.drop("moved")
        if new.filter("moved").isEmpty():
            return ways.select("id", "root")


def variant_forms(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n), each once.

    Near words differ by one inserted, deleted or replaced code point. The form is the
    near word of largest n (ties: smallest in code-point order) if its n is FORM_FACTOR
    times the word's or more, else null; the root is where the forms lead, the word itself
    without one. Words without near words have n_near 0. Rows without a word are left out;
    an empty table gives an empty result.
    """
    words = in_order(counts.filter("word IS NOT NULL").select("word", "n"), F.desc("n"), "word").select(F.col("index").alias("id"), "word", "n")
    forms = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = words.join(near_counts(words), "id", "left").join(forms, "best", "left")
    holds = F.coalesce(F.col("form_n") >= FORM_FACTOR * F.col("n"), F.lit(False))
    rows = cut(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(holds, F.col(c)).alias(c) for c in ("best", "form", "form_n"))))
    roots = _roots(rows.filter("form IS NOT NULL").select("id", F.col("best").alias("to"), "form"))
    return rows.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`variant_forms` of :func:`word_counts`: every word of the documents with its near words and its form.

    A very long run of letters is a word like others (its work grows with its length, not
    with the square of it). Columns other than doc_id and text play no part.
    """
    return variant_forms(word_counts(docs))
