"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with a fractional number of copies, its source's target over
its source's size. Within a bucket of a few thousand documents of one source, pairs
of fractional documents exchange mass (in words) at random until one of the two is
integral; a bucket ends with at most one fractional document. Those residuals meet
in the next level's buckets, and so on: a reduction tree whose fan-in is the bucket
size, so that the words of a source are kept up to one document's size and no task
sees more than a bucket. All random numbers come from hashes of whole rows, and rows
that are equal in all columns are numbered, so that they part too and reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_CLASS, cut, parts

#: Documents of a bucket, the fan-in of the reduction tree.
FAN_IN = 4096
#: A table of up to so many sources is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``rank``: position by code point, null last. Ranges are sorted apart and only their counts meet."""
    ordered = sizes.repartitionByRange(parts(sizes), F.col("source").isNull(), F.col("source")).withColumn("__part", F.spark_partition_id())
    ordered = cut(ordered)
    counts = {r["__part"]: r["n"] for r in ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(start)]
        start += counts[part]
    if not offsets:
        return ordered.drop("__part").withColumn("rank", F.lit(0).cast("long"))
    within = Window.partitionBy("__part").orderBy(F.col("source").isNull(), F.col("source"))
    return ordered.withColumn("rank", (F.row_number().over(within) - 1 + F.create_map(*offsets)[F.col("__part")]).cast("long")).drop("__part")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources by code point (null last). The sources share
    ``share`` times all sizes by weight; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight, until none is above.
    Each round aggregates the table of sources to two numbers.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked_sources(sizes).withColumn("weight", pick).drop("rank"))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    limit, level, capped = F.col("source_size") * F.lit(most), -1.0, -1
    while True:
        # at this level a source is capped; the rest share what is left
        full = F.lit(False) if level < 0 else F.col("weight") * F.lit(level) >= limit
        row = table.agg(
            F.sum(F.when(full, limit).otherwise(F.lit(0.0))).alias("used"),
            F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            if not row["weight"]:
                level = math.inf
            break
        capped, level = row["n"], max(level, (total - (row["used"] or 0.0)) / row["weight"])
    target = limit if math.isinf(level) else F.least(limit, F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def draws(ids: np.ndarray, level: int, seed: int) -> np.ndarray:
    """Uniform numbers from ids (splitmix64), so that reruns and retries agree."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1) + seed) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(size: np.ndarray, rate: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of pivotal rounding: (copies, rate left); at most one rate is left, the others are NaN.

    Two fractional documents of sizes v, w and rates p, q keep v*p + w*q: either p
    reaches an integer or q does, with the chances that keep both expectations.
    """
    copies, left = np.floor(rate).astype(np.int64), np.full(len(rate), np.nan)
    part = rate - copies
    copies[part > 1 - EPS] += 1
    a, p = -1, 0.0
    for b in np.flatnonzero((part > EPS) & (part < 1 - EPS) & (size > 0)):
        q = float(part[b])
        if a < 0:
            a, p = b, q
            continue
        v, w = float(size[a]), float(size[b])
        up, down = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)  # words that can move to a, to b
        moved = up if draw[b] * (up + down) < down else -down
        p, q = p + moved / v, q - moved / w
        whole_a, whole_b = not EPS < p < 1 - EPS, not EPS < q < 1 - EPS
        if whole_b:
            copies[b] += q > 0.5
        if whole_a:
            copies[a] += p > 0.5
            a, p = (-1, 0.0) if whole_b else (b, q)
        elif not whole_b:  # rounding noise: the pair stays one document
            copies[b] += q > 0.5
    if a >= 0:
        left[a] = p
    return copies, left


def reduce_level(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """One level of the tree: ``copies`` grows by what is settled, ``rate`` is null where nothing is left."""

    def run(pdf):
        # large documents first, so that the mass left over is that of a small one
        pdf = pdf.sort_values(["size", "__uid", "doc_id"], ascending=[False, True, True], kind="stable")
        draw = draws(pdf["__uid"].to_numpy(dtype=np.int64), level, seed)
        copies, left = pivot(pdf["size"].to_numpy(dtype=np.int64), pdf["rate"].to_numpy(dtype=np.float64), draw)
        if last:  # nobody is left to pair with: one draw settles it
            k = np.flatnonzero(~np.isnan(left))
            copies[k] += draws(pdf["__uid"].to_numpy(dtype=np.int64)[k], level + 1, seed) < left[k]
            left[k] = np.nan
        return pdf.assign(copies=pdf["copies"].to_numpy() + copies, rate=left)

    n = F.ceil(F.col("__n") / float(FAN_IN) ** (level + 1))
    keyed = rows.withColumn("__bucket", F.pmod(F.col("__uid"), n))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema])
    return keyed.groupBy("source", "__bucket").applyInPandas(run, schema).drop("__bucket")


def row_hash(docs: DataFrame) -> Column:
    """A hash of a document's whole row, the same in every rerun."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])


def counted_out(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row ``n`` times, numbered 1, 2, ... as ``name``; the numbers go out in blocks, so a large n is no large array."""
    block = 4096
    blocks = df.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))))
    within = F.sequence(F.col("__k") * block + 1, F.least(n, (F.col("__k") + 1) * block))
    return blocks.withColumn(name, F.explode(within)).drop("__k")


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """:func:`mix` with the hash of the row that each document is (column ``row``)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(docs).alias("row"))
    sized = cut(rows.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("same")))
    words = F.sum(F.col("size") * F.col("same"))
    sources = sized.groupBy("source").agg(words.alias("source_size"), F.sum("same").alias("__n"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, most)
    named = targets.withColumnRenamed("source", "__source")
    counted = sources.join(named.drop("source_size"), F.col("source").eqNullSafe(F.col("__source"))).withColumnRenamed("source", "__of").drop("__source")
    largest, n_sources = sources.agg(F.max("__n"), F.count(F.lit(1))).first()
    if n_sources <= BROADCAST_SOURCES:  # else Spark joins them by shuffling, and splits a hot source
        counted = F.broadcast(counted)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        counted_out(sized, F.col("same"), "__k_of_same").join(counted, F.col("source").eqNullSafe(F.col("__of")))
        .drop("__of", "same")
        .withColumn("rate", F.least(rate, F.lit(float(most))))
        .withColumn("copies", F.lit(0).cast("long"))
        .withColumn("__uid", F.xxhash64("row", "__k_of_same", F.lit(seed)))
        .drop("__k_of_same")
    )
    levels = max(1, math.ceil(math.log(max(largest or 0, 2), FAN_IN)))
    settled = None
    for level in range(levels):
        done = cut(reduce_level(rows, level, seed, level == levels - 1))
        rows = done.filter(F.col("rate").isNotNull() & ~F.isnan("rate"))
        own = done.filter(F.col("rate").isNull() | F.isnan("rate"))
        settled = own if settled is None else settled.unionByName(own)
    return settled.select("doc_id", "source", "size", "source_size", "target", "copies", "row")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies.

    ``size`` is the number of words; ``target`` is the words that the document's
    source shall give. Null text and text without words have size 0 and 0 copies
    unless their source's rate is 1 or more. A null source is a source, the last in
    order. Rows that repeat a doc_id, and rows that are equal in all columns, are
    documents of their own. A very long text counts by its words like any other: a
    source is met up to about one document. An empty table gives an empty result.
    Other columns are left out, whatever their names (they tell rows apart; columns of
    maps don't).
    """
    return mixed_rows(docs, weights, share, most, seed).drop("row")


def mix_digest(docs: DataFrame, **kw) -> DataFrame:
    """:func:`mix` with the words taken."""
    return mix(docs, **kw).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each row as often as it is taken, with ``copy`` 1, 2, ...

    Goes by rows: those that repeat a doc_id with another text are taken apart, and of
    equal rows the sum of what they are taken is written. An input column named
    ``copy`` is replaced.
    """
    taken = cut(mixed_rows(docs, **kw).groupBy(F.col("row").alias("__row")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__same")).filter("__copies > 0"))
    keyed = docs.withColumn("__key", row_hash(docs))
    joined = keyed.join(taken.filter("__same = 1"), F.col("__key") == F.col("__row"))
    if not (equal := taken.filter("__same > 1")).isEmpty():  # one of the equal rows stands for all
        one = keyed.join(equal.select("__row"), F.col("__key") == F.col("__row"), "left_semi").dropDuplicates(["__key"])
        joined = joined.unionByName(one.join(equal, F.col("__key") == F.col("__row")))
    every = counted_out(joined, F.col("__copies"), "__copy")
    return every.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"], F.col("__copy").cast("int").alias("copy"))
