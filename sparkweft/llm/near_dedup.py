"""MinHash near-dedup with SetSketch registers.

Exact copies of a shingle set are folded first (a partially aggregated group-by on a
128-bit digest). Each remaining set, a node, gets a SetSketch: registers that hold the
minimum of its elements' exponential variates on a scale of powers of ``BASE``, truncated
to 16 bits. Bands of registers are bucket keys. Round 0 compares every member of a bucket
with its most central one, which settles the groups of copies. What is left are buckets
whose members are in different components. There, two nodes are compared only if they can
still reach the similarity: with the shingles of either in order of rarity, the first one
that both hold must leave enough shingles behind it on either side (the prefix and
position bounds of exact set joins). What a whole group shares comes last in that order,
so a group of near copies doesn't meet all with all. These bounds are exact, no link of
two nodes that share a band is lost. Large buckets go in rounds with more and more
members as hubs, and members that were linked meanwhile aren't compared again.
A pair must share a band, pass the joint likelihood estimate of two sketches (with a
margin of five standard errors), then the exact test on full shingle sets. Components
come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import counted
from .common import arrow_map, column, cut, parts, texts

WORDS = 5
SIMILARITY = 75  # per cent
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: SetSketch: base and rate of the registers' scale, largest value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Estimates below SIMILARITY by more than this are not verified: above 5 standard errors of M registers.
MARGIN = 0.20
#: A pair list up to this long is broadcast (about 60 bytes a row); a longer one is shuffled.
BROADCAST_ROWS = 500_000
#: A pair list that is joined with sketches is broadcast up to this length (about 400 bytes a row).
BROADCAST_SKETCHES = 100_000
HUB_SHARE, ROWS_PER_PART = 256, 100_000
#: Ratio of the borders of size classes.
CLASS = 1.1

_rng = np.random.default_rng(8)
_A = (_rng.integers(0, 1 << 31, M, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; fewer words are one shingle, none are none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        k = min(n, len(h))
        s = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        return np.unique(_finish(s + np.uint64(k)))


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: floor(1 - log_BASE(x)) of each register's smallest exponential variate x."""
    low, x = np.full(M, 0xFFFFFFFF, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 512):
            np.minimum(low, (x[i : i + 512, None] * _A + _B).min(axis=0), out=low)
    variate = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, TOP).astype(np.uint16)


def node_of(digest: bytes) -> int:
    """A node's key: 64 bits of its set's digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, sketch) of every row; no node and sketch for the empty set."""

    def step(batch: pa.RecordBatch) -> dict:
        n, node, sketch = [], [], []
        for text in texts(batch):
            s = shingle_set(text)
            n.append(len(s))
            node.append(node_of(xxhash.xxh3_128_digest(s.tobytes())) if len(s) else None)
            sketch.append(registers(s).tobytes() if len(s) else None)
        return {"doc_id": column(batch, "doc_id"), "n_shingles": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "sketch": pa.array(sketch, pa.binary())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, n_shingles long, node long, sketch binary")


def banded(nodes: DataFrame) -> DataFrame:
    """(band, node): BANDS rows for each node."""

    def step(batch: pa.RecordBatch) -> dict:
        keys = [
            xxhash.xxh3_64_intdigest(sketch[2 * ROWS * j : 2 * ROWS * (j + 1)], j) - (1 << 63)
            for sketch in column(batch, "sketch").to_pylist()
            for j in range(BANDS)
        ]
        return {"band": pa.array(keys, pa.int64()), "node": pa.array(np.repeat(column(batch, "node").to_numpy(), BANDS), pa.int64())}

    return arrow_map(nodes.select("node", "sketch"), step, "band long, node long")


def joint_estimate(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard index of pairs from register order counts and the known set sizes."""
    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    u = (n_x / (n_x + n_y))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda t: -np.log1p(-np.clip(t, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    above, below = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    like = more * np.log(above) + less * np.log(below) + (M - more - less) * np.log(np.clip(1 - above - below, 1e-12, 1))
    return j[np.arange(len(j)), like.argmax(1)]


def few(df: DataFrame, n: int) -> DataFrame:
    """A table of about ``n`` rows in as many partitions as they fill, so that a small one makes no host of tiny files."""
    return df.coalesce(1 + n // ROWS_PER_PART)


def sent(df: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """The table, broadcast if its number of rows was counted and small; else Spark shuffles it."""
    return F.broadcast(df) if n <= (BROADCAST_ROWS if most is None else most) else df


def estimated(pairs: DataFrame, n: int, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, doc_a, doc_b) of the ``n`` pairs (a, b) that share a band and whose sketches' joint estimate is at least ``least``."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("doc").alias(f"doc_{k}"), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

    def step(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(column(batch, k).to_pylist()), np.uint16).reshape(-1, M) for k in ("s_a", "s_b"))
        n_x, n_y = (column(batch, k).to_numpy().astype(float) for k in ("n_a", "n_b"))
        good = (x == y).reshape(-1, BANDS, ROWS).all(2).any(1)
        good[good] = joint_estimate(x[good], y[good], n_x[good], n_y[good]) >= least
        return {k: column(batch, k).filter(pa.array(good)) for k in ("a", "b", "doc_a", "doc_b")}

    half = side("a").join(sent(pairs, n, BROADCAST_SKETCHES), "a")
    return arrow_map(side("b").join(sent(half, n, BROADCAST_SKETCHES), "b").select("a", "b", "doc_a", "doc_b", "n_a", "n_b", "s_a", "s_b"), step, "a long, b long, doc_a long, doc_b long")


def with_text(docs: DataFrame, keyed: DataFrame, n: int) -> DataFrame:
    """The texts of the ``n`` rows of ``keyed`` (columns ``node``, ``doc`` and others), from the documents that stand for the nodes.

    A document id can have several rows with different texts: readers hash the text
    again and leave out what is not the node's.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(sent(keyed, n), "doc").drop("doc")


def overlaps(pairs: DataFrame, n: int, docs: DataFrame) -> DataFrame:
    """(a, b, common, n_a, n_b): sizes of the ``n`` pairs' full shingle sets and of what they share.

    A hub's members are split into shares of about HUB_SHARE; the hub's text goes to
    each share once. A share is read as a stream, the hub first.
    """
    hubs = pairs.groupBy("a").agg(F.min("doc_a").alias("doc"), F.ceil(F.count(F.lit(1)) / HUB_SHARE).alias("shares"))
    members = pairs.join(sent(hubs.select("a", "shares"), n), "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), F.col("b").alias("node"), F.col("doc_b").alias("doc"), F.lit(1).alias("side"))
    every = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("a").alias("node"), "doc", F.lit(0).alias("side"))
    sides, m = counted(few(members.unionByName(every), 2 * n))
    rows = with_text(docs, sides, m).repartition(parts(docs), "a", "share").sortWithinPartitions("a", "share", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            out = []
            keys = zip(*(column(batch, k).to_pylist() for k in ("a", "share", "side", "node")), strict=True)
            for (a, share, side, node), text in zip(keys, texts(batch), strict=True):
                if (a, share) != at:
                    at, hub = (a, share), None
                s = shingle_set(text)
                if not len(s) or node_of(xxhash.xxh3_128_digest(s.tobytes())) != node:
                    continue
                if side == 0:
                    hub = s
                elif hub is not None:
                    out.append((a, node, len(np.intersect1d(hub, s, assume_unique=True)), len(hub), len(s)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "common", "n_a", "n_b"])

    return rows.mapInArrow(run, "a long, b long, common long, n_a long, n_b long")


def verified(pairs: DataFrame, n: int, nodes: DataFrame, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Of ``n`` distinct pairs (a, b) of nodes, those that share a band, are estimated near enough and whose full shingle sets reach the similarity."""
    likely, m = counted(estimated(pairs, n, nodes, similarity / 100 - MARGIN))
    linked = F.col("common") * (100 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity
    return overlaps(few(likely, m), m, docs).filter((F.col("common") > 0) & linked).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of a link (a, b); repeated links are one."""
    edges, n = counted(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        edges = few(edges, n)
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.join(sent(low, 2 * n), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(sent(low, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now, seen = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), Observation()
        now = now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("sum"))
        edges = cut(few(now, n) if n <= BROADCAST_ROWS else now)
        last, mark = mark, (seen.get["n"], seen.get["sum"])
        if mark == last:
            break
        n = max(n, mark[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def merged(labels: DataFrame, found: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """The labels after ``n`` more links (a, b), and what changed: (label, to) with its number of rows.

    Only the links between labels are searched for components.
    """
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    known = labels.join(sent(ends, 2 * n), "node", "left_semi")
    named = cut(few(ends.join(sent(known, 2 * n), "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("fresh")), 2 * n))
    side = lambda k: sent(named.select(F.col("node").alias(k), F.col("label").alias(f"l_{k}")), 2 * n)
    both = found.join(side("a"), "a").join(side("b"), "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b"))
    step = components(both).select(F.col("node").alias("label"), F.col("label").alias("to"))
    fresh = named.filter("fresh").select("node", "label")
    moved = labels.unionByName(fresh).join(sent(step, 2 * n), "label", "left")
    return cut(moved.select("node", F.coalesce("to", "label").alias("label"))), step, 2 * n


def by_rarity(docs: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """(node, n, label, lone, order) of ``n`` nodes (node, doc, n, label): their shingles, those of the fewest nodes first.

    ``order`` holds the hashes that stand in other nodes too, ``lone`` counts the
    others, which come before them. Ties go by hash, so all nodes have one order.
    """

    def step(batch: pa.RecordBatch) -> dict:
        node, sets = [], []
        for i, text in zip(column(batch, "node").to_pylist(), texts(batch), strict=True):
            s = shingle_set(text)
            if len(s) and node_of(xxhash.xxh3_128_digest(s.tobytes())) == i:
                node.append(i)
                sets.append(s.view(np.int64))
        return {"node": pa.array(node, pa.int64()), "hs": pa.array(sets, pa.list_(pa.int64()))}

    sets = cut(arrow_map(with_text(docs, some.select("node", "doc"), n), step, "node long, hs array<long>"))
    common = sets.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    held = sets.select("node", F.explode("hs").alias("h")).join(common, "h")
    # a set: the rows of a repeated document are the same node's
    ordered = held.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("held", "h"))).alias("order"))
    return ordered.join(sent(some, n), "node").select("node", "n", "label", (F.col("n") - F.size("order")).alias("lone"), F.col("order.h").alias("order"))


def prefixes(ranked: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(h, class, probe, node, label, n, rest): where two nodes that reach the similarity can first meet.

    ``rest`` is the number of shingles from ``h`` on, itself included. Of a pair, the
    larger node probes and the smaller one waits in the class of its size (powers of
    CLASS); both must have rest >= (n + n') * similarity / (100 + similarity), which
    for the class's smallest possible partner decides how far the node's rows go.
    """
    n, rest, t = F.col("n"), F.col("rest"), similarity
    class_of = lambda size: F.floor(F.log(size.cast("double")) / F.lit(math.log(CLASS)) + F.lit(1e-9)).cast("int")
    reach = lambda partner: rest * (100 + t) >= (n + partner) * t
    least = F.ceil(n * t / 100 - F.lit(1e-9))
    rows = ranked.select("node", "n", "label", "lone", F.posexplode("order").alias("at", "h")).withColumn("rest", n - F.col("lone") - F.col("at")).filter(reach(least))
    floor_of = lambda k: F.floor(F.pow(F.lit(CLASS), k.cast("double")))
    probes = F.transform(F.filter(F.sequence(class_of(least), class_of(n)), lambda k: reach(F.greatest(least, floor_of(k)))), lambda k: F.struct(k.alias("class"), F.lit(True).alias("probe")))
    waits = F.when(reach(n), F.array(F.struct(class_of(n).alias("class"), F.lit(False).alias("probe")))).otherwise(F.array())
    return rows.withColumn("x", F.explode(F.concat(probes, waits))).select("h", "x.class", "x.probe", "node", "label", "n", "rest")


def open_rows(rows: DataFrame) -> DataFrame:
    """The rows of the (h, class) where nodes of different components can meet, with the ``size`` of these."""
    both = rows.groupBy("h", "class").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("waits")
    )
    some = both.filter("lo < hi AND probes > 0 AND waits > 0").select("h", "class", F.greatest("probes", "waits").alias("size"))
    return rows.join(some, ["h", "class"])


def near_links(docs: DataFrame, nodes: DataFrame, similarity: int = SIMILARITY) -> DataFrame | None:
    """(node, label) of the nodes that are linked with another, None without any candidate."""
    rows = banded(nodes)
    buckets = rows.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).filter("first < last")
    members = cut(rows.join(buckets.select("band", "size"), "band"))
    if members.isEmpty():
        return None
    # round 0: a bucket's hub is the member whose buckets hold most
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    hubs = members.join(score, "node").groupBy("band").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("hub"))
    pairs, n = counted(members.join(hubs, "band").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    labels, linked = counted(components(verified(few(pairs, n), n, nodes, docs, similarity)))

    members = members.join(sent(labels, linked), "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    open_ = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band")
    some = members.join(open_, "band", "left_semi").select("node", "label").distinct()
    some, n = counted(some.join(nodes.select("node", "n", "doc"), "node"))
    if not n:
        return labels
    rows = open_rows(prefixes(by_rarity(docs, some, n), similarity)).withColumn("was", F.lit(False))
    k = 0
    while True:
        seen = Observation()
        rows = cut(rows.observe(seen, F.max("size").alias("size"), F.count(F.lit(1)).alias("n")))
        size, n = seen.get["size"], seen.get["n"]
        if not n:
            break
        k += 1
        rows = few(rows, n)
        # nodes are ranked by the trailing octal zeros of a hash: each round takes about 64 times as many as hubs
        zeros = F.length(F.regexp_extract(F.conv(F.abs(F.xxhash64("node")).cast("string"), 10, 8), "0*$", 0))
        least = F.greatest(F.lit(0), 2 * (F.floor(F.log2(F.col("size").cast("double")) / 6 - 1e-9) + 1 - k))
        ranked = rows.withColumn("hub", zeros >= least)
        side = lambda r, i: r.select("h", "class", *(F.col(c).alias(f"{c}{i}") for c in ("node", "label", "n", "rest", "was")))
        first, second = ranked.filter("probe"), ranked.filter("NOT probe")
        meet = (
            (F.col("label1") != F.col("label2"))
            & ((F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") > F.col("node2"))))
            & (F.least("rest1", "rest2") * (100 + similarity) >= (F.col("n1") + F.col("n2")) * similarity)
            & ~(F.col("was1") | F.col("was2"))  # they met in an earlier round
        )
        both = side(first.filter("hub"), 1).join(sent(side(second, 2), n), ["h", "class"]).filter(meet)
        last = 64**k >= size  # every member of every bucket is a hub
        if not last:
            both = both.unionByName(side(first.filter("NOT hub"), 1).join(sent(side(second.filter("hub"), 2), n), ["h", "class"]).filter(meet))
        pairs, m = counted(both.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct())
        if m:
            found, m = counted(verified(few(pairs, m), m, nodes, docs, similarity))
            if m:
                labels, step, m = merged(labels, few(found, m), m)
                ranked = ranked.join(sent(step, m), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        if last:
            break
        rows = open_rows(ranked.withColumn("was", F.col("was") | F.col("hub")).drop("size", "hub"))
    return labels


def near_dedup(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct five-word shingles (words lower-cased)
    reach the Jaccard ``similarity`` in per cent; component_id is the smallest doc_id
    reachable. Null, empty and blank texts have an empty set and are linked with
    nothing, not even with each other; fewer than five words are one shingle. Rows
    without doc_id are linked with nothing and kept (component_id null). Rows that
    repeat a doc_id go by their own text, repeated rows get equal results. A very long
    text is one set, held by the task that reads it. An empty table gives an empty
    result. Other columns are left out, whatever their names.
    """
    rows = cut(sketches(docs))
    some = rows.filter("doc_id IS NOT NULL AND node IS NOT NULL")
    nodes = cut(some.groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")))
    labels = near_links(docs, nodes, similarity)
    if labels is None:
        named = nodes.select("node", F.col("doc").alias("component_id"))
    else:
        of = nodes.select("node", "doc").join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
        named = of.join(of.groupBy("label").agg(F.min("doc").alias("component_id")), "label").select("node", "component_id")
    linked = some.join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("doc_id IS NULL OR node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns. A repeated doc_id stays if any of its rows is kept."""
    gone = near_dedup(docs, similarity).groupBy(F.col("doc_id").alias("__gone")).agg(F.bool_or("kept").alias("__kept")).filter(~F.col("__kept"))
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
