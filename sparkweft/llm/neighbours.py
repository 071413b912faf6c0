"""Nearest neighbours by inner product: inverted lists scanned by adaptive numbers of dimensions.

Vectors get one more component, which makes their norms equal, so that the largest
inner product is the smallest distance. Centres fitted on a bounded sample give each
row its list; how many lists a query probes is measured: the exact neighbours of a few
queries among all rows tell how far down the order of lists they lie. Lists are kept in
blocks of vectors, rotated at random and cut into blocks of columns. A scan adds up the
distance column block by column block; as the rotated dimensions are alike, the part of
a distance that is known estimates the whole, and a candidate whose estimate is beyond
the query's k-th distance by more than chance allows is abandoned. The k-th distance
comes from the nearest lists, which are scanned first. What survives is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, slices

#: Neighbours of a query; every so many-th vec_id is a query.
NEAREST, EVERY = 20, 20
#: The fit: vectors (and numbers) of the sample at most, vectors of it for each list, rounds. There are sqrt(rows) lists, as far as the sample goes.
SAMPLE, SAMPLE_NUMBERS, SAMPLE_EACH, ROUNDS = 32_768, 1 << 22, 32, 10
#: Queries whose exact neighbours set the number of probed lists, and the share of these neighbours that the lists must hold.
MEASURED, SHARE = 64, 0.985
#: Vectors of a stored block, queries that meet a block at once, columns of a column block, deviations beyond which a candidate is abandoned.
BLOCK, QUERIES, COLUMNS, DEVIATIONS = 512, 512, 16, 2.1
SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass
class Lists:
    """What is fitted: centres of equal-norm vectors, the squared norm, the rotation; and the probes measured with it."""

    centres: np.ndarray
    norm2: float
    rotation: np.ndarray
    probes: int = 1

    def widened(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0.0, self.norm2 - (v * v).sum(1)))])

    def rotated(self, wide: np.ndarray) -> np.ndarray:
        return wide @ self.rotation[: wide.shape[1]]

    def far(self, wide: np.ndarray) -> np.ndarray:
        """Distances to the centres, but for what is the same for all of them."""
        return (self.centres * self.centres).sum(1) - 2 * wide @ self.centres.T


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    x = column(batch, name)
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double array): rows whose vector is neither null, zero nor holds null or non-finite components.

    Of rows that repeat a vec_id the smallest vector (as an array) stands for it; rows
    without a vec_id, and vectors of another length than the commonest, take no part.
    """
    v = F.col("embedding").cast("array<double>")
    fine = vectors.filter("vec_id IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = fine.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0))
    one = cut(fine.groupBy("vec_id").agg(F.min("v").alias("v")))
    common = one.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return one.filter(F.size("v") == (common["d"] if common else 0))


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    centres = sample[:k].copy()
    for _ in range(ROUNDS):
        own = ((centres * centres).sum(1) - 2 * sample @ centres.T).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(rows: DataFrame) -> Lists:
    """Centres and rotation from a sample (the first rows in order of a hash) that is bounded in vectors and in numbers."""
    n, norm2 = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    d = len(rows.first()["v"])
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // d))
    wanted = min(n, most, SAMPLE_EACH * int(np.ceil(np.sqrt(n))))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()])
    wide = -(-(d + 1) // COLUMNS) * COLUMNS
    rotation, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((wide, wide)))
    lists = Lists(np.zeros((1, d + 1)), norm2, rotation)
    lists.centres = _centres(lists.widened(sample), max(1, min(int(np.ceil(np.sqrt(n))), max(1, wanted // SAMPLE_EACH))))
    return lists


def in_lists(rows: DataFrame, lists: Broadcast) -> DataFrame:
    """(list, vec_id, v): each row's nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = lists.value.far(lists.value.widened(_matrix(part))).argmin(1)
                yield pa.RecordBatch.from_pydict({"list": pa.array(own, pa.int32()), "vec_id": column(part, "vec_id"), "v": column(part, "v")})

    return rows.mapInArrow(run, "list int, vec_id long, v array<double>")


def measured_probes(placed: DataFrame, queries: DataFrame, lists: Lists, k: int) -> int:
    """Lists to probe so that a share SHARE of the exact neighbours of MEASURED queries lies in them; all rows are scanned, a task keeps its best ones."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).collect()
    if not some:
        return 1
    ids, q = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for batch in batches:
            for part in slices(batch):
                own = column(part, "vec_id").to_numpy()
                s = np.where(ids[:, None] == own, -np.inf, q @ _matrix(part).T)
                s, at = np.hstack([best, s]), np.hstack([where, np.broadcast_to(column(part, "list").to_numpy(), s.shape)])
                top = np.argpartition(-s, k - 1, 1)[:, :k]
                best, where = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
        i, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_pydict({"q": pa.array(i, pa.int32()), "list": pa.array(where[i, j], pa.int32()), "s": best[i, j]})

    near = placed.mapInArrow(run, "q int, list int, s double").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(F.col("r") <= k).select("q", "list").collect()
    place = np.argsort(np.argsort(lists.far(lists.widened(q) * ([1] * q.shape[1] + [0])), 1), 1)
    depth = np.sort([place[i, x] for i, x in near]) if near else np.zeros(1, int)
    return int(depth[min(len(depth) - 1, int(np.ceil(SHARE * len(depth))))]) + 1


def pack(placed: DataFrame, sizes: dict[int, int], lists: Broadcast) -> DataFrame:
    """The index: (list, block, ids, vectors, columns), about BLOCK rows of a list in each; ``columns`` are the rotated vectors' column blocks."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        v = _matrix(batch)
        turned = lists.value.rotated(lists.value.widened(v)).astype(np.float32)
        cols = [np.ascontiguousarray(turned[:, c : c + COLUMNS]).tobytes() for c in range(0, turned.shape[1], COLUMNS)]
        first = lambda name, kind: pa.array([column(batch, name)[0].as_py()], kind)
        return pa.table({"list": first("list", pa.int32()), "block": first("block", pa.int32()), "ids": [column(batch, "vec_id").to_numpy().tobytes()], "vectors": [v.tobytes()], "columns": pa.array([cols], pa.list_(pa.binary()))})

    n = F.broadcast(_per_list(placed, sizes, BLOCK, "n"))
    block = F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")
    return placed.join(n, "list").select("list", block.alias("block"), "vec_id", "v").groupBy("list", "block").applyInArrow(run, "list int, block int, ids binary, vectors binary, columns array<binary>")


def _per_list(df: DataFrame, sizes: dict[int, int], each: int, name: str) -> DataFrame:
    """(list, parts): a row for each list, of which there are at most SAMPLE / SAMPLE_EACH."""
    return df.sparkSession.createDataFrame([(i, -(-n // each)) for i, n in sizes.items()], f"list int, {name} int")


def probed(queries: DataFrame, lists: Broadcast, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, q, list, home): the lists that each query probes; at home are the nearest ones that hold 2k + 1 rows."""
    n_of = np.array([sizes.get(i, 0) for i in range(len(lists.value.centres))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                q = _matrix(part)
                order = np.argsort(lists.value.far(np.column_stack([q, np.zeros(len(q))])), 1, kind="stable")
                held = np.cumsum(n_of[order], 1)
                home = np.column_stack([np.ones(len(q), bool), held[:, :-1] < 2 * k + 1])
                row, at = np.nonzero(home | (np.arange(order.shape[1]) < lists.value.probes))
                own = order[row, at]
                keep = n_of[own] > 0
                row, at, own = row[keep], at[keep], own[keep]
                yield pa.RecordBatch.from_pydict({"query_id": column(part, "vec_id").take(pa.array(row)), "q": column(part, "v").take(pa.array(row)), "list": pa.array(own, pa.int32()), "home": home[row, at]})

    return queries.mapInArrow(run, "query_id long, q array<double>, list int, home boolean")


def _survivors(columns: list[np.ndarray], q: np.ndarray, far: float, k: int) -> np.ndarray:
    """Rows of a block that no test abandons: those whose distance to ``q`` (both rotated) may be within the k-th."""
    n, width = len(columns[0]), len(q)
    if far == np.inf and n > 4 * k:  # a first bound from some of the rows, scanned whole
        some = sum(((c[: 4 * k] - q[i * COLUMNS : (i + 1) * COLUMNS]) ** 2).sum(1) for i, c in enumerate(columns))
        far = np.partition(some, k)[k]  # one more than k, as the query itself may be among them
    alive, part = np.arange(n), np.zeros(n)
    for i, c in enumerate(columns):
        part = part + ((c[alive] - q[i * COLUMNS : (i + 1) * COLUMNS]) ** 2).sum(1)
        d = (i + 1) * COLUMNS
        slack = 1 + 1e-5 if d == width else (1 + DEVIATIONS / np.sqrt(d)) ** 2
        stay = part * (width / d) <= far * slack + 1e-9
        alive, part = alive[stay], part[stay]
    return alive


def scan(index: DataFrame, probes: DataFrame, sizes: dict[int, int], lists: Broadcast, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each probe (query_id, q, list, far) the k best of each block of its list that come within ``far``.

    A list's queries are cut into parts, and each part meets each block in a group of its
    own, of bounded size whatever the list holds.
    """
    counts = dict(probes.groupBy("list").agg(F.count(F.lit(1))).collect())
    blocks, chunks = _per_list(index, sizes, BLOCK, "blocks"), _per_list(index, counts, QUERIES, "chunks")
    asked = probes.join(F.broadcast(blocks), "list").join(F.broadcast(chunks), "list")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = index.join(F.broadcast(chunks), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        for row in block.select(["ids", "vectors", "columns"]).to_pylist() if queries.num_rows else ():
            ids = np.frombuffer(row["ids"], np.int64)
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
            columns = [np.frombuffer(c, np.float32).reshape(len(ids), -1) for c in row["columns"]]
            batch = queries.combine_chunks().to_batches()[0]
            q = _matrix(batch, "q")
            turned = lists.value.rotated(np.column_stack([q, np.zeros(len(q))])).astype(np.float32)
            for i, (own, far) in enumerate(zip(column(batch, "query_id").to_pylist(), column(batch, "far").to_pylist(), strict=True)):
                rows = _survivors(columns, turned[i], far, k)
                rows = rows[ids[rows] != own]
                score = (vectors[rows] * q[i]).sum(1)
                best = np.lexsort((ids[rows], -score))[:k]
                out["query_id"].append(np.full(len(best), own))
                out["vec_id"].append(ids[rows][best])
                out["score"].append(score[best])
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.float64() if n == "score" else pa.int64()) for n, x in out.items()})

    key = ["list", "block", "chunk"]
    return held.select(*key, "ids", "vectors", "columns").groupBy(*key).cogroup(asked.select(*key, "query_id", "q", "far").groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by inner product of each row whose vec_id ``every`` divides, itself left out.

    Of equal scores the smaller vec_id comes first. Where there are k other rows or more
    a query gets k, else all of them. Which rows take part: :func:`usable`. An empty table
    gives an empty result; other columns play no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    if rows.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    fitted = fit(rows)
    share = spark.sparkContext.broadcast
    placed = cut(in_lists(rows, share(fitted)))
    queries = rows.filter(F.col("vec_id") % every == 0)
    fitted.probes = measured_probes(placed, queries, fitted, k)
    lists = share(fitted)
    sizes = dict(placed.groupBy("list").agg(F.count(F.lit(1))).collect())
    index = cut(pack(placed, sizes, lists))
    probes = cut(probed(queries, lists, sizes, k))
    home = cut(_best(scan(index, probes.filter("home").withColumn("far", F.lit(float("inf"))), sizes, lists, k), k))
    # the k-th distance so far: |q|^2 + norm^2 - 2 score
    kth = home.filter(F.col("rank") == k).select("query_id", F.col("score").alias("__kth"))
    own = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    away = probes.filter("NOT home").join(kth, "query_id", "left").withColumn("far", F.coalesce(own + fitted.norm2 - 2 * F.col("__kth"), F.lit(float("inf"))))
    found = home.drop("rank").unionByName(scan(index, cut(away.select("query_id", "q", "list", "far")), sizes, lists, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> float:
    """The share of the exact neighbours, by brute force over the usable rows, that ``found`` has; for tables of a size that allows it."""
    rows = usable(vectors)
    q = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    exact = _best(rows.join(F.broadcast(q), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", score.alias("score")), k)
    wanted = exact.select("query_id", "vec_id")
    return wanted.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / max(1, wanted.count())
