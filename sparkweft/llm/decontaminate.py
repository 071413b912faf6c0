"""Benchmark decontamination: containment search by MinHash, native DataFrame operations only.

A test item of n distinct shingles that stands in a document with a containment of at
least t shares at least ceil(t*n) of them, so at least one of its n - ceil(t*n) + 1
shingles of smallest hash. These minima are the item's MinHash signature. Items are
partitioned by size (powers of two); a partition's signatures are as long as its sizes
ask for, and only documents with enough shingles for the partition's smallest item are
searched in it. The documents' shingles are looked up among the signatures alone; each
hit makes a candidate (document, item), and the candidates' full shingle sets are then
fetched and compared exactly. (Bands of document signatures can't do this search: 30
shingles in a document of 20,000 have a Jaccard index near 0.001.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut

WORDS = 5
CONTAINMENT = 0.75
#: Rows (about 60 bytes each in memory) up to which the items' side of a join is broadcast; beyond it both sides are shuffled.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """Lower-case words of a text (by SQL's ``lower``, as in the twin); null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+"), lambda w: w != "")


def row_key(df: DataFrame) -> Column:
    """A key of a document's row: rows that repeat a doc_id with another text, or have none, are told apart."""
    return F.xxhash64(df["doc_id"], df["text"])


def with_words(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, w): the words as a column of their own, so that lambdas read them and don't split again."""
    return df.select(*keys, words(F.col("text")).alias("w"))


def shingle_hashes(w: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the n-word shingles; none where there are fewer words."""
    full = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, full).otherwise(F.array().cast("array<bigint>"))


def signature_size(n: Column, containment: float = CONTAINMENT) -> Column:
    """Minima that an item of n shingles keeps: one more than it may miss."""
    return n - F.ceil(n * F.lit(containment) - F.lit(1e-9)) + 1


def size_class(n: Column) -> Column:
    """The power of two at or above a number of shingles."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")


def item_sets(items: DataFrame) -> DataFrame:
    """(item_id, width, s, n_item, size_class): the items' distinct shingles by hash; an item shorter than WORDS is one shingle of all its words."""
    width = F.least(F.size("w"), F.lit(WORDS))
    own = F.array().cast("array<bigint>")
    for k in range(1, WORDS + 1):
        own = F.when(width == k, shingle_hashes(F.col("w"), k)).otherwise(own)
    # an id with several texts is one item, of the shingles of all of them
    merged = with_words(items.filter("item_id IS NOT NULL"), "item_id").select("item_id", width.alias("width"), F.explode(own).alias("h")).groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("s"), F.collect_set("width").alias("width"))
    n = F.size("s").cast("long")
    return merged.select("item_id", "width", "s", n.alias("n_item"), size_class(n).alias("size_class"))


def signatures(sets: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(h, item_id, least): each item's minima, with the shingles that a document needs for the smallest item of its size class."""
    kept = F.slice("s", F.lit(1), signature_size(F.col("n_item"), containment).cast("int"))
    least = F.ceil((F.col("size_class") / 2).cast("double") * F.lit(containment))  # an item of the class has more than half of it
    return sets.select("item_id", F.greatest(F.lit(1), least).alias("least"), F.explode(kept).alias("h"))


def document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(row, doc_id, n_doc, h): the shingles of all widths that the items have; n_doc counts them with repeats."""
    every = F.concat(*[shingle_hashes(F.col("w"), k) for k in widths])
    n = sum((F.greatest(F.lit(0), F.size("w") - k + 1) for k in widths), F.lit(0))
    # the words stay behind the explode, which takes the expression itself: of a column Spark would infer a filter and push it below the words, and split them for every shingle
    counted = with_words(docs, "row", "doc_id").select("row", "doc_id", "w", n.alias("n_doc"))
    return counted.select("row", "doc_id", "n_doc", F.explode(every).alias("h"))


def candidates(docs: DataFrame, sets: DataFrame, widths: list[int], containment: float = CONTAINMENT) -> DataFrame:
    """(row, doc_id, item_id): the documents that hold a minimum of the item and are large enough for its size class."""
    minima = cut(signatures(sets, containment))
    if minima.count() <= BROADCAST_SHINGLES:
        minima = F.broadcast(minima)
    return document_shingles(docs, widths).join(minima, "h").filter("n_doc >= least").select("row", "doc_id", "item_id").distinct()


def contained_rows(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(row, doc_id, item_id, size_class, n_item, n_found) of documents (row, doc_id, text)."""
    sets = cut(item_sets(items))
    widths = sorted(r[0] for r in sets.select(F.explode("width")).distinct().collect()) or [WORDS]  # five at most
    found = cut(candidates(docs, sets, widths, containment))
    # the candidates' sets: the items' shingles on one side, those of the documents that are any item's on the other
    wanted = found.join(sets.select("item_id", "n_item", "size_class", F.explode("s").alias("h")), "item_id")
    some, known = found.select("row").distinct(), sets.select(F.explode("s").alias("h")).distinct()
    if some.count() <= BROADCAST_SHINGLES:
        some = F.broadcast(some)
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    held = document_shingles(docs.join(some, "row", "left_semi"), widths).join(known, "h", "left_semi").select("row", "h").distinct()
    pairs = wanted.join(held, ["row", "h"]).groupBy("row", "doc_id", "item_id", "size_class", "n_item").agg(F.count(F.lit(1)).alias("n_found"))
    return pairs.filter(F.col("n_found") >= F.ceil(F.col("n_item") * F.lit(containment) - F.lit(1e-9)))


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, size_class, n_item, n_found, containment): items that a document holds.

    A pair is a candidate if a minimum of the item stands in the document, and stays
    if the document holds at least ``containment`` of the item's distinct shingles of
    five words. An item of fewer words is one shingle of its own length, found wherever
    these words follow one another. Items without words match nothing. Null texts have
    no words. Items with ids of their own give pairs of their own; rows that repeat an
    item's id count as one item with the shingles of all of them, rows that repeat a
    doc_id go by their own text and the one that holds most counts; rows without an id
    give no pairs. A very long text, or one unbroken word, is one row of its task. Empty
    tables give no pairs. Other columns are left out, whatever their names.
    """
    known = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    rows = contained_rows(known.withColumn("row", row_key(known)), items, containment)
    ids = rows.groupBy("doc_id", "item_id", "size_class", "n_item").agg(F.max("n_found").alias("n_found"))
    return ids.withColumn("containment", F.round(F.col("n_found") / F.col("n_item"), 6))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item, with all their columns; every row goes by its own text, with a doc_id or not."""
    bad = contained_rows(docs.select(row_key(docs).alias("row"), "doc_id", "text"), items, containment).select(F.col("row").alias("__bad")).distinct()
    return docs.join(bad, row_key(docs) == F.col("__bad"), "left_anti")


#: The same pairs in plain SQL (DuckDB), by all shingles of all items.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p+k-1], ' '))) AS s FROM w, k WHERE len(w) >= k),
it AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p:p+least(5, len(w))-1], ' '))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM it GROUP BY item_id),
f AS (SELECT ds.doc_id, it.item_id, count(DISTINCT ds.s) AS n_found FROM ds JOIN it USING (s) GROUP BY ALL)
SELECT f.doc_id, f.item_id, CAST(pow(2, ceil(log2(n.n_item))) AS BIGINT) AS size_class, n.n_item, f.n_found,
       round(CAST(f.n_found AS DOUBLE) / n.n_item, 6) AS containment
FROM f JOIN n USING (item_id) WHERE 100 * f.n_found >= 75 * n.n_item
"""
