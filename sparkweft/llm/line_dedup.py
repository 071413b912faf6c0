"""Line dedup: hash every line's key, count the documents that hold it, drop what is too common.

The lines of each document are hashed (128 bits) in an Arrow map step. The distinct
documents of each key are counted in two steps, by (key, document) and then, partially
aggregated, by key, so a key that stands in a third of all documents reaches its
reducer as one row per task. The keys to drop are counted; up to BROADCAST_KEYS they
are broadcast, so that no line is shuffled again, beyond that they are joined by
shuffling (AQE splits a hot key). The drops are then joined to the documents once and
each document is put together again from its own lines, in place.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, arrow_map, column, cut, texts

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys up to which the table of common lines is broadcast (40 bytes each).
BROADCAST_KEYS = 250_000


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of a line's key, None where the key is shorter than ``min_chars`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key): the distinct long keys of every document."""

    def step(batch: pa.RecordBatch) -> dict | None:
        ids, keys = [], []
        for i, text in zip(column(batch, "doc_id").to_pylist(), texts(batch), strict=True):
            if len(text) >= min_chars:
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                ids += [i] * len(own)
                keys += own
        return {"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, key binary")


def common_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs, keeper): keys in at least ``min_docs`` different documents; keeper is the largest doc_id."""
    return keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def line_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, drop): the keys that each document loses."""
    keys = line_keys(docs, min_chars).filter("doc_id IS NOT NULL")
    common = cut(common_lines(keys, min_docs).select("key", "keeper"))
    if common.count() <= BROADCAST_KEYS:
        common = F.broadcast(common)
    lost = keys.join(common, "key").filter(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines that many documents share; returns doc_id, n_lines, n_dropped, kept_text.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    loses all its lines but those of the largest doc_id that holds it. Null or empty
    text: one empty line, kept. Rows that repeat a doc_id count as one document, which
    holds the lines of all of them, and lose lines alike; a row without doc_id counts
    for no key and stays as it is. A very long line is one key, hashed whole; a very
    long text is one row of its task. An empty table gives an empty result. Other
    columns are left out, whatever their names.
    """
    drops = line_drops(docs, min_chars, min_docs)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(drops.hint("shuffle_hash"), "doc_id", "left")

    def step(batch: pa.RecordBatch) -> dict:
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(texts(batch), column(batch, "drop").to_pylist(), strict=True):
            if drop:
                lines, gone = text.split(b"\n"), set(drop)
                rest = [x for x in lines if line_key(x, min_chars) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(rest))
                kept.append(b"\n".join(rest))
            else:
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                kept.append(text)
        return {
            "doc_id": column(batch, "doc_id"),
            "n_lines": pa.array(n_lines, pa.int64()),
            "n_dropped": pa.array(n_dropped, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    return arrow_map(joined, step, "doc_id long, n_lines long, n_dropped long, kept_text string")


def line_digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """:func:`line_dedup` with the kept text as a digest."""
    return line_dedup(docs, min_chars, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with all their columns, common lines dropped from ``text``; ``n_chars`` follows where there is one.

    Only documents that lose a line change; a null text stays null.
    """
    drops = line_drops(docs, min_chars, min_docs).select(F.col("doc_id").alias("__id"), "drop").hint("shuffle_hash")
    joined = docs.join(drops.withColumnRenamed("drop", "__drop"), F.col("doc_id").cast("long") == F.col("__id"), "left")

    @F.arrow_udf("string")
    def kept(text: pa.Array, drop: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(text.cast(pa.binary()).to_pylist(), drop.to_pylist(), strict=True):
            gone = set(d or ())
            out.append(b"\n".join(x for x in t.split(b"\n") if line_key(x, min_chars) not in gone) if t and gone else t)
        return pa.array(out, pa.binary()).cast(pa.string())

    new = joined.withColumn("__text", kept("text", "__drop"))
    changed = {"text": F.col("__text")} | ({"n_chars": F.when(F.col("__drop").isNull(), docs["n_chars"]).otherwise(F.length("__text"))} if "n_chars" in docs.columns else {})
    return new.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


def reference(rows: list[tuple[int, str | None]], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> dict[int, tuple[int, int, str]]:
    """Brute force for tests: {doc_id: (n_lines, n_dropped, sha256)}."""
    held: dict[bytes, set[int]] = {}
    for i, text in rows:
        for line in (text or "").encode().split(b"\n"):
            held.setdefault(line.strip(SPACE).lower(), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x in lines if len((k := x.strip(SPACE).lower()).decode()) < min_chars or len(held[k]) < min_docs or max(held[k]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


#: The same digest in plain SQL (DuckDB).
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NULL OR c.keeper = k.doc_id AS stays FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
