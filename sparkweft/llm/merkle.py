"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line; its leaves are pieces that end after each space, whatever the
paragraph's length, so that an edit changes the pieces it touches and no others.
A paragraph's hash covers its pieces, a section's its paragraphs, the root's the
sections. A section ends at a blank line, before a heading (``#``), or after a
paragraph whose hash says so. Equal roots mean equal texts; from unequal roots the
comparison goes down only into the branches that differ, which locates the edits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, parts, slices

#: One paragraph in so many ends a section.
SECTION = 8
#: Ranges of ids for each shuffle partition; rows of one id (or of none) from which its range is split by the texts' hashes.
RANGES, SPLIT = 4, 20_000


@dataclass
class Tree:
    """A text's tree: hashes by level, and for each node the span of its children."""

    root: str
    sections: list[bytes]
    section_ends: list[int]  # in paragraphs
    paragraphs: list[bytes]
    paragraph_ends: list[int]  # in pieces
    pieces: list[int]
    sizes: list[int]  # bytes of each piece


def piece_ends(line: bytes) -> list[int]:
    """Where the pieces of a paragraph end."""
    out = (np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1).tolist()
    return out if out and out[-1] == len(line) else [*out, len(line)]


def tree(text: str | None) -> Tree:
    """Build the tree of a text; null is the empty text, one empty paragraph."""
    sections, section_ends, paragraphs, paragraph_ends, pieces, sizes = [], [], [], [], [], []
    digest, first = xxhash.xxh3_128_digest, 0

    def close() -> None:
        nonlocal first
        if len(paragraphs) > first:
            sections.append(digest(b"".join(paragraphs[first:])))
            section_ends.append(len(paragraphs))
            first = len(paragraphs)

    for line in (text or "").encode().split(b"\n"):
        if line[:1] == b"#":
            close()
        start, own = 0, []
        for end in piece_ends(line):
            own.append(xxhash.xxh3_64_intdigest(line[start:end]))
            sizes.append(end - start)
            start = end
        pieces += own
        paragraphs.append(h := hashlib.blake2b(line, digest_size=16).digest())
        paragraph_ends.append(len(pieces))
        if not line.strip() or h[0] % SECTION == 0:
            close()
    close()
    # paragraphs and root are cryptographic hashes: equality of texts rests on them
    node = hashlib.sha256(b"\x02")
    for s, e0, e1 in zip(sections, [0, *section_ends], section_ends, strict=False):
        node.update(hashlib.blake2b(s + b"".join(paragraphs[e0:e1]), digest_size=16).digest())
    return Tree(node.hexdigest(), sections, section_ends, paragraphs, paragraph_ends, pieces, sizes)


def _unmatched(a: list[bytes], b: list[bytes]) -> tuple[list[int], list[int]]:
    """Positions of the nodes of either list that the other doesn't have, as multisets."""
    have = Counter(b)
    rest_a = []
    for i, h in enumerate(a):
        if have[h] > 0:
            have[h] -= 1
        else:
            rest_a.append(i)
    rest_b = []
    for i in range(len(b) - 1, -1, -1):
        if have[b[i]] > 0:
            have[b[i]] -= 1
            rest_b.append(i)
    return rest_a, rest_b[::-1]


def _children(nodes: list[int], ends: list[int]) -> list[int]:
    return [c for i in nodes for c in range(ends[i - 1] if i else 0, ends[i])]


def likeness(a: Tree, b: Tree) -> tuple[float, list[int], list[int]]:
    """Likeness of two trees (0 to 1) and the paragraphs of either that differ.

    The likeness is the share of bytes in matching pieces, twice the matches over
    both texts' bytes. Branches with equal hashes match as wholes.
    """
    if a.root == b.root:
        return 1.0, [], []
    sec_a, sec_b = _unmatched(a.sections, b.sections)
    in_a, in_b = _children(sec_a, a.section_ends), _children(sec_b, b.section_ends)
    par_a, par_b = _unmatched([a.paragraphs[i] for i in in_a], [b.paragraphs[i] for i in in_b])
    par_a, par_b = [in_a[i] for i in par_a], [in_b[i] for i in par_b]
    left_a, left_b = _children(par_a, a.paragraph_ends), _children(par_b, b.paragraph_ends)
    size_a, size_b = sum(a.sizes), sum(b.sizes)
    gone_a, gone_b = sum(a.sizes[i] for i in left_a), sum(b.sizes[i] for i in left_b)
    have, matched = Counter(b.pieces[i] for i in left_b), 0
    for i in left_a:
        if have[a.pieces[i]] > 0:
            have[a.pieces[i]] -= 1
            matched += a.sizes[i]
    same = (size_a - gone_a) + (size_b - gone_b) + 2 * matched
    return min(1.0, same / (size_a + size_b)) if size_a + size_b else 1.0, par_a, par_b


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points (or all) of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """(grp, pos, doc_id, h, text): ranges of ascending ids, each followed by a copy of the next range's first row.

    The ranges' borders are quantiles of the ids, as many as the session's shuffle
    partitions ask for; only these and each range's count and ends reach the driver. An
    id that holds many rows is a range of its own, split by the hash ``h`` of the texts,
    and so are the rows without an id, which come last. The last row is followed by the
    first one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    n = RANGES * parts(docs)
    quantiles = {int(q) for q in rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (2 * n))}
    borders = np.array(sorted(quantiles | {q + 1 for q in quantiles}), np.int64)

    def base(ids: pa.Array) -> np.ndarray:  # rows without an id form a range of their own after all others
        at = np.searchsorted(borders, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(borders) + 1, at)

    @F.arrow_udf("int")
    def base_of(ids: pa.Array) -> pa.Array:
        return pa.array(base(ids), pa.int32())

    ends = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy(base_of("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
    pieces = np.ones(len(borders) + 2, np.int64)
    for r in ends:
        if r["lo"] == r["hi"]:
            pieces[r["b"]] = -(-r["n"] // SPLIT)
    start = np.concatenate([[0], np.cumsum(pieces)])

    def group(ids: pa.Array, h: pa.Array) -> np.ndarray:
        b = base(ids)
        share = h.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5
        return start[b] + np.minimum((share * pieces[b]).astype(np.int64), pieces[b] - 1)

    @F.arrow_udf("int")
    def group_of(ids: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(group(ids, h), pa.int32())

    # a range's first row also follows the range before it, the very first row the last one
    firsts = [(int(start[r["b"]]), r["lo"], None) for r in ends if pieces[r["b"]] == 1]
    if split := [r["b"] for r in ends if pieces[r["b"]] > 1]:
        some = rows.filter(base_of("doc_id").isin(split)).groupBy(group_of("doc_id", "h").alias("grp"), "doc_id").agg(F.min("h").alias("h")).collect()
        firsts += [(r["grp"], r["doc_id"], r["h"]) for r in some]
    firsts.sort(key=lambda x: x[0])
    goes_to = {(i, h): firsts[k - 1][0] for k, (_, i, h) in enumerate(firsts)}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for g, i, x in zip(group(ids, h).tolist(), ids.to_pylist(), h.to_pylist(), strict=True):
            to = goes_to.get((i, None), goes_to.get((i, x)))
            out.append([g] if to is None else [g, to])
        return pa.array(out, pa.list_(pa.int32()))

    return rows.select("doc_id", "h", "text", F.posexplode(places("doc_id", "h")).alias("pos", "grp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text and the next one, ascending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs, edited_paragraphs (positions in the text of
    the paragraphs that the edit touched). Null is the empty text. Rows that repeat a
    doc_id follow each other by the hash of the text, then by text; rows without doc_id
    come last, by the same order. A single row is its own next. Two empty texts have
    likeness 1. A very long text, line or word is one row of its task. An empty table
    gives an empty result. Other columns are left out, whatever their names.
    """
    rows = with_next(docs).repartition(parts(docs) * 2, "grp").sortWithinPartitions("grp", "pos", F.col("doc_id").isNull(), "doc_id", "h", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs", "edited_paragraphs"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32())]

    def row(i, text: str, own: Tree, following: str, then: Tree) -> tuple:
        edit = edited_text(text, following)
        changed = tree(edit)
        near, touched, _ = likeness(own, changed)
        return (i, len(text), hashlib.sha256(edit.encode()).hexdigest(), own.root, changed.root, near, likeness(own, then)[0], len(own.paragraphs), touched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (grp, doc_id, text, tree) of the row that waits for its next one
        closed = None  # the range whose copy of the next row was seen
        for big in batches:
            for batch in slices(big):
                out = []
                for grp, pos, i, text in zip(*(column(batch, k).to_pylist() for k in ("grp", "pos", "doc_id", "text")), strict=True):
                    if closed == grp:
                        continue
                    text = text or ""
                    t = tree(text)
                    if last is not None and last[0] == grp:
                        out.append(row(last[1], last[2], last[3], text, t))
                    last = (grp, i, text, t) if pos == 0 else None
                    closed = grp if pos == 1 else None
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, edited_paragraphs array<int>"
    return rows.mapInArrow(run, schema)
