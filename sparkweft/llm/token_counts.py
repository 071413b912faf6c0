"""Token counts: the exact histogram of encoded lengths.

Documents are encoded whole, in tasks, by a public tokenizer; documents of equal
length are counted (partially aggregated, so one row per length and task is
shuffled); suffix sums over the lengths then answer, for every context limit, how
many documents are longer, how many tokens a cut at the limit keeps, and quantiles.
The suffix sums go in two steps, within and between blocks of lengths, so that no
task holds all lengths.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, column, cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's split pattern (fixed value, from the tokenizers' description).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
#: The white space of the pattern, where it stands in runs that its matcher, which goes back over a run step by step, has no stack for.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file; special tokens' strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(encoding, text: str | None) -> int:
    """Tokens of a whole text, however long.

    A run of white space is one piece of the pattern at the end of a text; before
    something else its last character belongs to what follows. Long runs are encoded as
    the piece that they are, and what stands between them by the pattern: the pieces, and
    so the tokens, are those of the whole text.
    """
    n, start = 0, 0
    for run in LONG_SPACE.finditer(text or ""):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[start : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        start = end
    return n + len(encoding.encode_ordinary(text[start:])) if text else 0


def shipped(docs: DataFrame, folder: str, vocabulary: str) -> str:
    """Send the rank file to all executors with the job; returns the name by which tasks find it."""
    docs.sparkSession.sparkContext.addFile(f"{folder}/{vocabulary}")
    return vocabulary


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every whole text, however long, encoded in one piece; null is empty and has 0 tokens."""
    path = shipped(docs, folder, vocabulary)

    def step(batch: pa.RecordBatch) -> dict:
        encoding = encoder(SparkFiles.get(path))
        return {"doc_id": column(batch, "doc_id"), "n_tokens": pa.array([token_count(encoding, t) for t in column(batch, "text").to_pylist()], pa.int64())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, n_tokens long")


def lengths(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n): partial counts of encoded lengths, one row for each length and slice."""
    path = shipped(docs, folder, vocabulary)

    def step(batch: pa.RecordBatch) -> dict:
        encoding = encoder(SparkFiles.get(path))
        c = Counter(token_count(encoding, t) for t in column(batch, "text").to_pylist())
        return {"n_tokens": pa.array(list(c), pa.int64()), "n": pa.array(list(c.values()), pa.int64())}

    return arrow_map(docs.select("text"), step, "n_tokens long, n long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """From (n_tokens, n): one row for each length L that occurs.

    n_docs: documents of length L; docs_from, tokens_from: documents of length L or
    more and their tokens; docs_total, tokens_total: of all; tokens_cut: tokens left if
    every document is cut at L; share_up_to: share of documents of length L or less
    (the smallest L with share_up_to >= q is the q-quantile). Limits between two
    lengths follow from the row of the next length L above the limit: tokens_total -
    tokens_from + limit * docs_from. An empty table gives an empty result.
    """
    # read twice below: the texts are encoded once, and a row per length is kept
    h = cut(counts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    own = h.withColumn("d", F.sum("n_docs").over(down)).withColumn("t", F.sum(F.col("n_docs") * F.col("n_tokens")).over(down))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each BLOCK lengths
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.select(
        "block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("bd", "bt")), *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("bd", "bt"))
    )
    docs_from, tokens_from = F.col("d") + F.col("bd_above"), F.col("t") + F.col("bt_above")
    return own.join(sums, "block").select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        F.col("bd_all").alias("docs_total"), F.col("bt_all").alias("tokens_total"),
        (F.col("bt_all") - tokens_from + F.col("n_tokens") * docs_from).alias("tokens_cut"),
        F.round((F.col("bd_all") - docs_from + F.col("n_docs")) / F.col("bd_all"), 9).alias("share_up_to"),
    )


def token_histogram(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`length_histogram` of the documents. Null and empty texts have length 0; a very long text, of white space too, is one row of its task; repeated rows count each, rows without doc_id too."""
    return length_histogram(lengths(docs, folder, vocabulary))


def quantiles(histogram: DataFrame, qs: list[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least a share q of the documents doesn't exceed."""
    picks = [F.min(F.when(F.col("share_up_to") >= q - 1e-9, F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(qs)]
    one = histogram.agg(*picks)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"`{i}`").alias("n_tokens")) for i, q in enumerate(qs)])).alias("x")).select("x.*")
